"""Column expressions over text: normalisation, tokens, n-grams, rules, templated fields."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented() -> tuple[str, str]:
    """Every code point whose canonical decomposition is an ASCII letter with marks, and that letter."""
    made = {}
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(parts) > 1 and len(base) == 1 and base[0].isascii() and base[0].isalnum():
            made[chr(code)] = base[0].lower()
    return "".join(made), "".join(made.values())


_FROM, _TO = _accented()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often the body names it.

    A lambda's variable is bound to a value; a column that is named twice may be computed twice, or, inside
    ``transform``, once for each element.
    """
    return F.transform(F.array(value), body)[0]


def normalised(text: Column) -> Column:
    """Lower case without accents; every run of other than a-z and 0-9 is one space; trimmed.  Null stays null.

    Letters without a decomposition (the German sharp s) separate words.
    """
    bare = F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(bare, "[^0-9a-z]+", " "))


def folded(text: Column) -> Column:
    """Lower case without accents, white space collapsed: the form evidence patterns are matched against."""
    bare = F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " "))


def tokens(norm: Column) -> Column:
    """Words of a normalised text; none for an empty or null one."""
    return F.filter(F.split(F.coalesce(norm, F.lit("")), " "), lambda w: w != "")


def grams(words: Column, n: int = 8) -> Column:
    """All runs of n words, joined by spaces, repeats included; none for fewer words."""
    none = F.array().cast("array<string>")

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)

    return let(words, runs)


def hashed_run(words: Column, n: int = 8) -> Column:
    """Hashes of all runs of n words, in order; none for fewer words.  Equal runs have equal hashes."""
    none = F.array().cast("array<bigint>")

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        return F.when(F.size(h) >= n, F.transform(at, lambda i: F.xxhash64(*[h[i + k] for k in range(n)]))).otherwise(none)

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def distinct_grams(words: Column, n: int = 8) -> Column:
    """How many different runs of n words there are.

    Hashes that all differ stand for runs that all differ; only where two are equal are the runs themselves compared.
    """
    whole = lambda w: F.size(F.array_distinct(grams(w, n)))
    counted = lambda w: let(hashed_run(w, n), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.size(h)).otherwise(whole(w)))
    return let(words, counted)


def title_and_abstract(state: Column) -> Column:
    """'Title: ...' line and the text after 'Abstract:', joined by a space; the whole state where either is missing."""
    title = F.regexp_extract(state, r"(?m)^Title: (.*)$", 1)
    abstract = F.regexp_extract(state, r"(?s)Abstract: (.*)\z", 1)
    return F.when((title != "") & (abstract != ""), F.concat_ws(" ", title, abstract)).otherwise(state)


def rewritten(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Applies (required pattern, pattern, replacement) in order, each only where its required pattern is found."""
    for required, pattern, replacement in rules:
        text = F.when(text.rlike(required), F.regexp_replace(text, pattern, replacement)).otherwise(text)
    return text


def fired(text: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules all of whose patterns are found, in the order of ``rules``."""
    hits = []
    for name, patterns in rules.items():
        found = F.lit(True)
        for pattern in patterns:
            found = found & text.rlike(pattern)
        hits.append(F.when(found, F.lit(name)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def hex_modulo_10(digest: Column) -> Column:
    """A hex digest's number modulo 10, without big integers: every power of 16 above the first is 6 modulo 10."""
    digit = lambda d, i: F.conv(F.substring(d, i, F.lit(1)), 16, 10).cast("int")

    def modulo(d: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + digit(d, i))
        last = digit(d, F.length(d))
        return (last + 6 * (total - last)) % 10

    return let(digest, modulo)
