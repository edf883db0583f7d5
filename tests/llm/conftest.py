import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, hash string, kept string, score double, rate int, raw_hash string, label string, norm string"
EN = "the and of to in that is was for with on as this from they are have one all which".split()
DE = "der die und das nicht ist ein zu mit sich auf auch den dem eine als wird noch nach bei".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "en", "er", "ly", "ung"]) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, "h", "k", 0.5, 3, "r", "l", "n")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies but for white space, odd characters."""
    rng = random.Random(1)
    long = prose(rng, EN, 30_000)
    rows = [row(i, prose(rng, EN if i % 2 else DE, rng.randrange(1, 80)), "en" if i % 2 else "de", "ab"[i % 2]) for i in range(10, 60)]
    copy = rows[3][1]
    rows += [row(1, None), row(2, ""), row(3, " \n\t "), row(4, long), row(5, long.replace(" ", "\n")), row(6, copy), row(7, copy.replace(" ", "  ")), row(None, copy), row(None, "no id", None, None)]
    rows += [row(8, "twice the same row"), row(8, "twice the same row"), row(8, "same id, other text"), row(9, "… ¡¿ 123 456 !!! 🙂"), row(61, "Ça\x0bva\x0cbien\r\n<|endoftext|> a   b\t\tc  ")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
