"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tokens.  Words score positive and tags negative; a linear scan finds the contiguous region of
greatest total, and the text of that region is the answer.  How much each kind of token scores is learned from labelled
pages: those that mark their own content with ``<article>`` or ``<main>`` tell which kinds stand inside and which outside.
A prior of a few tags of each kind speaks for kinds that labelled pages don't show.

Subtrees that are menus, headers, footers, sidebars, notices, adverts, forms or comments by their element, role, class or
id are one token each, with a negative score, and their words are never put out.  A class or id only counts if all parts of
the name say so or say nothing (``ad-box``, but not ``notice-period`` or ``has-sidebar``), and not for a wrapper of the
page's whole content.

One page is one call of a small parser, linear in the page's length; Spark deals out the pages.  There is no shuffle, and
nothing is cut.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled pages that the weights are learned from, about: a hash of the page id picks them.
LABELLED_PAGES = 500

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"<]*\"|'[^'<]*'|\"[^\">]*\"|'[^'>]*'|[^'\"<>])*+|[^<>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and no text of the page; it ends at their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym annotation b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msubsup msup mtext object picture q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
CONTENT = frozenset(("article", "main"))
#: Elements that are no content wherever they stand; a header may open an article, a footer never belongs to it.
BOILERPLATE = frozenset("nav footer aside select button dialog menu head svg template annotation".split())
#: Elements that are no content unless they wrap the page's.
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
HINTS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs consent cookie cookies footer gdpr hidden login masthead "
    "menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion recommended related share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Parts of a name that say nothing for or against.
NEUTRAL = frozenset(
    "area bar block bottom box btn button buttons col column container content form global group holder icons id inner item items js left link links list main "
    "message module outer overlay page panel primary right row secondary section shadow site slot text thread title top unit widgets wrap wrapper".split()
)
#: Ends of names such as "subnav" or "sitefooter".
ENDINGS = ("nav", "footer", "sidebar", "banner", "menu", "comments", "advert")
#: A class such as "page-header" is no content outside an article, and may hold its title inside.
OUTER_HINTS = frozenset("header topbar".split())
#: A wrapper holds at least this share of a page's unlinked words.
WRAPPER = 0.85
#: An open element that a start tag of the key ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that a search for what a start tag ends does not pass, and how far up it and an inline end tag look.
BARRIERS, UP = frozenset("article aside body div footer form header html main nav section table ul ol dl".split()), 32
#: The prior: tags of each kind that were seen inside and outside of content before any page.
PRIOR = (
    (18, 2, "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th b i em strong span br figure figcaption blockquote pre code hr img math sub sup header".split()),
    (18, 2, ["inline"]),  # all other inline elements
    (16, 4, "a section cite q small time".split()),
    (14, 6, "div other".split()),
    (10, 10, "body html label".split()),
    (1, 19, "article main form input option".split()),
)
KINDS = frozenset(k for _, _, kinds in PRIOR for k in kinds)


def tag_score(inside: float, outside: float) -> float:
    """A tag costs little if its kind stands inside of content, and much if it stands outside."""
    return -0.05 - 12 * (outside / (inside + outside)) ** 2


@dataclass
class Weights:
    """Scores: a word's, a linked word's, that of a whole subtree of noise, and a tag's by kind (``/p`` is an end tag)."""

    word: float = 1.0
    linked: float = 0.1
    noise: float = -0.5
    tags: dict[str, float] = field(default_factory=lambda: {e + k: tag_score(a, b) for a, b, kinds in PRIOR for k in kinds for e in ("", "/")})

    def of(self, token: Token) -> float:
        if token[1]:
            return token[1] * (self.linked if token[0] == "linked" else self.word)
        return self.noise if token[0] == "noise" else self.tags[token[0]]


#: (kind, words, block, node, inside): "word", "linked", "noise" for the start of a noise subtree, or the tag's kind; the
#: block of a text or -1; the innermost subtree that may be noise, or -1; whether an article or main element is open.
Token = tuple[str, int, int, int, bool]


class _Node:
    """A subtree that may be noise: the one around it, whether it can be a wrapper, its unlinked words and content elements."""

    __slots__ = ("above", "may_wrap", "words", "contents", "noise")

    def __init__(self, above: int, may_wrap: bool):
        self.above, self.may_wrap, self.words, self.contents, self.noise = above, may_wrap, 0, 0, True


def _name_hints(names: str, hints: frozenset[str], endings: tuple[str, ...] = ENDINGS) -> bool:
    """True if one of the names says that it is noise: a part that is a hint, and no part that says something else."""
    for name in names.split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        told = [p in hints or p.endswith(endings) for p in parts]
        if any(told) and all(t or p in NEUTRAL for p, t in zip(parts, told, strict=True)):
            return True
    return False


def _noise(name: str, attributes: str, in_content: bool) -> str:
    """"" for no noise, "wrap" for noise unless it wraps the page's content, "noise" otherwise."""
    if name in BOILERPLATE or (name == "header" and not in_content):
        return "noise"
    found = "wrap" if name in FORMS else ""
    if not attributes or name in ("html", "body"):
        return found
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NOT_SHOWN.search(value)):
            return "noise"
        if key == "role" and value.strip().lower() in ROLES:
            return "noise"
        if key in ("class", "id"):
            if _name_hints(value, COMMENTS, ("comments",)):
                return "noise"
            if name not in CONTENT and _name_hints(value, HINTS if in_content else HINTS | OUTER_HINTS):
                found = "wrap"
    return found


def parse(page: str) -> tuple[list[Token], list[str], list[_Node]]:
    """The page's tokens, its blocks' texts and the subtrees that may be noise."""
    tokens: list[Token] = []
    parts: list[list[str]] = []
    nodes: list[_Node] = []
    stack: list[tuple[str, int]] = []  # name, and its own node or -1
    opened: Counter = Counter()
    endless: set[str] = set()  # raw elements that no later end tag closes; "!" if no ">" is left
    node, fresh, at, size = -1, True, 0, len(page)

    def text(piece: str) -> None:
        nonlocal fresh
        n = 0 if not piece or piece.isspace() else len(piece.split())
        if fresh:
            if not n:
                return
            parts.append([])
            fresh = False
        parts[-1].append((piece, node))
        if n:
            linked = opened["a"] > 0
            tokens.append(("linked" if linked else "word", n, len(parts) - 1, node, opened["article"] + opened["main"] > 0))
            if node >= 0 and not linked:
                nodes[node].words += n

    def close(depth: int) -> None:
        nonlocal node, fresh
        while len(stack) > depth:
            name, own = stack.pop()
            opened[name] -= 1
            fresh |= name not in INLINE
            if own >= 0:
                node = nodes[own].above

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            break
        after = page[begin + 1 : begin + 2]
        if after and after in "!?":
            text(page[at:begin])
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = size if end < 0 else end + 3
                continue
            end = -1 if "!" in endless else page.find(">", begin)
            if end < 0:
                endless.add("!")
                text("<")
                at = begin + 1
            else:
                at = end + 1
            continue
        match = _TAG.match(page, begin)
        if not match:
            text(page[at : begin + 1])
            at = begin + 1
            continue
        text(page[at:begin])
        at = match.end()
        ending, name, attributes = bool(match[1]), match[2].lower(), match[3]
        kind = ("/" if ending else "") + (name if name in KINDS else "inline" if name in INLINE else "other")
        block = name not in INLINE and name not in RAW
        fresh |= block
        if name == "br" and not fresh:
            parts[-1].append((" ", node))
        inside = opened["article"] + opened["main"] > 0
        if ending:
            tokens.append((kind, 0, -1, node, inside and name not in CONTENT))
            if opened[name] > 0:
                reach = range(len(stack) - 1, -1, -1) if block else range(len(stack) - 1, max(-1, len(stack) - UP), -1)
                for k in reach:
                    if stack[k][0] == name:
                        close(k)
                        break
                    if not block and stack[k][0] in BARRIERS:
                        break
            continue
        if name in RAW and not attributes.endswith("/"):
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = size
            else:
                endless.add(name)
            continue
        if block and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        for ended in ENDS.get(name, ("p",) if block else ()):
            for k in range(len(stack) - 1, max(-1, len(stack) - UP), -1):
                if stack[k][0] == ended:
                    close(k)
                    break
                if stack[k][0] in BARRIERS:
                    break
        if name in CONTENT and node >= 0:
            nodes[node].contents += 1
        if name not in VOID and not attributes.endswith("/"):
            said, own = _noise(name, attributes, inside), -1
            if said:
                own = len(nodes)
                nodes.append(_Node(node, said == "wrap"))
                node = own
                tokens.append(("noise", 0, -1, own, False))
            stack.append((name, own))
            opened[name] += 1
        tokens.append((kind, 0, -1, node, inside))
    text(page[at:])
    _settle(nodes, tokens)
    blocks = []
    for pieces in parts:
        shown = "".join(p for p, n in pieces if n < 0 or not nodes[n].noise)
        blocks.append(" ".join(entities.unescape(shown).split()))
    return tokens, blocks, nodes


def _settle(nodes: list[_Node], tokens: list[Token]) -> None:
    """Says of each node whether it, or one around it, is noise.  A class, an id or a form is none if its subtree holds all
    of the page's content elements, or, on a page without such, nearly all of its unlinked words."""
    for n in reversed(nodes):  # a node stands after the one around it
        if n.above >= 0:
            nodes[n.above].words += n.words
            nodes[n.above].contents += n.contents
    contents = sum(1 for t in tokens if t[0] in CONTENT)
    words = sum(t[1] for t in tokens if t[0] == "word")
    for n in nodes:
        wraps = n.may_wrap and (n.contents == contents if contents else n.words >= WRAPPER * max(1, words))
        n.noise = not wraps or (n.above >= 0 and nodes[n.above].noise)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last] of the maximum-scoring subsequence by one linear scan; (0, -1) if no score is positive."""
    best, found, total, first = 0.0, (0, -1), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += score
        if total > best:
            best, found = total, (first, k)
    return found


def _of_page(tokens: list[Token], nodes: list[_Node]) -> list[Token]:
    """The tokens outside of noise, and one for each noise subtree that stands in none."""
    kept = []
    for token in tokens:
        node = token[3]
        if token[0] == "noise":
            above = nodes[node].above
            if nodes[node].noise and (above < 0 or not nodes[above].noise):
                kept.append(token)
        elif node < 0 or not nodes[node].noise:
            kept.append(token)
    return kept


def main_text(page: str, weights: Weights) -> str:
    """The text of the best region: its blocks in page order, joined by line feeds."""
    tokens, blocks, nodes = parse(page)
    tokens = _of_page(tokens, nodes)
    first, last = best_region([weights.of(t) for t in tokens])
    chosen = sorted({t[2] for t in tokens[first : last + 1] if t[1]})
    return "\n".join(blocks[b] for b in chosen if blocks[b])


def _page_counts(page: str) -> Counter:
    """(kind, inside) -> words or tags of a page that marks its content; empty for one that doesn't."""
    tokens, _, nodes = parse(page)
    tokens = _of_page(tokens, nodes)
    counts: Counter = Counter()
    if any(t[4] for t in tokens):
        for kind, words, _, _, inside in tokens:
            counts[kind, inside] += words or 1
    return counts


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, labelled: int = LABELLED_PAGES) -> Weights:
    """Weights from about ``labelled`` of the pages that mark their content, those of smallest id hash.  A word scores the
    share of such words inside the marked content, a tag by :func:`tag_score`.  Only sums of counts reach the driver."""
    marked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    total = marked.count()
    share = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = marked.where(share < F.lit(min(1.0, labelled / max(1, total))))
    entry = T.StructType([T.StructField("kind", T.StringType()), T.StructField("inside", T.BooleanType()), T.StructField("n", T.LongType())])

    @F.pandas_udf(T.ArrayType(entry))
    def counted(htmls: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "inside": i, "n": n} for (k, i), n in _page_counts(h).items()] for h in htmls])

    each = sample.select(F.explode(counted("html")).alias("e")).groupBy("e.kind").agg(F.sum(F.when(F.col("e.inside"), F.col("e.n")).otherwise(0)).alias("inside"), F.sum("e.n").alias("n"))
    seen = {row["kind"]: (row["inside"], row["n"] - row["inside"]) for row in each.collect()}  # at most the known kinds
    learned = Weights()
    for a, b, kinds in PRIOR:
        for kind in (e + k for k in kinds for e in ("", "/")):
            inside, outside = seen.get(kind, (0, 0))
            learned.tags[kind] = tag_score(a + inside, b + outside)
    words = {k: (seen[k][0] + 1) / (sum(seen[k]) + 2) for k in ("word", "linked") if k in seen}
    learned.word = max(0.1, words.get("word", learned.word))
    learned.linked = min(learned.word, words.get("linked", learned.linked))
    return learned


def extract(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """``pages`` as struct ``row`` with ``text`` and ``n_chars`` (code points): the main text of each whole page.

    Null counts as empty; a page without content has the empty text.  Character references are decoded once, white space
    in a block becomes one space, blocks are trimmed, empty ones left out, the others joined by a line feed.
    """

    @F.pandas_udf(T.StringType())
    def texts(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, weights) if h else "" for h in htmls], dtype=object)

    found = pages.select(F.struct("*").alias("row"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("text", texts("html"))
    return found.select("row", "text", F.char_length("text").cast("long").alias("n_chars"))
