"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts on the executors.  The trees are grown here, in numpy, on the driver, from the
statistics of a bounded sample of labelled rows: features become bins, a level of a tree needs one histogram a feature,
and the best split is the one of greatest gain.  Trees are complete, so they flatten into arrays in which the children of
node k are 2k+1 and 2k+2, and a batch of rows walks all trees a level at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.llm.sampling import sample_classes
from adjudica.llm.shared import small

#: Bound of the sample that the trees are fitted on: labelled rows of each of the two classes.
ROWS_A_CLASS = 8000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 50, 3, 0.2, 64, 1.0, 1.0
#: A text's score at or above this predicts label 1.
THRESHOLD = 0.7

_KINDS = np.zeros((256, 7), np.int64)  # lower, upper, digit, white space, sentence marks, symbols, beyond ASCII
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~")):
    _KINDS[list(_chars), _k] = 1
_KINDS[128:, 6] = 1
_WHITE, _SIGN = _KINDS[:, 3] > 0, _KINDS[:, 4] + _KINDS[:, 5] > 0

STATISTICS = (
    "bytes", "words", "lines", "lower", "upper", "digit", "space", "mark", "symbol", "wide", "entropy",
    "word_mean", "word_most", "distinct", "doubled", "commonest", "lines_distinct", "line_words", "marked_ends", "alone", "repeated",
)


def statistics(text: str) -> list[float]:
    """The numbers in STATISTICS, all 0 for an empty text; shares unless named bytes, words or lines (logarithms)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    if not words:
        return [math.log1p(len(data)), *[0.0] * (len(STATISTICS) - 1)]
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / len(data)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.splitlines()
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    n, sign = len(words), _SIGN[data]
    edge = np.concatenate(([True], _WHITE[data], [True]))  # signs that stand alone, and signs that repeat the one before
    return [
        math.log1p(len(data)), math.log1p(n), math.log1p(len(lines)), *(counts @ _KINDS / len(data)).tolist(), float(-(share * np.log2(share)).sum()),
        float(lengths.mean()), math.log1p(int(lengths.max())), len(seen) / math.sqrt(n), sum(map(eq, words, words[1:])) / n, max(seen.values()) / n,
        len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(line[-1:] in (".", "!", "?") for line in lines) / len(lines),
        float((sign & edge[:-2] & edge[2:]).sum()) / n, float((sign[1:] & (data[1:] == data[:-1])).mean()) if len(data) > 1 else 0.0,
    ]


@dataclass
class BoostedTrees:
    """Trees as arrays: ``feature`` and ``threshold`` (trees, 2**DEPTH - 1), ``leaf`` (trees, 2**DEPTH), on log-odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of statistics."""
        if not len(rows):
            return np.zeros(0)
        tree, node = np.arange(len(self.feature)), np.zeros((len(rows), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            right = rows[np.arange(len(rows))[:, None], self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        odds = self.base + self.leaf[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def grow(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> BoostedTrees:
    """Boosting on the logistic loss with second-order leaves; a row counts as ``weights`` rows (one, unless given)."""
    n, width = rows.shape
    weights = np.ones(n) if weights is None else weights
    edges = [np.unique(np.quantile(rows[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)])  # bin b: x <= edges[b]
    prior = ((weights * labels).sum() + 0.5) / (weights.sum() + 1)
    odds = np.full(n, base := math.log(prior / (1 - prior)))
    feature, threshold, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        gradient, hessian = weights * (labels - p), weights * p * (1 - p)
        node, f_of, t_of = np.zeros(n, np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for f in range(width):
                at = (node - first) * BINS + binned[f]
                g, h = (np.bincount(at, w, many * BINS).reshape(many, BINS).cumsum(1) for w in (gradient, hessian))
                worth = lambda a, b: a * a / (b + RIDGE)
                gain = worth(g, h) + worth(g[:, -1:] - g, h[:, -1:] - h) - worth(g[:, -1:], h[:, -1:])
                gain[(h < LEAST) | (h[:, -1:] - h < LEAST)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.size:
                    continue
                cut = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(many), cut] > best + 1e-9):
                    best[k], f_of[first + k], t_of[first + k] = gain[k, cut[k]], f, edges[f][cut[k]]
            node = 2 * node + 1 + (rows[np.arange(n), f_of[node]] > t_of[node])
        at = node - (2**DEPTH - 1)
        g, h = np.bincount(at, gradient, 2**DEPTH), np.bincount(at, hessian, 2**DEPTH)
        value = RATE * g / (h + RIDGE)
        odds += value[at]
        feature.append(f_of), threshold.append(t_of), leaf.append(value)
    return BoostedTrees(base, np.array(feature), np.array(threshold), np.array(leaf))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", *, rows_a_class: int = ROWS_A_CLASS) -> BoostedTrees | None:
    """Trees learned from the labelled rows where ``learn_from`` (over ``id_col`` of the labels) holds; None without any.

    A bounded sample of labels picks the rows (``rows_a_class`` a label, about, and four times that at most with ids that
    repeat); only their statistics reach the driver.  Rows of a label weigh as many as it has in the whole table, so the
    share of the labels, and with it the score, does not depend on the table's size.
    Null labels and labels other than 0 and 1 are passed over; a label row that repeats counts again; a null text is empty.
    """
    known = labels.where(learn_from & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    sample, classes = sample_classes(known, "label", F.col("id"), rows_a_class)
    if not classes:
        return None

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(small(sample, limit=4 * rows_a_class), "id").select("label", measured("text").alias("x"), "id").orderBy("id", "label").limit(8 * rows_a_class).toPandas()
    if found.empty:
        return None
    of_label = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    in_sample = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = found["label"].map({label: of_label[label] / n for label, n in in_sample.items()})
    return grow(np.stack(found["x"]), found["label"].to_numpy(np.float64), weights.to_numpy(np.float64))


def score_quality(docs: DataFrame, trees: BoostedTrees | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` as struct ``row`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is ``threshold`` or more).

    Null and empty texts are scored like any other, from statistics that are zero.  Without trees every score is 0.5.
    Whole texts are read; other columns are carried, not looked at.
    """
    carried = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    if trees is None:
        scored = carried.withColumn("score", F.lit(0.5))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(trees)

        @F.pandas_udf(T.DoubleType())
        def scores(texts: pd.Series) -> pd.Series:
            return pd.Series(shared.value.score(np.array([statistics(t or "") for t in texts]).reshape(len(texts), -1)))

        scored = carried.withColumn("score", scores("text"))
    return scored.select("row", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
