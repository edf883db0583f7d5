"""Language identification by a byte convolutional network, trained here in numpy on labelled text.

A text is lower-cased and cut into windows of fixed length.  Bytes are embedded; filters of several widths slide over a
window, each filter keeps its largest response (max pooling), and a softmax layer turns the responses into language
probabilities.  A text's language is that of the mean log-probability over all its windows.

One class more than the labels is learned, from windows that no language has: characters of training windows in random
order, random letters, random code points of scripts that no label uses.  It takes no part in the choice of a language;
its probability tells how little a text reads like any of them, and :func:`keep_known_languages` rejects by it.

Training takes a bounded sample of labelled rows to the driver; the network (some kB) goes to the workers, which apply it
to batches of windows.  Scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.llm.sampling import sample_classes
from adjudica.llm.shared import letters

#: Bounds of the sample that the network is fitted on: rows of a class, and windows of a row.
ROWS_A_CLASS, WINDOWS_A_ROW = 1000, 3
WINDOW, EMBED, FILTERS, WIDTHS = 192, 6, 12, (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows scored at a time, of however many texts: bounds a worker's memory.
BLOCK = 512
UNDETERMINED = "und"
#: Windows of no language for each training window, the least probability of that class that rejects a text, and the bytes
#: below which a text is too short to be told from noise.
NOISE_SHARE, REJECT, SHORTEST = 0.3, 0.9, 80
#: First and last code points of the ranges that noise is drawn from: Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
SCRIPTS = ((0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x30F6), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def text_windows(text: str, window: int = WINDOW) -> np.ndarray:
    """All windows of a text's UTF-8 bytes after lower-casing, as rows; byte 0 fills a window that is too short.  The
    last window of a longer text ends with it, and so may overlap the one before."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(data) <= window:
        return np.pad(data, (0, window - len(data)))[None]
    whole = data[: len(data) // window * window].reshape(-1, window)
    return whole if len(data) % window == 0 else np.concatenate([whole, data[None, -window:]])


def noise_windows(windows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` windows of no language.  Scripts that a tenth of the training windows use are no noise."""
    rng = np.random.default_rng(seed)
    texts = [bytes(w[w > 0]).decode("utf-8", "ignore") for w in windows[rng.permutation(len(windows))[:2000]]]
    used = lambda a, b: sum(any(a <= ord(c) <= b for c in t) for t in texts) * 10 > len(texts)
    foreign = [(a, b) for a, b in SCRIPTS if not used(a, b)]
    made = np.zeros((n, WINDOW), np.uint8)
    for k in range(n):
        kind = rng.integers(4 if foreign else 3)
        if kind <= 1:  # the characters of a window in random order
            chars = list(texts[rng.integers(len(texts))])
            rng.shuffle(chars)
            text = "".join(chars)
        else:
            a, b = (0x61, 0x7A) if kind == 2 else foreign[rng.integers(len(foreign))]
            codes = rng.integers(a, b + 1, WINDOW)
            gap = rng.random(WINDOW) < rng.uniform(0.02, 0.25)
            text = "".join(" " if g else chr(c) for g, c in zip(gap, codes, strict=True))
        data = np.frombuffer(text.lower().encode("utf-8", "replace")[:WINDOW], np.uint8)
        made[k, : len(data)] = data
    return made


@dataclass
class ByteNetwork:
    """``embed`` (256, EMBED), ``filters`` {width: (width * EMBED, FILTERS)}, ``out`` (all filters + 1, classes); the
    classes are those of ``labels`` and a last one for text of no language."""

    labels: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray

    @classmethod
    def start(cls, labels: list[str], seed: int) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        embed = rng.normal(0, 1, (256, EMBED)).astype(np.float32)
        embed[0] = 0
        filters = {w: normal(w * EMBED, FILTERS) for w in WIDTHS}
        return cls(labels, embed, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, normal(len(WIDTHS) * FILTERS + 1, len(labels) + 1))

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest responses (n, filters), and the positions where they were found."""
        n, length = windows.shape
        flat = self.embed[windows].reshape(n, length * EMBED)
        tops, places = [], []
        for w in WIDTHS:
            at = length - w + 1
            step = flat.strides[1]
            patches = np.lib.stride_tricks.as_strided(flat, (n, at, w * EMBED), (flat.strides[0], step * EMBED, step))
            response = (np.ascontiguousarray(patches).reshape(n * at, w * EMBED) @ self.filters[w]).reshape(n, at, FILTERS)
            if where:
                place = response.argmax(axis=1)
                places.append(place)
                tops.append(np.take_along_axis(response, place[:, None], 1)[:, 0] + self.bias[w])
            else:
                tops.append(response.max(axis=1) + self.bias[w])
        return np.maximum(np.concatenate(tops, 1), 0), np.concatenate(places, 1) if where else None

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = (pooled @ self.out[:-1] + self.out[-1]).astype(np.float64)
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of :meth:`weights`.  Through the pooling only the places with the
        largest responses count."""
        n = len(windows)
        pooled, places = self.pooled(windows, where=True)
        delta = np.exp(self.log_probabilities(pooled)).astype(np.float32)
        delta[np.arange(n), classes] -= 1
        delta /= n
        d_out = np.concatenate([pooled.T @ delta, delta.sum(0, keepdims=True)])
        d_top = (delta @ self.out[:-1].T) * (pooled > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g, place = d_top[:, own], places[:, own]
            taken = np.take_along_axis(windows[:, :, None], (place[:, None] + np.arange(w)[None, :, None]), 1)  # n, w, F
            kernel = self.filters[w].reshape(w, EMBED, FILTERS)
            d_filters.append(np.einsum("nwfe,nf->wef", self.embed[taken], g).reshape(w * EMBED, FILTERS))
            np.add.at(d_embed, taken, np.einsum("wef,nf->nwfe", kernel, g))
            d_bias.append(g.sum(0))
        d_embed[0] = 0
        return [d_embed, *d_filters, *d_bias, d_out]

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *(self.filters[w] for w in WIDTHS), *(self.bias[w] for w in WIDTHS), self.out]

    def predict(self, texts: Iterable[str]) -> list[tuple[str, float, float]]:
        """(label, its probability among the labels, probability of no language) of each text, from all its windows.
        Windows of successive texts are scored together, ``BLOCK`` at a time, and summed by text."""
        totals: list[np.ndarray] = []
        block, of, size = [], [], 0

        def score() -> None:
            nonlocal size
            if size:
                found = self.log_probabilities(self.pooled(np.concatenate(block))[0])
                np.add.at(sums, np.repeat(of, [len(w) for w in block]), found)
                block.clear()
                of.clear()
                size = 0

        texts = list(texts)
        sums, counts = np.zeros((len(texts), self.out.shape[1])), np.ones(len(texts))
        for k, text in enumerate(texts):
            windows = text_windows(text)
            counts[k] = len(windows)
            at = 0
            while at < len(windows):
                part = windows[at : at + BLOCK - size]
                block.append(part)
                of.append(k)
                at, size = at + len(part), size + len(part)
                if size == BLOCK:
                    score()
        score()
        for total in sums / counts[:, None]:
            share = np.exp(total - total.max())
            own = share[:-1]
            best = int(own.argmax())
            totals.append((self.labels[best], float(own[best] / max(own.sum(), 1e-300)), float(share[-1] / share.sum())))
        return totals


def fit(windows: np.ndarray, classes: np.ndarray, labels: list[str], seed: int = 5) -> ByteNetwork:
    """Adam over shuffled mini-batches; some windows are shortened at random so that short texts are learned too."""
    net, rng = ByteNetwork.start(labels, seed), np.random.default_rng(seed)
    weights = net.weights()
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, step = windows[pick].copy(), step + 1
            shorter = np.where(rng.random(len(x)) < 0.4, 4 + (WINDOW - 4) * rng.random(len(x)) ** 2, WINDOW)
            x[np.arange(WINDOW)[None] >= shorter[:, None]] = 0
            for w, g, m, v in zip(weights, net.gradients(x, classes[pick]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def train(docs: DataFrame, learn_from: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, rows_a_class: int = ROWS_A_CLASS, seed: int = 5) -> ByteNetwork | None:
    """The network learned from the rows where ``learn_from`` holds, the label isn't null and the text has a letter; None
    if there are none.  At most ``rows_a_class`` rows of a label (about; twice that at most) and ``WINDOWS_A_ROW`` evenly
    spaced windows of a row are read to the driver."""
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & letters(F.col(text_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def spaced(texts: pd.Series) -> pd.Series:
        picked = []
        for text in texts:
            windows = text_windows(text)
            picked.append([windows[k].tobytes() for k in np.unique(np.linspace(0, len(windows) - 1, WINDOWS_A_ROW).astype(int))])
        return pd.Series(picked)

    sample, labels = sample_classes(rows, "lang", F.col("id"), rows_a_class, lambda chosen: chosen.select("lang", "id", spaced("text").alias("windows")))
    if not labels:
        return None
    found = sample.toPandas()
    windows = np.frombuffer(b"".join(w for ws in found["windows"] for w in ws), np.uint8).reshape(-1, WINDOW)
    classes = np.repeat([labels.index(x) for x in found["lang"]], [len(w) for w in found["windows"]])
    noise = noise_windows(windows, max(1, int(NOISE_SHARE * len(windows))), seed)
    return fit(np.concatenate([windows, noise]), np.concatenate([classes, np.full(len(noise), len(labels))]), labels, seed)


def identify(docs: DataFrame, network: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with ``lang_pred``, ``score`` and ``noise``: the most likely learned label, its
    probability among the labels, and the probability that the text is of no language.

    A text that is null or has no letter gets ``und``, 0.0 and 1.0, as does every text if nothing was learned.  Whole texts
    are read; other columns are carried, not looked at.
    """
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("noise", T.DoubleType())])
    carried = docs.select(F.struct("*").alias("row"), F.when(letters(F.col(text_col)), F.col(text_col)).alias("text"))
    if network is None:
        return carried.select("row", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(1.0).alias("noise"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf(result)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        found = [(UNDETERMINED, 0.0, 1.0)] * len(texts)
        with_text = [k for k, t in enumerate(texts) if t]
        for k, said in zip(with_text, shared.value.predict(texts.iloc[k] for k in with_text), strict=True):
            found[k] = said
        return pd.DataFrame(found, columns=["lang_pred", "score", "noise"])

    return carried.withColumn("said", predicted("text")).select("row", "said.lang_pred", "said.score", "said.noise")


def keep_known_languages(docs: DataFrame, network: ByteNetwork | None, reject: float = REJECT, languages: Sequence[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that have no letter, those of at least ``SHORTEST`` bytes that the network says are of no
    language with a probability of ``reject`` or more, and, where ``languages`` names the wanted ones, those whose predicted
    language isn't one of them."""
    short = F.octet_length(F.col(f"row.`{text_col}`")) < SHORTEST
    said = identify(docs, network, text_col).where((F.col("lang_pred") != UNDETERMINED) & (short | (F.col("noise") < reject)))
    if languages is not None:
        said = said.where(F.col("lang_pred").isin(list(languages)))
    return said.select("row.*")
