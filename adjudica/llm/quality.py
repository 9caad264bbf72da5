"""Operator 7: a generalised additive model with pairwise interactions, as a quality classifier.

Cyclic boosting of shallow trees, a feature at a time and then a pair of features at a time, adds up to one lookup
table per feature and per pair; a text's score is the logistic of the sum of its bins' entries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "symbols", "digits", "capitals", "commas", "stops",
    "log_lines", "line_length", "distinct_lines", "distinct_sentences", "bars", "short_words", "longest_word", "squeezed", "odd_marks",
)
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DIGITS, _CAPITALS = b"0123456789", bytes(range(65, 91))
_ODD = b"#*%&$@~^|<>{}[]\\=+_"


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES; of null or empty text, those of no words."""
    import zstandard

    text = text or ""
    raw, words, lines = text.encode("utf-8", "replace"), text.split(), text.split("\n")
    counts, sentences = Counter(words), text.split(".")
    n, size, chars = max(1, len(words)), max(1, len(raw)), max(1, len(text))
    share = lambda marks: (len(raw) - len(raw.translate(None, marks))) / size
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / n, len(counts) / n, max(counts.values(), default=0) / n, (len(set(zip(words, words[1:]))) + 1) / n, share(_SYMBOLS), share(_DIGITS), share(_CAPITALS), text.count(",") / n, text.count(".") / n,
        math.log(len(lines)), chars / len(lines), len(set(lines)) / len(lines), len(set(sentences)) / len(sentences), text.count("|") / n, sum(map((4).__gt__, map(len, words))) / n, max(map(len, words), default=0), len(zstandard.ZstdCompressor(level=1).compress(raw)) / size, share(_ODD),
    ]


@dataclass
class Additive:
    """edges[f] are the upper ends of feature f's bins but the last; tables[f] their entries; pairs: (f, g, coarse edges of f and g, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, f])]
        for f, g, a, b, t in self.pairs:
            total += t[np.searchsorted(a, x[:, f]), np.searchsorted(b, x[:, g])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _ends(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def _stump(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """The best tree of up to *leaves* leaves over ordered bins, as one value per bin."""
    cuts = [0, len(g)]
    gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for s, e in zip(cuts, cuts[1:]):
            if e - s > 1:
                lg, lh = gs[s + 1 : e] - gs[s], hs[s + 1 : e] - hs[s]
                rg, rh = gs[e] - gs[s + 1 : e], hs[e] - hs[s + 1 : e]
                gain = lg**2 / (lh + smooth) + rg**2 / (rh + smooth) - (lg + rg) ** 2 / (lh + rh + smooth)
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), s + 1 + i))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for s, e in zip(cuts, cuts[1:]):
        out[s:e] = (gs[e] - gs[s]) / (hs[e] - hs[s] + smooth)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best cut of a pair's table into four leaves: gain and values."""
    gc, hc = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    best, values = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            corner = lambda t: np.array([[t[i, j], t[i, -1] - t[i, j]], [t[-1, j] - t[i, j], t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j]]])  # noqa: B023, E731
            a, b = corner(gc), corner(hc)
            gain = float((a**2 / (b + smooth)).sum() - gc[-1, -1] ** 2 / (hc[-1, -1] + smooth))
            if gain > best:
                best, values = gain, np.repeat(np.repeat(a / (b + smooth), [i, g.shape[0] - i], 0), [j, g.shape[1] - j], 1)
    return best, values


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.1, leaves: int = 3, pairs: int = 8, coarse: int = 8, pair_rounds: int = 40, smooth: float = 1.0) -> Additive:
    """Fit to rows *x* with labels *y* (0 or 1). Without rows every score is 1/2; with one label only, scores differ little."""
    n = len(y)
    rate_of_ones = (y.sum() + 1) / (n + 2)
    model = Additive(math.log(rate_of_ones / (1 - rate_of_ones)))
    if not n:
        return model
    model.edges = [_ends(x[:, f], bins) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f]) for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, t in zip(binned, model.tables):
            g, h = slopes()
            step = rate * _stump(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), leaves, smooth)
            t += step
            total += step[b]
    ends = [_ends(x[:, f], coarse) for f in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, f]) for f, e in enumerate(ends)]

    def tables(f: int, g: int, *weights: np.ndarray) -> list[np.ndarray]:
        shape = len(ends[f]) + 1, len(ends[g]) + 1
        return [np.bincount(rough[f] * shape[1] + rough[g], w, shape[0] * shape[1]).reshape(shape) for w in weights]

    first = slopes()
    chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quarters(*tables(*p, *first), smooth)[0])[:pairs]
    sums = [np.zeros((len(ends[f]) + 1, len(ends[g]) + 1)) for f, g in chosen]
    for _ in range(pair_rounds):
        for (f, g), t in zip(chosen, sums):
            step = rate * _quarters(*tables(f, g, *slopes()), smooth)[1]
            t += step
            total += step[rough[f], rough[g]]
    model.pairs = [(f, g, ends[f], ends[g], t) for (f, g), t in zip(chosen, sums)]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, text: str = "text", key: str = "doc_id", label: str = "quality") -> Additive:
    """Train on at most *sample* labelled documents, those of the least hashes of their keys.

    Labels other than 0 and 1 and null keys are passed over; of a key's several labels the larger counts, of its several
    texts the one with the lesser features. Only the sample's texts are read on for features.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)

    @F.arrow_udf("array<double>")
    def seen(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    met = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_key").select("_key", "_y", seen("_t").alias("_x"))
    rows = met.groupBy("_key", "_y").agg(F.min("_x").alias("_x")).orderBy("_key").collect()
    return train(np.array([r._x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r._y for r in rows], dtype=float))


def scored(docs: DataFrame, model: Additive, least: float = 0.7, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """*docs* with the score of each whole text (null and empty ones too), and 1 where it reaches *least*, else 0.

    Columns of the same names are replaced; repeated rows are scored each, alike; keys aren't read, so null ones matter nothing; very long texts
    are read whole; an empty table stays empty. A model that was taught nothing scores 1/2.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(np.array([features(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))), pa.float64())

    return docs.withColumn(names[0], score(F.col(text))).withColumn(names[1], (F.col(names[0]) >= least).cast("int"))
