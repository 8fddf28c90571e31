"""Quality classifier: a generalised additive model with pairwise interactions.

Features are numbers of the text alone (shape, symbols, case, repetition). Cyclic boosting
visits one feature after the other and fits a shallow tree on the feature's bins to the
current gradient; its leaves are added to the feature's lookup table, so the model stays a
sum of tables. Then the pairs with the largest remaining gain get tables of their own, from
depth-two trees. Scoring looks up bins and adds.

Labels are used only for the fit, and only rows with crc32(id) mod 3 other than 1. Features
are computed for all rows once and written; the fit takes at most ``ROWS`` labelled rows
(those of the smallest hashes; equal rows count once and weigh more), every other step covers
all rows. The driver holds the sample (``ROWS`` x features) and the tables.

Edge cases: a null text is an empty one, with all features 0, and gets a score; without
labelled rows, or with one class only, the score is the share of label 1 (0.5 if none);
repeated labels and documents weigh by their number; very long texts are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batch_of, by_batch, share, stored, table

ROWS, BINS, COARSE, ROUNDS, PAIRS, RATE, RIDGE, LEAST = 40_000, 48, 8, 120, 6, 0.15, 2.0, 4
NAMES = ["log_bytes", "word_bytes", "short_words", "distinct_words", "upper", "digits", "marks", "symbols", "bars", "bangs", "not_ascii", "line_words", "same_lines", "long_words", "stops", "again"]
_SET = np.zeros((256, 9))
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"?-()", b"#$%&*@^~<>{}[]\\/_=+`", b"|", b"!", range(128, 256), b"\n")):
    _SET[list(_chars), _k] = 1


def features(text: str | None) -> np.ndarray:
    out = np.zeros(len(NAMES))
    if not text:
        return out
    data = text.encode()
    upper, lower, digits, marks, symbols, bars, bangs, high, lines = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _SET
    w = data.split()
    n, size = max(len(w), 1), len(data)
    length = np.fromiter(map(len, w), np.int64, len(w))
    rows = [x for x in data.split(b"\n") if x]
    out[:] = (np.log1p(size), length.sum() / n, (length <= 3).sum() / n, len(set(w)) / n, upper / max(upper + lower, 1), digits / size, marks / n, symbols / n, bars / n, bangs / n,
              high / size, min(n / (lines + 1), 1000), 1 - len(set(rows)) / max(len(rows), 1), (length >= 14).sum() / n, data.count(b". ") / n, sum(map(eq, w, w[1:])) / n)
    return out


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def make():
        return lambda b: batch_of(schema, [b.column(0), [features(t.as_py()) for t in b.column(1)]])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(by_batch(make), "id long, x array<double>")


@dataclass
class Additive:
    """Bin edges of each feature, a table for each feature and for each pair (coarse bins)."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    single: list[np.ndarray] = field(default_factory=list)
    double: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.single):
            z += t[np.searchsorted(self.edges[k], x[:, k])]
        if self.double:
            c = [np.searchsorted(e, x[:, k]) for k, e in enumerate(self.coarse)]
            for (i, j), t in self.double.items():
                z += t[c[i], c[j]]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, last bin of the left side) of the best cut of a run of bins."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(nl < LEAST) | (n.sum() - nl < LEAST)] = -1
    return (float(gain.max()), int(gain.argmax())) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf value of each bin of a tree with a few leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts), default=(-1.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts.remove((a, b))
        parts += [(a, a + at + 1), (a + at + 1, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quads(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree that cuts the first feature once and each side once by the second one: (gain, table)."""
    best, table_ = -1.0, np.zeros_like(g)
    for a in range(1, len(g)):
        gain, out = 0.0, np.zeros_like(g)
        for part in (slice(0, a), slice(a, None)):
            gs, hs, ns = g[part].sum(0), h[part].sum(0), n[part].sum(0)
            more, at = _cut(gs, hs, ns)
            for cols in (slice(0, at + 1), slice(at + 1, None)) if more > 0 else (slice(None),):
                gq, hq = gs[cols].sum(), hs[cols].sum()
                gain += gq**2 / (hq + RIDGE)
                out[part, cols] = gq / (hq + RIDGE)
        if gain > best:
            best, table_ = gain, out
    return best, table_


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Additive:
    """``w`` counts how often each row stands."""
    n, m = x.shape if len(x) else (0, len(NAMES))
    w = np.ones(n) if w is None else w
    prior = float(np.average(y, weights=w)) if n else 0.5
    if not n or not 0 < prior < 1:
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return Additive([], [], float(np.log(prior / (1 - prior))))
    cuts = lambda k, bins: np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]))
    model = Additive([cuts(k, BINS) for k in range(m)], [cuts(k, COARSE) for k in range(m)], float(np.log(prior / (1 - prior))))
    bins = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)]
    sizes = [len(e) + 1 for e in model.edges]
    count = [np.bincount(b, w, s) for b, s in zip(bins, sizes, strict=True)]
    model.single = [np.zeros(s) for s in sizes]
    z = np.full(n, model.base)
    for _ in range(ROUNDS):
        for k in range(m):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(bins[k], w * (y - p), sizes[k]), np.bincount(bins[k], w * p * (1 - p), sizes[k]), count[k])
            model.single[k] += step
            z += step[bins[k]]
    coarse = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]

    def grids(i: int, j: int):
        p = 1 / (1 + np.exp(-z))
        at, shape = coarse[i] * width[j] + coarse[j], (width[i], width[j])
        return [np.bincount(at, v, width[i] * width[j]).reshape(shape) for v in (w * (y - p), w * p * (1 - p), w)]

    ranked = sorted(((_quads(*grids(i, j))[0], i, j) for i, j in combinations(range(m), 2) if min(width[i], width[j]) > 1), reverse=True)[:PAIRS]
    model.double = {(i, j): np.zeros((width[i], width[j])) for _, i, j in ranked}
    for _ in range(ROUNDS // 4):
        for (i, j), t in model.double.items():
            step = RATE * _quads(*grids(i, j))[1]
            t += step
            z += step[coarse[i], coarse[j]]
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = ROWS) -> Additive:
    """Fit on labelled rows that are not held out, at most ``rows`` distinct (id, features, label), each with its weight."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("double").alias("y"))
    known = known.groupBy("id", "y").agg(F.count(F.lit(1)).alias("w"))
    some = stored(x.join(known, "id").groupBy("id", "y", "x").agg(F.sum("w").alias("w")).withColumn("h", F.xxhash64("id", "y", "x")), "quality-known")
    part = 1.2 * rows / max(some.count(), 1)  # a little more by the hash, then exactly the first ones
    got = some.where(F.pmod("h", F.lit(1_000_000)) < math.ceil(part * 1_000_000)).orderBy("h", "id", "y").limit(rows).toArrow()
    flat = got["x"].combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0)
    return fit(flat.reshape(got.num_rows, len(NAMES)), got["y"].to_numpy().astype(float), got["w"].to_numpy().astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    x = stored(feature_table(docs, id_col, text_col), "quality-features")
    model = share(docs.sparkSession, train(x, labels, rows=rows))
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            flat = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            return batch_of(schema, [b.column(0), model.value.score(flat)])
        return one

    out = x.select("id", "x").mapInArrow(by_batch(make), "id long, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier accepts. Texts do not move: they are scored in place."""
    x = feature_table(docs, id_col, text_col)
    model = share(docs.sparkSession, train(x, labels, rows=rows))
    at = docs.columns.index(text_col)

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(b.num_rows, -1)
            return b.filter(pc.greater_equal(pa.array(model.value.score(x)), 0.5))
        return one

    return docs.mapInArrow(by_batch(make), docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
