"""Substring dedup by super-k-mers: runs of windows that share a minimiser travel as one string.

A window is ``window`` consecutive words; its minimiser is the least hash of its ``m``-word
pieces. Equal windows have equal minimisers, hence

1. every document lists its minimisers, one row for each place they hold (``places``). A
   minimiser with one place in the corpus cannot belong to a repeated window, so the rest of
   the work is for minimisers with two places or more (``shared``);
2. consecutive windows with the same shared minimiser form one packed string of words, sent
   once to the minimiser's bucket. Copies of a string combine in the task before they move;
3. in the bucket the windows of all strings are sorted by their words, then document and
   start: the first of equal windows is *fresh*, and any other one is a repeat;
4. a document joins its fresh windows: a window with a shared minimiser that is not fresh
   is a repeat, and every word under a repeat goes.

Hot minimisers (more than ``hot`` places) are spread: their windows go singly to buckets of
their own, so a passage in a third of all documents is one row a task and window there.
The join that finds shared minimisers has one row a minimiser on one side, so Spark splits
hot ones. The row key is a 64-bit hash of id and text; if two rows had the same one, they
would only list each other's minimisers.

Edge cases: null or empty text has no words; fewer than ``window`` words: nothing goes; a
null id is the smallest; rows with equal id and text count as one (each is returned), rows
with equal id and other text are ordered by their hash; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import back_to_id, batch_of, id_of, stored, words

WINDOW, PIECE, HOT = 20, 4, 20_000
#: Strings that a task holds to combine copies, and their bytes.
HELD, HELD_BYTES = 200_000, 48 << 20


class Words:
    """A text as its words joined by one blank: bytes, word borders and a 64-bit hash of each word.

    The hash is a polynomial in the word's bytes modulo 2**64. Prefix sums of all bytes give it
    for every word at once: the difference at its borders, moved to place 0 by the inverse power.
    """

    FACTOR = 0x9E3779B97F4A7C15
    BLOCK = 1 << 20  # bytes hashed at a time
    power = inverse = np.ones(1, np.uint64)

    def __init__(self, text: str | None):
        self.norm = b" ".join(words(text))
        a = np.frombuffer(self.norm, np.uint8)
        cut = np.flatnonzero(a == 32)
        self.start = np.concatenate([[0], cut + 1]) if len(a) else np.empty(0, np.int64)
        self.end = np.concatenate([cut, [len(a)]]) if len(a) else np.empty(0, np.int64)
        self.n = len(self.start)

    @classmethod
    def powers(cls, n: int) -> None:
        if len(cls.power) < n:
            for name, f in (("power", cls.FACTOR), ("inverse", pow(cls.FACTOR, -1, 1 << 64))):
                p = np.full(n, f, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))

    def hashes(self) -> np.ndarray:
        a = np.frombuffer(self.norm, np.uint8)
        out, k = np.empty(self.n, np.uint64), 0
        while k < self.n:
            e = max(k + 1, int(np.searchsorted(self.end, self.start[k] + self.BLOCK, "right")))
            lo, hi = self.start[k], self.end[e - 1]
            self.powers(max(hi - lo, self.BLOCK) + 1)
            before = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((a[lo:hi].astype(np.uint64) + np.uint64(1)) * self.power[:hi - lo], out=before[1:])
            s = self.start[k:e] - lo
            out[k:e] = (before[self.end[k:e] - lo] - before[s]) * self.inverse[s]
            k = e
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return out

    def slice(self, first: int, stop: int) -> bytes:
        return self.norm[self.start[first]:self.end[stop - 1]]


def sliding(a: np.ndarray, k: int, op) -> np.ndarray:
    """op over every k neighbours, by doubling."""
    span = 1
    while 2 * span <= k:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[:len(a) - (k - span)], a[k - span:]) if span < k else a


def minimisers(h: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each piece, minimiser of each window)."""
    n = len(h) - piece + 1
    g = h[:n].copy()
    for j in range(1, piece):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += h[j:j + n]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return g, sliding(g, window - piece + 1, np.minimum)


def places(g: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The minimiser at each place that is the least one of a window over it."""
    k = len(g) - len(least) + 1
    edge = np.zeros(k - 1, np.uint64)
    return g[g == sliding(np.concatenate([edge, least, edge]), k, np.maximum)]


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def list_places(window: int, piece: int):
    schema = pa.schema([("least", pa.int64()), ("row", pa.int64())])

    def run(batches):
        for b in batches:
            least, rows = [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = Words(text.as_py())
                if w.n >= window:
                    p = places(*minimisers(w.hashes(), window, piece))
                    least.append(p)
                    rows.append(np.full(len(p), row))
            if least:
                yield batch_of(schema, [np.concatenate(least).view(np.int64), np.concatenate(rows)])

    return run


def shared_runs(w: Words, window: int, piece: int, shared: list[int]) -> list[tuple[int, int, int]]:
    """(minimiser, first window, end) of every run of windows with one shared minimiser."""
    least = minimisers(w.hashes(), window, piece)[1].view(np.int64)
    cut = (np.flatnonzero(least[1:] != least[:-1]) + 1).tolist()
    known = set(shared)
    return [(m, a, e) for m, a, e in zip(least[[0, *cut]].tolist(), [0, *cut], [*cut, len(least)], strict=True) if m in known]


def pack(window: int, piece: int):
    """(row, id, text, shared, hot) -> (bucket, id, row, start, string): the first of equal strings in the task."""
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("string", pa.binary())])

    def flush(held: dict):
        string = list(held)
        first = list(zip(*held.values(), strict=True))
        held.clear()
        for at in range(0, len(string), 20_000):
            part = slice(at, at + 20_000)
            yield batch_of(schema, [first[3][part], first[0][part], first[1][part], first[2][part], string[part]])

    def run(batches):
        held, size = {}, 0
        for b in batches:
            for row, i, text, shared, hot in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(b.columns)), strict=True):
                w = Words(text.as_py())
                hot = set(hot)
                for bucket, a, e in shared_runs(w, window, piece, shared):
                    for s, t in ((x, x + 1) for x in range(a, e)) if bucket in hot else ((a, e),):
                        string = w.slice(s, t + window - 1)
                        key = int(np.uint64(xxhash.xxh3_64_intdigest(string)).view(np.int64)) if bucket in hot else bucket
                        new, old = (i, row, s, key), held.get(string)
                        if old is None:
                            size += len(string)
                        if old is None or new < old:
                            held[string] = new
                if len(held) > HELD or size > HELD_BYTES:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    return run


def sort_windows(window: int):
    """Rows sorted by bucket -> (row, id, start, n): runs of fresh windows."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])

    def firsts(found: list) -> list:
        found.sort()
        return [x for k, x in enumerate(found) if not k or x[0] != found[k - 1][0]]

    def runs(found: list):
        start = None
        for _, i, row, s in sorted(firsts(found), key=lambda x: x[1:]):
            if start and start[0] == row and start[1] == i and start[2] + start[3] == s:
                start[3] += 1
            else:
                if start:
                    yield start
                start = [row, i, s, 1]
        if start:
            yield start

    def run(batches):
        key, found, out, limit = None, [], [], 100_000
        for b in batches:
            for bucket, i, row, s, string in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != key:
                    out.extend(runs(found))
                    key, found, limit = bucket, [], 100_000
                w = string.split(b" ")
                found.extend((b" ".join(w[k:k + window]), i, row, s + k) for k in range(len(w) - window + 1))
                if len(found) > limit:  # keep the first of each window met so far
                    found = firsts(found)
                    limit = max(limit, 2 * len(found))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))
                out = []
        if last := list(runs(found)):
            yield batch_of(schema, list(zip(*last, strict=True)))

    return run


def remove(window: int, piece: int):
    """(row, id, text, shared, fresh) -> result row."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())])

    def run(batches):
        for b in batches:
            out = []
            for i, text, shared, fresh in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                w = Words(text.as_py())
                n, kept, text = w.n, w.n, w.norm
                if shared is not None:
                    repeat = np.zeros(n - window + 1, bool)
                    for _, a, e in shared_runs(w, window, piece, shared):
                        repeat[a:e] = True
                    for f in fresh or ():
                        if f["id"] == i:
                            repeat[f["start"]:f["start"] + f["n"]] = False
                    edge = np.zeros(n + 1, np.int64)
                    for a, e in _runs(repeat):
                        edge[a] += 1
                        edge[e + window - 1] -= 1
                    stay = np.cumsum(edge[:n]) == 0
                    kept = int(stay.sum())
                    if kept < n:
                        text = b" ".join(w.slice(a, e) for a, e in _runs(stay))
                out.append((i, n, n - kept, text))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (binary, words joined by one space)."""
    rows = docs.select(F.xxhash64(id_of(id_col), text_col).alias("row"), id_of(id_col).alias("id"), F.col(text_col).alias("text"))
    listed = stored(rows.select("row", "text").mapInArrow(list_places(window, piece), "least long, row long"), "minimisers")
    # Written, so that the join below has plain shuffles on both sides and Spark can split a hot minimiser.
    shared = stored(listed.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-minimisers")
    of_row = (listed.join(shared, "least").groupBy("row")
              .agg(F.collect_set("least").alias("shared"), F.collect_set(F.when(F.col("n") > hot, F.col("least"))).alias("hot")))
    known = rows.join(of_row, "row", "left")
    strings = known.where("shared IS NOT NULL").select("row", "id", "text", "shared", "hot").mapInArrow(
        pack(window, piece), "bucket long, id long, row long, start long, string binary")
    fresh = (strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort_windows(window), "row long, id long, start long, n long")
             .groupBy("row").agg(F.collect_list(F.struct("id", "start", "n")).alias("fresh")))
    out = known.join(fresh, "row", "left").select("row", "id", "text", "shared", "fresh").mapInArrow(
        remove(window, piece), "id long, n_words long, n_removed long, kept_text binary")
    return out.withColumn("id", back_to_id("id")).withColumnRenamed("id", id_col)
