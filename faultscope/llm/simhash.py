"""SimHash near-dedup: inverted index on byte positions, count filter, verification.

Two 64-bit fingerprints within 3 bits share at least 5 of their 8 positional bytes. Lists
on single positional bytes would hold 1/256 of the corpus each and give pairs without
number, so a posting is keyed by 5 positions and their bytes: the guaranteed minimum of
the tally. Two fingerprints meet in a list exactly if their tally reaches 5, and only
there is the distance verified. Members of one list differ in at most 3 bytes, so no list
has more than 2**24 fingerprints, whatever the corpus is: no group is unbounded. A list
gives the links of a spanning star (member, least member reachable in the list), not its
pairs. Exact copies collapse to one fingerprint before (map-side).

Edge cases: null and empty texts have fingerprint 0 and link like any other; a null id is
the smallest; repeated rows give repeated result rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import back_to_id, batch_of, by_batch, id_of, stored
from .components import components

BITS, MOST, BYTES = 64, 3, 8
SHARED = BYTES - MOST
SETS = [sum(0xFF << 8 * i for i in c) for c in combinations(range(BYTES), SHARED)]
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Lists up to this size are compared row by row in blocks, larger ones by looking up all flips.
BLOCKWISE = 4096


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    w = text.encode().lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    parts = zip(*(w[i:] for i in range(size)), strict=False) if len(w) >= size else [w]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, parts)), np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit set if it is set in over half the shingle hashes; tallied by byte value, then by bit."""
    h = shingle_hashes(text)
    count = np.zeros((BYTES, 8), np.int64)
    for at in range(0, len(h), 1 << 16):
        b = h[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        count += np.bincount((b + np.arange(BYTES) * 256).ravel(), minlength=2048).reshape(BYTES, 256) @ _ONES
    return int(np.packbits((2 * count > len(h)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp), fp as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], schema=schema)
        return one

    return docs.select(id_of(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(by_batch(make), "id long, fp long")


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): one row for each set of 5 positions; the key holds the set's number and a hash of its bytes."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.asarray(b.column(0)).view(np.uint64)
            keys = [packed(fp & np.uint64(m), k) for k, m in enumerate(SETS)]
            return batch_of(schema, [np.concatenate(keys).view(np.int64), np.tile(fp, len(SETS)).view(np.int64)])
        return one

    return fps.mapInArrow(by_batch(make), "key long, fp long")


def packed(masked: np.ndarray, k: int) -> np.ndarray:
    """The 40 kept bits and the set's number, packed without loss: 3 zero bytes are squeezed out."""
    out = np.zeros(len(masked), np.uint64)
    at = 0
    for i in range(BYTES):
        if SETS[k] >> 8 * i & 0xFF:
            out |= (masked >> np.uint64(8 * i) & np.uint64(0xFF)) << np.uint64(8 * at)
            at += 1
    return out | np.uint64(k << 8 * SHARED)


def links(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member reachable within the list) under the distance limit."""
    fp = np.unique(fp)
    n = len(fp)
    free = ~np.uint64(SETS[key >> 8 * SHARED])
    label = np.arange(n)
    pairs = list(_close(fp) if n <= BLOCKWISE else _flips(fp, int(free)))
    while pairs:
        before = label.copy()
        for i, j in pairs:
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
        label = label[label]
        if (before == label).all():
            break
    hung = np.flatnonzero(label != np.arange(n))
    return fp[hung], fp[label[hung]]


def _close(fp: np.ndarray):
    for at in range(0, len(fp), 256):
        i, j = np.nonzero(np.bitwise_count(fp[at:at + 256, None] ^ fp[None, :]) <= MOST)
        i += at
        yield i[i < j], j[i < j]


def _flips(fp: np.ndarray, free: int):
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    for r in range(1, MOST + 1):
        for c in combinations(bits, r):
            other = fp ^ np.uint64(sum(c))
            j = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            i = np.flatnonzero((fp[j] == other) & (np.arange(len(fp)) < j))
            if len(i):
                yield i, j[i]


def list_links(batches):
    """mapInArrow over rows sorted by key; a list that spans batches is carried over."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def done(key: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        size = np.diff(np.r_[start, len(key)])
        two = start[size == 2]
        near = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= MOST) & (fp[two] != fp[two + 1])]
        out = [(fp[near], fp[near + 1])] + [links(int(key[a]), fp[a:a + s]) for a, s in zip(start[size > 2], size[size > 2], strict=True)]
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        seen = np.unique(np.stack([u, v], 1), axis=0)  # a close pair meets in up to 21 lists
        return batch_of(schema, [seen[:, 0], seen[:, 1]])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the last list
    for b in batches:
        k, f = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
        if not len(k):
            continue
        last = np.searchsorted(k, k[-1])
        if held and held[0][0][0] != k[-1] or last:
            key = np.concatenate([*(x for x, _ in held), k[:last]])
            fp = np.concatenate([*(x for _, x in held), f[:last]])
            held = []
            yield done(key, fp)
        held.append((k[last:], f[last:]))
    if held:
        yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    lists = postings(fps.select("fp").distinct()).repartition("key").sortWithinPartitions("key")
    roots = components(lists.mapInArrow(list_links, "u long, v long"))
    rows = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("id", "fp", F.coalesce("root", "fp").alias("root"))
    least = stored(rows.groupBy("root").agg(F.min("id").alias("least")), "components")  # written: see components._stars
    return rows.join(least, "root").select(
        back_to_id("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back_to_id("least").alias("component_id"))
