"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Items and documents are normalised the same way (A-Z lower-cased, words of letters, digits
and anything beyond ASCII). The automaton runs on word numbers: a document is read once, a
word that no item has is number 0. A match ends at a word, so hits are word ranges, and the
byte spans of the words map them to code points of the original text.

The items' windows are the only thing broadcast. Their size is counted first: beyond
``BLOCK`` (half the bytes) the items are dealt into blocks by hash, each scanned with an automaton of
its own, and the (few) hit documents are put together by key. Documents themselves never
move while there is one block.

Edge cases: null text or item has no words and no window; an item of fewer than ``window``
words is one window; items that share an id count once; a null item id reads as an empty
string; repeated rows are judged each; other columns are ignored; without documents there is no
row, without items no hit; a text is read once, its length only bounds the memory of its task.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_of, plain_word_spans, plain_words, share, table

WINDOW, BLOCK = 10, 500_000


class Windows:
    """Windows of the items of one block; the automaton is built once in each worker."""

    def __init__(self, items: list[tuple], window: int):
        self.items, self.window, self.built = items, window, None

    def automaton(self):
        if self.built is None:
            import ahocorasick

            words: dict[bytes, int] = {}
            of: dict[tuple, set] = {}
            for i, text in self.items:
                w = [words.setdefault(x, len(words) + 1) for x in plain_words(text)]
                for k in range(max(1, len(w) - self.window + 1) if w else 0):
                    of.setdefault(tuple(w[k:k + self.window]), set()).add("" if i is None else str(i))
            a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, ids in of.items():
                a.add_word(key, (len(key), ids))
            if of:
                a.make_automaton()
            self.built = words, a if of else None
        return self.built

    def __getstate__(self):
        return self.items, self.window, None

    def __setstate__(self, state):
        self.items, self.window, self.built = state

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, hit ranges of words, ids of items with a hit)."""
        words, a = self.automaton()
        w = plain_words(text)
        runs, ids = [], set()
        if w and a is not None:
            for end, (n, of) in a.iter(tuple(map(words.get, w, repeat(0)))):
                ids |= of
                start, stop = end - n + 1, end + 1
                while runs and runs[-1][1] >= start:  # ends only grow: merge with what it touches
                    start = min(start, runs.pop()[0])
                runs.append((start, stop))
        return len(w), runs, ids


def code_points(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point spans of the original text."""
    spans = plain_word_spans(text)
    lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return [(int(before[spans[a][0]]), int(before[spans[b - 1][1]])) for a, b in runs]


SPANS = "array<struct<start: long, stop: long>>"
ROW = f"id long, n_words long, n_hit long, items array<string>, spans {SPANS}"


def _scan(rows: DataFrame, items: list[tuple], window: int, only_hits: bool) -> DataFrame:
    shared = share(rows.sparkSession, Windows(items, window))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", span), ("key", pa.string()), ("runs", span)])
    name = lambda pairs: [{"start": a, "stop": b} for a, b in pairs]

    def run(batches):
        windows = shared.value
        for b in batches:
            out = []
            for i, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                n, runs, ids = windows.scan(text)
                if runs or not only_hits:
                    out.append((i, n, sum(e - s for s, e in runs), sorted(ids), name(code_points(text, runs) if runs else ()), key, name(runs)))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    return rows.mapInArrow(run, f"{ROW}, key string, runs {SPANS}")


class item_blocks:
    """The items in blocks of bounded size, each fetched when its turn comes."""

    def __init__(self, items: DataFrame, item_col: str, item_text: str, block: int):
        tests = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()  # copies count once
        size = int(tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // 2  # no fewer than there are windows
        self.n = max(1, -(-size // block))
        self.dealt = tests.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(self.n)))

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        for k in range(self.n):
            yield [(r.i, r.t) for r in self.dealt.where(F.col("block") == k).select("i", "t").collect()]

    def first(self) -> list[tuple]:
        return next(iter(self))


def row_key(id_col: str, text_col: str):
    """SHA-256 of id and text: no two rows that differ share it. A null text reads as an empty one, neither has words."""
    return F.sha2(F.concat(F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))), 256)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted ids), spans (code points), contaminated."""
    parts = item_blocks(items, item_col, item_text, block)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (row_key(id_col, text_col) if len(parts) > 1 else F.lit("")).alias("key"), F.col(text_col).alias("text"))
    if len(parts) == 1:
        out = _scan(rows, parts.first(), window, False).drop("key", "runs")
    else:
        hits = None
        for items_ in parts:
            part = _scan(rows, items_, window, True).select("key", "items", "runs")
            hits = part if hits is None else hits.unionByName(part)
        put = hits.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.flatten(F.collect_set("runs")).alias("runs"))
        out = rows.join(put, "key", "left").select("id", "text", "items", "runs").mapInArrow(_merge, ROW)
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("id", id_col)


def _merge(batches):
    """Rows with the hits of all blocks -> counts and spans."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", span)])
    for b in batches:
        out = []
        for i, text, items, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            merged: list[list[int]] = []
            for r in sorted(runs or (), key=lambda r: (r["start"], r["stop"])):
                if merged and r["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r["stop"])
                else:
                    merged.append([r["start"], r["stop"]])
            spans = [{"start": x, "stop": y} for x, y in code_points(text, merged)] if merged else []
            out.append((i, len(plain_words(text)), sum(y - x for x, y in merged), items or [], spans))
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs``, all columns, without a hit; each block of items is one filter, nothing is shuffled."""
    at = docs.columns.index(text_col)

    def clean(shared):
        def run(batches):
            windows = shared.value
            for b in batches:
                yield b.filter(pa.array([not windows.scan(t.as_py())[1] for t in b.column(at)], pa.bool_()))
        return run

    for part in item_blocks(items, item_col, item_text, block):
        docs = docs.mapInArrow(clean(share(docs.sparkSession, Windows(part, window))), docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(greatest(len(w) - 9, 1))) AS start FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[start + 1:start + n], ' ') AS win FROM bs),
lens AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS start FROM d, lens WHERE len(w) >= n),
m AS (SELECT doc_id, start, ds.n, item_id FROM ds JOIN bw ON bw.n = ds.n AND bw.win = array_to_string(ds.w[ds.start + 1:ds.start + ds.n], ' ')),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS place FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
