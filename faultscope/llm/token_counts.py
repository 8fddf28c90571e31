"""Token counts of a sentencepiece BPE model by heap-and-linked-list merging, without ids.

A text becomes ``▁`` + text with blanks as ``▁`` (the model's normalisation). No piece has a
``▁`` behind another character, so merges stay inside runs ``▁+[^▁]*``; characters that are
in no longer piece (line feeds, say) cut a run as well. Runs are merged once and their count
is kept in a bounded cache. A character without a piece falls back to its UTF-8 bytes, each
an initial symbol that no merge joins.

The vocabulary (a fixed file) is read by the driver and broadcast. Edge cases: null and
empty texts have no tokens; control strings such as ``</s>`` in a text are ordinary text, as
the library treats them; a very long run without blanks costs n log n.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_of, by_batch, share

LIMIT, MARK, CACHED = 4096, "▁", 400_000


def vocabulary(model_file: str) -> dict[str, float]:
    """piece -> rank (the negated score; the lowest merges first). Bytes and controls never merge."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = {p.id_to_piece(i): -p.get_score(i) for i in range(p.get_piece_size()) if not (p.IsByte(i) or p.IsControl(i) or p.IsUnknown(i))}
    if any(MARK in x.lstrip(MARK) for x in out):
        raise ValueError("a piece holds a blank behind another character: runs are not independent")
    return out


def count_run(run: str, rank: dict[str, float]) -> int:
    """Initial symbols less merges."""
    sym: list[str | None] = list(run)
    n = len(sym)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, s) for i in range(n - 1) if (r := rank.get(s := run[i:i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, s = heappop(heap)
        if sym[i] is None or (j := after[i]) < 0 or sym[i] + sym[j] != s:
            continue  # one of the two has merged meanwhile
        sym[i], sym[j] = s, None
        after[i] = k = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := rank.get(t := s + sym[k])) is not None:
                heappush(heap, (r, i, t))
        if (h := before[i]) >= 0 and (r := rank.get(t := sym[h] + s)) is not None:
            heappush(heap, (r, h, t))
    return n - merges + sum(len(c.encode()) - 1 for c in run if c not in rank)


class Runs(dict):
    """run -> its count; a cache of bounded size."""

    def __init__(self, rank: dict[str, float]):
        self.rank = rank
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in rank))
        self.cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else "")).findall

    def __missing__(self, run: str) -> int:
        if len(self) > CACHED:
            self.clear()
        out = count_run(run, self.rank)
        if len(run) < 64:
            self[run] = out
        return out

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.cut(MARK + text.replace(" ", MARK)))) if text else 0


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit."""
    rank = share(docs.sparkSession, vocabulary(model_file))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def make():
        runs = Runs(rank.value)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            return batch_of(schema, [b.column(0), b.column(2), [runs.count(t.as_py()) for t in b.column(1)]])

        return one

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"))
    out = rows.mapInArrow(by_batch(make), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
