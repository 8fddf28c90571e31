"""Packing by concatenate and cut, with offsets from prefix sums over partition totals.

Pass 1 encodes every document, with its end id, and writes (part, at, ids) where ``at`` is
the running number of ids in its partition. The totals of the partitions, one number each,
are summed up in order: that gives every partition its global offset. Pass 2 reads the
written ids and cuts at the multiples of the sequence length, with a row for each piece: the
boundary records. Every sequence is full but the last, so padding is at most one sequence.

The written table makes both passes see the same rows in the same order even if executors
are lost. The driver holds 8 bytes a partition; more than ``PARTS`` partitions are refused.

Edge cases: a null or empty text is its end id alone; repeated rows are packed each; a very
long text gives a piece in each of its sequences; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import batch_of, share

LENGTH, END, PARTS, CACHED = 2048, 1, 8_000_000, 800_000
#: Characters for which the split below is the tokenizer's own; texts with others go to it whole.
PLAIN = "[\t-\r -~¡-ɏ‐-‧€]*"
_WHITE = re.compile(r" \s")


class Encoder(dict):
    """text -> ids as uint16 bytes, through a bounded cache of blank-separated units.

    Byte-level BPE never merges across the parts of its split pattern, and a single blank
    before other text always starts a part. So " unit" has the same ids in any text, unless
    white space follows a blank; such a text is encoded whole, and one with unusual characters
    or special strings is left to the tokenizer itself. ``ranks`` is the same vocabulary for
    the faster of the two public encoders; both give equal ids on plain characters.
    """

    def __init__(self, tokenizer_json: str, ranks: bytes, pattern: str):
        self.source = tokenizer_json, ranks, pattern

    def __reduce__(self):
        return Encoder, self.source

    def ready(self) -> Encoder:
        """Set up once in each worker; the cache serves all its tasks."""
        if not hasattr(self, "tok"):
            import tiktoken
            from tokenizers import Tokenizer

            tokenizer_json, ranks, pattern = self.source
            self.tok = Tokenizer.from_str(tokenizer_json)
            if self.tok.get_vocab_size() > 1 << 16:
                raise ValueError("ids need more than 16 bits")
            order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=order, special_tokens={}).encode_ordinary
            self.plain = re.compile(PLAIN).fullmatch
            self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        return self

    def __missing__(self, unit: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        out = array("H", self.fast(" " + unit)).tobytes()
        if len(unit) < 64:
            self[unit] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain(text) or any(s in text for s in self.special):
            return array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if _WHITE.search(text):
            return array("H", self.fast(text)).tobytes()
        first, *units = text.split(" ")
        return array("H", self.fast(first)).tobytes() + b"".join(map(self.__getitem__, units))


def encoder(tokenizer_file: str, ranks_file: str, pattern: str) -> Encoder:
    with open(tokenizer_file, encoding="utf-8") as a, open(ranks_file, "rb") as b:
        return Encoder(a.read(), b.read(), pattern)


def encoded(docs: DataFrame, path: str, tokenizer_file: str, ranks_file: str, pattern: str, id_col: str, text_col: str, end: int = END) -> DataFrame:
    """Pass 1: (part, at, id, n, ids) written to ``path``."""
    spark = docs.sparkSession
    source = share(spark, encoder(tokenizer_file, ranks_file, pattern))
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    tail = np.array([end], "<u2").tobytes()

    def run(batches):
        enc, part, at = source.value.ready(), TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, 500):
                ids = [enc.encode(t.as_py()) + tail for t in b.column(1)[k:k + 500]]
                n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
                yield batch_of(schema, [np.full(len(n), part), at + np.cumsum(n) - n, b.column(0)[k:k + 500], n, ids])
                at += int(n.sum())

    out = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "part int, at long, id long, n long, ids binary")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids as well."""
    spark = docs.sparkSession
    ids = encoded(docs, scratch_path(spark, "token-ids"), tokenizer_file, ranks_file, pattern, id_col, text_col, end)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row a partition
    if len(totals) > PARTS:
        raise ValueError(f"{len(totals)} partitions: read the documents in larger splits")
    size = np.zeros(max((r.part for r in totals), default=-1) + 1, np.int64)
    for r in totals:
        size[r.part] = r.n
    base = share(spark, np.cumsum(size) - size)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        for b in batches:
            out = []
            for part, at, i, n, raw in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                wide = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4").tobytes()
                first = int(base.value[part]) + at
                start = 0
                while start < n:
                    seq, off = divmod(first + start, length)
                    stop = min(n, start + length - off)
                    piece = wide[4 * start:4 * stop]
                    out.append((i, start, stop - start, zlib.crc32(piece), n, seq, off, piece))
                    start = stop
                if len(out) > 2000:
                    yield batch_of(schema, list(zip(*out, strict=True)))
                    out = []
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    kinds = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ids.mapInArrow(cut, kinds).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame) -> DataFrame:
    """With the public tokenizer of the contract; the ids stay in the operator's output."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"))
