"""Small helpers shared by the operators: word rules, sinks, per-batch tasks."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id wherever ids are compared: a null id is the smallest.
NO_ID = -(2**63)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Pure ASCII rows take Spark's byte path."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def id_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def back_to_id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def words(text: str | None) -> list[bytes]:
    r"""``[^\x20\x09-\x0D]+`` on UTF-8: bytes.split() cuts at exactly these six bytes."""
    return text.encode().split() if text else []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once under spark.checkpoint.dir and read back: survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class _ByValue:
    """Pickles as its object with classes by value: executors need not have this package."""

    def __init__(self, obj):
        self.obj = obj

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(self.obj),)


def share(spark: SparkSession, obj):
    """Broadcast of an object of bounded size; ``value`` is set up once in each worker."""
    return spark.sparkContext.broadcast(_ByValue(obj))


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]):
    """mapInArrow function from ``make``, which is called once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None and out.num_rows:
                yield out

    return run


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PUNCT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: str | None) -> list[bytes]:
    r"""A-Z lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: one translate and one split."""
    return text.encode().translate(_PUNCT).split() if text else []


def plain_word_spans(text: str) -> list[tuple[int, int]]:
    """Byte spans of plain_words in the UTF-8 text."""
    return [m.span() for m in _WORD.finditer(text.encode().lower())]
