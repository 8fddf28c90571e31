"""Exact dedup: stateful streaming over digests, full bytes checked on hits. DataFrame code only.

The documents are first written as a narrow feed (id, digest, locator). A Structured
Streaming query reads the feed and keeps one state row per digest in RocksDB, without
watermark or expiry: largest id, its locator (the row's place in the feed) and the
number of rows. The state is read back with Spark's state reader, so no row passes the
driver. Rows whose digest was met more than once are then compared by their full
normalised text; digests that stand for several texts are grouped by the texts
themselves.

Hot groups: the streaming aggregate combines map-side before its shuffle, the joins
put the state on the side with one row a digest, and the byte check aggregates by text
map-side, so copies of one text meet as one row a task.

Edge cases: null text is empty; a null id is the smallest; of repeated rows with one id
one row stays (locator); very long texts are compared whole; other columns are ignored; an
empty table gives no rows. The id -2^63 stands for null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from .common import ascii_lower, back_to_id, id_of

#: Disk-backed state; without preallocation, which takes megabytes for each of many small stores.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(feed_path: str, like: DataFrame, trigger_bytes: int | None = None, files: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """(digest, keep_id, keep_at, group_size) after all files of the feed went through the stream.

    Called again with the same ``checkpoint`` after new files arrived, it goes on from the stored state.
    """
    spark = like.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    reader = spark.readStream.schema(like.schema)
    if files or trigger_bytes:  # Spark takes one of the two
        reader = reader.option(*(("maxFilesPerTrigger", files) if files else ("maxBytesPerTrigger", trigger_bytes)))
    state = reader.parquet(feed_path).groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.max_by("at", "id").alias("keep_at"), F.count(F.lit(1)).alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    kept = spark.read.format("statestore").load(checkpoint)
    fields = kept.schema["value"].dataType.fieldNames()  # buffers in the order of the aggregates: max, (value, ordering), count
    return kept.select("key.digest", F.col("value")[fields[0]].alias("keep_id"), F.col("value")[fields[1]].alias("keep_at"), F.col("value")[fields[3]].alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256,
                trigger_bytes: int | None = 64 << 30, files: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    norm = ascii_lower(F.col(text_col))
    feed_path = scratch_path(spark, "dedup-feed")
    narrow = docs.select(id_of(id_col).alias("id"), digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), F.monotonically_increasing_id().alias("at"))
    narrow.write.parquet(feed_path)
    feed = spark.read.schema(narrow.schema).parquet(feed_path)
    state = keyed_state(feed_path, feed, trigger_bytes, files)
    hits = state.where("group_size > 1").select("digest")
    # Full bytes of every hit; grouped by text, so that copies combine before they move.
    texts = (docs.select(digest(norm).alias("digest"), norm.alias("norm")).join(hits, "digest", "left_semi")
             .groupBy("norm").agg(F.first("digest").alias("digest")))
    mixed = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    if mixed.isEmpty():
        out = feed.join(state, "digest", "left")
    else:
        out = by_bytes(docs, feed, state, mixed, id_col, norm, digest)
    return out.select(back_to_id("id").alias(id_col), back_to_id("keep_id").alias("keep_id"), "group_size",
                      (F.col("at") == F.col("keep_at")).alias("kept"), "text_sha256")


def by_bytes(docs: DataFrame, feed: DataFrame, state: DataFrame, mixed: DataFrame, id_col: str, norm: Column, digest) -> DataFrame:
    """The same rows when a digest stands for several texts: those digests are grouped by text.

    No digest decides here. Copies of a row (same id, same text) are counted and written out again, the first one stays.
    """
    clear = feed.join(mixed, "digest", "left_anti").join(state, "digest")
    full = docs.select(id_of(id_col).alias("id"), digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), norm.alias("norm")).join(mixed, "digest", "left_semi")
    rows = full.groupBy("norm", "id").agg(F.count(F.lit(1)).alias("n"), F.first("digest").alias("digest"), F.first("text_sha256").alias("text_sha256"))
    groups = rows.groupBy("norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    rest = rows.join(groups, "norm").withColumn("at", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    rest = rest.withColumn("keep_at", F.when(F.col("id") == F.col("keep_id"), 1).otherwise(0).cast("bigint"))
    cols = ["id", "digest", "text_sha256", "at", "keep_id", "keep_at", "group_size"]
    return clear.select(cols).unionByName(rest.select(cols))
