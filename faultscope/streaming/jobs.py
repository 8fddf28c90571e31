"""Structured Streaming forms of the batch operators.

Every function maps a streaming DataFrame to a streaming DataFrame. Event time is the timestamp column ``ts``. Machines with
memory wait until the watermark has passed a row, so the result does not depend on
how rows are dealt to files and batches.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import idiv
from ..session import scratch_path

# Executors get the state functions with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def run_to_table(stream: DataFrame, label: str, checkpoint: str | None = None, path: str | None = None, mode: str = "append") -> DataFrame:
    """Drive a stream over all available input into a Parquet table and read it back.

    The checkpoint and the table live in the shared folder; a rerun with the same
    two paths continues after the last committed batch. State is kept in RocksDB, on disk.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, f"{label}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{label}-ckpt")
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(path)


def arrival_files(df: DataFrame, path: str, order, batches: int, files: int = 2, first: int = 0, last: int | None = None) -> str:
    """Write a table as it would arrive: ``batches`` groups of ``files`` files, one group after the other.

    ``order`` is the number of the group of each row (0 .. batches - 1); groups ``first .. last`` are written.
    """
    for b in range(first, batches if last is None else last + 1):
        df.where(order == b).repartition(files).write.mode("append").parquet(path)
    return path


def read_events(spark: SparkSession, base: str, schema: T.StructType, glob: str = "events.parquet", files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """Files as a stream; micro-batches are cut by number of files or by bytes (``"512m"``), not by both."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        r = r.option("maxBytesPerTrigger", bytes_per_batch)
    return r.parquet(base)


# ---- windows and sessions (built-in state) -------------------------------------------

def stream_bins(src: DataFrame, step: str, delay: str, keys=("entity",), metric: str = "value") -> DataFrame:
    """Tumbling mean, std and count per entity; closed windows only."""
    return (src.withWatermark("ts", delay).groupBy(*keys, F.window("ts", step))
            .agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(metric).alias("n"))
            .select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "std", "n"))


def stream_episodes(src: DataFrame, gap: str, delay: str, keys=("entity", "code")) -> DataFrame:
    """Closed fault sessions; a row exactly one gap later still belongs to the session."""
    return (src.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap))
            .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("observations"))
            .select(*keys, "start_ts", "end_ts", "observations"))


def stream_counts(src: DataFrame, length: str, slide: str, delay: str, keys=("entity",)) -> DataFrame:
    """Sliding event counts per entity."""
    return (src.withWatermark("ts", delay).groupBy(*keys, F.window("ts", length, slide)).agg(F.count("*").alias("n"))
            .select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n"))


def stream_dedup(src: DataFrame, delay: str, keys: list[str]) -> DataFrame:
    """First row per key within the watermark delay."""
    return src.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_matured(scores: DataFrame, onsets: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Scores leave with their label once ``(t, t + horizon]`` has passed the watermark."""
    s = scores.withWatermark("ts", delay)
    o = onsets.select(F.col("entity").alias("o_entity"), F.col("ts").alias("onset_ts")).withWatermark("onset_ts", delay)
    cond = F.expr(f"entity = o_entity AND onset_ts > ts AND onset_ts <= ts + INTERVAL {horizon}")
    return s.join(o, cond, "left_outer").select(*scores.columns, "onset_ts")


def stream_topk(scores: DataFrame, length_us: int, k: int, delay: str, salts: int = 8) -> DataFrame:
    """The best rows of every window of ``length_us``, given out once, when the watermark has closed it.

    ``scores`` has ``ts, t, score, item``; equal scores prefer the smaller item. A window is kept
    as ``salts`` lists of at most ``k`` rows, so neither state nor task grows with its rows; the
    final Top-K of a window is taken among its ``salts * k`` rows when the table is read.
    """

    def run(key, pdfs, state: GroupState):
        score, item = state.get if state.exists else ([], [])
        best = list(zip(score, item))
        if not state.hasTimedOut:
            for pdf in pdfs:
                best = sorted([*best, *zip(pdf["score"].tolist(), pdf["item"].tolist())], key=lambda x: (-x[0], x[1]))[:k]
        if (key[0] + length_us) // 1000 <= state.getCurrentWatermarkMs():
            state.remove()
            yield pd.DataFrame([(key[0], s, i) for s, i in best], columns=["start", "score", "item"])
        else:
            state.update(([float(s) for s, _ in best], [int(i) for _, i in best]))
            state.setTimeoutTimestamp(max((int(key[0]) + length_us) // 1000 - 1, state.getCurrentWatermarkMs() + 1))

    d = scores.withWatermark("ts", delay).withColumns({"start": idiv("t", length_us) * F.lit(length_us), "salt": F.pmod(F.xxhash64("item"), F.lit(salts))})
    return d.groupBy("start", "salt").applyInPandasWithState(run, "start bigint, score double, item bigint", "score array<double>, item array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


# ---- custom state --------------------------------------------------------------------
#
# Each machine below keeps the rows that the watermark has not passed in RocksDB and runs over
# the rows behind it in the order of time. So late rows inside the delay take their place, and
# the result does not depend on how the input is cut into files or batches. A timer releases
# what is held when no more rows come; rows later than the delay are dropped by Spark.
#
# Every access to the state is a round trip between Python and the JVM, and so is every call of
# a machine. So the key is one of ``BUCKETS`` hash buckets of entities, not an entity: a bucket
# reads and writes the memories of its entities and its held rows as one value, once a
# micro-batch. Of held rows only ``LOOSE`` lie in that value; more are cut into chunks of event
# time in a map and released one chunk after the other (``width`` sets the chunk). What a task
# holds at once is one Arrow batch, ``LOOSE`` rows, the rows of one bucket in one chunk and the
# memories of a bucket, never the rows of an entity in a micro-batch.

WIDTH, BUCKETS, LOOSE = 600_000_000, 2048, 65_536
I64, F64 = np.dtype(np.int64), np.dtype(np.float64)


def hold(held, t: np.ndarray, v: np.ndarray, width: int, part: int, *ids: np.ndarray) -> None:
    """Put one Arrow batch of rows into the state, a part for each time chunk it touches."""
    chunk = t // width
    order = np.argsort(chunk, kind="stable")
    keys, starts = np.unique(chunk[order], return_index=True)
    for c, at in zip(keys.tolist(), np.split(order, starts[1:])):
        held.updateValue((c, part), tuple(x[at].tobytes() for x in (t, v, *ids)))


def in_order(t: np.ndarray, v: np.ndarray, *ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """By time, then value, NaN last."""
    order = np.lexsort((v, np.isnan(v), t))
    return tuple(x[order] for x in (t, v, *ids))


def columns(parts) -> tuple[np.ndarray, ...]:
    """The columns of held parts: times, values and, if they were put in, ids."""
    kinds = (I64, F64, I64)
    return tuple(np.concatenate([np.frombuffer(x, k) for x in xs]) for xs, k in zip(zip(*parts), kinds))


def release(held, mark: int, width: int, part: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows up to ``mark`` leave the state in the order of (time, value, NaN last), a chunk at a time."""
    due: dict[int, list[tuple]] = {}
    for c, p in held.keys():
        if c * width <= mark:
            due.setdefault(c, []).append((c, p))
    for c in sorted(due):
        parts = [held.getValue(k) for k in due[c]]
        rows = in_order(*columns(parts))
        cut = int(np.searchsorted(rows[0], mark, "right"))
        if cut == 0 and len(parts) == 1:
            continue
        for k in due[c]:
            held.removeKey(k)
        if cut < len(rows[0]):
            held.updateValue((c, part), tuple(x[cut:].tobytes() for x in rows))
        if cut:
            yield tuple(x[:cut] for x in rows)


class Machine(StatefulProcessor):
    """``step(memory, t, v) -> (memory, output rows)`` over each entity's rows in the order of time.

    ``start`` is the memory before the first row, of plain values and lists. ``step(memory, None,
    watermark)`` is asked once the rows are done, to close what the watermark has closed; it
    returns a third value, the time in microseconds to be asked again, or None.
    """

    def __init__(self, key: str, value: str | None, step: Callable, start: tuple, names: list[str], width: int, loose: int):
        self.key, self.value, self.step, self.start, self.names, self.width, self.loose = key, value, step, start, names, width, loose

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "memory string, part bigint, due bigint, cut boolean, t binary, v binary, id binary")
        self.held = handle.getMapState("held", "chunk bigint, part bigint", "t binary, v binary, id binary")

    def handleInputRows(self, key, rows, timerValues):
        return self.advance(key, rows, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self.advance(key, (), timerValues.getCurrentWatermarkInMs(), True)

    def released(self, loose: tuple[np.ndarray, ...], cut: bool, mark: int, part: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows up to ``mark`` in the order of time: of the sorted loose ones, or of the chunks."""
        if cut:
            yield from release(self.held, mark, self.width, part)
        elif n := int(np.searchsorted(loose[0], mark, "right")):
            yield tuple(x[:n] for x in loose)

    def advance(self, key, pdfs, mark_ms: int, fired: bool) -> Iterator[pd.DataFrame]:
        text, part, due, cut, *rows = self.state.get() or ("[]", 0, -1, False, b"", b"", b"")
        memories, loose = dict(json.loads(text)), columns([rows])
        if fired:
            due = -1
        for pdf in pdfs:
            t = pdf["t"].to_numpy(dtype=np.int64)
            v = pdf[self.value].to_numpy(dtype=float) if self.value else np.zeros(len(pdf))
            ids = np.zeros(len(pdf), np.int64) if key[1] else pdf[self.key].to_numpy(dtype=np.int64)
            if not cut and len(loose[0]) + len(t) <= self.loose:
                loose = tuple(np.concatenate(x) for x in zip(loose, (t, v, ids)))
                continue
            if len(loose[0]):
                hold(self.held, *loose[:2], self.width, part, loose[2])
                part, loose = part + 1, tuple(x[:0] for x in loose)
            hold(self.held, t, v, self.width, part, ids)
            part, cut = part + 1, True
        loose = in_order(*loose)
        mark, done = mark_ms * 1000, []
        for t, v, ids in self.released(loose, cut, mark, part):
            for at, x, i in zip(t.tolist(), v.tolist(), ids.tolist()):
                memories[i], more = self.step(memories.get(i, self.start), at, x)
                if more:
                    done += [(i, *r) for r in more]
            if len(done) >= 10_000:
                yield self.frame(key, done)
                done = []
        part, wake = part + 1, []
        for i in memories:
            memories[i], more, again = self.step(memories[i], None, mark)
            done += [(i, *r) for r in more]
            if again is not None:
                wake.append(again)
        if done:
            yield self.frame(key, done)
        if cut:
            first = min((c for c, _ in self.held.keys()), default=None)
            cut = first is not None
            wake += [first * self.width - 1000] if cut else []
        else:
            left = loose[0] > mark
            loose = tuple(x[left] for x in loose)
            wake += [int(loose[0][0]) - 1] if len(loose[0]) else []
        next_due = max(min(wake) // 1000, mark_ms + 1) if wake else -1  # fires once the watermark is past it; one at or before it never does
        if next_due != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            if next_due >= 0:
                self.handle.registerTimer(next_due)
        self.state.update((json.dumps(list(memories.items())), part, next_due, cut, *[x.tobytes() for x in loose]))

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        d = pd.DataFrame(rows, columns=self.names)
        return d.assign(**{self.names[0]: pd.array([None] * len(d), "Int64")}) if key[1] else d


def _machine(src: DataFrame, key: str, value: str | None, step: Callable, start: tuple, out: str, delay: str, width: int = WIDTH, buckets: int = BUCKETS, loose: int = LOOSE) -> DataFrame:
    """``out`` begins with the key, a bigint; rows without a key are a key of their own."""
    names = [c.split()[0] for c in out.split(",")]
    wanted = src.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).isNull().alias("absent"), key, "ts", "t", *([value] if value else [])).withWatermark("ts", delay)
    return wanted.groupBy("bucket", "absent").transformWithStateInPandas(Machine(key, value, step, start, names, width, loose), out, "append", "EventTime")


LEDGER_OUT = "entity bigint, code bigint, onset_t bigint, end_t bigint, uncertain_onset boolean, close_reason string"


def stream_ledger(src: DataFrame, gap_us: int, delay: str) -> DataFrame:
    """Episode state machine per entity: ``src`` has ``entity, ts, t, code`` (NULL = not observed).

    Closed episodes are emitted as they close. If no observed row follows within ``gap``, the
    episode ends as a ``time_gap``: by an event-time timer once the watermark is there, or by
    the next row if that is released first; both give the same episode.
    """

    def step(memory, t, c):
        code, start, last, unc, missing = memory
        if t is None:
            if code > 0 and (last + gap_us) // 1000 + 1 <= c // 1000:
                return [-1, 0, 0, False, missing], [(code, start, last, unc, "time_gap")], None
            return memory, [], last + gap_us if code > 0 else None
        done = []
        ok = c == c and c >= 0 and c == int(c)
        if ok:
            if code > 0 and (c != code or t - last > gap_us):
                why = "time_gap" if t - last > gap_us else "observed_zero" if c == 0 else "repeat_timeout_or_code_change"
                done.append((code, start, last, unc, why))
                code = -1
            if c > 0:
                if code <= 0:
                    code, start, unc = int(c), t, bool(missing)
                last = t
        return [int(code), int(start), int(last), bool(unc), not ok], done

    return _machine(src, "entity", "code", step, (-1, 0, 0, False, True), LEDGER_OUT, delay)


def stream_inertia(src: DataFrame, gamma: float, half_life_hours: float, delay: str, reset_us: int = 24 * 3_600_000_000) -> DataFrame:
    """Blend with the memory from strictly before, then update; ``src`` has ``entity, ts, t, z`` (logit scores).

    Repeated times of an entity count once (the smallest value).
    """
    h = half_life_hours * 3_600_000_000

    def step(memory, t, z):
        m, last = memory
        if t is None:
            return memory, [], None
        if 0 <= last and t <= last:
            return memory, []
        if last < 0 or t - last >= reset_us:
            return [float(z), t], [(t, z)]
        rho = 2.0 ** (-(t - last) / h)
        return [rho * m + (1 - rho) * z, t], [(t, (z + gamma * m) / (1 + gamma))]

    return _machine(src, "entity", "z", step, (0.0, -1), "entity bigint, t bigint, blended double", delay)


def stream_alerts(src: DataFrame, threshold: float, required: int, window: int, cooldown: int, delay: str) -> DataFrame:
    """Alert when ``required`` of the last ``window`` scores, by time, reach the threshold and the cooldown is over."""
    if not 1 <= required <= window:
        raise ValueError("required must lie in 1..window")

    def step(memory, t, s):
        flags, n, last = memory
        if t is None:
            return memory, [], None
        flags = [*flags, int(s >= threshold)][-window:]
        hit = sum(flags) >= required and n - last >= cooldown
        return [[int(f) for f in flags], n + 1, n if hit else last], [(t,)] if hit else []

    return _machine(src, "entity", "score", step, ([], 0, -cooldown), "entity bigint, t bigint", delay)


def stream_gaps(src: DataFrame, step_us: int, delay: str, key: str = "entity") -> DataFrame:
    """Recording gaps and the longest missing run so far, in the order of time."""

    def step(memory, t, _):
        last, longest = memory
        if t is None:
            return memory, [], None
        done = []
        if last >= 0 and t - last > step_us:
            longest = max(longest, (t - last) // step_us - 1)
            done.append((last, t, (t - last) // step_us - 1, longest))
        return [t, longest], done

    return _machine(src, key, None, step, (-1, 0), f"{key} bigint, gap_start bigint, gap_end bigint, missing_rows bigint, longest bigint", delay)
