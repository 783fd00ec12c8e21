"""Slice outcomes as a stream: repeats dropped, progress counted, and jobs released once when they are ready."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SECONDS = 620
KEYS = ["job_id", "slice_key"]
RELEASED = "job_id long, done long, failed long, complete boolean"


def read_outcomes(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """A stream over Parquet files of outcomes; files: how many a batch takes at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def first_outcomes(stream: DataFrame, late: str = "30 days", at: str = "ts") -> DataFrame:
    """The first outcome of each (job, slice); a repeated delivery is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(KEYS)


def progress(stream: DataFrame, width: str = "30 days", late: str = "30 days", at: str = "ts") -> DataFrame:
    """Outcomes of each state in windows of event time, for update mode."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "state", "n")


def live_slices(due: DataFrame, outcomes: DataFrame, seconds: int = SECONDS, late: str = "0 seconds") -> DataFrame:
    """What is known of each slice that is due, as soon as it is: job_id, slice_key, started, ts and state (done, failed or stale).

    due: a stream of job_id, slice_key, started; outcomes: one of job_id, slice_key, state, ts.  A stream-stream outer join over the range in which an
    outcome counts, from the start to so many seconds later: a slice without one turns stale once the watermark has passed its
    range, and both sides' state goes then.  Slices that the sink doesn't hold yet are pending.
    """
    a = due.select("job_id", "slice_key", "started").withWatermark("started", late)
    b = outcomes.select(F.col("job_id").alias("_job"), F.col("slice_key").alias("_slice"), "state", "ts").withWatermark("ts", late)
    within = (F.col("ts") >= F.col("started")) & (F.col("ts") <= F.col("started") + F.expr(f"interval {seconds} seconds"))
    both = a.join(b, (F.col("job_id") == F.col("_job")) & (F.col("slice_key") == F.col("_slice")) & within, "leftOuter")
    return both.select("job_id", "slice_key", "started", "ts", F.coalesce("state", F.lit("stale")).alias("state"))


class Barrier(StatefulProcessor):
    """Holds a job until each of its slices has an outcome, or its time is up; then releases it once.

    The first outcome of a slice counts.  A job's time starts with its first outcome, and outcomes later than its end don't
    count, in whatever batch they come.  That a job is released is kept for ``keep`` milliseconds of event time after its end, so that what comes
    until then changes nothing; then all of its state goes, and with it the job.
    """

    expected: int = 5
    millis: int = SECONDS * 1000
    keep: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "slice_key string", "state string")
        self.released = handle.getValueState("released", "released boolean")
        self.started = handle.getValueState("started", "at long")

    def _release(self, key) -> Iterator[pd.DataFrame]:
        states = [v[0] for v in self.slices.values()]
        done = sum(s == "done" for s in states)
        self.released.update((True,))
        self.slices.clear()
        if self.keep is not None:
            self.handle.registerTimer(self.started.get()[0] + self.millis + self.keep)
        yield pd.DataFrame({"job_id": [key[0]], "done": [done], "failed": [self.expected - done], "complete": [len(states) >= self.expected]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        if self.released.exists():
            return
        start = self.started.get()[0] if self.started.exists() else None
        for r in pd.concat(frames).sort_values(["at", "event_id"], kind="stable").itertuples():
            if start is None:
                start = int(r.at)
                self.started.update((start,))
                self.handle.registerTimer(start + self.millis)
            if r.at > start + self.millis:
                yield from self._release(key)
                return
            if not self.slices.containsKey((r.slice_key,)):
                self.slices.updateValue((r.slice_key,), (r.state,))
        if len(list(self.slices.keys())) >= self.expected:
            yield from self._release(key)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        start = int(initialState["at"].min())
        self.started.update((start,))
        self.released.update((True,))
        if self.keep is not None:
            self.handle.registerTimer(start + self.millis + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.released.exists():
            yield from self._release(key)
        elif self.keep is not None and expiredTimerInfo.getExpiryTimeInMs() >= self.started.get()[0] + self.millis + self.keep:
            self.released.clear()
            self.started.clear()

    def close(self) -> None:
        pass


def completion_barrier(
    stream: DataFrame, expected: int, late: str = "0 seconds", seconds: int = SECONDS, keep_seconds: int | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """One row for each job that is ready: job_id, done, failed, complete.  Needs the RocksDB state store.

    keep_seconds: for how long after a job's end its release is remembered (None: for ever); it has to cover how late outcomes of a job
    come, as one that comes later begins a new job.  State is then bounded by the jobs of that time.  known: a batch snapshot of jobs released before, job_id
    and started; a stream without a checkpoint, as after a restart from scratch, begins with them as released.

    stream: job_id, slice_key, state, ts, event_id.  Slices without an outcome in time count as failed.  A timer is set by the first
    outcome's own time and fires as the watermark passes it, so the last jobs of a finite stream are released by close_open_jobs.
    """
    kind = type("BarrierOf", (Barrier,), {"expected": expected, "millis": seconds * 1000, "keep": None if keep_seconds is None else keep_seconds * 1000})
    before = None if known is None else known.select("job_id", F.unix_millis("started").alias("at")).groupBy("job_id")
    return stream.withWatermark("ts", late).withColumn("at", F.unix_millis("ts")).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=kind(), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime", initialState=before)


def close_open_jobs(outcomes: DataFrame, released: DataFrame, expected: int, seconds: int = SECONDS) -> DataFrame:
    """The closing pass over a finite log: jobs that the barrier has not released, with what they had in time."""
    open_ = outcomes.join(released.select("job_id"), "job_id", "left_anti").withColumn("at", F.unix_millis("ts"))
    starts = open_.groupBy("job_id").agg(F.min("at").alias("_start"))
    timely = open_.join(starts, "job_id").filter(F.col("at") <= F.col("_start") + seconds * 1000)
    first = timely.groupBy(*KEYS).agg(F.min_by("state", F.struct("at", "event_id")).alias("state"))
    jobs = first.groupBy("job_id").agg(F.count_if(F.col("state") == "done").alias("done"), F.count(F.lit(1)).alias("_slices"))
    return jobs.select("job_id", "done", (F.lit(expected) - F.col("done")).cast("long").alias("failed"), (F.col("_slices") >= expected).alias("complete"))


def finalize(stream: DataFrame, merge: Callable[[DataFrame], DataFrame], status: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Merges each batch of released jobs into a partition of its own, and writes the jobs' status last.

    A repeated batch overwrites its own partitions, so it changes nothing; a batch that failed between the two writes has no
    status and is not read.
    """

    def write(batch: DataFrame, number: int) -> None:
        merge(batch).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        status(batch).write.mode("overwrite").parquet(f"{path}/status/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_final(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results and status of each job, as its last batch with a status left them."""
    status = spark.read.parquet(f"{path}/status")
    last = status.groupBy("job_id").agg(F.max("batch").alias("batch"))
    return tuple(df.join(last, ["job_id", "batch"]).drop("batch") for df in (spark.read.parquet(f"{path}/results"), status))
