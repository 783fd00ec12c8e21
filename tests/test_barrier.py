"""The barrier's state: it ends, and a stream that starts anew releases nothing twice."""

import pytest
from pyspark.sql import functions as F

from rollcall.streaming import outcomes as so

SCHEMA = "job_id long, slice_key string, state string, ts timestamp, event_id long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, held) if held else spark.conf.unset(name)


def run(spark, tmp_path, batches, tag="a", **options):
    """Feeds batches of (job, slice, second), out of order within and across them; the released rows and the state rows after each batch."""
    source, out, check = (str(tmp_path / f"{tag}-{x}") for x in ("in", "out", "check"))
    held, number = [], 0
    for batch in batches:
        rows = [(j, s, "done", at, number + i) for i, (j, s, at) in enumerate(batch)]
        number += len(rows)
        spark.createDataFrame(rows, "job_id long, slice_key string, state string, at long, event_id long").select(
            "job_id", "slice_key", "state", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")).alias("ts"), "event_id").write.mode("append").parquet(source)
        stream = so.completion_barrier(so.read_outcomes(spark, source, SCHEMA), 2, seconds=100, **options)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    return sorted((r.job_id, r.done, r.failed, r.complete) for r in spark.read.parquet(out).collect()), held


def test_state_of_released_jobs_ends(rocks, tmp_path):
    batches = [[(j, s, 1000 * k + j) for j in range(10 * k, 10 * k + 10) for s in "ab"] for k in range(5)]
    released, ended = run(rocks, tmp_path, batches, "ends", keep_seconds=200)
    assert released == [(j, 2, 0, True) for j in range(50)]
    same, grown = run(rocks, tmp_path, batches, "stays")
    assert same == released and max(ended) < grown[-1] and ended[-1] <= ended[0] * 2


def test_late_outcomes_within_the_delay_count_and_later_ones_release_nothing_twice(rocks, tmp_path):
    batches = [[(1, "a", 50), (2, "a", 0), (2, "b", 10)], [(1, "b", 20), (2, "b", 30), (3, "a", 90)], [(4, "a", 500)], [(2, "a", 60), (4, "b", 520)], [(5, "a", 900)]]
    released, _ = run(rocks, tmp_path, batches, late="100 seconds", keep_seconds=1000)
    assert [r for r in released if r[0] in (1, 2, 4)] == [(1, 2, 0, True), (2, 2, 0, True), (4, 2, 0, True)] and (3, 1, 1, False) in released


def test_a_stream_that_starts_anew_knows_what_was_released(rocks, tmp_path):
    known = rocks.createDataFrame([(1, 1_700_000_000)], "job_id long, s long").select("job_id", F.timestamp_seconds("s").alias("started"))
    released, _ = run(rocks, tmp_path, [[(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 1)]], known=known, keep_seconds=300)
    assert released == [(2, 2, 0, True)]
