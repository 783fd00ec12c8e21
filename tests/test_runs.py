"""Stored runs: what is read is what was written, and run meets run as the files lie."""

import io
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.errors import AnalysisException

from rollcall.operators import audit, jobs
from rollcall.sources import runs
from rollcall.sources.parts import shared_path

SCHEMA, KEYS = "doc_id long, bucket string, number long, text string", ["doc_id", "bucket", "number"]


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_two_runs_meet_without_an_exchange(spark):
    first = [(d, b, n, f"{d}{b}{n}") for d in range(30) for b in "xy" for n in range(4)] + [(None, "x", 1, "a"), (3, None, 1, None)]
    second = [r for r in first if r[0] != 5] + [(99, "x", 0, "new")]
    second[7] = (*second[7][:3], "other")
    paths = [shared_path(spark, "run") for _ in range(2)]
    for path, rows in zip(paths, (first, second), strict=True):
        runs.write_run(spark.createDataFrame(rows, SCHEMA), path, KEYS)
    a, b = (runs.open_run(spark.newSession(), p) for p in paths)
    assert Counter(map(tuple, a.collect())) == Counter(first) and a.dtypes == [("doc_id", "bigint"), ("bucket", "string"), ("number", "bigint"), ("text", "string")]
    a, b = (runs.open_run(spark, p) for p in paths)
    diff = audit.diff_runs(a, b, KEYS, ["text"])
    assert "Exchange" not in plan_of(diff)
    plain = audit.diff_runs(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA), KEYS, ["text"])
    got = Counter(map(tuple, diff.collect()))
    assert got == Counter(map(tuple, plain.collect())) and Counter(k[-1] for k in got) >= Counter({"removed": 8, "added": 1, "changed": 1})


def test_known_hashes_and_inventories_are_read_as_they_lie(spark, no_broadcast):
    store = spark.createDataFrame([(i, f"h{i}", 1990) for i in range(0, 50, 2)], "doc_id long, hash string, since_year int")
    path = shared_path(spark, "run")
    runs.write_run(store, path, ["doc_id", "hash"])
    docs = spark.createDataFrame([(i, f"h{i}" if i % 3 else "new", None) for i in range(50)], "doc_id long, hash string, since_year int")
    plan = jobs.plan_reprocess(docs, runs.open_run(spark, path), "doc_id")
    assert plan_of(plan).count("Arguments: hashpartitioning") == 1  # that of the new documents
    assert {r.doc_id for r in plan.collect() if r.action == "reuse"} == {i for i in range(0, 50, 2) if i % 3}
    paths = [shared_path(spark, "run") for _ in range(2)]
    for p, rows in zip(paths, ([(1, "a", 2)], [(1, "a", 3), (2, "a", 2)]), strict=True):
        runs.write_run(spark.createDataFrame(rows, "doc_id long, key string, copies long"), p, ["doc_id", "key"])
    new = audit.new_duplicates(*(runs.open_run(spark, p) for p in paths), ["doc_id", "key"])
    assert "Exchange" not in plan_of(new) and [tuple(r) for r in new.select("doc_id", "key", "copies").collect()] == [(2, "a", 2)]


def test_broken_empty_and_repeated_runs(spark):
    path = shared_path(spark, "run")
    spark.createDataFrame([(1, "x", 1, "t")], SCHEMA).write.parquet(f"{path}/rows")  # broken off before the last step
    with pytest.raises(AnalysisException):
        runs.open_run(spark, path)
    path = shared_path(spark, "run")
    runs.write_run(spark.createDataFrame([], SCHEMA), path, KEYS)
    assert runs.open_run(spark, path).count() == 0
    with pytest.raises(AnalysisException):
        runs.write_run(spark.createDataFrame([], SCHEMA), path, KEYS)
