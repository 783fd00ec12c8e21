"""Stored parts, purging, attempts, live slices and many patterns at once."""

import io
import random
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from rollcall.operators import audit, fuzzy, jobs, matching
from rollcall.plans.consolidate import merge_results
from rollcall.plans.queries import LIVE_NOW, QUERIES, saved
from rollcall.sources import files, ingest, parts
from rollcall.streaming import outcomes as so


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


BODY = '{"metadata": {"name": "A"}, "sections": {"books": [{"citation": "b1"}, 7], "awards": ["x", " "], "grants": {"no": "list"}, "specialization": " s "}, "gaps": [{"section": "g"}]}'
ROWS = [(1, 1, BODY), (1, 2, "```json\n" + BODY + "\n```"), (2, 1, "[1]"), (3, 1, "no"), (4, 1, None), (None, 1, BODY), (5, 1, '{"sections": 3}'), (6, 1, '{"sections": {"books": [null, {"citation": {}}]}, "gaps": 4}')]


@pytest.fixture(scope="module")
def stored(spark):
    return parts.stored(spark.createDataFrame(ROWS, "doc_id long, part long, body string"))


def test_stored_parts_hold_what_the_bodies_say(spark, stored):
    assert Counter((r.doc_id, r.problem, r.refused) for r in stored.collect()) == Counter({
        (1, None, None): 2, (2, "not an object", "[1]"): 1, (3, "not JSON", "no"): 1, (4, "not JSON", None): 1, (None, None, None): 1, (5, None, None): 1, (6, None, None): 1})
    books = ingest.publication_rows(parts.elements(stored, ("books", "grants")))
    assert sorted((r.doc_id or 0, r.part, r.pos, r.citation) for r in books.collect()) == [(0, 1, 0, "b1"), (1, 1, 0, "b1"), (1, 2, 0, "b1")]
    assert Counter(r.doc_id for r in ingest.gap_rows(parts.listed(stored, "gaps")).collect()) == {1: 2, None: 1}
    assert {(r.doc_id, r.name, r.specialization) for r in parts.metadata(stored).collect()} == {(1, "A", "s"), (None, "A", "s"), (5, "", ""), (6, "", "")}
    assert parts.metadata(stored.limit(0)).count() == 0


def test_a_reader_takes_its_sections_and_needs_no_exchange(stored):
    rows = ingest.string_rows(parts.elements(stored, ("awards",)))
    plan = plan_of(rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")))
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "awards" in schema and "books" not in schema and "metadata" not in schema and "gaps" not in schema
    assert "Exchange" not in plan and "parse_json" not in plan


def test_the_merge_shuffles_by_document_once(spark, small):
    merged = merge_results(QUERIES_BODIES(spark, small))
    for df in (merged.publications, merged.services, merged.grants, merged.groups, merged.employment, merged.education, merged.metadata):
        assert "Exchange" not in plan_of(df)


def QUERIES_BODIES(spark, small):
    from rollcall.plans.queries import dealt_bodies

    return dealt_bodies(spark, small)


SCHEMA = "job_id long, text string"


@pytest.mark.parametrize("broken", [None, "note", "keep", "swap", "forget"])
def test_purge_survives_a_failure_between_any_steps(spark, tmp_path, broken):
    path = str(tmp_path / "store")
    rows = [(i % 40, f"t{i}") for i in range(400)]
    files.write_sources(spark.createDataFrame(rows, SCHEMA), path, buckets=8)
    ended = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(777,)], "job_id long")
    wanted = Counter((j, x) for j, x in rows if j % 3)

    def step(name):
        if name == broken:
            raise RuntimeError(name)

    if broken:
        with pytest.raises(RuntimeError):
            files.purge(spark, path, SCHEMA, ended, step=step)
        seen = Counter((r.job_id, r.text) for r in files.read_sources(spark, path, SCHEMA).collect())
        assert seen == (Counter(rows) if broken == "note" else wanted)  # what is noted is hidden at once
        files.purge(spark, path, SCHEMA, ended if broken == "note" else None)
    else:
        assert 0 < files.purge(spark, path, SCHEMA, ended) <= 8
    raw = spark.read.schema(SCHEMA).parquet(f"{path}/sources")
    assert Counter((r.job_id, r.text) for r in raw.select("job_id", "text").collect()) == wanted
    assert not (tmp_path / "store" / "purging").exists() and not (tmp_path / "store" / "kept").exists()
    files.purge(spark, path, SCHEMA, spark.createDataFrame([(i,) for i in range(40)], "job_id long"))
    assert not list((tmp_path / "store" / "sources").glob("*/*.parquet"))  # whole jobs, and the partitions with them


def test_attempts_go_on_until_one_succeeds(spark):
    docs = spark.createDataFrame([(1, "a", "b", "good"), (2, "a", "b", "late"), (3, "a", "b", "bad"), (4, "c", "b", "good"), (5, "d", "b", "good")], "doc long, slice_key string, bucket string, body string")

    def first(body, bucket, limit, attempt):
        if body != "good":
            raise ValueError(f"first {limit}")
        return [body, bucket]

    def second(body, bucket, limit, attempt):
        if body == "bad" or attempt < 2:
            raise KeyError(attempt)
        return [body]

    slices = spark.createDataFrame([("a", True), ("c", False)], "slice_key string, high_fidelity boolean")
    got = jobs.extract_attempts(docs, "doc", jobs.route_candidates(slices), {"cloud": first, "onPrem": second}).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["rank"], r.attempt)):
        by.setdefault(r.doc, []).append((r.provider, r.attempt, r.ok, r.texts, r.error))
    assert by == {
        1: [("cloud", 1, True, ["good", "b"], None)], 2: [("cloud", 1, False, None, "ValueError: first 12000"), ("onPrem", 1, False, None, "KeyError: 1"), ("onPrem", 2, True, ["late"], None)],
        3: [("cloud", 1, False, None, "ValueError: first 12000"), ("onPrem", 1, False, None, "KeyError: 1"), ("onPrem", 2, False, None, "KeyError: 2")],
        4: [("onPrem", 1, False, None, "KeyError: 1"), ("onPrem", 2, True, ["good"], None)], 5: [(None, 0, False, None, "no extractor")]}


def test_slices_without_an_outcome_turn_stale_or_stay_pending(spark, tmp_path):
    from rollcall.sources.parts import shared_path

    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    due, out, live, check = (str(tmp_path / x) for x in ("due", "out", "live", "check"))
    started = spark.createDataFrame([("a", "s1", 0), ("a", "s2", 0), ("b", "s1", 10), ("c", "s1", 2000)], "job_id string, slice_key string, s long").select("job_id", "slice_key", at(F.col("s")).alias("started"))
    came = spark.createDataFrame([("a", "s1", "done", 620), ("b", "s1", "failed", 5), ("b", "s1", "failed", 640), ("z", "s1", "done", 2000)], "job_id string, slice_key string, state string, s long").select("job_id", "slice_key", "state", at(F.col("s")).alias("ts"))
    started.write.parquet(due)
    came.write.parquet(out)
    stream = so.live_slices(so.read_outcomes(spark, due, started.schema), so.read_outcomes(spark, out, came.schema))
    stream.writeStream.format("parquet").option("path", live).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = {(r.job_id, r.slice_key): r.state for r in spark.read.parquet(live).collect()}
    assert got == {("a", "s1"): "done", ("a", "s2"): "stale", ("b", "s1"): "stale"} and shared_path(spark, "x")  # an outcome a second too late doesn't count, c is pending


def test_live_jobs_are_of_every_kind(spark, small):
    got = Counter(r.status for r in QUERIES["live_status"](spark, small).collect())
    assert set(got) == {"pending", "merging", "failed"} and LIVE_NOW


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_many_patterns_equal_all_comparisons(spark, most):
    r = random.Random(2)
    word = lambda: "".join(r.choice("ab ") for _ in range(r.randint(0, 4)))
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(0, 12))) for _ in range(60)] + [None]
    checks = sorted({tuple(word() for _ in range(r.randint(1, 3))) for _ in range(30)})
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    df = spark.createDataFrame([(str(i), list(c)) for i, c in enumerate(checks)], "name string, parts array<string>")
    got = {x.name: x.matches for x in matching.count_holding(rows, F.col("text"), df, "name", "parts", most).collect()}
    want = {str(i): sum(t is not None and all(p in t for p in c) for t in texts) for i, c in enumerate(checks)}
    assert got == {k: n for k, n in want.items() if n}
    ordered = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, "ab")], "ord long, text string")
    first = {x.name: x.text for x in matching.first_holding(ordered, "text", "ord", df.select(F.col("parts")[0].alias("name")).distinct(), "name", most).collect()}
    for p in {c[0] for c in checks}:
        held = [(i // 2, t) for i, t in enumerate(texts) if t is not None and p in t]
        assert first.get(p) == (min(held)[1] if held else None)


def test_anchor_and_date_plans_have_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, "topic 3 in 1997)"), (2, "topic 3")], "ord long, text string")
    for df in (audit.anchor_counts(rows, spark.createDataFrame([("topic|in",), ("none",)], "anchor string"), "text"),
               audit.date_precision(rows, spark.createDataFrame([("topic 3", "1997)"), ("none", "1")], "anchor string, date string"), "text")):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    assert sorted(map(tuple, audit.date_precision(rows, spark.createDataFrame([("topic 3", "1997)"), ("none", "1")], "anchor string, date string"), "text").collect())) == [("none", "1", False), ("topic 3", "1997)", True)]


def test_saved_tables_and_gap_totals(spark):
    gaps = saved(spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, None, "x")], "doc_id long, section string, severity string"), "gaps")
    got = Counter((r.level, r.section, r.severity, r.doc_id, r.gaps) for r in audit.gap_totals(gaps, "doc_id").collect())
    assert got == Counter([("section and severity", "a", "x", None, 1), ("section and severity", "a", "y", None, 1), ("section and severity", None, "x", None, 1),
                           ("severity", None, "x", None, 2), ("severity", None, "y", None, 1), ("document", None, None, 1, 2), ("document", None, None, 2, 1), ("all", None, None, None, 3)])
    assert fuzzy.LEAST == 8


def test_a_bucket_is_one_file(spark):
    """However the rows lie, a table holds at most as many files as buckets; rows that lie by document get no exchange more."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = spark.range(0, 4000, 1, 16).selectExpr("id % 400 as doc_id", "id as number")
    kept = parts.kept_by_document(spread.unionByName(spread), "spread")
    assert len(kept.inputFiles()) <= n
    assert kept.count() == 8000
    again = kept.selectExpr("doc_id", "number + 1 as number").repartition(n, "doc_id")
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
