"""Excerpts are joined where a document's lines lie: nothing is grouped, sorted or shuffled for them."""

from rollcall.operators import jobs, lines as ln
from rollcall.plans.queries import QUERIES


def test_no_row_is_sorted_or_grouped_after_the_windows(spark, small):
    plan = QUERIES["extracted_slices"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "BroadcastHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2  # by ord for the numbers, by n for all windows


def test_same_as_grouped_excerpts(spark):
    text = ["Invited Lectures at Institutions", "Talk 1999", "plain", "University Service", "Chair, 2015 panel", "1. Journal of x, in press", "", "Grant 2004"]
    data = [(d, n, text[(n * 5 + (d or 7)) % 8]) for d in (None, 1, 2, 3) for n in range(12)] + [(4, 0, "one")]
    df = spark.createDataFrame(data, "doc_id long, n int, line string").repartition(5)
    slices = ln.slice_dim(spark)

    def fn(body, bucket):
        if bucket == "grants":
            raise ValueError(body[:3])
        return [*body.split("\n"), bucket]

    cut = {}
    for r in sorted(ln.slice_excerpts(df, slices).collect(), key=lambda r: r.n):
        cut.setdefault((r.doc_id, r.slice_key), []).append(r.line)
    bodies = [(*k, "\n".join(x)) for k, x in cut.items()]
    asked = spark.createDataFrame(bodies, "doc_id long, slice_key string, body string").join(slices.select("slice_key", "bucket"), "slice_key")
    plain = lambda x: sorted(tuple(str(v) for v in r) for r in x.select("doc_id", "slice_key", "pos", "text", "error").collect())
    wanted, got = plain(jobs.extract_slices(asked, "doc_id", fn)), plain(jobs.extract_excerpts(df, slices, "doc_id", fn))
    assert got == wanted and any("ValueError" in r[4] for r in got)
