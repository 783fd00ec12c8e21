"""fuzzy_check counts copies as members of a set, and small tables of sets are read by few tasks."""

import random

from rollcall.operators import fuzzy
from rollcall.plans.queries import QUERIES


def rows_of_joins(spark, df):
    """The collected rows of df, and the most rows that a join of its plan gave."""
    got = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    most = []
    for i in range(nodes.size()):
        node = nodes.apply(i)
        for j in range(node.metrics().size()):
            m = node.metrics().apply(j)
            if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    assert most
    return got, max(most)


def test_copies_are_not_made_into_pairs(spark, tmp_path):
    """300 copies of an item and 400 of a document that holds it; before, their 120,000 pairs were made to be counted."""
    rng = random.Random(3)
    item, other = (" ".join(f"{x}{k}" for k in range(12)) for x in "pq")
    items = [(i, item) for i in range(300)] + [(300, other), (301, None), (302, "too few"), (300, other + " once more")]
    texts = [f"before {item} after", item.replace("p3 ", "")] + [f"before {item} after"] * 399 + [other, None, "", " ".join(rng.sample(other.split(), 12)), item.replace("p3 ", "").replace("p7 ", "")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got, most = rows_of_joins(spark, QUERIES["fuzzy_check"](spark, str(tmp_path)))
    sets = lambda rows: [(k, set((x or "").split())) for k, x in rows]
    wanted = {}
    for k, x in sets(items):
        for _, y in sets(enumerate(texts)):
            if min(len(x), len(y)) >= 8 and len(x & y) >= 0.9 * min(len(x), len(y)):
                wanted[k] = wanted.get(k, 0) + 1
    # 401 that hold the item or lack one word of it, and the last, which is the smaller and lies in it whole; 300 comes twice with two documents each.
    assert {r.key_a: r.documents for r in got} == wanted == {**dict.fromkeys(range(300), 402), 300: 4}
    assert most <= 400


def test_small_sets_are_not_read_by_bucket(spark):
    """Before, few sets in many buckets were read by a task a bucket, each with a Python worker; repeats, edges and empty texts are no words."""
    texts = [" ".join(f"w{i + k}" for k in range(9)) for i in range(40)]
    rows = lambda x: spark.createDataFrame(list(enumerate(x)), "key long, body string")
    a = fuzzy._Sets(rows(texts), "key", "body", 8, None)
    b = fuzzy._Sets(rows([f"..{x}, {x}!" for x in texts] + ["", "...", None, "a a a a a a a a a"]), "key", "body", 8, None)
    assert sorted(a.sets.collect()) == sorted(b.sets.collect()) and a.sets.count() == 40
    met = fuzzy._meeting(*fuzzy._blocked(a, b, 0.9)).distinct()
    assert "Bucketed: true" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.filter("one = other").count() == 40
    none = fuzzy._Sets(rows(["", None]), "key", "body", 8, None)
    assert fuzzy._meeting(*fuzzy._blocked(a, none, 0.9)).count() == fuzzy._meeting(*fuzzy._blocked(none, a, 0.9)).count() == 0
