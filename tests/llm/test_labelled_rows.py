"""The quality model learns from the same rows, but texts aren't shuffled to meet their labels."""

import numpy as np
from pyspark.sql import functions as F

from rollcall.llm import quality_model as qm


def test_same_model_without_shuffled_texts(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 37, F.lit(" of "), F.col("id") % 5).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 50")).unionByName(docs.filter("doc_id < 20").withColumn("text", F.lit("another text")))
    labels = spark.range(100, 700).unionByName(spark.range(0, 60)).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3 > 0).cast("int")).alias("label"))
    order = F.xxhash64("doc_id")
    for n in (64, 8192):
        seen = qm.labelled(docs, labels, "doc_id", order, train_rows=n)
        (w, b), (v, c) = qm.fit(docs.join(labels, "doc_id"), order=order, train_rows=n), qm.fit(seen, order=order, train_rows=n)
        assert w.any() and np.array_equal(w, v) and b == c
    assert seen.select("doc_id").distinct().count() == docs.join(labels.filter("label is not null"), "doc_id").select("doc_id").distinct().count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = qm.labelled(docs, labels, "doc_id", order)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan.split("Exchange hashpartitioning")[0]
    assert not qm.labelled(docs, labels.filter("doc_id > 1000"), "doc_id", order).count()
