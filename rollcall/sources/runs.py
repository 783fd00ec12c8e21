"""Results of whole runs, kept as files in buckets of their keys, so that run is joined to run as the files lie."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_run(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> None:
    """Stores df below path in buckets of keys, sorted by them; buckets: the session's shuffle partitions if not named.

    Runs that are to meet need the same keys in the same order and the same number of buckets.  What the files are is
    written last, so a run that broke off can't be opened; a path that exists is an error.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    name = f"run_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).mode("error").option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay
    spark.createDataFrame([(columns, keys, n)], "columns string, keys array<string>, buckets int").coalesce(1).write.mode("error").parquet(f"{path}/spec")


def open_run(spark: SparkSession, path: str) -> DataFrame:
    """A stored run, in this session or a later one: joins on its keys, and groups by them, need no exchange of it."""
    spec = spark.read.parquet(f"{path}/spec").first()
    keys = ", ".join(f"`{k}`" for k in spec["keys"])
    name = f"run_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({spec['columns']}) using parquet clustered by ({keys}) sorted by ({keys}) into {spec['buckets']} buckets location '{path}/rows'")
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out
