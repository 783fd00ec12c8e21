"""Small DataFrame helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key from which on they are dealt into cells, and how many cells.
HOT, CELLS = 1000, 64
#: Hot keys that a plan may name.
FEW = 500
_thread = threading.local()


def _written() -> list[str]:
    """The tables saved by this thread: operators that run at once don't see each other's."""
    if not hasattr(_thread, "written"):
        _thread.written = []
    return _thread.written


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session, as in tests, may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def begun() -> int:
    """A mark for finished()."""
    return len(_written())


def finished(df: DataFrame, what: str, since: int) -> DataFrame:
    """df saved, an operator's whole result; the tables saved since the mark, on which it no longer depends, are deleted."""
    spark = df.sparkSession
    out = saved(df, what)
    written = _written()
    for path in written[since:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del written[since:-1]
    return out


def ranked(df: DataFrame, keys: list[str], order: list[Column], salt: Column, cells: int, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... within keys, in the order of (salt, order).

    salt is a number from 0 to cells - 1 that rises with the wanted order.  Only
    the rows of one (keys, salt) cell are sorted together; counts of cells, which
    are summed before the shuffle, say how many rows lie before a cell.  No key may
    be null.
    """
    rows = df.withColumn("_cell", salt)
    counts = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    before = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    within = Window.partitionBy(*keys, "_cell").orderBy(*order)
    numbered = rows.withColumn("_k", F.row_number().over(within) - 1).join(before, [*keys, "_cell"])
    return numbered.select(*df.columns, (F.col("_k") + F.col("_before")).cast("long").alias(name))


def range_ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... over all rows of df, a saved table, in the order given; equal rows are numbered one by one.

    The rows are dealt by ranges of (order, row), so no key is held by one task however often it comes, and saved with
    the number of their range; a row's rank is its place in its range after the counts of the ranges before, of
    which there are as many as shuffle partitions.
    """
    ranges = partitions(df.sparkSession)
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "_row")
    dealt = saved(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_row")) - 1
    numbered = dealt.withColumn("_place", place).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return numbered.select(*df.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))


def only_touched(df: DataFrame, key: Column, keys: DataFrame, keys_col: Column, bits: int = 23) -> DataFrame:
    """df without most of the rows whose key is not in keys: a filter before a join, never a replacement for it."""
    return flagged(df, key, keys, keys_col, "_flag", bits).filter("_flag").drop("_flag")


def flagged(df: DataFrame, key: Column, keys: DataFrame, keys_col: Column, name: str, bits: int = 23) -> DataFrame:
    """df with a flag that is true where key is in keys, and seldom elsewhere; rows of equal keys have equal flags.

    The keys are hashed into a bitmap of 2**bits bits, at most 2**bits / 8 bytes whatever the input, which is broadcast.
    """
    cells = 2**bits
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(cells)) + 1
    maps = keys.select(h(keys_col).alias("_hash_of_key")).groupBy(F.bitmap_bucket_number("_hash_of_key").alias("_bitmap_number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_hash_of_key")).alias("_bitmap"))
    # A row for each part of the bitmap, keys or not, so that the plan is the same whatever the keys.
    every = df.sparkSession.range(1, cells // 32768 + 1, 1, 1).select(F.col("id").alias("_bitmap_number"), F.lit(None).cast("binary").alias("_bitmap"))
    maps = maps.unionByName(every).groupBy("_bitmap_number").agg(F.max("_bitmap").alias("_bitmap"))
    out = df.withColumn("_hash_of_key", h(key)).withColumn("_bitmap_number", F.bitmap_bucket_number("_hash_of_key")).join(F.broadcast(maps), "_bitmap_number", "left")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(bitmap_bit_position(_hash_of_key) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.pmod(F.bitmap_bit_position("_hash_of_key"), F.lit(8)).cast("int")
    return out.select(*df.columns, F.coalesce(F.getbit(byte, bit) == 1, F.lit(False)).alias(name))


def spread_join(many: DataFrame, one: DataFrame, on: str, by: Column, how: str = "inner", counted: DataFrame | None = None, hot: int = HOT, cells: int = CELLS) -> DataFrame:
    """many.join(one, on), one having a row for each key, with the rows of hot keys dealt into cells by a hash of by.

    counted: a table that has many's keys as often and is cheaper to read.

    Which keys are hot is counted, summed before the shuffle; only those rows of one are repeated for each cell.  Up to FEW hot keys, and
    none at all, are named in the plan; more are told by a bitmap of bounded size, for which a key that is taken for a hot one by chance
    is dealt too: the result is the same.
    """
    often = (many if counted is None else counted).groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot).select(on)
    named = often.filter(F.col(on).isNotNull()).limit(FEW + 1).agg(F.collect_list(on)).first()[0]
    if not named and how == "inner":
        return many.join(one, on)
    if len(named) <= FEW:
        # Rows of many without a key are dealt as well: they stay in a left join, and would lie in one task.
        tell = lambda df: df.withColumn("_hot", F.col(on).isNull() | (F.col(on).isin(named) if named else F.lit(False)))
    else:
        tell = lambda df: flagged(df, F.col(on), often, F.col(on), "_hot")
    left = tell(many).withColumn("_cell", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(cells)).cast("int")).otherwise(0)).drop("_hot")
    right = tell(one).withColumn("_cell", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(cells - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [on, "_cell"], how).drop("_cell")
