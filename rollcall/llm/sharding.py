"""Proportional stratified interleaving: every shard gets every source in the mixture's proportion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import ranked, saved

#: Cells into which a source's shuffled rows, and all rows' fractions, are cut for ranking.
SOURCE_CELLS, CELLS = 1024, 4096


def stratified_shards(
    docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", stratum: str = "source", text: str = "text"
) -> DataFrame:
    """Assigns each row of docs to a shard and to a slot in it.

    Within a stratum, rows are shuffled by a seeded hash of key and text and
    ranked; row r of n has the fraction (r + 1/2) / n.  All rows are then sorted by
    fraction and cut into runs whose lengths differ by one at most, so each
    shard holds each stratum in the mixture's proportion.

    Rows of a stratum are ranked in cells of the hash's range, and all rows in
    cells of the fraction's range, so a stratum with a third of all rows is
    spread like any other, and only counts of cells are summed up.

    Returns key, size (UTF-8 bytes of text plus 16), text_crc32, stratum, shard
    and slot.  A null stratum is a stratum of its own; a null text has size 16
    and the checksum of no bytes; a null key is a key like any other; repeated
    rows are dealt one by one; an empty table gives no rows; other columns are
    not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.xxhash64(F.lit(seed), F.col(key), F.crc32(body.cast("binary")), F.octet_length(body))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.col(stratum),
        F.when(F.col(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string"))).alias("_stratum"),
        digest.alias("_shuffle"),
    )
    rows = saved(rows, "sharding")  # narrow: the texts are read once, not by every step
    ties = [F.col("_shuffle"), F.col(key), F.col("text_crc32"), F.col("size")]
    cell = F.shiftrightunsigned("_shuffle", 64 - (SOURCE_CELLS - 1).bit_length()).cast("int")
    unsigned: list[Column] = [F.col("_shuffle") < 0, *ties]
    rows = ranked(rows, ["_stratum"], unsigned, cell, SOURCE_CELLS, "_rank")
    totals = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(totals, "_stratum").withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_n"))
    last = [F.col("_fraction"), F.col("_stratum"), *ties]
    rows = ranked(rows, [], last, F.floor(F.col("_fraction") * CELLS).cast("int"), CELLS, "_place")
    everything = totals.agg(F.sum("_n").alias("_all"))
    base, rest = F.expr(f"_all div {shards}"), F.col("_all") % shards
    long_end = rest * (base + 1)
    place = F.col("_place")
    shard = F.when(place < long_end, F.expr(f"_place div (_all div {shards} + 1)")).otherwise(
        rest + F.floor((place - long_end) / F.greatest(base, F.lit(1))))
    slot = F.when(place < long_end, place % (base + 1)).otherwise((place - long_end) % F.greatest(base, F.lit(1)))
    return rows.crossJoin(F.broadcast(everything)).select(
        key, "size", "text_crc32", stratum, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
