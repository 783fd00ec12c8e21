"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import range_ranked, saved

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _digits(seed: int, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))), 256), 1, 16)


def targets(totals: DataFrame, source: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """totals (source, source_size) with weight and target.

    The sources, by code point and null last, take the weights in turn.  A level, in words for a weight of 1, is raised
    until the targets add up to share of all sizes: sources whose target would pass most times their size
    stop there, and what they leave is shared among the others by weight.  Each round is an aggregate over the
    sources, of which three numbers reach the driver; a source that stops never starts again, so the rounds end.
    """
    ranked = range_ranked(saved(totals, "sources"), [F.col(source).asc_nulls_last()], "_at")
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    plan = saved(ranked.withColumn("weight", weight).drop("_at"), "mixture")
    everything = share * (plan.agg(F.sum("source_size")).first()[0] or 0)
    full, numerator, denominator = 0, 0.0, 1.0
    while True:
        stopped = F.col("weight") * numerator / denominator > most * F.col("source_size")
        n, held, free = plan.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if denominator and (n, numerator) == (full, everything - most * (held or 0)):
            break
        full, numerator, denominator = n, everything - most * (held or 0), free
        if not free:
            break
    level = F.col("weight") * numerator / denominator if denominator else F.lit(float("inf"))
    return plan.withColumn("target", F.least(most * F.col("source_size"), level).cast("double"))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
    key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each document, so that each source's words come near its target.

    A document's expected copies are its source's target over the source's size, in words.  Within a source the
    documents are sorted by size and, among equals, by a seeded hash of the key; the prefix sums of expected copies are shifted
    by one random offset for each source, and a document is taken once for each whole number that lies between its
    two sums.  So every document is taken floor or ceil of its expected copies, which are at most ``most``, and as the
    sums are never over one copy off along sizes that rise, a source's words are off by less than its longest document.

    Ranks come from range partitions over (source, size, hash), so a source with a third of all rows is sorted by
    many tasks; only sizes and keys are shuffled, no texts but those asked for in carry.

    Returns key, size, source, source_size, target, copies and taken (copies times size), and the columns of carry.  A null
    text has size 0; a source without words has target 0 and is not taken; a null source is a source of its own, the last;
    a null key counts as an empty one; repeated rows are taken one by one; an empty table gives no rows; a very long text is read
    once, to count its words; other columns are not read.
    """
    rows = saved(
        docs.select(F.col(key), word_count(F.col(text)).alias("size"), F.col(source), _digits(seed, F.col(key)).alias("_shuffle"), *[F.col(c).alias(f"_carry_{c}") for c in carry]),
        "mixing")
    totals = rows.groupBy(source).agg(F.sum("size").alias("source_size"))
    plan = saved(targets(totals, source, weights, share, most), "targets")
    first = plan.select(F.col(source).alias("_source"), "source_size", "target")
    ranked = saved(range_ranked(rows, [F.col(source).asc_nulls_last(), F.col("size"), F.col("_shuffle"), F.col(key)], "_rank"), "ranked")
    lowest = ranked.groupBy(source).agg(F.min("_rank").alias("_first")).withColumnRenamed(source, "_source2")
    first = first.join(lowest, F.col("_source").eqNullSafe(F.col("_source2"))).drop("_source2")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(_digits(seed, F.concat(F.lit("source "), F.coalesce(F.concat(F.lit("+"), F.col("_source")), F.lit("-")))), 1, 8), 16, 10).cast("double") / 2.0**32
    first = first.withColumn("_whole", F.floor(r)).withColumn("_part", r - F.floor(r)).withColumn("_offset", offset)
    k = F.col("_rank") - F.col("_first")
    crossed = F.floor((k + 1) * F.col("_part") + F.col("_offset")) - F.floor(k * F.col("_part") + F.col("_offset"))
    copies = (F.col("_whole") + F.least(crossed, F.lit(1))).cast("long")
    out = ranked.join(first, F.col(source).eqNullSafe(F.col("_source")))
    return out.select(key, "size", source, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"_carry_{c}").alias(c) for c in carry])


def emitted(mix: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its copy's number from 1."""
    return mix.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
