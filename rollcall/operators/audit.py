"""What a reviewer should look at: doubtful placements, gaps, counts, and differences between runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import text as t
from rollcall.functions.patterns import NOT_LISTED
from rollcall.operators import matching


def review_key(c: Column | str) -> Column:
    """The normal form of a record of 24 characters or more, else null."""
    key = F.trim(F.regexp_replace(t.norm_dedupe(t.strip_source_number(c)), "[^a-z0-9]+", " "))
    return F.when(F.length(key) >= 24, key)


def cross_bucket_notes(df: DataFrame, doc: str, bucket: str, content: str, key: Column, order: list[str]) -> DataFrame:
    """A note for each record whose key was first seen in another bucket of the document."""
    w = Window.partitionBy(doc, "_key").orderBy(*order)
    seen = df.withColumn("_key", key).filter("_key <> ''").withColumn("_first", F.first(bucket).over(w))
    return seen.filter(F.col("_first") != F.col(bucket)).select(
        doc, F.concat("_first", F.lit("; "), bucket).alias("section"), *[c for c in order if c not in (doc, bucket)], t.strip_source_number(content).alias("item"))


def dedupe_notes(notes: DataFrame, doc: str, columns: tuple[str, ...], order: list[str]) -> DataFrame:
    """The first of notes that are equal but for case and spacing."""
    w = Window.partitionBy(doc, *[f"_{c}" for c in columns]).orderBy(*order)
    return notes.withColumns({f"_{c}": t.norm_dedupe(c) for c in columns}).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", *[f"_{c}" for c in columns])


# --- fixed values: kind of record, condition, and the gap that one such record opens ---
GAP_RULES = (
    ("employment", "location", "Section I: Employment History", "Employment location", f'Review employment rows marked "{NOT_LISTED}" and add locations when available.'),
    ("education", "dates", "Section I: Education", "Attendance dates", f'Review education rows marked "{NOT_LISTED}" and add attendance dates when available.'),
    ("education", "location", "Section I: Education", "School location", f'Review education rows marked "{NOT_LISTED}" and add school locations when available.'),
    ("grants", "role", "Section II: Contracts and Grants", "Role and co-PI/share", f'Review grant rows marked "{NOT_LISTED}" and add role or co-PI/share details when available.'),
)


def structural_gaps(records: DataFrame, gaps: DataFrame, doc: str) -> DataFrame:
    """Recommended gaps that records open and gaps doesn't list: doc, section, field, instruction, severity.

    records: doc, kind and missing, an array of what a record lacks (location, dates, role).  Gaps grow with the documents, and are merged
    and never broadcast, however small the files that they are read from.
    """
    opened = records.select(doc, "kind", F.explode("missing").alias("lack")).distinct()
    rules = records.sparkSession.createDataFrame(GAP_RULES, "kind string, lack string, section string, field string, instruction string")
    found = opened.join(F.broadcast(rules), ["kind", "lack"]).select(doc, "section", "field", "instruction", F.lit("recommended").alias("severity"))
    low = lambda df: F.lower(F.concat_ws("|", df["section"], df["field"], df["instruction"]))
    return found.join(gaps.hint("merge"), (found[doc] == gaps[doc]) & (low(found) == low(gaps)), "left_anti")


def record_gaps(employment: DataFrame, education: DataFrame, grants: DataFrame, doc: str) -> DataFrame:
    """What records lack, as structural_gaps reads it: doc, kind, missing."""
    no = lambda c: ~t.has_text(c)
    return employment.select(doc, F.lit("employment").alias("kind"), F.array_compact(F.array(F.when(no("location"), F.lit("location")))).alias("missing")).unionAll(
        education.select(doc, F.lit("education"), F.array_compact(F.array(F.when(no("datesFrom") & no("datesTo"), F.lit("dates")), F.when(no("location"), F.lit("location")))))).unionAll(
        grants.select(doc, F.lit("grants"), F.array_compact(F.array(F.when(no("role") | no("coPIsShare"), F.lit("role"))))))


def section_counts(records: DataFrame, doc: str, bucket: str, groups: dict[str, list[str]]) -> DataFrame:
    """Records of each document in each group of buckets."""
    return records.groupBy(doc).agg(*[F.count_if(F.col(bucket).isin(*names)).alias(g) for g, names in groups.items()])


def section_summary(records: DataFrame, gaps: DataFrame, notes: DataFrame, doc: str, bucket: str, groups: dict[str, list[str]]) -> DataFrame:
    """Groups that hold a record, gaps by severity, and notes, for each document with a record."""
    counts = section_counts(records, doc, bucket, groups)
    filled = reduce(Column.__add__, [(F.col(g) > 0).cast("long") for g in groups])
    by = gaps.groupBy(doc).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("required", "recommended", "optional")])
    many = notes.groupBy(doc).agg(F.count(F.lit(1)).alias("notes"))
    out = counts.withColumn("filled", filled).join(by, doc, "left").join(many, doc, "left")
    return out.na.fill(0, ["required", "recommended", "optional", "notes"])


def summary_order(gaps: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Gaps numbered within severity in their own order, required ones first."""
    rank = F.array_position(F.array(F.lit("required"), F.lit("recommended"), F.lit("optional")), F.col("severity"))
    w = Window.partitionBy(doc, "severity").orderBy(*order)
    return gaps.withColumn("severity_rank", rank).withColumn("number", F.row_number().over(w))




def anchor_counts(records: DataFrame, anchors: DataFrame, content: str, anchor: str = "anchor") -> DataFrame:
    """How many records hold all parts (parted by |) of each anchor; anchors that none holds count 0.

    anchors is the reader's own list of checks, of any length.  Parts are compared as normal forms, and an automaton
    over all of them finds those that a record holds in one pass over its text.
    """
    checks = anchors.select(anchor).distinct()
    parts = checks.select(anchor, F.transform(F.split(anchor, r"\|"), t.norm_compare).alias("parts")).filter(F.col(anchor).isNotNull())
    counts = matching.count_holding(records, t.norm_compare(content), parts, anchor, "parts")
    return checks.join(counts, anchor, "left").na.fill(0, ["matches"])


def leak_scan(df: DataFrame, content: str, patterns: dict[str, str]) -> DataFrame:
    """How many texts are like each pattern: one row, a column for each name."""
    return df.agg(*[F.count_if(F.col(content).rlike(x)).alias(name) for name, x in patterns.items()])


def duplicate_inventory(df: DataFrame, group: list[str], key: Column) -> DataFrame:
    """Keys that occur twice or more in their group, with the number of copies; empty keys don't count."""
    return df.withColumn("key", key).filter("key <> ''").groupBy(*group, "key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def placement_inventory(services: DataFrame, activities: DataFrame, publications: DataFrame, doc: str) -> DataFrame:
    """doc and entry: activities that are services too, citations twice in a bucket, and activities that occur twice."""
    own = services.select(doc, t.norm_service("description", F.col("dates")).alias("_key")).distinct()
    as_service = activities.select(doc, t.norm_service("text").alias("_key")).filter("_key <> ''").distinct().join(own, [doc, "_key"])
    cited = duplicate_inventory(publications, [doc, "bucket"], t.norm_record(t.split_contribution("text")["citation"]))
    twice = duplicate_inventory(activities, [doc], t.norm_record("text"))
    return as_service.select(doc, F.concat(F.lit("service/external:"), "_key").alias("entry")).unionAll(
        cited.select(doc, F.concat("bucket", F.lit(":"), "key"))).unionAll(twice.select(doc, F.concat(F.lit("external-professional-activities:"), "key")))


def new_duplicates(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the later inventory whose keys the earlier one lacks."""
    return after.join(before.select(*keys), keys, "left_anti")


def diff_runs(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that differ between two runs: removed, added or changed, by key."""
    x = a.select(*keys, F.struct(*values).alias("_a"))
    y = b.select(*keys, F.struct(*values).alias("_b"))
    both = x.join(y, keys, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*keys, F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("changed").alias("change"))


def count_tolerance(a: DataFrame, b: DataFrame, key: str, count: str, share: Column) -> DataFrame:
    """Whether counts of b lie within a share of those of a; where a has none, b must have none."""
    x, y = a.select(key, F.col(count).alias("expected")), b.select(key, F.col(count).alias("actual"))
    both = x.join(y, key, "full_outer").na.fill(0, ["expected", "actual"])
    near = F.abs(F.col("actual") - F.col("expected")) <= share * F.col("expected")
    return both.withColumn("within", F.when(F.col("expected") == 0, F.col("actual") == 0).otherwise(near))


def date_precision(records: DataFrame, checks: DataFrame, content: str) -> DataFrame:
    """checks (anchor, date) with ok: some record holds the anchor, and the first such record, trimmed, ends with the date."""
    first = matching.first_holding(records, content, "ord", checks, "anchor").withColumnRenamed(content if content == "text" else "text", "_first")
    found = checks.join(first, "anchor", "left")
    return found.withColumn("ok", F.coalesce(t.trim("_first").endswith(F.col("date")), F.lit(False))).drop("_first")


def gap_totals(gaps: DataFrame, doc: str) -> DataFrame:
    """Counts of gaps by section and severity, by severity, by document and over all, in one aggregate; level says which."""
    sets = [["section", "severity"], ["severity"], [doc], []]
    level = {0b001: "section and severity", 0b101: "severity", 0b110: "document", 0b111: "all"}
    of = F.create_map(*[F.lit(x) for kv in level.items() for x in kv])
    out = gaps.groupingSets([[F.col(c) for c in own] for own in sets], "section", "severity", doc).agg(
        of[F.grouping_id("section", "severity", doc).cast("int")].alias("level"), F.count(F.lit(1)).alias("gaps"))
    return out.select("level", "section", "severity", doc, "gaps")
