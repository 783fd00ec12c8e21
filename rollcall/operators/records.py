"""Jobs over the long table of records: (document, bucket, order) rows with a text.

Rows are ordered by the columns named in order, never by where they happen to lie.  Everything about a document is
decided inside its own (document, bucket, key) group, so the jobs share one exchange on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import dates, patterns as p, text as t


def dedupe_first(df: DataFrame, group: list[str], key: Column, order: list[str]) -> DataFrame:
    """The first row of each key within group; rows with an empty or null key go."""
    w = Window.partitionBy(*group, "_key").orderBy(*order)
    keyed = df.withColumn("_key", key).filter("_key <> ''")
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key")


def number_by_date(df: DataFrame, group: list[str], content: Column, order: list[str], name: str = "number") -> DataFrame:
    """Numbers rows 1..n within group: oldest first, undated last, ties in the given order."""
    w = Window.partitionBy(*group).orderBy(F.col("_date").asc_nulls_last(), *order)
    return df.withColumn("_date", dates.sort_key(content)).withColumn(name, F.row_number().over(w)).drop("_date")


def renumber(df: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def concat_buckets(df: DataFrame, doc: str, buckets: tuple[str, ...], order: list[str], name: str = "number") -> DataFrame:
    """The buckets of a document, in the order given, as one list numbered 1..n; rows of other buckets go."""
    place = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket"))
    listed = df.withColumn("_place", place).filter(F.col("_place") > 0)
    return renumber(listed, [doc], ["_place", *order], name).drop("_place")


def review_divider(df: DataFrame, group: list[str], content: Column, number: str, cutoff: str, explicit: Column | None = None) -> DataFrame:
    """Adds is_new and divider: whether the line 'new since last review' stands before the row.

    It stands before the first new row, if that isn't the group's first row and some row is dated before the cutoff.
    """
    new = dates.on_or_after(content, cutoff)
    if explicit is not None:
        new = new | F.coalesce(explicit, F.lit(False))
    w = Window.partitionBy(*group)
    seen = df.withColumn("is_new", new).withColumn("_old", dates.before(content, cutoff))
    first = F.min(F.when(F.col("is_new"), F.col(number))).over(w)
    divider = F.coalesce(F.bool_or("_old").over(w) & (first > 1) & (F.col(number) == first), F.lit(False))
    return seen.withColumn("divider", divider).drop("_old")


def move(df: DataFrame, to: Column, moves: int = 1) -> DataFrame:
    """Rows into other buckets (null: stay); a moved row is ordered after what its new bucket held before."""
    return df.withColumn("_to", to).withColumn("moved", F.coalesce(F.col("moved") if "moved" in df.columns else F.lit(0), F.lit(0)) + F.when(
        F.col("_to").isNotNull() & (F.col("_to") != F.col("bucket")), moves).otherwise(0)).withColumn("bucket", F.coalesce("_to", "bucket")).drop("_to")


def is_in_progress(citation: Column | str) -> Column:
    """Named as unpublished, or without a year of 19xx or 20xx."""
    c = F.col(citation) if isinstance(citation, str) else citation
    return c.rlike(p.words(*p.IN_PROGRESS)) | ~c.rlike(rf"{p.LEFT}(?:19|20)\d{{2}}{p.RIGHT}")


def move_in_progress(df: DataFrame, content: str = "text") -> DataFrame:
    return move(df, F.when(F.col("bucket").isin(*p.PRIMARY_BUCKETS) & is_in_progress(content), F.lit("workInProgress")))


def publication_home(bucket: Column, citation: Column) -> Column:
    """The bucket in which an 'other' article or proceeding belongs."""
    first, second = p.BOOK_REVIEW
    # Forms such as "ed." end in a mark, so only their front is a word edge.
    book = citation.rlike(p.words(*first)) & citation.rlike(f"(?i){p.LEFT}(?:{'|'.join(x if x.endswith('.') else x + p.RIGHT for x in second)})")
    refereed = citation.rlike(f"(?i)(?:{'|'.join(p.REFEREED_PROCEEDINGS)})")
    conference = citation.rlike(f"(?i){p.LEFT}(?:{'|'.join(x if x.endswith('.') else x + p.RIGHT for x in p.CONFERENCE)})")
    article = bucket == "otherArticles"
    return (
        F.when(article & book, F.lit("popularWorks"))
        .when((article | (bucket == "otherProceedings")) & refereed, F.lit("refereedProceedings"))
        .when(article & conference, F.lit("otherProceedings"))
        .otherwise(bucket))


def reclassify(df: DataFrame, content: str = "text") -> DataFrame:
    """Articles and proceedings filed as 'other' into the bucket that their citation names."""
    moved = move(df, publication_home(F.col("bucket"), F.col(content)))
    kinds = F.when(F.col("bucket") == "popularWorks", F.lit("popular")).when(F.col("bucket").isin("refereedProceedings", "otherProceedings"), F.lit("proceedings"))
    return moved.withColumn("pub_type", F.when(F.col("moved") > 0, F.coalesce(kinds, F.col("pub_type"))).otherwise(F.col("pub_type"))) if "pub_type" in df.columns else moved


def without_keys_of(df: DataFrame, group: list[str], bucket: str, other: str, key: Column) -> DataFrame:
    """df without rows of bucket whose key a row of other has in the same group: one window, no self-join."""
    w = Window.partitionBy(*group, "_key")
    there = F.bool_or(F.col("bucket") == other).over(w)
    return df.withColumn("_key", key).withColumn("_there", there).filter(~(F.col("_there") & (F.col("bucket") == bucket))).drop("_there", "_key")


def proceedings_anti(df: DataFrame, group: list[str], content: str = "text") -> DataFrame:
    return without_keys_of(df, group, "otherProceedings", "refereedProceedings", t.norm_citation(content))


def core_conflicts(df: DataFrame, group: list[str]) -> DataFrame:
    """A note for each activity that has a service row's identity but other dates or words: the last such service row.

    df: rows of the buckets universityService and professionalActivities with description, dates and ord.
    """
    service = F.col("bucket") == "universityService"
    last = F.max_by(F.when(service, F.struct("description", "dates")), F.when(service, F.col("ord"))).over(Window.partitionBy(*group, "_core"))
    seen = df.withColumn("_core", t.activity_core("description")).withColumn("_service", last)
    return seen.filter(~service & F.col("_service").isNotNull()).select(
        *group, "ord",
        F.concat(F.col("_service.description"), F.lit(" ("), F.col("_service.dates"), F.lit(") / "), t.strip_source_number("description")).alias("conflict"))


def route_presentations(df: DataFrame, content: str = "text") -> DataFrame:
    """Invited talks at conferences and societies into the bucket of meetings."""
    return move(df, F.when((F.col("bucket") == "invitedPresentations") & F.col(content).rlike(p.words(*p.WIDE_AUDIENCE)), F.lit("presentations")))


def is_honorific(rank: Column, institution: Column) -> Column:
    both = F.concat_ws(" ", rank, institution)
    return both.rlike(p.words("distinguished professor")) | (both.rlike(p.words(*p.HONORIFIC)) & ~both.rlike(p.words(*p.ORDINARY_POST)))


def honorific_awards(df: DataFrame) -> DataFrame:
    """Honorific appointments of employment rows (rank, institution, start, finish) as award texts."""
    title = F.concat_ws(", ", *[F.when(t.has_text(c), F.col(c)) for c in ("rank", "institution")])
    a, b = (t.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("start", "finish"))
    period = F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit(" – "), b)).when(a != "", a).otherwise(b)
    award = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(period, F.lit("")))
    return df.filter(is_honorific(F.col("rank"), F.col("institution"))).withColumn("award", award).filter("award <> ''")


def applicable_employment(df: DataFrame) -> DataFrame:
    rank, other = t.trim("rank"), p.words(*p.NOT_EMPLOYMENT)
    kept = rank.rlike(p.words(*p.ACADEMIC_RANK)) | ~F.concat(rank, F.lit(" "), F.col("institution")).rlike(other)
    return df.filter((rank == "") | (~rank.rlike(other) & kept))


def is_rendered_talk(c: Column | str) -> Column:
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return ~(low.contains(p.NOT_RENDERED_TALKS[0]) | low.contains(p.NOT_RENDERED_TALKS[1]) | low.contains(p.NOT_RENDERED_TALKS[2]))


def is_mentoring(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(p.words(*p.MENTORING))


def own_theses(df: DataFrame, flag: str = "is_own_thesis") -> DataFrame:
    """All but theses marked as someone else's; a missing mark keeps the row."""
    return df.filter(F.coalesce(flag, F.lit(True)))


def in_progress_view(pub_type: Column | str) -> Column:
    c = F.col(pub_type) if isinstance(pub_type, str) else pub_type
    return F.when(c == "chapter", F.lit("book")).when(c.isin("journal", "review", "book", "proceedings"), c).otherwise(F.lit("other"))


def merge_duplicates(df: DataFrame, group: list[str], content: str = "text", optional: tuple[str, ...] = ("note",), flags: tuple[str, ...] = ("is_new",),
                     specific: str = "workInProgress", order: str = "ord") -> DataFrame:
    """Copies of a citation as one row: the shortest citation (the earliest if equal), the first of each optional value
    that is there, flags true if any copy's is; the type is the first copy's, or the most specific in the bucket
    named by specific.  One aggregate, whose parts are summed before the shuffle."""
    split = df.withColumn("_split", t.split_contribution(content))
    note = {"note": F.coalesce("note", "_split.note")} if "note" in optional else {}
    plain = F.col("note").isNull() & F.col("_split.note").isNotNull() if "note" in optional else F.lit(False)
    rows = split.withColumn("_key", t.norm_citation(F.col("_split.citation"))).withColumns(
        note | {"_citation": F.when(plain, F.col("_split.citation")).otherwise(F.col(content))})
    # Empty keys go by an aggregate: a filter on the key would be moved below it, and the key, the dearest part, made twice.
    rank = F.array_position(F.array(*[F.lit(x) for x in p.PUBLICATION_TYPES]), F.col("pub_type"))
    best = F.min_by("pub_type", F.when(F.col("bucket") == specific, F.struct(rank, order)).otherwise(F.struct(F.lit(0).cast("bigint"), order)))
    return rows.groupBy(*group, "bucket", "_key").agg(
        F.min_by("_citation", F.struct(F.length("_citation"), F.col(order))).alias(content),
        best.alias("pub_type"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in optional],
        *[F.bool_or(c).alias(c) for c in flags],
        F.min(order).alias(order), F.count(F.lit(1)).alias("copies"), F.max(F.length("_key")).alias("_length")).filter("_length > 0").drop("_key", "_length")


def merge_groups(df: DataFrame, doc: str, heading: str, content: str, order: str = "ord") -> DataFrame:
    """Entries under canonical headings: prefixes off, blanks and repeats out, oldest first; headings as first seen."""
    clean = df.withColumn("heading", t.canonical_heading(heading)).filter("heading <> ''")
    clean = clean.withColumn("entry", t.strip_group_prefix(content, "heading"))
    place = F.min(order).over(Window.partitionBy(doc, "heading"))
    kept = dedupe_first(clean.withColumn("heading_order", place), [doc, "heading"], t.norm_dedupe("entry"), [order])
    return number_by_date(kept, [doc, "heading"], F.col("entry"), [order]).select(doc, "heading", "heading_order", "number", "entry")


def fold_groups(groups: DataFrame, flat: DataFrame, doc: str, content: str, order: str = "ord") -> DataFrame:
    """merge_groups over groups and over ``heading: entry`` texts of flat, which come after them.

    groups: doc, heading, entry and order; flat: doc, content and order.
    """
    late = lambda n: F.struct(F.lit(n).alias("_late"), F.col(order).alias("_at")).alias("_order")
    own = groups.select(doc, "heading", "entry", late(0))
    folded = flat_groups(flat, content).select(doc, "heading", "entry", late(1))
    return merge_groups(own.unionByName(folded), doc, "heading", "entry", "_order")


def nested_groups(groups: DataFrame, doc: str) -> DataFrame:
    """merge_groups' rows as one list a document: headings as first seen, each with its entries in order."""
    one = groups.groupBy(doc, "heading", "heading_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "entry"))), lambda x: x["entry"]).alias("entries"))
    listed = F.array_sort(F.collect_list(F.struct("heading_order", "heading", "entries")))
    return one.groupBy(doc).agg(F.transform(listed, lambda x: F.struct(x["heading"].alias("heading"), x["entries"].alias("entries"))).alias("groups"))


def service_view(category: Column | str) -> Column:
    """In which list a service is shown."""
    return F.when((F.col(category) if isinstance(category, str) else category) == "departmental", F.lit("departmentalService")).otherwise(F.lit("otherService"))


def grant_view(status: Column | str) -> Column:
    return F.when((F.col(status) if isinstance(status, str) else status) == "current", F.lit("currentGrants")).otherwise(F.lit("pastGrants"))


def flat_groups(df: DataFrame, content: str) -> DataFrame:
    """``heading: entry`` texts with a heading of 4 to 90 characters, taken apart."""
    return df.filter(F.col(content).rlike(p.FLAT_GROUP)).withColumns({"heading": F.regexp_extract(content, p.FLAT_GROUP, 1), "entry": F.regexp_extract(content, p.FLAT_GROUP, 2)})
