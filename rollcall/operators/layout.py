"""The fixed layout of a document's sections as a table of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import dates, patterns as p, text as t
from rollcall.operators import records as rec

# --- fixed values: level, heading, bucket, what stands where the bucket is empty (None: the section goes, if it has a bucket) ---
NONE, NO_FILE = "None.", "None submitted with file."
OUTLINE = (
    (1, "Section I: Employment History and Education", None, None),
    (2, "Previous Applicable Employment", "employment", "List all employment chronologically from first academic position to present. Include institution, location, rank/title, and dates."),
    (2, "Education", "education", "List schools attended, dates, location, major field, degree, and date received."),
    (2, "Areas of Sub-Specialization", "specialization", "Describe your areas of sub-specialization or board certification."),
    (1, "Section II: Professional Data", None, None),
    (2, "(a) University Service", None, None),
    (3, "Departmental Service", "departmentalService", NONE),
    (3, "University, Campus, Academic Senate, and Systemwide Service", "otherService", NONE),
    (3, "Public Service", "publicService", None),
    (2, "(b) Memberships", "memberships", NONE),
    (2, "(c) Honors and Awards", "awards", "List awards and honors with dates received."),
    (2, "(d) Contracts and Grants", None, None),
    (3, "Current Research Support", "currentGrants", NONE),
    (3, "Past Research Support", "pastGrants", NONE),
    (2, "(e) External Professional Activities", None, None),
    (3, "Professional Committee Service and Conference Organization", "professionalActivities", NONE),
    (3, "Consulting", "consulting", NONE),
    (3, "Reviewer for External Academic Files, Funding Agencies, and Journals", "reviewerActivities", NONE),
    (3, "Presentations at National and International Meetings", "presentations", NONE),
    (3, "Other Invited Presentations", "invitedPresentations", NONE),
    (2, "(f) Most Significant Contributions to Promoting Diversity", "diversityContributions", NONE),
    (2, "(g) Other Activities", "otherActivities", NONE),
    (2, "(h) Student Instructional Activities", "studentInstructionalActivities",
     "List students supervised, postdoctoral researchers mentored, undergraduate research students, visiting scholars/students, and thesis committee service."),
    (2, "(i) External Reviews of Primary Creative Work", "externalReviews", NO_FILE),
    (1, "Section III – Bibliography", None, None),
    (2, "A. Primary Published Work or Creative Work:", None, None),
    (3, "I. Refereed Journal Articles", "peerReviewedJournals", NONE),
    (3, "II. Review and Invited Articles", "reviewAndInvited", NONE),
    (3, "III. Books and Book Chapters", None, None),
    (3, "a. Books", "books", NONE),
    (3, "b. Book Chapters", "chapters", NONE),
    (3, "IV. Refereed Conference Proceedings", "refereedProceedings", NONE),
    (3, "V. Other Articles", "otherArticles", NONE),
    (2, "B. Other Work", None, None),
    (3, "I. Other Conference Proceedings", "otherProceedings", NONE),
    (3, "II. Abstracts", "abstracts", NONE),
    (3, "III. Popular Works", "popularWorks", NONE),
    (3, "IV. Additional Products of Major Research", None, None),
    (3, "a. Theses", "theses", NONE),
    (3, "b. Patent/Patent License", "patents", NONE),
    (3, "c. Other Products", "additionalProducts", None),
    (2, "C. Work in Progress", None, None),
    (3, "I. Refereed Journal Articles", "inProgress journal", NONE),
    (3, "II. Review and Invited Articles", "inProgress review", NONE),
    (3, "III. Books and Book Chapters", "inProgress book", NONE),
    (3, "IV. Refereed Conference Proceedings", "inProgress proceedings", NONE),
    (3, "V. Other Articles", "inProgress other", NONE),
)
#: The heads of tables, cell by cell.
TABLES = {
    "employment": ("Period", "Institution / Organization", "Location", "Rank / Title"),
    "education": ("Dates of attendance", "School, college, university, or hospital", "Location", "Major subject or field", "Degrees or certificates", "Date received"),
    "currentGrants": ("Title", "Granting agency", "Amount of total award", "Time period", "Role", "Co-PIs / share"),
    "pastGrants": ("Title", "Granting agency", "Amount of total award", "Time period", "Role", "Co-PIs / share"),
}
BLANK = "________________"
SUMMARY_INTRO = "This page lists items the automated conversion could not complete or was unsure how to place. Resolve each item, then delete this page."
GAPS_HEADING, NOTES_HEADING = "Manual Completion Items", "Placement and Duplication Review Notes"
SEVERITY_LABELS = (("required", "Required before submission"), ("recommended", "Recommended"), ("optional", "Optional"))
# --- end of fixed values ---
#: Buckets shown as one list, in this order; bibliographies, numbered and starred; texts that are numbered.
OTHER_ACTIVITIES = ("outreach", "clinicalActivities", "otherActivities")
NUMBERED = ("presentations", "invitedPresentations")
CELL = " | "
DIVIDER = "New since last review"


def render_lines(docs: DataFrame, records: DataFrame, doc: str, layout: tuple, starred: bool = True) -> DataFrame:
    """doc, line_no and line: all sections in order, records numbered, with a fallback line for an empty section.

    records: doc, bucket, number, text, is_new, divider.  The layout is a broadcast table of fixed size.
    """
    spark = docs.sparkSession
    dim = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(layout)], "seq int, heading string, bucket string, fallback string"))
    star = F.when(F.col("is_new") & F.lit(starred), F.lit("*")).otherwise(F.lit(""))
    shown = F.concat(star, F.col("number").cast("string"), F.lit(". "), F.col("text"))
    own = records.join(dim, "bucket").withColumn("_part", F.when(F.col("divider"), F.array(F.lit(DIVIDER), shown)).otherwise(F.array(shown)))
    body = own.select(doc, "seq", "number", F.posexplode("_part").alias("sub", "line")).withColumn("kind", F.lit(1))
    heads = docs.select(doc).distinct().crossJoin(dim)
    held = own.select(doc, "seq").distinct().withColumn("_held", F.lit(True))
    heads = heads.join(held, [doc, "seq"], "left").filter("_held or fallback is not null")
    lines = heads.select(doc, "seq", F.lit(0).alias("number"), F.lit(0).alias("sub"), F.col("heading").alias("line"), F.lit(0).alias("kind")).unionByName(
        heads.filter("_held is null").select(doc, "seq", F.lit(0).alias("number"), F.lit(1).alias("sub"), F.col("fallback").alias("line"), F.lit(0).alias("kind"))
    ).unionByName(body.select(doc, "seq", F.col("number").cast("int"), "sub", "line", "kind"))
    w = Window.partitionBy(doc).orderBy("seq", "kind", "number", "sub")
    return lines.withColumn("line_no", F.row_number().over(w)).select(doc, "line_no", "line")


def _listed(df: DataFrame, doc: str, bucket: Column, number: Column, dated: Column, lines: Column, explicit: Column | None = None) -> DataFrame:
    """Records as doc, bucket, number, dated (the text whose date decides what is new), lines and whether they say that they are new."""
    new = F.coalesce(explicit, F.lit(False)) if explicit is not None else F.lit(False)
    return df.select(doc, bucket.alias("bucket"), number.cast("long").alias("number"), dated.alias("dated"), lines.alias("lines"), new.alias("said"))


def _cells(*cells: Column) -> Column:
    return F.concat_ws(CELL, *[t.display_cell(F.coalesce(c, F.lit(""))) for c in cells])


def shown_records(merged, doc: str = "doc_id") -> DataFrame:
    """All records of merged results (plans.consolidate.Merged) as they are shown: one row each, in the outline's buckets."""
    m, c, lit, one = merged, F.col, F.lit, lambda x: F.array(x)
    within = lambda *group: Window.partitionBy(doc, *group)
    employment = _listed(m.employment, doc, lit("employment"), c("number"), lit(None).cast("string"), one(_cells(t.display_period("start", "finish"), c("institution"), c("location"), c("rank"))))
    education = _listed(m.education, doc, lit("education"), c("number"), lit(None).cast("string"), one(_cells(
        t.display_period("datesFrom", "datesTo"), c("school"), c("location"), c("major"), t.display_degree("degree", "dateReceived"), c("dateReceived"))))
    special = _listed(m.metadata.filter("specialization <> ''"), doc, lit("specialization"), lit(1), lit(None).cast("string"), one(c("specialization")))

    served = m.services.withColumn("view", rec.service_view("category"))
    when = t.unwrap("dates")
    said = F.concat("description", F.when(when == "", lit("")).otherwise(F.concat(lit(" ("), when, lit(")"))))
    services = _listed(served, doc, c("view"), F.row_number().over(within("view").orderBy("number")), said, one(said))

    granted = m.grants.withColumn("view", rec.grant_view("status"))
    cells = _cells(c("title"), c("funder"), F.coalesce("totalAward", "amount"), c("period"), c("role"), c("coPIsShare"))
    grants = _listed(granted, doc, c("view"), F.row_number().over(within("view").orderBy("number")), F.concat_ws(" ", "period", "title"), one(cells))

    others = rec.concat_buckets(m.texts, doc, OTHER_ACTIVITIES, ["number"], "place").select(doc, lit("otherActivities").alias("bucket"), "text", c("place").alias("number"))
    plain = m.texts.filter(~c("bucket").isin(*OTHER_ACTIVITIES, *NUMBERED, "studentInstructionalActivities", "teaching")).select(doc, "bucket", "text", "number").unionByName(others)
    texts = _listed(plain, doc, c("bucket"), c("number"), c("text"), one(c("text")))
    talks = m.texts.filter(c("bucket").isin(*NUMBERED)).withColumn("text", t.drop(t.trim("text"), t.LIST_NUMBER)).filter(rec.is_rendered_talk("text"))
    talks = rec.renumber(talks, [doc, "bucket"], ["number"], "place")
    talks = _listed(talks, doc, c("bucket"), c("place"), c("text"), one(F.concat(c("place").cast("string"), lit(". "), "text")))

    starred = rec.own_theses(m.publications.filter("bucket = 'theses'")).unionByName(m.publications.filter("bucket <> 'theses'"))
    shown = F.when(c("bucket") == "workInProgress", F.concat(lit("inProgress "), rec.in_progress_view("pub_type"))).otherwise(c("bucket"))
    starred = starred.withColumn("bucket", shown)
    starred = starred.withColumn("place", F.row_number().over(within("bucket").orderBy("number")))
    shown_number = F.when(c("bucket").startswith("inProgress"), c("place")).otherwise(c("number"))
    notes = F.array_join(F.array_remove(F.array(t.article_kind(F.coalesce("article_kind", lit(""))), t.previously_listed("previouslyListedAs")), ""), "; ")
    more = F.array_remove(F.array(notes, t.contribution_note("note", "text")), "")
    starred = _listed(starred, doc, c("bucket"), shown_number, c("text"), F.concat(one(F.concat(shown_number.cast("string"), lit(". "), "text")), more), c("is_new"))
    return employment.unionAll(education).unionAll(special).unionAll(services).unionAll(grants).unionAll(texts).unionAll(talks).unionAll(starred)


def _students(merged, doc: str, cutoff: str | None, saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Lines of the student section: groups with their numbered entries; without a group, teaching that is mentoring."""
    texts = merged.texts
    flat = texts.filter("bucket = 'studentInstructionalActivities'").select(doc, "text", F.struct(F.lit(0).alias("a"), F.col("number").alias("b")).alias("ord"))
    own = merged.groups.select(doc, "heading", "entry", F.struct(F.col("heading_order").alias("a"), F.col("number").alias("b")).alias("ord"))
    place = F.dense_rank().over(Window.partitionBy(doc).orderBy("a"))
    own = own.withColumn("a", F.col("ord.a")).withColumn("ord", F.struct(place.cast("int").alias("a"), F.col("ord.b").alias("b"))).drop("a")
    groups = saved(rec.fold_groups(own, flat, doc, "text"), "groups")
    entries = _divided(groups.withColumnRenamed("entry", "dated").withColumn("said", F.lit(False)), [doc, "heading", "heading_order"], cutoff)
    line = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("dated"))
    entries = entries.withColumn("lines", F.when(F.col("divider"), F.array(F.lit(DIVIDER), line)).otherwise(F.array(line)))
    entries = entries.select(doc, "heading", "heading_order", "number", F.posexplode("lines").alias("sub", "line"))
    heads = groups.select(doc, "heading", "heading_order").distinct().select(doc, "heading", "heading_order", F.lit(0).alias("number"), F.lit(0).alias("sub"), F.col("heading").alias("line"))
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy("heading_order"))
    listed = entries.unionByName(heads).select(doc, rank.alias("part"), F.col("number").cast("long").alias("number"), "sub", "line")
    mentoring = texts.filter("bucket = 'teaching'").filter(rec.is_mentoring("text")).join(groups.select(doc).distinct(), doc, "left_anti")
    mentoring = rec.renumber(mentoring, [doc], ["number"], "place").select(doc, F.lit("").alias("bucket"), F.col("place").alias("number"), F.col("text").alias("dated"), F.lit(False).alias("said"))
    mentoring = _divided(mentoring, [doc, "bucket"], cutoff)
    mentoring = mentoring.select(doc, F.lit(1).alias("part"), F.col("number").cast("long").alias("number"), F.posexplode(F.when(F.col("divider"), F.array(F.lit(DIVIDER), F.col("dated"))).otherwise(F.array("dated"))).alias("sub", "line"))
    return listed.unionByName(mentoring)


def _divided(df: DataFrame, group: list[str], cutoff: str | None) -> DataFrame:
    if cutoff is None:
        return df.withColumn("is_new", F.col("said")).withColumn("divider", F.lit(False))
    return rec.review_divider(df, group, F.col("dated"), "number", cutoff, F.col("said"))


def render_documents(merged, doc: str = "doc_id", cutoff: str | None = None, since_year: int | None = None, title: str | None = None, closing: tuple[str, ...] = (),
                     saved: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """doc, line_no and line: each document's whole form, from the name to the summary of what is left to do.

    merged: plans.consolidate.Merged.  Every section of OUTLINE stands in its order, with a fallback where it is empty; tables are lines
    of cells, lists are numbered as their section asks for, new records of bibliographies are starred, and a divider stands
    before the first new one.  saved: writes a table that several steps read and reads it again.  The outline is a broadcast table of fixed size; all else is joined or unioned by document.
    """
    spark = merged.metadata.sparkSession
    rows = [(i, level, heading, bucket, fallback, CELL.join(TABLES.get(bucket, ()))) for i, (level, heading, bucket, fallback) in enumerate(OUTLINE)]
    outline = F.broadcast(spark.createDataFrame(rows, "seq int, level int, heading string, bucket string, fallback string, head string"))
    line = lambda df, seq, a, b, c, text: df.select(doc, seq.cast("int").alias("seq"), a.cast("int").alias("a"), b.cast("long").alias("b"), c.cast("int").alias("c"), text.alias("line"))
    zero = F.lit(0)

    records = _divided(shown_records(merged, doc), [doc, "bucket"], cutoff).join(outline, "bucket")
    bibliography = F.col("bucket").isin(*p.PUBLICATION_BUCKETS) | F.col("bucket").startswith("inProgress")
    lines = F.when(bibliography & F.col("is_new"), F.transform("lines", lambda x, i: F.when(i == 0, F.concat(F.lit("*"), x)).otherwise(x))).otherwise(F.col("lines"))
    parts = records.select(doc, "seq", "number", F.posexplode(F.when(F.col("divider"), F.concat(F.array(F.lit(DIVIDER)), lines)).otherwise(lines)).alias("sub", "text"))
    body = line(parts, F.col("seq"), F.lit(1), F.col("number"), F.col("sub"), F.col("text"))
    students = _students(merged, doc, cutoff, saved).crossJoin(F.broadcast(spark.createDataFrame([(x[0],) for x in rows if x[3] == "studentInstructionalActivities"], "seq int")))
    body = body.unionAll(line(students, F.col("seq"), F.col("part"), F.col("number"), F.col("sub"), F.col("line")))

    body = saved(body, "lines")
    held = body.select(doc, "seq").distinct().withColumn("held", F.lit(True))
    places = saved(merged.metadata.select(doc).crossJoin(outline).join(held, [doc, "seq"], "left"), "places")
    places = places.filter("held or bucket is null or fallback is not null")
    out = body.unionAll(line(places, F.col("seq"), zero, zero, zero, F.col("heading")))
    out = out.unionAll(line(places.filter("held is null and bucket is not null"), F.col("seq"), zero, zero, F.lit(1), F.col("fallback")))
    out = out.unionAll(line(places.filter("held and head <> ''"), F.col("seq"), zero, zero, F.lit(2), F.col("head")))

    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(BLANK))
    top = [F.lit(title) if title else None, F.concat(F.lit("Name: "), filled("name"), F.lit("     Department: "), filled("department")), F.concat(F.lit("Title: "), filled("title")),
           F.lit(f"Review period (Section II activities): {since_year} – present") if since_year else None, F.lit(f"New since last review date: {cutoff}") if cutoff else None]
    top = merged.metadata.select(doc, F.posexplode(F.array(*[x for x in top if x is not None])).alias("i", "text"))
    out = out.unionAll(line(top, F.lit(-1), zero, F.col("i"), zero, F.col("text")))
    if closing:
        end = merged.metadata.select(doc, F.posexplode(F.array(*[F.lit(x) for x in closing])).alias("i", "text"))
        out = out.unionAll(line(end, F.lit(len(OUTLINE)), zero, F.col("i"), zero, F.col("text")))
    out = out.unionAll(_summary(merged, doc, len(OUTLINE) + 1, line))
    return out.withColumn("line_no", F.row_number().over(Window.partitionBy(doc).orderBy("seq", "a", "b", "c"))).select(doc, "line_no", "line")


def _summary(merged, doc: str, seq: int, line) -> DataFrame:
    """What is left to do, of documents with a gap or a note: gaps by severity, then notes, each numbered in its own order."""
    zero, at = F.lit(0), F.lit(seq)
    rank = {s: i + 1 for i, (s, _) in enumerate(SEVERITY_LABELS)}
    place = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("severity")]
    label = F.create_map(*[F.lit(x) for kv in SEVERITY_LABELS for x in kv])[F.col("severity")]
    gaps = merged.gaps.withColumn("n", F.row_number().over(Window.partitionBy(doc, "severity").orderBy("number")))
    text = lambda name: F.concat(F.col("n").cast("string"), F.lit(". "), "section", F.lit(" — "), name, F.lit(": "), "instruction")
    notes = merged.notes.withColumn("n", F.col("number"))
    some = gaps.select(doc).unionAll(notes.select(doc)).distinct()
    opening = some.select(doc, F.posexplode(F.array(F.lit(p.APPENDIX_HEADING), F.lit(SUMMARY_INTRO))).alias("i", "text"))
    return (
        line(opening, at, zero, F.col("i"), zero, F.col("text"))
        .unionAll(line(gaps.select(doc).distinct(), at, F.lit(1), zero, zero, F.lit(GAPS_HEADING)))
        .unionAll(line(gaps.select(doc, "severity").distinct(), at, F.lit(1), place, zero, label))
        .unionAll(line(gaps, at, F.lit(1), place, F.col("n"), text("field")))
        .unionAll(line(notes.select(doc).distinct(), at, F.lit(2), zero, zero, F.lit(NOTES_HEADING)))
        .unionAll(line(notes, at, F.lit(3), F.col("n"), zero, text("topic"))))
