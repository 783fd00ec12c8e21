"""Source text as lines, and the excerpts of it that a slice of the work needs."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.functions import patterns as p
from rollcall.functions.text import plain_spaces, trim


def read_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", breaks: str = r"\r?\n", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, the columns in keep, n (0, 1, ...) and line of the lines that aren't blank."""
    parts = F.filter(F.transform(F.split(plain_spaces(text), breaks), trim), lambda x: x != "")
    return docs.select(doc, *keep, F.posexplode(parts).alias("n", "line"))


def segments(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs of text whose breaks were lost: a line end, or two white spaces or more."""
    return read_lines(docs.withColumn("_t", F.replace(F.col(text), F.lit("\r"), F.lit(""))), doc, "_t", r"\n|\s{2,}")


def doc_header(lines: DataFrame, doc: str = "doc_id", first: int = 20) -> DataFrame:
    """Name (the first line), department and title (the first of the leading lines with a word for it; else '')."""
    low = F.lower("line")
    has = lambda *w: low.rlike("|".join(w))
    pick = lambda c: F.coalesce(F.min_by("line", F.when(c, F.col("n"))), F.lit(""))
    return lines.filter(F.col("n") < first).groupBy(doc).agg(
        F.min_by("line", "n").alias("name"), pick(has("department", "dept")).alias("department"),
        pick(has("professor", "lecturer", "associate", "assistant")).alias("title"))


def cut_generated_tail(text: Column | str, heading: str = p.APPENDIX_HEADING, intro: str = p.APPENDIX_INTRO) -> Column:
    """The text up to a generated appendix: a line with its heading, whose intro follows within 600 characters."""
    c = F.col(text) if isinstance(text, str) else text
    mark = rf"(?:^|\n)\s*{heading}\s*(?:\n|$)"
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.regexp_count(c, F.lit(mark)), F.lit(1))), lambda i: F.regexp_count(c, F.lit(mark)) >= i)
    pieces = F.split(c, mark)
    # Where the i-th heading starts: after the pieces and headings before it.
    marks = F.regexp_extract_all(c, F.lit(f"({mark})"), 1)
    at = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(
        F.slice(marks, 1, i - 1), F.lit(0), lambda s, x: s + F.length(x))
    real = F.filter(F.transform(starts, at), lambda a: F.contains(F.regexp_replace(F.substring(c, a + 1, F.lit(600)), r"\s+", " "), F.lit(intro)))
    return F.when(F.size(real) > 0, F.regexp_replace(F.substring(c, F.lit(1), F.array_min(real)), r"\s+$", "")).otherwise(c)


def lines_between(lines: DataFrame, group: list[str], start: str, end: str | None) -> DataFrame:
    """From the first line like start to before the first later line like end; all lines if none is like start."""
    w = Window.partitionBy(*group)
    a = lines.withColumn("_a", F.min(F.when(F.col("line").rlike(start), F.col("n"))).over(w))
    z = F.min(F.when((F.col("n") > F.col("_a")) & F.col("line").rlike(end), F.col("n"))).over(w) if end else F.lit(None).cast("int")
    a = a.withColumn("_z", z)
    inside = (F.col("n") >= F.col("_a")) & (F.col("_z").isNull() | (F.col("n") < F.col("_z")))
    return a.filter(F.col("_a").isNull() | inside).drop("_a", "_z")


def has_year_between(line: Column | str, first: int | None, last: int | None) -> Column:
    c = F.col(line) if isinstance(line, str) else line
    years = F.regexp_extract_all(c, F.lit(rf"{p.LEFT}((?:19|20)\d{{2}}){p.RIGHT}"), 1)
    return F.exists(years, lambda y: (y.cast("int") >= (first or 0)) & (y.cast("int") <= (last or 9999)))


def context(lines: DataFrame, group: list[str], hit: Column, heading: Column) -> DataFrame:
    """Lines that hit, with two lines before and one after, and heading lines; the whole text if that leaves nothing."""
    ordered = Window.partitionBy(*group).orderBy("n")
    marked = lines.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    near = F.max("_hit").over(ordered.rowsBetween(-1, 2))
    marked = marked.withColumn("_keep", near | F.coalesce(heading, F.lit(False)))
    some = F.max("_keep").over(Window.partitionBy(*group))
    return marked.withColumn("_some", some).filter("_keep or not _some").drop("_hit", "_keep", "_some")


# --- fixed values: slices of a document by section and years --------------------------------------------------------
_SERVICE = (
    r"departmental and university service activities|service to uc(?:\s*&\s*|\s+and\s+)uc san diego|university service",
    r"professional service activities|service outside of uc(?:\s*&\s*|\s+and\s+)uc san diego|memberships", "service|committee|council|senate|departmental|campus|university|systemwide")
_TALKS = (
    "invited lectures at national and international meetings|invited lectures at institutions|presentations at national and international meetings|other invited presentations",
    "abstracts and contributed talks|most significant contributions to promoting diversity", "presentations?|lectures?|seminars?|meetings?")
_ABSTRACTS = ("abstracts and contributed talks", None, "abstracts?")
_JOURNALS = ("peer-reviewed publications", "other publications", "refereed|journal|articles?|publications?")
_NONE = (None, None, None)
#: slice, label, first year, last year, (start, end, heading), first bucket, high fidelity, limited to the review period
SLICES = (
    ("meta_and_I", "Section I — Employment & Education", None, None, _NONE, "employment", True, False),
    ("II_service_pre_2010", "Section II — University Service (through 2010)", None, 2010, _SERVICE, "universityService", False, True),
    ("II_service_2011_2020", "Section II — University Service (2011–2020)", 2011, 2020, _SERVICE, "universityService", False, True),
    ("II_service_post_2020", "Section II — University Service (after 2020)", 2021, None, _SERVICE, "universityService", False, True),
    ("II_memberships_awards", "Section II — Memberships & Awards", None, None, (
        r"appointments|memberships|professional societies|professional affiliations|honors(?:,\s*|\s+and\s+)awards(?:\s+and\s+fellowships)?|awards and fellowships|honors and fellowships",
        "contracts and grants|research support|external professional activities", None), "memberships", True, True),
    ("II_teaching", "Section II — Teaching & Mentoring", None, None, (
        "student instructional activities|educational activities|teaching and mentoring", "external reviews of primary creative work|section iii", None), "teaching", True, False),
    ("II_grants", "Section II — Contracts & Grants", None, None, (
        "contracts and grants|current research support|past research support", "external professional activities|professional service activities", None), "grants", False, True),
    ("II_external", "Section II — External Activities & Reviews", None, None, (
        "professional service activities|external professional activities",
        "educational activities|presentations at national and international meetings|most significant contributions to promoting diversity", None), "professionalActivities", False, True),
    ("II_presentations_pre_2000", "Section II — Presentations (< 2000)", None, 1999, _TALKS, "presentations", True, True),
    ("II_presentations_2000_2010", "Section II — Presentations (2000–2010)", 2000, 2010, _TALKS, "presentations", True, True),
    ("II_presentations_2011_2020", "Section II — Presentations (2011–2020)", 2011, 2020, _TALKS, "presentations", True, True),
    ("II_presentations_post_2020", "Section II — Presentations (> 2020)", 2021, None, _TALKS, "presentations", True, True),
    ("II_diversity_other", "Section II — Diversity, Outreach, Other", None, None, (
        "most significant contributions to promoting diversity|contributions to diversity|outreach", "student instructional activities|educational activities|section iii", None),
     "diversityContributions", False, True),
    ("III_journals_pre_2000", "Section III — Peer-Reviewed Journals (< 2000)", None, 1999, _JOURNALS, "peerReviewedJournals", True, False),
    ("III_journals_2000_2010", "Section III — Peer-Reviewed Journals (2000–2010)", 2000, 2010, _JOURNALS, "peerReviewedJournals", True, False),
    ("III_journals_late", "Section III — Peer-Reviewed Journals (> 2010)", 2011, None, _JOURNALS, "peerReviewedJournals", True, False),
    ("III_other_a", "Section III — Books, Chapters, Reviews", None, None, _NONE, "books", True, False),
    ("III_other_proc", "Section III — Conference Proceedings", None, None, _NONE, "refereedProceedings", True, False),
    ("III_abstracts_pre_2000", "Section III — Abstracts (< 2000)", None, 1999, _ABSTRACTS, "abstracts", False, False),
    ("III_abstracts_2000_2010", "Section III — Abstracts (2000–2010)", 2000, 2010, _ABSTRACTS, "abstracts", False, False),
    ("III_abstracts_2011_2020", "Section III — Abstracts (2011–2020)", 2011, 2020, _ABSTRACTS, "abstracts", False, False),
    ("III_abstracts_post_2020", "Section III — Abstracts (> 2020)", 2021, None, _ABSTRACTS, "abstracts", False, False),
    ("III_popular_products", "Section III — Popular Works & Products", None, None, _NONE, "popularWorks", False, False),
)
# --- end of fixed values ---------------------------------------------------------------------------------------------


def slice_dim(spark: SparkSession) -> DataFrame:
    """The slices as a table of 23 rows."""
    edge = lambda x: f"(?i){p.LEFT}(?:{x}){p.RIGHT}" if x else None
    rows = [
        (i, k, label, first, last, edge(s), edge(e), edge(h), bucket, high, limited, k == "III_journals_late")
        for i, (k, label, first, last, (s, e, h), bucket, high, limited) in enumerate(SLICES)]
    return spark.createDataFrame(
        rows, "slice_seq int, slice_key string, label string, first_year int, last_year int, start_pattern string, end_pattern string, heading_pattern string, "
        "bucket string, high_fidelity boolean, review_period boolean, with_in_progress boolean")


def _between(first: int, last: int, y: Column) -> Column:
    return y.between(first, last)


def slice_excerpts(lines: DataFrame, slices: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The lines of each document that each slice needs: doc, slice_key, n, line; only lines that a slice keeps are copied."""
    return slice_marks(lines, slices, lambda r: r.slice_key, doc).select(doc, F.explode("slices").alias("slice_key"), "n", "line")


def slice_marks(lines: DataFrame, slices: DataFrame, named: Callable[[Row], object], doc: str = "doc_id") -> DataFrame:
    """doc, n, line and slices, the names of the slices that need the line; rows lie by document, in the order of n.

    A slice without a year window keeps its bounded lines; one with it keeps the context of lines with such a year, or, if
    there is none, the whole text.  slices is the dimension of slice_dim, whose few rows become columns: each pattern is
    searched once a line, all bounds and contexts are windows over the document in one order, so its lines are shuffled and
    sorted once.
    """
    dim = slices.collect()
    edges = {p: F.regexp_like("line", F.lit(p)) for r in dim for p in (r.start_pattern, r.end_pattern, r.heading_pattern) if p}
    name = {p: f"_like{i}" for i, p in enumerate(edges)}
    like = lambda p: F.col(name[p]) if p else F.lit(False)
    years = F.regexp_extract_all("line", F.lit(rf"{p.LEFT}((?:19|20)\d{{2}}){p.RIGHT}"), 1)
    short = F.length("line") <= 140
    rows = lines.select(doc, "n", "line").withColumns({
        **{name[p]: c for p, c in edges.items()}, "_years": F.transform(years, lambda y: y.cast("int")),
        "_unfinished": F.col("line").rlike(p.words(*p.SOURCE_IN_PROGRESS)), "_short": short, "_section": short & F.col("line").rlike(r"(?i)^section\s")})
    ordered = Window.partitionBy(doc).orderBy("n")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounds = {(r.start_pattern, r.end_pattern): i for i, r in enumerate(dim) if r.start_pattern}
    rows = rows.withColumns({f"_a{i}": F.min(F.when(like(a), F.col("n"))).over(whole) for (a, _), i in bounds.items()})
    rows = rows.withColumns({f"_z{i}": F.min(F.when((F.col("n") > F.col(f"_a{i}")) & like(z), F.col("n"))).over(whole) for (_, z), i in bounds.items()})
    inside = {None: F.lit(True)} | {k: F.col(f"_a{i}").isNull() | ((F.col("n") >= F.col(f"_a{i}")) & (F.col(f"_z{i}").isNull() | (F.col("n") < F.col(f"_z{i}")))) for k, i in bounds.items()}
    of = lambda r: inside[(r.start_pattern, r.end_pattern) if r.start_pattern else None]
    dated = [(i, r) for i, r in enumerate(dim) if r.first_year is not None or r.last_year is not None]
    hits = {}
    for i, r in dated:
        year = F.exists("_years", partial(_between, r.first_year or 0, r.last_year or 9999))
        hits[f"_hit{i}"] = of(r) & (year | F.col("_unfinished") if r.with_in_progress else year)
    rows = rows.withColumns(hits)
    near = {f"_keep{i}": of(r) & (F.max(f"_hit{i}").over(ordered.rowsBetween(-1, 2)) | F.col("_section") | (F.col("_short") & like(r.heading_pattern))) for i, r in dated}
    rows = rows.withColumns(near)
    rows = rows.withColumns({f"_some{i}": F.max(f"_keep{i}").over(whole) for i, _ in dated})
    kept = {i: F.col(f"_keep{i}") | ~F.col(f"_some{i}") for i, _ in dated}
    keys = F.array_compact(F.array(*[F.when(kept.get(i, of(r)), F.lit(named(r))) for i, r in enumerate(dim)]))
    return rows.select(doc, "n", "line", keys.alias("slices"))
