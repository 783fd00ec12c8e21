"""Literal cases for each fixed pattern: texts that it finds, and near ones that it doesn't."""

from pyspark.sql import functions as F

from rollcall.functions import dates, patterns as p, text as t
from rollcall.operators import records as rec

WORDS = {
    "in progress": (p.words(*p.IN_PROGRESS), ["Submitted to X", "now under review.", "Forthcoming"], ["resubmittedly", "progress", "reviewed"]),
    "source in progress": (p.words(*p.SOURCE_IN_PROGRESS), ["in review", "In Progress:"], ["forthcoming", "preview"]),
    "audience": (p.words(*p.WIDE_AUDIENCE), ["Gordon conference", "the ACS, 2001", "World meeting"], ["internationally", "acsx", "meetings"]),
    "honorific": (p.words(*p.HONORIFIC), ["Fellow, X", "visiting scholar"], ["fellowship", "visit"]),
    "ordinary post": (p.words(*p.ORDINARY_POST), ["Postdoctoral Fellow", "Professor, Department of X", "staff scientist"], ["professor of X", "biochemist"]),
    "no employment": (p.words(*p.NOT_EMPLOYMENT), ["Vice Chancellor", "chair"], ["chairs", "chancellor"]),
    "rank": (p.words(*p.ACADEMIC_RANK), ["Associate Professor", "Lecturer"], ["lectures", "profess"]),
    "mentoring": (p.words(*p.MENTORING), ["Thesis of A", "undergraduate helper"], ["students", "supervised"]),
    "refereed": (f"(?i)(?:{'|'.join(p.REFEREED_PROCEEDINGS)})", ["Proc. of X", "International parts Symposium", "Conf. Proc. 7", "Radiocarbon 12"], ["process", "international meeting", "radiocarbon dating"]),
    "authorship": (p.CONTRIBUTION, ["A study. *co-author with B", "A ** Senior author."], ["A study, co-author", "*co-author first"]),
    "group in front": (p.GROUP_PREFIX, ["Current Ph.D. Students: A", "former Staff X: B"], ["Ph.D. Students: A", "Current students: A"]),
    "flat group": (p.FLAT_GROUP, ["Masters: A", "  Long name of a group: B"], ["abc: d", "no colon", "Masters:"]),
    "list number": (p.LIST_NUMBER, ["71. A", "71) A", "71 . A"], ["(71) A", "A 71."]),
    "source number": (p.SOURCE_NUMBER, ["(22) A", "71. A", "71) A"], ["71 . A", "[71] A"]),
    "years": (p.YEARS, ["in 1999", "2001 - present", "2001 to 2003"], ["1899", "120012"]),
    "leading date": (p.LEADING_DATE, ["Sept 23, 2014 A", "May 2010: A", "2010-02-03 A", "2001, 2002 A", "1999 – present A", "1750 A"], ["Sept. 23, 2014", "12 May 2010 A", "20101 A"]),
    "hidden note": (f"(?i){p.LEFT}(?:{'|'.join(p.HIDDEN_NOTE)})", ["Source no. 7", "review  material"], ["resource no", "reviewed"]),
}


def test_each_pattern_on_literal_texts(spark):
    rows = [(k, pattern, x, want) for k, (pattern, yes, no) in WORDS.items() for xs, want in ((yes, True), (no, False)) for x in xs]
    got = spark.createDataFrame(rows, "name string, pattern string, text string, want boolean").withColumn("found", F.regexp_like("text", F.col("pattern"))).collect()
    assert [(r.name, r.text) for r in got if r.found != r.want] == []


def test_homes_of_publications(spark):
    cases = [
        ("otherArticles", "A review of the book B, 1999", "popularWorks"), ("otherArticles", "Proc. of the parts, 1999", "refereedProceedings"), ("otherArticles", "Parts workshop, 1999", "otherProceedings"),
        ("otherProceedings", "SPIE Conference 7", "refereedProceedings"), ("otherProceedings", "Parts workshop", "otherProceedings"), ("otherArticles", "Letters 7", "otherArticles"), ("books", "Proceedings", "books")]
    df = spark.createDataFrame(cases, "bucket string, text string, want string")
    assert [r for r in df.withColumn("home", rec.publication_home(F.col("bucket"), F.col("text"))).collect() if r.home != r.want] == []


def test_headings_and_notes(spark):
    df = spark.createDataFrame([("Current Ph.D. Students:", "Former Ph.D. Students"), ("current postdoctoral fellows", "Current Postdoctoral Associates"), ("Former undergraduates", "Former Undergraduate Research Students"),
                                ("Masters students", "Former Masters Students"), ("Visiting", "Visiting Faculty/Students"), ("Group x", "Group x"), (" : ", ":")], "heading string, want string")
    assert [r for r in df.withColumn("got", t.canonical_heading("heading")).collect() if r.got != r.want] == []
    notes = spark.createDataFrame([("A study. *co-author with B.", "A study.", "*co-author with B."), ("A study", "A study", None), (" A * star ", "A * star", None)], "text string, citation string, note string")
    got = notes.withColumn("s", t.split_contribution("text")).collect()
    assert [(r.s.citation, r.s.note) for r in got] == [(r.citation, r.note) for r in got]


def test_dates_keep_their_kind(spark):
    df = spark.createDataFrame([("Talk, Sept 23, 2014", 20140923), ("Talk, 2014-09-23", 20140923), ("May 2010", 20100500), ("Talk 2001 - present", 20010000), ("1750 drawings, 2010", None), ("none", None)], "text string, want int")
    assert [r for r in df.withColumn("got", dates.sort_key(F.col("text"))).collect() if r.got != r.want] == []
