"""Expressions on literal rows, quirks included."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions import dates as d
from rollcall.functions import text as t
from rollcall.operators import lines as ln
from rollcall.operators import records as rec
from rollcall.sources.files import decode_entities, markup_to_text


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [
    ("71. Sept 23, 2014 Talk at X.", "Talk at X. (Sept 23, 2014)"), ("2017 Prize (2017)", "Prize (2017)"), ("(22) Title (2010)", "Title (2010)"), ("2010. Title", "Title"),
    ("2001–present Board", "Board (2001–present)"), ("May 2010", "May 2010"), ("  a \t b  ", "a b"), ("1999, 2001 Visits", "Visits (1999, 2001)"), ("", ""),
])
def test_clean_record(spark, given, wanted):
    assert value(spark, d.clean_record(F.lit(given))) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("Talk, Sept. 23, 2014", 20140000), ("1750 drawings, shown 2010", None), ("Talk, 12 May 2010", 20100500), ("Prize 2020", 20200000), ("nothing", None), (None, None),
    ("June 3, 2001: x", 20010603), ("x 2001-02-30", 20010230), ("é2010", 20100000), ("a 1999 - 2004 b", 19990000), ("12010", None),
])
def test_sort_key(spark, given, wanted):
    assert value(spark, d.sort_key(F.lit(given))) == wanted


def test_cutoff(spark):
    assert value(spark, d.before(F.lit("Prize 2020"), "2020-01-01")) is True
    assert value(spark, d.on_or_after(F.lit("Prize 2020"), "2020-01-01")) is False
    assert value(spark, d.on_or_after(F.lit("Prize 2020"), "2020-1-1")) is False
    assert value(spark, d.on_or_after(F.lit("none"), "1900-01-01")) is False


def test_valid(spark):
    assert [value(spark, d.valid_iso_date(F.lit(x))) for x in ("2020-02-29", "2021-02-29", "2020-2-2", None)] == [True, False, False, False]
    assert [value(spark, d.valid_since_year(F.lit(x), 2030)) for x in ("1950", "1949", "2031", "2000.5", "x")] == [True, False, False, False, False]


def test_keys(spark):
    assert value(spark, t.norm_record(F.lit("3. Current  Chair, École"))) == "present chair cole"
    assert value(spark, t.norm_service(F.lit("Chair, Academic Senate: budget"), F.lit("2001"))) == "budget 2001"
    assert value(spark, t.activity_core(F.lit("7) Member of board 1999–present"))) == value(spark, t.activity_core(F.lit("board 2004")))
    assert value(spark, t.citation_key(F.lit("5. A, B. Title **Corresponding author."))) == "a b title"
    assert value(spark, t.norm_record(F.lit("--"))) == ""


def test_headings(spark):
    assert value(spark, t.canonical_heading(F.lit("Current Ph.D. Students:"))) == "Former Ph.D. Students"
    assert value(spark, t.canonical_heading(F.lit("Other:"))) == "Other"
    assert value(spark, t.strip_group_prefix(F.lit("1. A (b): x"), F.lit("a (b)"))) == "x"
    assert value(spark, t.strip_group_prefix(F.lit("Current Masters in art: y"), F.lit("q"))) == "y"


def test_display(spark):
    assert value(spark, t.display_period(F.lit("- 1999"), F.lit("2001 –"))) == "1999 – 2001"
    assert value(spark, t.display_cell(F.lit("  "))) == "Not listed"
    assert value(spark, t.display_degree(F.lit("PhD (1999)"), F.lit("1999"))) == "PhD"
    assert value(spark, t.sentence_case(F.lit("SENIOR AUTHOR"))) == "Senior author"
    assert value(spark, t.sentence_case(F.lit("ABC"))) == "ABC"
    assert value(spark, t.contribution_note(F.lit("Source no. 5"), F.lit("x"))) == ""
    assert value(spark, t.contribution_note(F.lit("lead author."), F.lit("x (Lead author)"))) == ""


def test_publications(spark):
    assert value(spark, rec.is_in_progress(F.lit("A paper"))) is True
    assert value(spark, rec.is_in_progress(F.lit("A paper 1999"))) is False
    home = lambda b, c: value(spark, rec.publication_home(F.lit(b), F.lit(c)))
    assert home("otherArticles", "Review of a book, Press") == "popularWorks"
    assert home("otherArticles", "Proc. of X") == "refereedProceedings"
    assert home("otherArticles", "Workshop Y") == "otherProceedings"
    assert home("books", "Proc. of X") == "books"


def test_tail(spark):
    intro = ln.p.APPENDIX_INTRO
    cut = lambda x: value(spark, ln.cut_generated_tail(F.lit(x)))
    assert cut(f"body  \nConversion Review Summary\n{intro}\nmore") == "body"
    assert cut("body\nConversion Review Summary\nother") == "body\nConversion Review Summary\nother"
    assert cut(f"a\nConversion Review Summary\nb{'x' * 700}\nConversion Review Summary\n{intro}") == f"a\nConversion Review Summary\nb{'x' * 700}"


def test_markup(spark):
    assert value(spark, markup_to_text(F.lit("<p>a &amp;lt; b  </p><p>c</p>"))) == "a < b\nc"
    assert value(spark, decode_entities(F.lit("&amp;lt;"), False)) == "&lt;"
