"""The key of a citation is made once a row, and dates are found whatever their kind."""

from pyspark.sql import functions as F

from rollcall.functions import dates
from rollcall.operators import records as rec


def test_the_key_is_made_once(spark):
    data = [(1, "books", 1, "Title x, 1999", "book", None, None), (1, "books", 2, "1. title X 1999", "book", "n", True), (1, "books", 3, "--", "book", None, None), (1, "books", 4, None, "book", None, None)]
    df = spark.createDataFrame(data, "doc_id int, bucket string, ord int, text string, pub_type string, note string, is_new boolean").repartition(3)
    out = rec.merge_duplicates(df, ["doc_id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+") == 1
    assert [(r.text, r.note, r.is_new, r.ord, r.copies) for r in out.collect()] == [("Title x, 1999", "n", True, 1, 2)]


def test_kinds_of_dates_behind_their_cheap_signs(spark):
    texts = {"Talk, May 12, 2010": 20100512, "Talk, Sept\t2014": 20140900, "Talk on 2003-04-05 x": 20030405, "Talk 2001–2005": 20010000, "Talk (1999)": 19990000, "x 1998 - present": 19980000, "none 12": None, "": None}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "text string, wanted int")
    assert [(r.text, r.key) for r in df.select("text", dates.sort_key(F.col("text")).alias("key")).collect()] == list(texts.items())
