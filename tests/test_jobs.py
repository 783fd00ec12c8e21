"""Jobs on small tables: order, ties, blanks and bad input."""

import random

from pyspark.sql import functions as F

from rollcall.functions import text as t
from rollcall.operators import audit, fuzzy, jobs, records as rec
from rollcall.sources import files, ingest


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_dedupe_drops_empty_keys_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1, "--"), (1, 2, "a"), (1, 3, "A "), (2, 1, "a")], "doc int, ord int, text string")
    once = rec.dedupe_first(df, ["doc"], t.norm_record("text"), ["ord"])
    assert rows(once, "doc", "ord") == [(1, 2), (2, 1)]
    assert rows(rec.dedupe_first(once, ["doc"], t.norm_record("text"), ["ord"]), "doc", "ord") == [(1, 2), (2, 1)]


def test_undated_rows_come_last_in_their_order(spark):
    df = spark.createDataFrame([(1, 1, "B"), (1, 2, "A 2001"), (1, 3, "C"), (1, 4, "D 1999")], "doc int, ord int, text string")
    out = rec.number_by_date(df, ["doc"], F.col("text"), ["ord"])
    assert [r.text for r in out.orderBy("number").collect()] == ["D 1999", "A 2001", "B", "C"]


def test_divider(spark):
    df = spark.createDataFrame([("a", 1, "x 1990"), ("a", 2, "y 2001"), ("b", 1, "y 2001"), ("b", 2, "z 2002")], "doc string, n int, text string")
    assert rows(rec.review_divider(df, ["doc"], F.col("text"), "n", "2000-01-01").filter("divider"), "doc", "n") == [("a", 2)]


def test_merge_does_not_depend_on_partitions(spark):
    data = [(1, "workInProgress", i, f"{i}. Title x" + (" *co-author y" if i == 2 else ""), k, None, f) for i, k, f in ((3, "other", None), (2, "journal", True), (1, "book", False))]
    random.shuffle(data)
    df = spark.createDataFrame(data, "doc_id int, bucket string, ord int, text string, pub_type string, note string, is_new boolean")
    for n in (1, 5):
        got = rec.merge_duplicates(df.repartition(n), ["doc_id"]).first()
        assert (got.text, got.pub_type, got.note, got.is_new, got.ord, got.copies) == ("1. Title x", "journal", "*co-author y", True, 1, 3)


def test_fuzzy_needs_eight_words(spark):
    w = "one two three four five six seven"
    a = spark.createDataFrame([(1, w), (2, w + " eight nine ten")], "key int, body string")
    b = spark.createDataFrame([(7, w), (8, "ten nine eight " + w + " more words here"), (9, w + " eight x y")], "key int, body string")
    assert rows(fuzzy.fuzzy_pairs(a, b, "key", "body"), "key_a", "key_b") == [(2, 8)]


def test_fuzzy_equals_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    a, b = ([(i, " ".join(r.sample(words, r.randint(6, 14)))) for i in range(60)] for _ in range(2))
    wanted = [(i, j) for i, x in a for j, y in b for s, u in [(set(x.split()), set(y.split()))] if min(len(s), len(u)) >= 8 and len(s & u) >= 0.9 * min(len(s), len(u))]
    df = [spark.createDataFrame(x, "key int, body string") for x in (a, b)]
    assert rows(fuzzy.fuzzy_pairs(*df, "key", "body"), "key_a", "key_b") == sorted(wanted)


def test_guarded_append_is_greedy(spark):
    long = "one two three four five six seven eight"
    df = spark.createDataFrame([([long, " ONE two three four five six seven eight", ""], [long + " nine", "other words here", "other words here"])], "held array<string>, more array<string>")
    assert df.select(fuzzy.guarded_append(F.col("held"), F.col("more")).alias("x")).first().x == [long, "other words here", "other words here"]


def test_one_bad_element(spark):
    df = spark.createDataFrame([(1, '{"sections":{"books":[{"citation":"a"}, 7, {"citation":{}}]}}'), (2, "[]"), (3, None)], "id int, body string")
    assert rows(ingest.publications(df, "body", "books"), "id", "pos", "citation") == [(1, 0, "a")]
    assert rows(ingest.quarantine(df, "body"), "id", "reason") == [(2, "not an object"), (3, "not JSON")]


def test_blank_metadata_overwrites(spark):
    df = spark.createDataFrame([(1, 1, '{"metadata":{"name":"A"},"sections":{"specialization":""}}'), (1, 2, '{"metadata":{"name":""},"sections":{"specialization":"s"}}')], "doc int, part int, body string")
    assert ingest.metadata(df, "doc", "body", "part").first().asDict() == {"doc": 1, "name": "", "department": "", "title": "", "specialization": "s"}


def test_own_theses(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_own_thesis boolean")
    assert rows(rec.own_theses(df), "id") == [(1,), (3,)]


def test_partials_are_replaced_not_repeated(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", "s1"), (1, "y", "s2")], "doc int, text string, slice_key string")
    path = str(tmp_path / "p")
    for df in (a, a.filter("slice_key = 's1'")):
        files.write_partials(df, path)
    assert rows(files.read_partials(spark, path, "doc int, text string, slice_key string"), "text", "slice_key") == [("x", "s1"), ("y", "s2")]


def test_admission(spark):
    df = spark.createDataFrame([("a.DOCX", 5), ("b.pdf", 5), ("c.docx", 60 << 20)], "path string, length long")
    assert [r.reject for r in files.admit_files(df).orderBy("path").collect()] == [None, "only .docx files are taken", "larger than 50 MB"]


def test_extractor_errors_are_rows(spark):
    def fn(body, bucket):
        if body == "bad":
            raise ValueError("no")
        return [body, bucket]

    df = spark.createDataFrame([(1, "s", "b", "ok"), (2, "s", "b", "bad")], "doc int, slice_key string, bucket string, body string")
    assert rows(jobs.extract_slices(df, "doc", fn).select("doc", "pos", F.coalesce("text", "error").alias("x")), "doc", "pos", "x") == [(1, 0, "ok"), (1, 1, "b"), (2, -1, "ValueError: no")]


def test_diff_of_a_run_with_itself_is_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert audit.diff_runs(df, df, ["k"], ["v"]).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, bucket string, ord int, text string, pub_type string, note string, is_new boolean")
    from rollcall.plans.consolidate import consolidate

    assert consolidate(empty).count() == 0


def test_no_turn_and_no_letter_is_cut(spark, tmp_path):
    from rollcall.functions import text
    from rollcall.plans.queries import QUERIES

    rows = [(1, t, f"t{t}") for t in range(1500)] + [(2, 0, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["guarded_append"](spark, str(tmp_path)).collect()
    assert sorted((x.conv_id, x.pos, x.text) for x in got) == rows
    long = spark.range(1).select(F.expr("repeat('ABCD', 300000)").alias("c")).select(F.length(text.sentence_case("c")).alias("n"))
    assert long.first().n == 1_200_000
