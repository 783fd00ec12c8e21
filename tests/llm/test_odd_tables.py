"""Null keys, null texts, repeated rows, clashing columns and long texts, and plain versions of what SQL can't express."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import decontamination, html_extraction, language_id, near_duplicates, packing, quality_model, quality_rules, queries, sharding, suffix_dedup, warc
from rollcall.llm._frames import begun, finished, flagged, only_touched, saved, spread_join
from rollcall.llm.queries import tokenizer_path
from tests.llm.util import CLASH, WORD, prose

R = random.Random(4)
PASSAGE = prose(R, 120)
TEXTS = [(None, None), (None, PASSAGE), (None, "a"), (1, ""), (2, PASSAGE + " " + prose(R, 30)), (3, prose(R, 80)), (3, prose(R, 80)), (4, "same words " * 30), (4, "same words " * 30), (4, "same words " * 30), (5, "é" * 10)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "en", "s", 0, *["x"] * 8) for k, t in TEXTS], CLASH).cache()


def test_near_duplicates_of_null_and_repeated_keys(odd):
    got = near_duplicates.near_duplicates(odd).collect()
    assert Counter((x.doc_id, x.kept) for x in got if x.doc_id == 4) == {(4, True): 3} and len(got) == len(TEXTS)
    assert all(x.component_id == x.doc_id for x in got)


def test_passages_of_null_and_repeated_keys(odd):
    got = suffix_dedup.repeated_passages(odd, length=100, words=51, cut_words=False).collect()
    by = Counter((x.doc_id, x.n_removed, x.n_run_words) for x in got)
    size = len(PASSAGE)
    assert by[None, size, 120] == 1 and by[2, size, 120] == 1 and by[4, 330, 60] == 3 and by[None, 0, 0] == 2 and len(got) == len(TEXTS)


def test_items_of_null_and_repeated_keys(spark, odd):
    items = spark.createDataFrame([(None, PASSAGE, 1), (7, PASSAGE, 1), (7, PASSAGE, 1), (8, None, 1)], "item_id long, text string, n long")
    got = Counter((x.doc_id, x.item_id) for x in decontamination.contained_items(odd, items).collect())
    assert got == {(None, None): 1, (None, 7): 2, (2, None): 1, (2, 7): 2}
    assert Counter((x.doc_id, x.item_id) for x in decontamination.contained_items(odd, items, block_shingles=10).collect()) == got
    assert decontamination.contained_items(odd, items.limit(0)).count() == 0


def test_rules_models_shards_and_packing_keep_every_row(spark, odd):
    keys = Counter(k for k, _ in TEXTS)
    assert Counter(x.doc_id for x in quality_rules.repetition_rules(odd, keep=["doc_id"]).collect()) == keys
    model = quality_model.fit(odd.withColumn("label", F.col("doc_id") % 2))
    assert Counter(x.doc_id for x in quality_model.score(odd, model, ["doc_id"]).collect()) == keys
    found = language_id.identify(odd, language_id.prototypes(odd), ["doc_id"]).collect()
    assert Counter(x.doc_id for x in found) == keys and {x.lang_pred for x in found} == {"en", "und"}
    assert Counter(x.doc_id for x in packing.best_fit_packing(odd, tokenizer_path(), 2048).collect()) == keys
    long = spark.createDataFrame([(1, "x" * 3_000_000, "s"), (1, "x" * 3_000_000, "s"), (None, None, None)], "doc_id long, text string, source string")
    got = sharding.stratified_shards(long, 2).collect()
    assert Counter((x.doc_id, x.size) for x in got) == {(1, 3_000_016): 2, (None, 16): 1}
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert Counter((x.page_id, x.text) for x in html_extraction.main_text(pages).collect()) == Counter((k, (t or "").strip()) for k, t in TEXTS)
    dated = pages.withColumn("seen", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    assert {x.warc_date for x in warc.derivatives(warc.responses(dated, date="seen")).collect()} == {"2024-05-06T07:08:09Z"}
    assert Counter(x.page_id for x in warc.derivatives(warc.responses(pages)).collect()) == Counter({k: 2 * n for k, n in keys.items()})


def test_copies_do_not_fill_the_training_sample(spark):
    rows = [("good words here", 1.0)] * 500 + [(f"bad ### {i}", 0.0) for i in range(40)] + [(f"fine {i}", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, label double")
    model = quality_model.fit(df, order=F.lit(5).cast("long"), train_rows=81)
    got = {x.text: x.score for x in quality_model.score(df, model, ["text"]).collect()}
    assert got["bad ### 1"] < 0.5 < got["fine 1"]


def test_held_out_is_never_null(spark, tmp_path):
    rows = [(None, PASSAGE, "en"), (1, PASSAGE, "en"), (2, "ab", None), (10, "cd", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query, n, wanted in ((queries.op7_quality_model, 4, 2), (queries.op10_language_id, 5, 0)):
        got = {x.doc_id: x.held_out for x in query(spark, str(tmp_path)).collect()}
        assert got == {k: k is not None and zlib.crc32(str(k).encode()) % n == wanted for k, *_ in rows}


def test_shards_equal_the_law_computed_plainly(spark):
    rows = [(i, f"t{i % 50}", "en", f"s{min(i % 10, 4)}", 0) for i in range(500)]
    got = sharding.stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long"), 40).collect()
    hashes = {x.doc_id: x.h for x in spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").select(
        "doc_id", F.xxhash64(F.lit(0), "doc_id", F.crc32(F.col("text").cast("binary")), F.octet_length("text")).alias("h")).collect()}
    order = lambda i: (hashes[i] < 0, hashes[i])
    place = []
    by = defaultdict(list)
    for i, _, _, s, _ in rows:
        by[s].append(i)
    for s, own in by.items():
        for rank, i in enumerate(sorted(own, key=order)):
            place.append(((rank + 0.5) / len(own), s, hashes[i], i))
    size, more = divmod(len(rows), 40)
    edges = np.cumsum([0] + [size + 1] * more + [size] * (40 - more))
    wanted = {}
    for at, (_, _, _, i) in enumerate(sorted(place)):
        shard = int(np.searchsorted(edges, at, "right")) - 1
        wanted[i] = shard, at - int(edges[shard])
    assert {x.doc_id: (x.shard, x.slot) for x in got} == wanted


def test_the_rules_own_verdict_computed_plainly(spark):
    r = random.Random(8)
    part = prose(r, 40)
    texts = [prose(r, 150), *(prose(r, 60) + " " + part[: 60 * k] + " " + prose(r, 40) + " " + part[: 60 * k] + " " + prose(r, 5 * k) for k in range(1, 5)), prose(r, 30) + " a b c d e f g h i j k l m n" * 3]
    got = {x.doc_id: x for x in quality_rules.repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    least = quality_rules.REPEAT_WORDS
    rejected = 0
    for i, text in enumerate(texts):
        w = WORD.findall(text)
        lcp = [max(next((k for k in range(len(w)) if max(a, b) + k >= len(w) or w[a + k] != w[b + k]), 0) for b in range(len(w)) if b != a) for a in range(len(w))]
        covered = set()
        for a, n in enumerate(lcp):
            if n >= least:
                covered |= set(range(a, a + n))
        chars = sum(len(w[a]) for a in covered)
        bad = chars > quality_rules.MAX_COVERED * sum(map(len, w)) or max(lcp) > quality_rules.MAX_REPEAT and max(lcp) > quality_rules.MAX_REPEAT_SHARE * len(w)
        assert (got[i].covered_chars, got[i].longest_repeat, got[i].kept) == (chars, max(lcp), not bad and not got[i].base_failed), i
        rejected += bad and not got[i].base_failed
    assert rejected  # the method rejects what the base rules let through


def test_languages_equal_vectors_added_up_plainly(spark):
    r = random.Random(6)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(2, 6)))
    rows = [(i, " ".join(word(s) for _ in range(8)), k) for i in range(12) for k, s in (("aa", "abcdé"), ("bb", "cdefñ"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dim = language_id.DIMENSIONS

    def vector(text):
        x = [ord(c) for c in re.sub("[^a-zéñ]+", "\0", text.lower())]
        x = [0, 0, *x, 0, 0]
        v = [language_id.letter_vector(c, dim) for c in x]
        return sum(np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2] for i in range(len(x) - 2))

    sums = {k: sum(vector(t) for _, t, lang in rows if lang == k) for k in ("aa", "bb")}
    cos = lambda a, b: float(a @ b) / math.sqrt(float(a @ a) * float(b @ b))
    wanted = Counter((i, max(sums, key=lambda k: cos(vector(t), sums[k])), round(max(cos(vector(t), s) for s in sums.values()), 4)) for i, t, _ in rows)
    got = language_id.identify(df, language_id.prototypes(df), ["doc_id"]).collect()
    assert Counter((x.doc_id, x.lang_pred, round(x.score, 4)) for x in got) == wanted


def test_scores_equal_sparse_sums_computed_plainly(spark):
    texts = [prose(R, 30) for _ in range(40)] + ["Aa aa aa ### 12x", "", None]
    df = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(texts)], "doc_id long, text string, label double")
    w, b = quality_model.fit(df)
    got = {x.doc_id: x.score for x in quality_model.score(df, (w, b), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        row, number = quality_model.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), quality_model.BITS, quality_model.NGRAM)
        tokens = re.findall("[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]+", t or "")
        assert len(number) == max(0, 2 * len(tokens) - 1)
        total = sum(float(w[k]) for k in number) / math.sqrt(max(1, len(number))) + b
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


@pytest.mark.parametrize("batch", [1, 4])
def test_updates_follow_the_leader_coordinate_by_coordinate(batch, monkeypatch):
    """Each weight is the minimum of its linearised losses, step-size terms and penalties, kept here in plain dictionaries."""
    monkeypatch.setattr(quality_model, "BATCH", batch)
    monkeypatch.setattr(quality_model, "L1", 0.5)  # high enough that some weights stay at nought
    bits, passes, r = 5, 3, np.random.default_rng(batch)
    rows = []
    for i in range(30):
        number = np.sort(r.choice(2**bits, r.integers(0, 9), replace=False)).astype(np.int64)
        rows.append((number, r.uniform(0.1, 2, len(number)), float(i % 3 == 0)))
    z, n, bias = Counter(), Counter(), 2**bits

    def weight(k):
        limit = 0.0 if k == bias else quality_model.L1
        if abs(z[k]) <= limit:
            return 0.0
        return -(z[k] - math.copysign(limit, z[k])) / ((quality_model.BETA + math.sqrt(n[k])) / quality_model.ALPHA + quality_model.L2)

    share, order = sum(y for *_, y in rows) / len(rows), np.random.default_rng(11)
    for _ in range(passes):
        for part in np.array_split(order.permutation(len(rows)), len(rows) // batch):
            slopes = Counter()
            for i in part:
                number, value, y = rows[i]
                x = [*zip(number.tolist(), value.tolist(), strict=True), (bias, 1.0)]
                p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x)))
                for k, v in x:
                    slopes[k] += (p - y) * v * 0.5 / (share if y else 1 - share)
            for k, g in slopes.items():
                old = weight(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality_model.ALPHA * old
                n[k] += g * g
    w, b = quality_model.follow_leader(rows, bits, passes)
    assert b == pytest.approx(weight(bias), abs=1e-9)
    assert w.tolist() == pytest.approx([weight(k) for k in range(2**bits)], abs=1e-6)
    assert any(w) and not all(w)


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hot_keys_are_dealt_into_cells(spark):
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(60)] + [(None, 90), (777, 91)], "k long, v long")
    one = spark.createDataFrame([(i, f"x{i}") for i in range(0, 60, 2)] + [(1, "hot")], "k long, x string")
    for how in ("inner", "left"):
        got = spread_join(many, one, "k", F.col("v"), how, hot=5, cells=4)
        assert Counter((r.k, r.v, r.x) for r in got.collect()) == Counter((r.k, r.v, r.x) for r in many.join(one, "k", how).collect())
    hot = one.filter("k = 1")
    flags = {(r.k, r.hot) for r in flagged(many, F.col("k"), hot, F.col("k"), "hot").collect()}
    assert (1, True) in flags and sum(f for _, f in flags) <= 2 and Counter(r.k for r in only_touched(many, F.col("k"), hot, F.col("k")).collect())[1] == 40


def test_few_hot_keys_need_no_bitmap(spark):
    """Each of a join's two bitmaps was a broadcast of 1 MB and three more exchanges, which filled the driver's memory where many joins follow each other."""
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(60)] + [(None, i) for i in range(40)], "k long, v long")
    one = spark.createDataFrame([(i, f"x{i}") for i in range(60)], "k long, x string")
    for hot in (5, 1000):
        for how in ("inner", "left"):
            got = spread_join(many, one, "k", F.col("v"), how, hot=hot, cells=4)
            assert "bitmap" not in got._jdf.queryExecution().optimizedPlan().toString()
            assert Counter((r.k, r.v, r.x) for r in got.collect()) == Counter((r.k, r.v, r.x) for r in many.join(one, "k", how).collect())


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    mark = begun()
    a = saved(spark.range(5), "way")
    kept = finished(a.selectExpr("id * 2 as id"), "result", mark)
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4, 6, 8] and not any(os.path.exists(f.removeprefix("file:")) for f in a.inputFiles())


def test_two_threads_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    meet = Barrier(2)

    def work(n):
        mark = begun()
        meet.wait(60)
        a = saved(spark.range(n), "way")
        meet.wait(60)
        b = saved(a.selectExpr("id + 1 as id"), "way")
        if n == 3:
            finished(spark.range(1), "result", mark)
        meet.wait(60)
        return n, None if n == 3 else finished(b, "result", mark).count()

    with ThreadPoolExecutor(2) as pool:
        assert dict(pool.map(work, [3, 5])) == {3: None, 5: 5}


def thue_morse():
    """Two words of 1024 letters on which polynomials modulo 2**64 agree, whatever the base."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_on_which_polynomials_agree_are_told_apart(spark):
    a, b = thue_morse()
    rows = [(1, a), (2, b), (3, f"{a}\n{b}\n{a}"), (4, " ".join(a[:9])), (5, " ".join(b[:9]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, words=4).collect()} == {i: i for i in range(1, 6)}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.repetition_rules(docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).collect()}
    assert got >= {(i, i) for i in range(1, 6)} and not got & {(1, 2), (2, 1), (4, 5), (5, 4)}
    tokenizer = packing.WordIds(tokenizer_path())
    for texts in ([a, b], [b, a, a]):
        raw = "".join(texts).encode()
        ids, first = tokenizer.documents(np.frombuffer(raw, np.uint8), np.array([0, *np.cumsum([len(t) for t in texts])]))
        assert [ids[first[i] : first[i + 1] - 1].tolist() for i in range(len(texts))] == [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_runs_of_words_tie_by_their_bytes(spark, monkeypatch):
    class Same(suffix_dedup.Prefix):
        def of(self, start, end):
            return np.zeros(len(start), np.uint64) + np.uint64(7)

    monkeypatch.setattr(suffix_dedup, "_word_names", lambda data, at: (Same(np.zeros(1, np.uint64)), suffix_dedup.find_words(data, at)[2]))
    passage = [f"x{i}" for i in range(51)]
    data = " ".join(passage * 2 + ["y"] + passage).encode()
    begin = np.array([0, 51, 103, 1])
    names = suffix_dedup._run_names(np.frombuffer(data, np.uint8), np.array([0, len(data)]), begin, 51)
    assert names[0] == names[1] == names[2] != names[3]
    spaced = "  ".join(passage).encode()
    assert suffix_dedup._run_names(np.frombuffer(spaced, np.uint8), np.array([0, len(spaced)]), np.array([0]), 51)[0] == names[0]
    run = suffix_dedup._word_sampler(51, 4)  # every sample ties, so all runs are named by their bytes
    assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array([data.decode()])], names=["text"])])))


def test_the_pipeline_puts_settings_back_and_takes_very_long_texts(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    r = random.Random(3)
    texts = [prose(r, 150_000, 90_000), prose(r, 300_000, 90_000), prose(r, 80), prose(r, 80), None, ""]
    texts.append(texts[2])
    rows = [(i if i != 3 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {0, 1, 2, None} and spark.conf.get(name) == before
