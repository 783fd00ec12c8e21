"""Extraction, language, quality model, sharding, packing and the pipeline."""

import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import html_extraction as he, language_id, packing, quality_model, sharding
from rollcall.llm.queries import tokenizer_path
from tests.llm.util import clashing, covered, groups, prose, table

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">{nav}</a></li></ul></nav><div class="ad">{ad}</div><aside>Side {ad}</aside><article><h1>{title}</h1><p>First &amp;  part<br>{body}<p><b>Second
 part {body}</b></p><!-- gone --></article><section class="comments"><p>I like {ad}</p></section><div id="cookie-notice">We use cookies</div><form><p>Name</p></form><footer>&copy; Host {ad}</footer>"""


def test_extraction_keeps_the_article(spark):
    r = random.Random(0)
    rows = [(i, f"http://h{i % 3}.example/{i}", PAGE.format(nav=f"n{i}", ad=prose(r, 6), title=f"T{i}", body=f"text {i} &lt;x&gt; é")) for i in range(30)]
    plain = "<html><body><div class=top>Top words {}</div><div><div><p>Long text {} of the page, and more of it, a good deal more than elsewhere.</p><p>More {} text of the same page.</p></div></div><div>Same footer</div>"
    rows += [(100 + i, f"http://plain.example/{i}", plain.format(i % 2, prose(r, 30), prose(r, 20))) for i in range(8)]
    rows += [(200, None, None), (201, "no url", ""), (202, "http://z/", "just words & <b>more"), (203, "http://z/", "<p>a<p>b</div></p> <"), (204, "http://z/", "<a href='x>y"), (205, "http://h0.example/0", rows[0][2]), (205, "http://h0.example/0", rows[0][2])]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "page_id long, url string, html string, text string, host int")
    got = {x.page_id: x for x in he.main_text(df).collect()}
    for i in range(30):
        assert got[i].text == f"T{i}\n\nFirst & part text {i} <x> é\n\nSecond part text {i} <x> é"
        assert got[i].n_chars == len(got[i].text)
    for i in range(8):
        assert got[100 + i].text.startswith("Long text") and "More" in got[100 + i].text and "footer" not in got[100 + i].text and "Top" not in got[100 + i].text
    assert got[200].text == got[201].text == "" and got[202].text == "just words & more" and got[203].text == "a\n\nb\n\n<" and got[205].text == got[0].text
    assert len(he.main_text(df).collect()) == len(rows) and he.main_text(df.limit(0)).count() == 0


class Blocks(HTMLParser):
    """The text of article elements, block by block: a plain reading with the standard parser."""

    BREAKS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "blockquote", "table", "tr", "td", "figure", "figcaption"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.now = 0, [], []

    def close_block(self):
        text = " ".join("".join(self.now).split())
        self.out += [text] if text and self.depth else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.close_block()
        self.now += [" "] if tag == "br" else []
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.close_block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.now += [data] if self.depth else []


def test_extraction_against_a_plain_reading(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {x.page_id: x.text for x in he.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for x in rows:
        plain = Blocks()
        plain.feed(x.html or "")
        plain.close()
        assert got[x.page_id] == "\n\n".join(plain.out), x.page_id


def test_alignment_decides_where_elements_and_names_tell_nothing(spark):
    r = random.Random(5)
    side = "<div><div>Our town paper since 1901, read by everyone in the valley and beyond it, every single day</div><div>{}</div></div>"
    body = "<div><h1>{}</h1><div><p>{}</p>{}<blockquote>Reprint only with leave of the paper, which is given on request by the desk.</blockquote><p>{}</p></div></div>"
    rows, want = [], {}
    for i in range(40):
        title, one, two = f"Title {i}", prose(r, 40), prose(r, 30)
        extra = f"<ul><li>{prose(r, 5)}</li></ul>" if i % 4 == 0 else ""  # a second form, aligned with the first
        rows.append((i, f"http://paper.example/{i}", f"<html><body>{side.format(prose(r, 2))}{body.format(title, one, extra, two)}<div>Valley paper, all days</div></body></html>"))
        want[i] = [title, one, two]
    # Copies of one article under other addresses, apart from a counter: no template.
    rows += [(100 + i, f"http://copies.example/{i}", f"<body><div>Seen {i} times</div><div><p>{want[0][1]}</p><p>{want[0][2]}</p></div></body>") for i in range(9)]
    # A hot host whose pages are long.
    rows += [(200 + i, "http://long.example/", f"<body><div>Fixed words</div><div><p>{prose(r, 30_000)}</p></div></body>") for i in range(4)]
    got = {x.page_id: x.text for x in he.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        blocks = got[i].split("\n\n")
        assert set(want[i]) <= set(blocks) and blocks[0] == want[i][0]
        assert not any("Reprint" in b or "Valley paper" in b or "Our town" in b for b in blocks)
    assert all(got[100 + i].split("\n\n")[-2:] == want[0][1:] for i in range(9))
    assert all(len(got[200 + i].split()) == 30_000 for i in range(4))


def test_names_of_wrappers_do_not_hide_the_text(spark):
    rows = [
        (1, "http://a/1", '<body><div class="with-sidebar"><article><div class="entry-header"><h1>T</h1></div><p>Words</p><div class="comments"><p>me too</p></div></article></div></body>'),
        (2, "http://b/1", '<body><div id="menu-page"><p>Only words</p></div></body>'), (3, "http://c/1", "<nav><p>All there is"),
        (4, "http://d/1", "<div><nav><a href=x>Home</a></nav><div role=main><p>Main words</p></div><p>Other</p></div>")]
    got = {x.page_id: x.text for x in he.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T\n\nWords", 2: "Only words", 3: "All there is", 4: "Main words"}


def test_tree_matching_keeps_order_and_ancestors():
    a = "-1/#;0/body;1/div;2/p;1/ul;4/li;1/div"
    b = "-1/#;0/body;1/nav;1/div;3/p;3/h1;1/ul;6/li"
    assert he.match(a, b) == {0: 0, 1: 1, 2: 3, 3: 4, 4: 6, 5: 7}
    assert he.match(a, a) == {i: i for i in range(7)}


def test_language(spark):
    r = random.Random(1)
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "abcvw", "éé": "éèàü"}
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(2, 6)))
    rows = [(i, " ".join(word(s) for _ in range(20)), k) for i in range(40) for k, s in letters.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.prototypes(df.filter("doc_id < 30"))
    assert list(profiles) == sorted(letters)
    odd = spark.createDataFrame([(900, None, None), (901, "", None), (902, "12 ?!", None), (903, "z", None), (904, "éà", None), (905, "vw " * 50_000, None), (906, "漢字" * 5, None)], "doc_id long, text string, lang string")
    got = language_id.identify(df.filter("doc_id >= 30").unionAll(odd).withColumn("score", F.lit("x")), profiles, ["doc_id", "lang"]).collect()
    assert all(x.lang_pred == x.lang for x in got if x.doc_id < 900) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.lang_pred for x in got if x.doc_id >= 900}
    assert [by[i] for i in (900, 901, 902)] == ["und"] * 3 and by[904] == "éé" and by[906] in letters
    assert {x.lang_pred for x in language_id.identify(odd, {}, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), profiles, ["doc_id"]).count() == 0


def test_bundles_equal_the_sum_of_bound_vectors():
    buf = np.frombuffer("abc cab".encode(), np.uint8)
    x, first = language_id.letters_of(buf, np.array([0, 7]))
    got = language_id.bundles(*language_id.grams(x, first, 3, 64), 1)[0]
    v = [language_id.letter_vector(ord(c) if c != " " else 0, 64) for c in "abc cab"]
    wanted = sum(np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2] for i in range(5))
    assert np.array_equal(got, wanted)


def test_quality_model_learns(spark):
    r = random.Random(2)
    texts = [prose(r, 40) + (" !! ### buy now" if i % 3 == 0 else "") for i in range(600)]
    df = clashing(spark, [*texts, None, "", "w1 " * 40_000]).withColumn("label", F.when(F.col("doc_id") < 400, (F.col("doc_id") % 3 != 0).cast("int")))
    model = quality_model.fit(df.select("text", "label"))
    got = {x.doc_id: x.score for x in quality_model.score(df, model, ["doc_id"]).collect()}
    right = sum((got[i] >= 0.5) == (i % 3 != 0) for i in range(400, 600))
    assert right >= 190 and all(0 <= s <= 1 for s in got.values()) and len(got) == 603
    w, b = quality_model.fit(df.filter("label is null").select("text", "label"))
    assert not w.any() and set(x.score for x in quality_model.score(df, (w, b), ["doc_id"]).collect()) == {0.5}


def shards_of(df, n):
    return [(x.doc_id, x.size, x.text_crc32, x.source, x["shard"], x["slot"]) for x in sharding.stratified_shards(df, n).collect()]


def test_sharding(spark):
    r = random.Random(3)
    texts = [None, "", "é", *(prose(r, 3) for _ in range(200)), *["same"] * 60]
    rows = [(i, t, "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}", 0) for i, t in enumerate(texts)] + [(7, "same", "en", "hot", 0)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    got = shards_of(df, 7)
    assert sorted((x[0], x[1], x[2]) for x in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(x[4] for x in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(x[5] for x in got if x[4] == k) == list(range(n)) for k, n in counts.items())
    total = Counter(x[3] for x in got)
    for k, n in counts.items():
        mine = Counter(x[3] for x in got if x[4] == k)
        assert all(abs(mine[s] - total[s] * n / len(got)) <= 1 + len(total) * total[s] / len(got) for s in total)
    assert sorted(got, key=str) == sorted(shards_of(df.repartition(5), 7), key=str)
    assert shards_of(df.limit(0), 7) == [] and len({x[4] for x in shards_of(df.limit(3), 7)}) == 3


def test_plan_is_exact_and_tight():
    r = random.Random(4)
    for limit in (10, 64):
        lengths = [r.randint(1, limit) for _ in range(500)] + [3] * 300
        places = []
        for length, first, ranks, each, seq, offset in packing.plan(Counter(lengths), limit):
            places += [(length, first + k, seq + k // each, offset + length * (k % each)) for k in range(ranks)]
        assert Counter(x[0] for x in places) == Counter(lengths)
        assert all(sorted(x[1] for x in places if x[0] == n) == list(range(c)) for n, c in Counter(lengths).items())
        used = {}
        for length, _, seq, offset in places:
            used.setdefault(seq, []).append((offset, length))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= limit
        assert len(used) <= 1.05 * sum(lengths) / limit + 1


def test_units_have_the_ids_of_whole_texts():
    r = random.Random(3)
    letters = [*"aBsßtmdlrev'''  ,.;:-5²٣é×÷İΣσςΆ=—“” 　\n\t\x00\x0b\x1c\x85#$ﬁשׁ가각ᄀ", "̸", "́", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "'LL"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    words = packing.WordIds(tokenizer_path())
    assert words.parted
    old, packing.REMEMBERED = packing.REMEMBERED, 500  # generations change, and old units are taken over
    try:
        for lo in range(0, len(texts), 250):
            ids, first = words.documents(buf[off[lo] : off[lo + 250]], off[lo : lo + 251] - off[lo])
            for i in range(250):
                assert ids[first[i] : first[i + 1]].tolist() == words.tokenizer.encode(texts[lo + i], add_special_tokens=False).ids + [0], texts[lo + i]
    finally:
        packing.REMEMBERED = old


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    texts = [None, "", " \t ", "It's <|endoftext|>x 42 Ünï code é", *(prose(r, r.randint(1, 60)) for _ in range(80)), prose(r, 3000), *["same words here"] * 50, "a" * 5000, "é ́x"]
    tk = Tokenizer.from_file(tokenizer_path())
    ids = [np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], np.uint32) for t in texts]
    got = packing.best_fit_packing(clashing(spark, texts), tokenizer_path(), 256).collect()
    for x in got:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert x.start == 256 * x.piece and len(part) == x.length and zlib.crc32(part.tobytes()) == x.ids_crc32
    assert Counter(x.doc_id for x in got) == Counter({i: -(-len(v) // 256) for i, v in enumerate(ids)})
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in seqs.values():
        assert sum(n for _, n in parts) <= 256 and all(o == sum(n for p, n in parts if p < o) for o, n in parts)
    assert len(seqs) <= -(-sum(map(len, ids)) // 256) + 1
    assert packing.best_fit_packing(table(spark, []), tokenizer_path()).count() == 0


def test_pipeline(spark, tmp_path):
    import re

    from corpus_pipeline import STAGES, run

    r = random.Random(6)
    passage, item = prose(r, 90), prose(r, 30)
    texts = [prose(r, 150) for _ in range(20)]
    near = texts[0].split()
    near[75] = "changed"
    texts += [texts[1], " ".join(near), None, "", "short", "a b c " * 60, prose(r, 80) + " " + passage + " " + prose(r, 70), prose(r, 60) + " " + passage + " " + prose(r, 90), prose(r, 100) + " " + item + " " + prose(r, 60), texts[1]]
    rows = [(i if i != 3 else None, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = {x.doc_id: x for x in docs.collect()}
    every = set(range(len(texts))) - {3} | {None}
    assert set(after["quality_rules"]) == every - {22, 23, 24, 25}
    kept = [i for i in range(len(texts)) if (i if i != 3 else None) in after["quality_rules"]]
    roots, _ = groups([texts[i] for i in kept], 5)
    assert set(after["near_duplicates"]) == {kept[k] if kept[k] != 3 else None for k in range(len(kept)) if roots[k] == k}
    left = sorted(after["near_duplicates"], key=lambda x: -1 if x is None else x)
    for i, gone in zip(left, covered([after["near_duplicates"][i].text for i in left], 400), strict=True):
        t = after["near_duplicates"][i].text
        x = after["suffix_dedup"][i]
        assert x.text == "".join(c for c, g in zip(t, gone, strict=True) if not g) and x.n_chars == len(x.text)
    assert set(after["suffix_dedup"]) - set(after["decontamination"]) == {28}
    packed = run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(after["decontamination"]) and re.match("doc_id", packed[0].__fields__[0])


def test_pipeline_removes_repeats_of_51_words(spark):
    from corpus_pipeline import repeats

    r = random.Random(7)
    texts, planted = [], {}
    for n in range(51, 61):  # all under 400 bytes
        passage = prose(r, n).split()
        for sep in (" ", "\n"):
            before, after = prose(r, r.randrange(60, 100)) + f" a{len(texts)}", f"z{len(texts)} " + prose(r, 70)
            planted[len(texts)] = before.split() + after.split()
            texts.append(f"{before} {sep.join(passage)} {after}")
        assert len(" ".join(passage)) < 400
    few, twice = prose(r, 50), prose(r, 52)
    texts += [prose(r, 60) + " a " + few + " b " + prose(r, 60), prose(r, 60) + " c " + few + " d " + prose(r, 60)]
    texts += [twice + " mid " + twice, " " + prose(r, 55) + "\n", None, ""]
    texts += [texts[23].strip()]
    got = {x.doc_id: x for x in repeats(spark, table(spark, texts), "").collect()}
    assert all(got[i].text.split() == words and got[i].n_chars == len(got[i].text) for i, words in planted.items())
    assert [got[i].text for i in (20, 21)] == texts[20:22] and got[22].text.split() == ["mid"]
    assert got[24].text is None and got[25].text == "" and 23 not in got and 26 not in got


def test_stages_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    from corpus_pipeline import STAGES

    r = random.Random(8)
    item, passage = prose(r, 30), prose(r, 55)
    texts = [prose(r, 80) for _ in range(60)]
    texts += [texts[5], texts[6], f"{prose(r, 60)} {passage} x {prose(r, 60)}", f"{prose(r, 60)} {passage} y {prose(r, 60)}", f"{prose(r, 60)} {item} {prose(r, 60)}"]
    rows = [(i if i % 7 else None, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", len(texts[5]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in STAGES[1:4]:
        same, other = (stage(spark, docs, str(tmp_path)) for _ in range(2))
        wanted = sorted(same.collect(), key=str)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        try:
            assert sorted(other.collect(), key=str) == wanted != sorted(docs.collect(), key=str), name
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        texts_left = [x.text for x in wanted]
        if name == "near_duplicates":
            assert len(wanted) == 63 and len(set(texts_left)) == 63
        if name == "decontamination":
            assert len(wanted) == len(rows) - 1 and not any(item in t for t in texts_left)


@pytest.mark.parametrize("name", ["op1_html_extraction", "op2_decontamination", "op3_warc_derivatives", "op4_suffix_dedup", "op5_near_duplicates", "op6_sharding", "op7_quality_model", "op8_quality_rules", "op9_packing", "op10_language_id"])
def test_registered_queries_cover_their_tables(spark, small, name):
    from rollcall.llm.queries import queries

    out = queries()[name](spark, small)
    if name != "op2_decontamination":
        source, key = ("pages", "page_id") if name[:4] in ("op1_", "op3_") else ("documents", "doc_id")
        keys = out.select(key).distinct().count()
        assert keys == spark.read.parquet(f"{small}/{source}.parquet").count()
    else:
        assert out.count() > 0
