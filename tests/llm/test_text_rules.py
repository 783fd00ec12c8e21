"""Quality rules, near duplicates, suffix de-duplication and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import suffix_dedup
from rollcall.llm.decontamination import contained_items, decontaminated
from rollcall.llm import near_duplicates as near
from rollcall.llm.near_duplicates import near_duplicates, superminhash
from rollcall.llm.components import components
from rollcall.llm.quality_rules import repeat_lengths, repetition_rules
from rollcall.llm.suffix_dedup import repeated_passages
from rollcall.llm.suffix_order import difference_cover
from tests.llm.util import WORD, clashing, covered, groups, prose, shingle_set, table


def test_repeat_lengths_equal_brute_force():
    r = np.random.default_rng(3)
    for _ in range(60):
        docs = [r.integers(0, 4, r.integers(0, 25)) for _ in range(4)]
        wanted = []
        for w in docs:
            for i in range(len(w)):
                best = 0
                for j in range(len(w)):
                    k = 0
                    while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                        k += 1
                    best = max(best, k)
                wanted.append(best)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        assert repeat_lengths(np.concatenate(docs).astype(np.uint64), first).tolist() == wanted


def base_measures(text):
    text = text or ""
    w = WORD.findall(text)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def awkward(r):
    long = prose(r, 30_000)
    passage = prose(r, 60)
    return [None, "", " \n\t ", "a", "é ñ # <b>", prose(r, 200), prose(r, 200) + "\n" + passage + "\n" + prose(r, 20) + "\n" + passage, "x y z " * 100, "line one\nline one\n\nline one", long, long,
            "tab\tand\x0bvt\x0cff\rcr\x1cfs nb sp"]


def test_quality_rules(spark):
    texts = awkward(random.Random(1))
    got = {r.doc_id: r for r in repetition_rules(clashing(spark, texts), keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        wanted = base_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted, i
        assert r.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
    assert got[5].kept and got[9].kept and not got[6].kept and not got[7].kept and not got[0].kept
    assert repetition_rules(table(spark, [])).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(0)
    same = r.integers(0, 2**63, 600).astype(np.uint64)
    a, b = np.concatenate([same, r.integers(0, 2**63, 200).astype(np.uint64)]), np.concatenate([same, r.integers(0, 2**63, 200).astype(np.uint64)])
    s = superminhash(np.concatenate([a, b, same[:3]]), np.array([0, 800, 1600, 1603, 1603]), 256)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1 and (s[2] < 0xFFFFFFFF).all() and (s[3] == 0xFFFFFFFF).all()


@pytest.mark.parametrize("part", [1, 7, 100, 1000])
def test_signatures_do_not_depend_on_parts(part, monkeypatch):
    r = np.random.default_rng(part)
    begin = np.concatenate([[0], np.cumsum([0, 3, 250, 1, 0, 90, 700, 0])])
    el = r.integers(0, 2**63, begin[-1]).astype(np.uint64)
    whole = superminhash(el, begin, 128)
    monkeypatch.setattr(near, "PART", part)
    assert (superminhash(el, begin, 128) == whole).all()


@pytest.mark.parametrize("low, high", [(0.80, 0.82), (0.82, 0.88), (0.88, 0.95), (0.95, 1.0)])
def test_recall_by_similarity(low, high):
    """Candidates that bands and signatures let through, of pairs in a band of similarity, for small and large sets."""
    r = np.random.default_rng(round(100 * low))
    for size in (30, 150, 600):
        found = 0
        for _ in range(200):
            shared = int(size * r.uniform(low, high) + 1e-9)
            own = int(r.integers(0, size - shared + 1))
            el = r.integers(0, 2**63, size).astype(np.uint64)
            x, y = el[: shared + own], np.concatenate([el[:shared], el[shared + own :]])
            s = superminhash(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), near.HASHES)
            bands = near._bands(s, near.BAND)
            found += bool((bands[0] == bands[1]).any() and near._alike(s[0], s[1]) >= near._least(0.8, near.HASHES))
        assert found == 200, size


def test_repeated_rows_and_many_texts_of_no_key(spark):
    """One key and text in most rows, and a null key that stands for many texts."""
    r = random.Random(11)
    base = prose(r, 120)
    near_one = base.rsplit(" ", 1)[0]
    texts = [prose(r, 100) for _ in range(40)]
    rows = [(7, base)] * 300 + [(8, near_one), (None, base)] + [(None, t) for t in texts] + [(None, t + " more") for t in texts]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows) and {x.component_id for x in got if x.doc_id is not None} == {7}
    assert sum(x.component_id == 7 for x in got if x.doc_id is None) == 1 and sum(x.component_id is None for x in got) == 80


def near_texts(r):
    base = prose(r, 150)
    out = awkward(r) + [base, base.upper()]
    for k in range(60):  # copies of one text, some of them linked only through it or through each other
        w = base.split()
        for _ in range(1 + k % 12):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out + [base] * 20 + ["one two three", "ONE  two three", "one two"]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    texts = near_texts(random.Random(k))
    wanted, sizes = groups(texts, k)
    got = {r.doc_id: r for r in near_duplicates(clashing(spark, texts), words=k).collect()}
    assert [got[i].component_id for i in range(len(texts))] == wanted
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (wanted[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    assert [r.kept for r in near_duplicates(table(spark, [None, "", " "])).collect()] == [True] * 3
    same = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(same).collect()} == {3}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 50)]
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_difference_covers():
    for q in (2, 3, 7, 17):
        v, d = difference_cover(q)
        assert len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup(spark, length):
    r = random.Random(length)
    passage, other = prose(r, 120), prose(r, 150)
    cut = passage[7 : 7 + length]
    texts = [None, "", "é" * 30, prose(r, 300), passage, prose(r, 20) + passage + prose(r, 30), other, other, "x" * (length + 5), "ab" * 3 * length, cut, cut[:-1] + "!", prose(r, 9) + cut + "é",
             prose(r, 40) + other[20 : 20 + length + 1], " ".join([prose(r, 5), other[3:500], passage[100:600], other[3:450]]), prose(r, 20_000), passage[1:]]
    got = {x.doc_id: x for x in repeated_passages(clashing(spark, texts), length=length).collect()}
    for i, (t, gone) in enumerate(zip(texts, covered(texts, length), strict=True)):
        raw = (t or "").encode()
        rest = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest()), i
    assert repeated_passages(table(spark, [])).count() == 0


def test_suffix_dedup_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 50)
    r = random.Random(9)
    passage = prose(r, 200)
    texts = [prose(r, 10) + passage[i : i + 300 + 10 * i] for i in range(40)]
    got = {x.doc_id: x.n_removed for x in repeated_passages(table(spark, texts), length=200).collect()}
    assert got == {i: sum(g) for i, g in enumerate(covered(texts, 200))}


def test_decontamination(spark):
    r = random.Random(2)
    items = [prose(r, n) for n in (5, 9, 30, 60, 200)] + [None, "", "two words", "Some Fixed Words!"]
    clean = [prose(r, 300, 10**6) for _ in range(5)]

    def edited(x, n):
        w = x.split()
        for i in r.sample(range(len(w)), n):
            w[i] = "other"
        return " ".join(w)

    texts = [None, "", *clean, *(clean[0] + " " + x.upper() + ", " + clean[1] for x in items if x), edited(items[4], 2), edited(items[4], 30), prose(r, 30_000, 10**6) + " " + items[2], items[3][:-20]]
    plain = lambda x, k: shingle_set(" ".join(re.findall(r"[0-9A-Za-z\x80-￿]+", x or "")), k)
    wanted = set()
    for i, item in enumerate(items):
        n = len(re.findall(r"[0-9A-Za-z]+", item or ""))
        s = plain(item, min(5, n)) if n else set()
        for d, t in enumerate(texts):
            if s and len(s & plain(t, min(5, n))) >= 0.8 * len(s):
                wanted.add((d, i))
    b = spark.createDataFrame([(i, x, "q") for i, x in enumerate(items)], "item_id long, text string, n string")
    for block in (10**6, 50):
        got = contained_items(clashing(spark, texts), b, block_shingles=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == wanted and len(got) == len(wanted)
    assert {x.doc_id for x in decontaminated(table(spark, texts), b).collect()} == set(range(len(texts))) - {d for d, _ in wanted}
    assert contained_items(table(spark, []), b).count() == 0 and contained_items(table(spark, texts), b.limit(0)).count() == 0
