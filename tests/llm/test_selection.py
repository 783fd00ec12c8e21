"""Importance resampling, mixing and lexical search against plain versions, with odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollcall.llm import importance, lexical_search, mixing
from rollcall.llm._frames import range_ranked, saved
from rollcall.llm._text import names
from tests.llm.util import CLASH, LOW, WORD, prose

R = random.Random(21)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PART = prose(R, 30, 60)
TEXTS = [
    (None, None), (None, PART), (1, ""), (2, "?! ..."), (3, PART), (3, PART), (3, PART), (4, PART.upper()), (5, "é" * 70 + " " + PART), (6, "x" * 300 + " W1 w1"),
    *((i, prose(R, R.randint(1, 60), 60)) for i in range(7, 60)), (60, prose(R, 9000, 60)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return saved(spark.createDataFrame([(k, t, "en", None if i % 3 else f"s{i % 4}", 0, *["x"] * 8) for i, (k, t) in enumerate(TEXTS)], CLASH), "odd")


def low_words(text):
    return TERM.findall((text or "").translate(LOW))


@pytest.mark.parametrize(("ngrams", "percent"), [(1, 10), (1, 37), (2, 50), (1, 100), (1, 0)])
def test_resampling_equals_the_law_computed_plainly(spark, odd, ngrams, percent):
    target = spark.createDataFrame([(0, PART + " w1 w2"), (1, None), (2, "W1")], "item_id long, text string")

    def features(text):
        w = low_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 50 for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    raw, wanted = Counter(b for _, t in TEXTS for b in features(t)), Counter(b for t in (PART + " w1 w2", "W1") for b in features(t))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 50) / ((raw[b] + 1) * (t + 50)))) for b in range(50)]
    rows = []
    for k, text in TEXTS:
        f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(low_words(text)) >= 20))
    may = sorted((-score, k is None, k or 0, i) for i, (k, _, _, score, ok) in enumerate(rows) if ok)
    rank = {i: n + 1 for n, (*_, i) in enumerate(may[: len(may) * percent // 100])}
    got = importance.resampled(odd, target, ngrams=ngrams, buckets=50, percent=percent, probes=3).collect()
    assert Counter(map(tuple, got)) == Counter((*r[:4], rank.get(i)) for i, r in enumerate(rows))


def test_resampling_of_empty_tables(spark, odd):
    none = odd.limit(0)
    assert importance.resampled(none, odd).count() == 0
    got = importance.resampled(odd, none).collect()
    assert len(got) == len(TEXTS) and sum(r.rank is not None for r in got) == sum(len(low_words(t)) >= 20 for _, t in TEXTS) // 10


@pytest.mark.parametrize("wanted", [1, 2, 3, 7, 40, 100])
def test_bisection_finds_the_least_value(spark, wanted):
    values = [R.randint(-50, 50) for _ in range(60)] + [7] * 40
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v long")
    for probes in (1, 15):
        assert importance.bisected(rows, F.col("v"), wanted, probes) == sorted(values)[wanted - 1]
    assert importance.bisected(rows, F.col("v"), 101) is None


def test_ranks_over_ranges_number_equal_rows_one_by_one(spark):
    rows = saved(spark.createDataFrame([(5,)] * 300 + [(R.randint(0, 9),) for _ in range(100)] + [(None,)] * 9, "v long"), "rows")
    got = sorted((r.at, r.v) for r in range_ranked(rows, [F.col("v").asc_nulls_last()], "at").collect())
    assert [a for a, _ in got] == list(range(409))
    assert [v for _, v in got] == sorted((v for _, v in got), key=lambda v: (v is None, v or 0))


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_comes_near_its_targets(spark):
    rows = [(i, prose(R, int(R.paretovariate(1.2) * 10) % 4000), R.choice(["a", "é", "b", "ab", None, "hot", "hot", "hot"])) for i in range(1500)]
    rows += [(2000 + i, "one two", "tiny") for i in range(3)] + [(3000, None, "empty"), (3001, " \n", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    sizes, longest, taken = Counter(), Counter(), Counter()
    for _, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        longest[s] = max(longest[s], n)
    wanted = plain_targets(sizes, (5, 2, 1), 1.5, 2.0)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and r.copies in (math.floor(wanted[r.source] / max(sizes[r.source], 1)), math.ceil(wanted[r.source] / max(sizes[r.source], 1))) and r.taken <= 2 * r.size
    assert {r.source: (r.source_size, pytest.approx(r.target)) for r in got} == {s: (sizes[s], wanted[s]) for s in sizes}
    assert all(abs(taken[s] - wanted[s]) <= longest[s] for s in sizes)
    assert sum(r.target for r in {x.source: x for x in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert Counter(mixing.mixed(df.repartition(5)).collect()) == Counter(got)
    assert mixing.emitted(mixing.mixed(df, carry=("text",))).filter("text is not null").count() == sum(r.copies for r in got if r.doc_id != 3000)


def test_mix_of_nulls_repeated_rows_and_empty_tables(odd):
    got = mixing.mixed(odd, carry=("n",)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, len(WORD.findall(t or ""))) for k, t in TEXTS)
    assert mixing.mixed(odd.limit(0)).count() == 0 and {r.n for r in got} == {"x"}


def plain_search(texts, items, k=10):
    terms = [(key, Counter(low_words(t))) for key, t in texts]
    lengths = [sum(c.values()) for _, c in terms]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(w for _, c in terms for w in c)
    out = Counter()
    for item, text in items:
        scores = []
        for (key, c), n in zip(terms, lengths, strict=True):
            m = 10 + (90 * n * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(low_words(text)) if c[w])
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out.update((item, i + 1, None if none else key, -score) for i, (score, none, key) in enumerate(sorted(scores)[:k]))
    return out


ITEMS = [(0, PART), (0, PART), (1, "W1 w2 w3, nothing-else"), (2, None), (3, "..."), (4, "unseen"), (None, "w5 w5 w6 w7 w8 w9"), *((10 + i, prose(R, 12, 60)) for i in range(20))]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 500, "seed_every": 2}, {"segment_bytes": 3000, "seed_every": 1000, "block_terms": 40}])
def test_search_equals_all_scores_computed_plainly(spark, odd, options):
    items = spark.createDataFrame([(k, t, 1) for k, t in ITEMS], "item_id long, text string, rank long")
    got = lexical_search.search(odd, items, **options).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(TEXTS, ITEMS)


def test_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(odd.limit(0), items).count() == 0 and lexical_search.search(odd, items.limit(0)).count() == 0


def test_pair_bounds_hold_and_skip_more():
    r = np.random.default_rng(5)
    lists = {t: (np.sort(r.choice(400, size, replace=False)), r.integers(1, 1000, size)) for t, size in enumerate((300, 260, 200, 120, 40))}
    lists[5] = (np.setdiff1d(np.arange(400), lists[1][0])[:100], np.full(100, 900))
    pairs = {(a, b): (most, both) for a, b, most, both in lexical_search._joined(lists, {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)})}
    with_pairs, without = (lexical_search.Segment(pa.array(range(400)), lists, p) for p in (pairs, {}))
    total = np.zeros((7, 400), np.int64)
    for i in range(6):
        total[i + 1] = total[i]
        total[i + 1][lists[i][0]] += lists[i][1]
    tight, loose = with_pairs.bounds(list(range(6))), without.bounds(list(range(6)))
    assert all(total[i].max() <= tight[i] <= loose[i] for i in range(7)) and tight[-1] < loose[-1]
    for k, least in ((10, 1), (3, 2000), (5, int(total[-1].max())), (5, loose[-1] + 1)):
        want = sorted(((-s, i) for i, s in enumerate(total[-1].tolist()) if s >= least))[:k]
        for segment in (with_pairs, without):
            at, points = segment.best(list(range(6)), k, least)
            assert [(-int(s), int(i)) for i, s in zip(at, points, strict=True)] == want


def test_names_tell_words_apart():
    words = ["", "a", "b", "ab", "ba", "a\0", "abcdefg", "abcdefgh", "abcdefghi", "x" * 256, "x" * 257, "x" * 258]
    a = "a"
    for _ in range(10):  # a word and its complement, on which polynomials modulo 2**64 agree
        a += a.translate(str.maketrans("ab", "ba"))
    words += [a[:1024], a[:1024].translate(str.maketrans("ab", "ba")), a[:128], a[:128].translate(str.maketrans("ab", "ba"))]
    raw = [w.encode() for w in words] * 2
    buf = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(w) for w in raw])
    got = names(buf, end - [len(w) for w in raw], end)
    assert len(set(got.tolist())) == len(words) and (got[: len(words)] == got[len(words) :]).all()
    by = defaultdict(set)
    for i in range(20000):
        w = f"{i:x}".encode()
        by[int(names(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])].add(w)
    assert len(by) == 20000
