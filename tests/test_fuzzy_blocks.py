"""The fuzzy join's blocking: what is dropped before a shuffle, and that nothing is lost by it."""

import random

from pyspark.sql import functions as F

from rollcall.operators import fuzzy

SCHEMA = "key long, doc long, body string"


def made(seed, n, vocabulary):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:  # a near copy, a part or a copy of an earlier text
            words = rng.choice(out)[2].split()
            words = rng.sample(words, rng.randint(max(1, len(words) - 3), len(words))) + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(3))]
        else:
            words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(5, 40))]
        out.append((i, rng.choice([1, 2, None]), " ".join(words)))
    return out


def alike(x, y):
    s, t = set(x.split()), set(y.split())
    return min(len(s), len(t)) >= 8 and len(s & t) >= 0.9 * min(len(s), len(t))


def test_pairs_that_share_a_word_only_are_dropped_where_they_meet(spark):
    """Every two texts share their rarest words of the table; before, all 90,000 pairs were shuffled with both sets."""
    texts = lambda side: [(i, 1, " ".join(["shared", "words", *(f"{side}{i}n{k}" for k in range(10))])) for i in range(300)]
    a, b = (fuzzy._Sets(spark.createDataFrame(texts(x), SCHEMA), "key", "body", 8, None) for x in "ab")
    assert fuzzy._meeting(*fuzzy._blocked(a, b, 0.9)).count() == 0

    some = spark.createDataFrame([(i, 1, " ".join(f"w{(i * 7 + k * k) % 400}" for k in range(12))) for i in range(400)], SCHEMA)
    x, y = (fuzzy._Sets(some.filter(c), "key", "body", 8, None) for c in ("key % 2 = 0", "key % 2 = 1"))
    keys, words = fuzzy._blocked(x, y, 0.9)
    assert fuzzy._meeting(keys, words).count() < keys.join(words, "word").count() / 50


def test_against_all_pairs(spark):
    for seed in range(3):
        a, b = made(seed, 80, 60), made(seed + 100, 80, 60)
        b[:30] = [(i, d, x) for (i, _, _), (_, d, x) in zip(b, a[20:50], strict=False)]
        left, right = (spark.createDataFrame(x, SCHEMA) for x in (a, b))
        got = sorted((r.key_a, r.key_b) for r in fuzzy.fuzzy_pairs(left, right, "key", "body").collect())
        assert got == sorted((i, j) for i, _, x in a for j, _, y in b if alike(x, y)) and got
        inside = {(i, j) for i, d, x in a for j, e, y in b if d is not None and d == e and alike(x, y)}
        assert {(r.key_a, r.key_b) for r in fuzzy.fuzzy_pairs(left, right, "key", "body", within="doc").collect()} == inside
        for within, pairs in ((None, set(got)), ("doc", inside)):
            kept = [r.key for r in fuzzy.without_fuzzy_copies(left, right, "key", "body", F.col("key") % 5 != 0, within).collect()]
            assert sorted(kept) == sorted({i for i, _, _ in a} - {i for i, _ in pairs if i % 5})


def test_a_group_of_near_copies_is_compared_once_a_set(spark, monkeypatch):
    """One partner settles a row: 40 by 40 near copies were 1600 comparisons before."""
    base = [f"w{k}" for k in range(30)]
    rows = lambda side: [(i, 1, " ".join([*base, f"{side}{i}"])) for i in range(40)]
    left, right = (spark.createDataFrame(rows(x), SCHEMA) for x in "ab")
    compared, confirmed = [], fuzzy._confirmed
    monkeypatch.setattr(fuzzy, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirmed(pairs, *rest))
    assert fuzzy.without_fuzzy_copies(left, right, "key", "body").count() == 0
    assert compared == [40, 0]
