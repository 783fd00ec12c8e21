"""The fuzzy join reads a text for its words once, and stores of the other side what the first side's sets may meet."""

import random

from pyspark.sql import functions as F

from rollcall.functions import text
from rollcall.operators import fuzzy

SCHEMA = "key long, body string"


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def test_a_text_is_read_once(spark, monkeypatch):
    """Before, a filter on the number of words was moved below them, so that they were made for it and again for what was stored."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        read.add(1)
        return x

    monkeypatch.setattr(fuzzy, "tokens", lambda c: text.tokens(counted(c)))
    made = fuzzy._Sets(rows(spark, [" ".join(f"w{i + k}" for k in range(9)) for i in range(50)]), "key", "body", 8, None)
    assert (made.sets.count(), read.value) == (50, 50)


def test_words_that_the_left_lacks_are_not_stored(spark, monkeypatch):
    """Before, 100 texts of 400 words were stored whole, to meet one text of 10; now those are that hold 8 of its words, with these words."""
    left = " ".join(f"p{k}" for k in range(10))
    right = [" ".join([*(f"p{k}" for k in range(i % 11)), *(f"x{i}y{k}" for k in range(400))]) for i in range(100)]
    stored, kept = [], fuzzy.by_document
    monkeypatch.setattr(fuzzy, "by_document", lambda df, *rest: stored.append(kept(df, *rest)) or stored[-1])
    got = sorted((r.key_b, r.share) for r in fuzzy.fuzzy_pairs(rows(spark, [left]), rows(spark, right), "key", "body").collect())
    assert got == sorted((i, i % 11 / 10) for i in range(100) if i % 11 >= 9)
    held = [n for (n,) in stored[1].select(F.size("hashes")).collect()]
    assert sorted(held) == sorted(i % 11 for i in range(100) if i % 11 >= 8)


def test_sets_cut_to_what_meets_keep_their_sizes(spark):
    """Texts that hold the other's or are held by it, with words that only one side has, at other shares and sizes; against all pairs."""
    rng = random.Random(7)
    some = [[f"w{rng.randrange(90)}" for _ in range(rng.randint(3, 30))] for _ in range(60)]
    a = [" ".join(x + [f"a{rng.randrange(99)}" for _ in range(rng.randrange(4))]) for x in some]
    b = [" ".join(rng.sample(x, rng.randint(max(1, len(x) - 3), len(x))) + [f"b{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 2, 40]))]) for x in some] + ["", "...", None, "É é w1"]
    for share, least in ((0.9, 8), (0.8, 3), (0.5, 1)):
        alike = lambda x, y: min(len(x), len(y)) >= least and len(x & y) >= share * min(len(x), len(y))  # noqa: E731, B023
        sets = lambda t: [{w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").lower()).split()} for x in t]
        wanted = sorted((i, j) for i, x in enumerate(sets(a)) for j, y in enumerate(sets(b)) if alike(x, y))
        for turned in (False, True):
            left, right = (b, a) if turned else (a, b)
            got = fuzzy.fuzzy_pairs(rows(spark, left), rows(spark, right), "key", "body", share, least).collect()
            assert sorted((r.key_b, r.key_a) if turned else (r.key_a, r.key_b) for r in got) == wanted and wanted
