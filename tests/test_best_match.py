"""The best match against all pairs, on texts made to collide."""

import io
import random
from contextlib import redirect_stdout

import pytest

from rollcall.operators import fuzzy

RECORDS, PARAGRAPHS = "doc long, r long, text string", "doc long, p long, text string"


def plain(records, paragraphs, least):
    """What the docstring says, pair by pair; the texts are normal forms already."""
    out = {}
    long = lambda x: list(dict.fromkeys(w for w in x.split(" ") if len(w) > 2))
    for doc, r, x in records:
        for other, p, y in paragraphs:
            if doc is None or doc != other or not x or not y:
                continue
            a, b = long(x), long(y)
            score = 1.0 if x == y else 0.9 if x in y or y in x else len(set(a) & set(b)) / max(len(a), len(b)) if a or b else 0.0
            if score >= least and (score, -p) > out.get((doc, r), (0, 0)):
                out[doc, r] = (score, -p)
    return {(*k, -p, round(score, 6)) for k, (score, p) in out.items()}


def made(seed):
    rng = random.Random(seed)
    words = ["a", "to", "of", "committee", "mit", "com", "board", "review", "grant", "grants", "panel", "chair", "2001", "member"] + [f"w{i}x" for i in range(20)]
    text = lambda: " ".join(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 5, 8, 25])))

    def near(x):
        parts = x.split(" ")
        how = rng.randrange(5)
        if how == 0:
            rng.shuffle(parts)
        elif how == 1:
            parts = parts[rng.randrange(len(parts)) :]
        elif how == 2:
            parts += rng.choices(words, k=rng.randrange(1, 4))
        elif how == 3:
            return x[rng.randrange(len(x)) :].strip() or x  # cut inside a word
        else:
            parts[rng.randrange(len(parts))] = rng.choice(words)
        return " ".join(parts)

    paragraphs = [(rng.randrange(4), i, text()) for i in range(120)]
    records = []
    for i in range(120):
        doc, _, x = rng.choice(paragraphs)
        records.append((doc, i, rng.choice([x, near(x), near(near(x)), text()])))
    odd = [None, ""]
    return records + [(1, 900 + i, x) for i, x in enumerate(odd)] + [(None, 950, "board"), (77, 951, "board")], paragraphs + [(1, 900 + i, x) for i, x in enumerate(odd)] + [(None, 950, "board")]


@pytest.mark.parametrize(("seed", "least", "some"), [(1, 0.72, 60), (2, 0.72, 60), (3, 0.5, 60), (4, 1.0, 40)])
def test_best_match_finds_what_all_pairs_find(spark, seed, least, some):
    records, paragraphs = made(seed)
    got = fuzzy.best_match(spark.createDataFrame(records, RECORDS), spark.createDataFrame(paragraphs, PARAGRAPHS), "doc", "r", "p", "text", least)
    wanted = plain(records, paragraphs, least)
    assert got.columns == ["doc", "r", "p", "score"] and len(wanted) > some
    assert {tuple(x) for x in got.collect()} == wanted


def test_empty_tables_and_no_nested_loop(spark):
    records, paragraphs = spark.createDataFrame([(1, 1, "some board of review")], RECORDS), spark.createDataFrame([], PARAGRAPHS)
    assert fuzzy.best_match(records, paragraphs, "doc", "r", "p", "text").count() == 0
    assert fuzzy.best_match(records.limit(0), paragraphs, "doc", "r", "p", "text").count() == 0
    out = io.StringIO()
    with redirect_stdout(out):
        fuzzy.best_match(records, paragraphs, "doc", "r", "p", "text").explain("formatted")
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()
