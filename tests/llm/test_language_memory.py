"""Vectors of n-grams in blocks: the same sums, whatever their number, in bounded memory."""

import tracemalloc

import numpy as np

from rollcall.llm import language_id as li


def many_letters(letters, seed=3):
    """Made text of many different letters, so of nearly as many n-grams as letters."""
    rng = np.random.default_rng(seed)
    return "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, letters))


def sums(texts, dimensions=li.DIMENSIONS):
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    return li.bundles(*li.grams(*li.framed(*li.letters_of(buf, off), 3), 3, dimensions), len(texts))


def test_blocks_give_the_sums_of_the_definition(monkeypatch):
    texts = ["abc cab abc", "", many_letters(40), "xyz"]
    whole = sums(texts, 64)
    monkeypatch.setattr(li, "VECTORS", 7)
    assert np.array_equal(sums(texts, 64), whole)  # sums of +1 and -1 are exact
    x = [ord(c) if c != " " else 0 for c in "  xyz  "]
    plain = sum(np.roll(li.letter_vector(x[i], 64), 2) * np.roll(li.letter_vector(x[i + 1], 64), 1) * li.letter_vector(x[i + 2], 64) for i in range(len(x) - 2))
    assert np.array_equal(whole[3], plain)


def test_memory_does_not_grow_with_the_n_grams():
    text = many_letters(330_000)  # 1 MB: a whole piece, with some 330,000 n-grams
    sums(["warm"])
    tracemalloc.start()
    sums([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
