"""Suffix order in one block against brute force, with clashing fingerprints and planted passages."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import suffix_dedup, suffix_order
from rollcall.llm.queries import op4_suffix_dedup
from tests.llm.util import covered, prose


def pieces_of(r, depth):
    base = [bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcdefgh") for _ in range(r.randint(depth, 3 * depth))) for _ in range(4)]
    base += [b"a" * (2 * depth), (b"abc" * depth)[: 2 * depth + 1]]
    out = []
    for _ in range(r.randint(1, 12)):
        s = bytearray(b"".join(r.choice(base)[r.randint(0, depth // 2) :] for _ in range(2)))
        if r.random() < 0.4:
            s[r.randrange(len(s))] ^= 1
        out += [bytes(s)] if len(s) >= depth else []
    return out


@pytest.mark.parametrize("depth", [5, 8, 17, 40, 400])
def test_ties_equal_brute_force(depth, monkeypatch):
    r = random.Random(depth)
    for trial in range(25):
        monkeypatch.setattr(suffix_order, "AT_ONCE", 50 if trial % 2 else 3_000_000)
        segments = pieces_of(r, depth)
        if not segments:
            continue
        count = Counter(s[i : i + depth] for s in segments for i in range(len(s) - depth + 1))
        size = np.array([len(s) for s in segments])
        got = suffix_order.tied_in_segments(np.frombuffer(b"".join(segments), np.uint8), np.cumsum(size) - size, size - depth + 1, depth)
        assert got.tolist() == [count[s[i : i + depth]] > 1 for s in segments for i in range(len(s) - depth + 1)]


@pytest.mark.parametrize("length", [40, 400])
def test_clashing_fingerprints_tie_nothing(length, monkeypatch):
    """All sample windows share a fingerprint and all suffixes a bucket: only equal bytes tie."""
    r = random.Random(length)
    passage = prose(r, 200)
    texts = [prose(r, 200), passage, prose(r, 30) + passage[40 : 60 + length] + prose(r, 30), passage[: length + 10], "ab" * length, "é" * length, passage[50 : 49 + length]]
    same = type("Same", (), {"__init__": lambda self, data: None, "of": lambda self, start, end: np.zeros(len(start), np.uint64)})
    monkeypatch.setattr(suffix_dedup, "Prefix", same)
    places = [suffix_dedup._packed(np.arange(max(1, len(t.encode())), dtype=np.uint32)) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(places, pa.binary())], names=["id", "text", "places"])
    rows = [tuple(c[i].as_py() for c in b.columns) for b in suffix_dedup._segmenter(length, 7, 24, 8)(iter([batch])) for i in range(b.num_rows)]
    assert len({x[0] for x in rows if x[0] >= 0}) == 1
    gone = [np.zeros(len(t.encode()), bool) for t in texts]
    found = suffix_dedup.bucket_runs([x for x in rows if x[0] >= 0], length)
    for x in rows:
        if x[0] < 0:
            found += zip(*(suffix_dedup._unpacked(x[k], np.int64).tolist() for k in (1, 2, 3)), strict=True)
    for i, place, n in found:
        gone[i][place : place + n + length - 1] = True
    assert [g.tolist() for g in gone] == covered(texts, length)


def test_planted_passages_by_their_words(spark, tmp_path):
    r = random.Random(11)
    lengths = [49, 50, 51, 52, 60, 65, 90, 150]
    passages = {n: [prose(r, n) for _ in range(3)] for n in lengths}
    texts = [prose(r, 80) for _ in range(60)]
    held = {}
    for n in lengths:
        for k, x in enumerate(passages[n]):
            for _ in range(2):
                held[len(texts)] = n, x
                texts.append(f"{prose(r, 30)} {x.replace(' ', '  ', k)} {prose(r, 20)}")  # white space may differ
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in op4_suffix_dedup(spark, str(tmp_path)).collect()}
    removed = {i: sum(g) for i, g in enumerate(covered(texts, 400))}
    assert {i: x.n_removed for i, x in got.items()} == removed
    assert {i: x.n_run_words for i, x in got.items()} == {i: held[i][0] if i in held and held[i][0] >= 51 else 0 for i in got}
    assert any(removed[i] == 0 and got[i].n_run_words >= 51 for i in got)  # short of 400 bytes
