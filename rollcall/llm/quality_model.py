"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm._text import TOKEN, Prefix, U, find_words, mix, pieces, rows_of, shingles, text_buffer, trimmed

#: Labelled rows learnt from, at most: the bound of the training sample, taken by a hash of key and label.
TRAIN_ROWS = 8192
#: Bits of the hashed feature space, longest n-gram, passes, rows of one update.
BITS, NGRAM, PASSES, BATCH = 18, 2, 6, 32
#: Step size, its offset, and the L1 and L2 penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1


def features(buf: np.ndarray, off: np.ndarray, bits: int, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed number of every n-gram of words; runs of letters, digits and marks are words.

    A word that repeats the one before it, or the one before that, stands as such, whatever it is.
    """
    starts, ends, first = find_words(buf, off, TOKEN)
    words = mix(Prefix(buf, fold=True).of(starts, ends) ^ (ends - starts).astype(U))
    row = rows_of(first)
    plain = words.copy()
    for back in (2, 1):
        words[back:][(plain[back:] == plain[:-back]) & (row[back:] == row[:-back])] = U(back)
    rows, numbers = [], []
    for n in range(1, ngram + 1):
        long = np.diff(first) >= n
        sh, begin = shingles(words, first, n)
        row = rows_of(begin)
        keep = long[row]
        rows.append(row[keep])
        numbers.append((sh[keep] >> U(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(numbers)


def weigh(row: np.ndarray, number: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """Sparse dot products: each n-gram counts 1 / sqrt(the text's n-grams)."""
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    return np.bincount(row, weights[number], minlength=rows) / np.sqrt(n)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, passes: int) -> tuple[np.ndarray, float]:
    """Weights and bias after per-coordinate FTRL-proximal updates; rows: numbers, values, label."""
    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
    bias = 2**bits
    random = np.random.default_rng(11)
    y = np.array([r[2] for r in rows])
    share = y.mean() if len(y) else 0.5
    cost = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    for _ in range(passes):
        for batch in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
            if not len(batch):
                continue
            index = np.concatenate([np.append(rows[i][0], bias) for i in batch])
            value = np.concatenate([np.append(rows[i][1], 1.0) for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) + 1 for i in batch])
            w = _lead(z[index], n[index], index == bias)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w * value, minlength=len(batch)), -35, 35)))
            slope = (p - y[batch]) * cost[batch]
            touched, where = np.unique(index, return_inverse=True)
            g = np.bincount(where, slope[owner] * value)
            now = _lead(z[touched], n[touched], touched == bias)
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / ALPHA
            z[touched] += g - sigma * now
            n[touched] += g * g
    w = _lead(z, n, np.arange(len(z)) == bias)
    return w[:-1].astype(np.float32), float(w[-1])


def _lead(z: np.ndarray, n: np.ndarray, bias: np.ndarray) -> np.ndarray:
    l1 = np.where(bias, 0.0, L1)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", order: Column | None = None, train_rows: int = TRAIN_ROWS,
        bits: int = BITS, ngram: int = NGRAM, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Learns from at most train_rows labelled rows; the weights, 2**bits numbers, come back to the driver.

    order decides which rows of a larger table are taken (default: a hash of text and
    label).  Texts become hashed counts in parallel; one task follows the
    leader over the bounded sample.  Rows with a null label are left out; rows of equal
    order, text and label count once, so that copies don't fill the sample; a null
    text has no n-grams; without rows, every score is one half.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), F.col(text).cast("string").alias("text"),
        (order if order is not None else F.xxhash64(text, label)).alias("at"), F.xxhash64(text, label).alias("same"))

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in pieces(off):
                row, number = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], bits, ngram)
                cell, n = np.unique(row * (1 << bits) + number, return_counts=True)
                cut = np.searchsorted(cell, np.arange(hi - lo + 1) << bits)
                total = np.sqrt(np.maximum(np.bincount(row, minlength=hi - lo), 1))
                own = [(cell[a:b] & ((1 << bits) - 1), n[a:b] / t) for a, b, t in zip(cut[:-1], cut[1:], total, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([x.astype(np.int32).tobytes() for x, _ in own], pa.binary()),
                     pa.array([v.astype(np.float32).tobytes() for _, v in own], pa.binary())],
                    names=["label", "at", "number", "value"])

    @trimmed
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for y, at, i, v in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                seen.append((at, i, v, y))
        seen.sort(key=lambda r: (r[0], r[1], r[3]))
        w, b = follow_leader([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), y) for _, i, v, y in seen], bits, passes)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    place = F.struct("at", "same")
    last = rows.select("at", "same").distinct().orderBy("at", "same").limit(train_rows).agg(F.max(place)).first()[0]
    if last is None:
        return np.zeros(2**bits, np.float32), 0.0
    sample = rows.filter(place <= F.struct(F.lit(last["at"]).alias("at"), F.lit(last["same"]).alias("same"))).dropDuplicates(["at", "same"])
    counted = sample.select("label", "text", "at").mapInArrow(count, "label double, at long, number binary, value binary")
    out = counted.repartition(1).mapInArrow(learn, "w binary, b double").first()
    if out is None:
        return np.zeros(2**bits, np.float32), 0.0
    return np.frombuffer(out["w"], np.float32), out["b"]


def labelled(docs: DataFrame, labels: DataFrame, key: str, order: Column, text: str = "text", label: str = "label", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """key, text and label of the documents that fit(..., order=order) may learn from; order is made of key alone.

    Which keys come first is settled on keys without their texts, of documents that are there; at most train_rows
    keys with their labels are broadcast, so no text is shuffled to meet its label.  fit takes its rows by order, and each key
    has at least one, so it takes none beyond these.
    """
    there = labels.filter(F.col(label).isNotNull()).select(key, label).distinct().join(docs.select(key).distinct(), key, "left_semi").withColumn("_at", order)
    last = there.select("_at").distinct().orderBy("_at").limit(train_rows).agg(F.max("_at")).first()[0]
    first = there.filter(F.lit(False) if last is None else F.col("_at") <= last).select(key, label)
    return docs.select(key, text).join(F.broadcast(first), key)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keys: list[str | Column], text: str = "text", bits: int = BITS, ngram: int = NGRAM) -> DataFrame:
    """keys and score, the probability of label 1 for each whole text.

    A null or empty text gets the score of a text without n-grams (the bias); repeated rows
    are scored one by one; an empty table gives no rows; other columns are not read.
    """
    names = docs.select(*keys).columns
    rows = docs.select(*[F.col(k).alias(f"_{i}") if isinstance(k, str) else k.alias(f"_{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(len(names)))
            for lo, hi in pieces(off):
                sums = weigh(*features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], bits, ngram), weights, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(len(names))), pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))))],
                    names=[*(f"_{i}" for i in range(len(names))), "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())]))
    return out.select(*[out[f"_{i}"].alias(c) for i, c in enumerate(names)], "score")
