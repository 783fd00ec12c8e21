"""Importance resampling towards a target text distribution, by hashed n-gram counts and seeded Gumbel keys."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import range_ranked, saved
from rollcall.llm._text import LOWER, PLAIN, find_words, pieces, text_buffer, trimmed

#: Points of a range at which one job counts: so many as four bisections would try one after the other.
PROBES = 15
_LONG = 64


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & np.uint32(1), (row >> np.uint32(1)) ^ np.uint32(0xEDB88320), row >> np.uint32(1))
    return row


_TABLE = _crc_table()


def crc_on(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 registers of state after the bytes of each range too; all ranges at once, a byte of each at a time."""
    n = end - start
    order = np.argsort(-n, kind="stable")
    order = order[np.searchsorted(-n[order], -_LONG, "left") :]  # at most _LONG bytes
    out, crc, at, length = state.copy(), state[order], start[order], n[order]
    for j in range(int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -j, "left"))
        crc[:m] = _TABLE[(crc[:m] ^ buf[at[:m] + j]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[order] = crc
    for i in np.flatnonzero(n > _LONG):
        out[i] = zlib.crc32(buf[start[i] : end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(buf: np.ndarray, off: np.ndarray, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature and its row, features of one length after those of another, and each row's words."""
    low = LOWER[buf]
    starts, ends, first = find_words(low, off, PLAIN)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    state = crc_on(np.full(len(starts), 0xFFFFFFFF, np.uint32), low, starts, ends)
    out, rows = [(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)], [row]
    for n in range(2, ngrams + 1):
        state = _TABLE[(state[:-1] ^ np.uint32(0x20)) & np.uint32(255)] ^ (state[:-1] >> np.uint32(8)) if len(state) else state
        state = crc_on(state, low, starts[n - 1 :], ends[n - 1 :])
        whole = row[n - 1 :] == row[: len(row) - n + 1]
        out.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))[whole])
        rows.append(row[: len(row) - n + 1][whole])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows), words


def bucket_counts(texts: DataFrame, text: str, ngrams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: summed in each task, then over tasks; as many numbers as buckets."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            for lo, hi in pieces(off):
                total += np.bincount(features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ngrams, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(F.col(text).cast("string").alias("_text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of a bucket's shares) for each bucket."""
    n, s, t = len(raw), raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gumbel(seed: int, key: Column) -> Column:
    """floor(1000 * a Gumbel variate) of a seeded hash of the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, ngrams: int, seed: int, key: str, text: str) -> DataFrame:
    """key, n_words, n_features, weight and score of each document: sums over an array with a gain for each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @trimmed
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            words, n, total = [], [], []
            for lo, hi in pieces(off):
                bucket, row, w = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ngrams, len(own))
                order = np.argsort(row, kind="stable") if ngrams > 1 else slice(None)
                upto = np.concatenate([[0], np.cumsum(own[bucket[order]])])
                count = np.bincount(row, minlength=hi - lo)
                ends = np.cumsum(count)
                words.append(w)
                n.append(count)
                total.append(upto[ends] - upto[ends - count])
            if n:
                count = np.concatenate(n)
                weight = np.concatenate(total) // np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(count), pa.array(weight)], names=["_key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(weigh, f"_key {kind}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("_key")))


def bisected(rows: DataFrame, value: Column, wanted: int, probes: int = PROBES) -> int | None:
    """The least v for which at least ``wanted`` rows have value <= v, found by exact counts; null values count as beyond all.

    Each job counts the rows up to ``probes`` points of the range that is left, so it is cut to a (probes + 1)th; only
    those counts reach the driver.  None if there are fewer rows with a value.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < wanted:
        return None
    while low < high:
        points = sorted({low + (high - low) * i // (probes + 1) for i in range(1, probes + 1)})
        counts = rows.agg(*[F.count_if(value <= p) for p in points]).first()
        for p, c in zip(points, counts, strict=True):
            if c >= wanted:
                high = p
                break
            low = p + 1
    return low


def resampled(
    docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20,
    key: str = "doc_id", text: str = "text", target_text: str = "text", probes: int = PROBES,
) -> DataFrame:
    """Weighs documents by how much likelier their n-grams are in the target texts than in docs, and draws a share of them without replacement.

    Words are runs of letters and digits, only A-Z lower-cased.  Counts over all of docs and all of target give each hash
    bucket a gain; a document's weight is the floored mean of its features' gains; weight plus a seeded Gumbel variate is its
    score, and the highest scores among documents of min_words words or more are drawn, ties to the smaller key.

    Scores are persisted once.  The cutoff among them is found by bisection over exact counts, and so is the last key drawn among
    the rows that tie at the cutoff; then only drawn rows are shuffled, by ranges, to be ranked.

    key must be an integer.  Returns key, n_features, weight, score and rank (from 1; null: not drawn), a row for each row.  A null
    or empty text has no features and weight 0; a null key is hashed as an empty one and comes last among ties; of repeated rows that
    tie at the cutoff as many are drawn as are wanted; an empty table gives no rows, an empty target equal counts of nothing; a
    very long text is worked on whole, in arrays of some 12 bytes a byte; other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets))
    rows = saved(weighted(docs, gain, ngrams, seed, key, text).withColumn("_may", F.col("n_words") >= min_words), "scores")
    eligible = rows.filter("_may")
    wanted = eligible.count() * percent // 100
    last = bisected(eligible, -F.col("score"), wanted, probes) if wanted else None
    if last is None:
        drawn, others = rows.filter("false"), rows
    else:
        tied = eligible.filter(F.col("score") == -last)
        left = wanted - eligible.filter(F.col("score") > -last).count()
        final = bisected(tied, F.col("_key").cast("long"), left, probes)
        among = F.lit(True) if final is None else F.coalesce(F.col("_key") <= final, F.lit(False))
        take = F.col("_may") & ((F.col("score") > -last) | (F.col("score") == -last) & among)
        drawn, others = rows.filter(take), rows.filter(~take)
    out = range_ranked(saved(drawn, "drawn"), [F.col("score").desc(), F.col("_key").asc_nulls_last()], "_place")
    rank = F.when(F.col("_place") < wanted, F.col("_place") + 1)  # rows that repeat the last one drawn
    columns = [F.col("_key").alias(key), "n_features", "weight", "score"]
    return out.select(*columns, rank.cast("long").alias("rank")).unionAll(others.select(*columns, F.lit(None).cast("long").alias("rank")))
