"""Benchmark decontamination: test items found inside documents by MinHash containment sketches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import saved
from rollcall.llm._text import LOWER, PLAIN, U, find_words, mix, names, pieces, rows_of, shingles, text_buffer, trimmed

#: Shingles of all items of one block, whose sketches and sets are broadcast: 8 bytes each.
BLOCK_SHINGLES = 1_000_000


def word_prints(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, first = find_words(low, off, PLAIN)
    return names(low, starts, ends), first


class Sketches:
    """Bottom-k MinHash sketches of one block of items, in partitions by size.

    An item with n shingles, of which a document must hold at least
    ceil(t * n), misses n - ceil(t * n) at most.  So of its k lowest-hashed
    shingles, k = n - ceil(t * n) + 1, the document holds one at least: no item
    is lost.  k is taken from the largest n of the item's size partition (powers
    of two), and the item's own n where that is smaller.
    """

    def __init__(self, sets: list[np.ndarray], widths: list[int], threshold: float):
        self.sets, self.threshold = sets, threshold
        self.widths = sorted(set(widths))
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in self.widths:
            keys, items = [], []
            for i, (s, w) in enumerate(zip(sets, widths, strict=True)):
                if w == width:
                    top = 1 << (len(s) - 1).bit_length()
                    k = min(len(s), top - int(np.ceil(threshold * top - 1e-9)) + 1)
                    keys.append(s[np.argsort(mix(s))[:k]])
                    items.append(np.full(k, i))
            key, item = np.concatenate(keys), np.concatenate(items)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[key >> U(44)] = True
            self.index[width] = key[order], item[order], seen

    def hits(self, prints: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of each pair at or over the threshold."""
        for width in self.widths:
            key, item, seen = self.index[width]
            sh, begin = shingles(prints, first, width)
            at = np.flatnonzero(seen[sh >> U(44)])
            lo, hi = np.searchsorted(key, sh[at], "left"), np.searchsorted(key, sh[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            row = np.repeat(rows_of(begin)[at], n)
            which = item[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            last, own = -1, np.zeros(0, U)
            for r, i in np.unique(np.stack([row, which], 1), axis=0).tolist():
                if r != last:
                    last, own = r, np.unique(sh[begin[r] : begin[r + 1]])
                shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                    yield r, i, shared


def contained_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", words: int = 5, threshold: float = 0.8, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Pairs of a document and an item of which it holds a share of threshold or more.

    Words are runs of letters and digits, lower-cased (A-Z).  An item's set is
    its distinct shingles of so many words (all its words as one shingle, if it
    has fewer).  Items are the query set: they are searched in blocks of
    bounded size, each block against every whole document in one pass without
    a shuffle.  Candidates come from bottom-k MinHash sketches and are confirmed
    on the full sets.

    Returns key, item_key, n_item (shingles), n_shared and containment, one row for each
    pair of rows, so repeated rows give repeated pairs.  A null or empty text or
    item is contained in nothing and contains nothing; an empty table gives no
    rows; other columns are not read.
    """
    item_type = items.schema[item_key].dataType.simpleString()
    schema = f"n long, width int, prints binary, item_key {item_type}"

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            prints, first = word_prints(buf, off)
            out = []
            for r in range(len(off) - 1):
                own = prints[first[r] : first[r + 1]]
                width = min(words, len(own))
                out.append((np.unique(shingles(own, np.array([0, len(own)]), width)[0]) if width else np.zeros(0, U), width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s, _ in out], pa.int64()), pa.array([w for _, w in out], pa.int32()),
                 pa.array([s.tobytes() for s, _ in out], pa.binary()), batch.column(0)],
                names=["n", "width", "prints", "item_key"])

    sets = saved(
        items.select(items[item_key].alias("_key"), items[item_text].cast("string").alias("_text")).mapInArrow(cut, schema).filter("n > 0"), "items")
    # Equal sets are searched once, so repeated items fill no block; their keys are joined to what is found.
    print_of = F.md5(F.concat(F.col("width").cast("string").cast("binary"), F.col("prints")))
    named = sets.select(print_of.alias("_set"), F.col("item_key").alias("_item"))
    sets = sets.select(print_of.alias("_set"), "n", "width", "prints").dropDuplicates(["_set"])
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    found = []
    for b in range(blocks):
        block = sets.filter(F.pmod(F.xxhash64("_set"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows and b:
            continue
        found.append(_search(rows, key_type, block, threshold))
    out = reduce(DataFrame.unionAll, found).join(named, "_set")
    return out.select(
        F.col("_key").alias(key), F.col("_item").alias(item_key), "n_item", "n_shared",
        (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _search(rows: DataFrame, key_type: str, block: pa.Table, threshold: float) -> DataFrame:
    spark = rows.sparkSession
    prints = [np.frombuffer(x, U) for x in block["prints"].to_pylist()]
    shared = spark.sparkContext.broadcast((prints, block["width"].to_pylist(), block["_set"].combine_chunks()))

    @trimmed
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, widths, keys = shared.value
        sketches = Sketches(sets, widths, threshold) if sets else None
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in pieces(off) if sketches else ():
                one, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                hits = list(sketches.hits(*word_prints(one, at)))
                if hits:
                    r, i, n = (np.array(x) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r + lo)), keys.take(pa.array(i)),
                         pa.array([len(sets[k]) for k in i], pa.int64()), pa.array(n, pa.int64())],
                        names=["_key", "_set", "n_item", "n_shared"])

    return rows.mapInArrow(search, f"_key {key_type}, _set string, n_item long, n_shared long")


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold a benchmark item; a document with a null key stays only if no row with a null key holds one."""
    leaks = contained_items(docs, items, key=key, **options).select(F.col(key).alias("_leak")).distinct()
    return docs.join(leaks, docs[key].eqNullSafe(leaks["_leak"]), "left_anti")
