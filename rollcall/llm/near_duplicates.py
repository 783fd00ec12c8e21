"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import begun, finished, flagged, only_touched, partitions, saved, spread_join
from rollcall.llm._text import LOWER, U, find_words, mix, names, pieces, rows_of, shingles, text_buffer, trimmed
from rollcall.llm.components import components

#: Signature length and rows of a band: a pair at similarity 0.8 shares no band once in 2e7 pairs.
HASHES, BAND = 128, 4
#: Standard deviations of the signature's estimate (of plain MinHash, the larger one) that a pair may lie under the threshold.
MARGIN = 4.0
#: Members of a bucket's block; a larger bucket is compared block by block.
BLOCK = 512
#: Cells of a set's histogram of fingerprints, which bounds how much two sets can share.
CELLS = 1024
_EMPTY = np.uint32(0xFFFFFFFF)
#: Elements that draw their permutations at once, each of which takes a byte for each place.
PART = 1 << 16


def superminhash(el: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """Signatures of sets of fingerprints, PART elements at a time.

    Elements draw independently of each other, so a set's signature is the place by place minimum of its parts'
    signatures: a very long text takes no more memory than PART shingles.
    """
    if len(el) <= PART:
        return _superminhash(el, begin, m)
    out = np.full((len(begin) - 1, m), _EMPTY, np.uint32)
    for lo in range(0, len(el), PART):
        hi = min(lo + PART, len(el))
        first, last = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left")
        part = _superminhash(el[lo:hi], np.clip(begin[first : last + 1], lo, hi) - lo, m)
        out[first:last] = np.minimum(out[first:last], part)
    return out


def _superminhash(el: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """Signatures of sets of fingerprints, m numbers a row: step in the upper bits, random fraction in the lower.

    Each element draws one permutation of the m places, place by place (a Fisher-Yates shuffle by its own random
    numbers), and offers step + fraction to the place drawn in each step.  All elements go through step j together;
    a row stops once no place is open, as later steps offer more.
    """
    rows = len(begin) - 1
    row = rows_of(begin)
    out = np.full(rows * m, _EMPTY, np.uint32)
    filled = np.zeros(rows * m, bool)
    fraction = 32 - (m - 1).bit_length()
    places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(el), 1))
    at = np.arange(len(el))
    for j in range(m):
        x = mix(el[at] + U((0x9E3779B97F4A7C15 * (j + 1)) % 2**64))
        k = j + (((x >> U(32)) * U(m - j)) >> U(32)).astype(np.int64)
        drawn = places[at, k]
        places[at, k] = places[at, j]
        place = row[at] * m + drawn
        open_ = ~filled[place]
        place = place[open_]
        np.minimum.at(out, place, (x[open_] & U((1 << fraction) - 1)).astype(np.uint32) | np.uint32(j << fraction))
        filled[place] = True
        full = filled.reshape(rows, m).all(1)
        at = at[~full[row[at]]]
        if not len(at):
            break
    return out.reshape(rows, m)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, and each row's first (len + 1)."""
    low = LOWER[buf]
    starts, ends, first = find_words(low, off)
    sh, begin = shingles(names(low, starts, ends), first, k)
    row = rows_of(begin)
    order = np.lexsort((sh, row))
    sh = sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return sh[new], np.concatenate([[0], np.cumsum(new)])[begin]


def signatures(docs: DataFrame, key: str, text: str, words: int, hashes: int, band: int) -> DataFrame:
    """_key, n, set and check (a digest of the full set, 64 bits each; null if empty), bands (the hashes of the signature's bands) and print, the text's sha256."""
    string = docs[text].cast("string")
    rows = docs.select(docs[key].alias("_key"), string.alias("_text"), _print(string).alias("print"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in pieces(off, 1 << 19):
                sh, begin = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                n = np.diff(begin)
                digests = _digests(sh, begin)
                bands = _bands(superminhash(sh, begin, hashes), band)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(digests[:, 0], mask=n == 0), pa.array(digests[:, 1], mask=n == 0),
                     pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), bands.shape[1]).cast(pa.list_(pa.int64())), batch.column(2).slice(lo, hi - lo)],
                    names=["_key", "n", "set", "check", "bands", "print"])

    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, n long, set long, check long, bands array<long>, print binary")


def _digests(sh: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128 bits for each set, as two numbers."""
    raw = memoryview(sh.tobytes())
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)), np.int64).reshape(-1, 2)


def _told_apart(found: DataFrame) -> DataFrame:
    """found with sets renamed where one number stands for unequal digests, and the digest's first half as digest.

    Which numbers those are is told by a bitmap; all rows of a digest are renamed alike, so it may name too many.
    """
    clash = found.filter("n > 0").groupBy("set").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("set")
    out = flagged(found, F.col("set"), clash, F.col("set"), "_clash").withColumn("digest", F.col("set"))
    return out.withColumn("set", F.when(F.col("_clash"), F.xxhash64("set", "check")).otherwise(F.col("set"))).drop("_clash")


def _bands(signature: np.ndarray, band: int) -> np.ndarray:
    rows, m = signature.shape
    parts = signature.reshape(rows, m // band, band).astype(U)
    h = np.broadcast_to(np.arange(1, m // band + 1, dtype=U), (rows, m // band))
    for d in range(band):
        h = mix(h * U(0x9E3779B97F4A7C15) + parts[:, :, d])
    return h.view(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of sets whose similarity on the full sets is the threshold or more.

    pairs: a saved table.  A set in very many pairs, such as a hub, is compared in cells of them.
    """
    percent = round(threshold * 100)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                shared = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return _beside(pairs, one, other).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _beside(pairs: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """pairs (a, b), a saved table, with the row of one for a and of other for b."""
    return spread_join(spread_join(pairs, one, "a", F.col("b")), other, "b", F.col("a"), counted=pairs)


def _histogram(sh: np.ndarray) -> bytes:
    """How many fingerprints fall into each cell, as bytes; 255 stands for that or more."""
    return np.minimum(np.bincount((sh >> U(54)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _alike(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (s == t).sum(-1) / s.shape[-1]


def likely(pairs: DataFrame, sets: DataFrame, threshold: float, hashes: int) -> DataFrame:
    """The pairs (a, b), a saved table, whose sizes and signatures allow the threshold."""
    least = _least(threshold, hashes)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (_matrix(batch.column(k), hashes) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(_alike(s, t) >= least))

    one = sets.select(F.col("set").alias("a"), F.col("signature").alias("x"), F.col("n").alias("na"))
    other = sets.select(F.col("set").alias("b"), F.col("signature").alias("y"), F.col("n").alias("nb"))
    fit = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    return _beside(pairs, one, other).filter(fit).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _least(threshold: float, hashes: int) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / hashes) ** 0.5


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def across(members: DataFrame, threshold: float, hashes: int, band: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members, of different components, whose sizes, signatures and histograms allow the threshold.

    members: bucket, size (of the bucket), set, n, component, signature, cells.  A bucket of over BLOCK members is cut
    into blocks, and each pair of blocks is a group of its own; a pair is named in the first band that its sets share.
    What two sets share is at most the sum of their histograms' lower counts, so few pairs under the threshold get through.
    """
    least = _least(threshold, hashes)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "n", "component", "signature", "cells")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        if len({r[6] for r in group}) < 2:
            return
        bucket, i, j = group[0][:3]
        own, ids, n, comp = (np.array([r[k] for r in group]) for k in (3, 4, 5, 6))
        sig = np.frombuffer(b"".join(r[7] for r in group), np.uint32).reshape(-1, hashes)
        cells = np.frombuffer(b"".join(r[8] for r in group), np.uint8).reshape(-1, CELLS)
        bounded = cells.max(1) < 255
        bands = _bands(sig, band)
        for k in range(len(group) - 1):
            rest = np.arange(k + 1, len(group))
            fit = (comp[rest] != comp[k]) & (np.minimum(n[rest], n[k]) >= threshold * np.maximum(n[rest], n[k]) - 1e-9)
            if i != j:
                fit &= own[rest] != own[k]
            rest = rest[fit]
            rest = rest[_alike(sig[rest], sig[k]) >= least]
            shared = np.minimum(cells[rest], cells[k]).sum(1, dtype=np.int64)
            rest = rest[((1 + threshold) * shared >= threshold * (n[rest] + n[k]) - 1e-6) | ~bounded[rest] | ~bounded[k]]
            if len(rest):
                same = bands[rest] == bands[k]
                first = bands[k][same.argmax(1)]
                for r in rest[(first == bucket) & same.any(1)].tolist():
                    yield min(ids[k], ids[r]), max(ids[k], ids[r])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != r[:3]:
                    out += compare(group)
                    group = []
                group.append(r)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if group:
            out += compare(group)
        yield _pairs(out)

    n = partitions(members.sparkSession)
    return dealt.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, hashes: int = HASHES, band: int = BAND,
) -> DataFrame:
    """Groups of documents linked by a similarity (Jaccard) of threshold or more of their sets of shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a set holds the distinct shingles of so many words
    (all words as one, if there are fewer).

    1. Documents with equal sets are one class, found by a digest of the full set.
    2. Classes that share a band of their SuperMinHash signatures are candidates.  In each bucket, the class with most
       collisions is the hub; members are confirmed against it on full sets, and links are joined into components.
       So a large group of near copies costs one comparison a member, not one a pair.
    3. Members of a bucket that are still in different components are compared with each other, in blocks, by signature;
       the pairs at or near the threshold are confirmed on full sets.  Nothing is left out for a bucket's size.

    Returns key, n_shingles, component_id (the smallest key reachable, its own included) and kept (key = component_id), one
    row for each row of docs.  A null or empty text, or one without words, has an empty set and is linked with nothing;
    repeated rows are copies of each other; a null key is never a component's number unless it is alone; an empty table
    gives no rows; other columns are not read.  A very long text takes memory in proportion to its own words.
    """
    mark = begun()
    found = _told_apart(saved(signatures(docs, key, text, words, hashes, band), "signatures"))
    classes = found.filter("n > 0").groupBy("set").agg(F.min("_key").alias("rep"), F.min(_name(F.col("_key"), F.col("print"))).alias("name"), F.min("digest").alias("digest"), F.min("check").alias("check"))
    classes = saved(classes, "classes")
    placed = found.filter("n > 0").select("set", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).filter("lo <> hi").select("bucket")
    members = saved(placed.join(shared, "bucket").distinct(), "members")

    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    sized = members.join(sizes, "bucket")
    weights = sized.groupBy("set").agg(F.sum("size").alias("weight"))
    hubs = members.join(weights, "set").groupBy("bucket").agg(F.max_by("set", F.struct("weight", "set")).alias("hub"))
    pairs = members.join(hubs, "bucket").filter("hub <> set").select(F.least("hub", "set").alias("a"), F.greatest("hub", "set").alias("b")).distinct()
    pairs = saved(pairs, "pairs")

    wanted = members.select("set").distinct().join(classes, "set")
    sets = saved(_full_sets(docs, wanted, key, text, words, hashes), "sets")
    links = saved(verified(saved(likely(pairs, sets, threshold, hashes), "pairs"), sets, threshold), "links")
    joined = saved(components(links), "components")

    of = sized.join(joined, sized["set"] == joined["node"], "left").select(sized["bucket"], "size", sized["set"], F.coalesce("component", "set").alias("component"))
    mixed = of.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = of.join(mixed, "bucket").join(sets.select("set", "n", "signature", "cells"), "set")
    more = saved(verified(saved(across(open_, threshold, hashes, band), "pairs"), sets, threshold), "links")
    if not more.isEmpty():
        joined = saved(components(links.unionAll(more)), "components")

    least = classes.join(joined, classes["set"] == joined["node"], "left").select("set", F.coalesce("component", "set").alias("component"), "rep")
    smallest = least.groupBy("component").agg(F.min("rep").alias("smallest"))
    numbers = spread_join(least, smallest, "component", F.col("set")).select("set", "smallest")
    out = spread_join(found.drop("bands", "print"), numbers, "set", F.col("_key"), "left")
    number = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("_key"))
    out = out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), number.alias("component_id"), F.col("_key").eqNullSafe(number).alias("kept"))
    return finished(out, "near-duplicates", mark)


def _print(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _name(key: Column, text_print: Column) -> Column:
    """Key and text as one name that is never null, to join on: a key, null or not, may stand for several texts."""
    return F.concat(F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit("-")), F.lit("/"), F.hex(text_print))


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int, hashes: int) -> DataFrame:
    """set, n, shingles (sorted fingerprints), signature and cells of one document of each wanted class, one row a set.

    Rows of the same key and text, however many, are one row of each task before they are shuffled.
    """
    string = docs[text].cast("string")
    rows = docs.select(_name(docs[key], _print(string)).alias("name"), string.alias("_text"))
    once = only_touched(rows, F.col("name"), wanted, F.col("name")).groupBy("name").agg(F.first("_text").alias("_text"))
    joined = once.join(wanted, "name").select("set", "digest", "check", "_text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(3))
            asked = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], 1)
            for lo, hi in pieces(off, 1 << 19):
                sh, begin = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                right = np.flatnonzero((_digests(sh, begin) == asked[lo:hi]).all(1))
                signature = superminhash(sh, begin, hashes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(right)), pa.array(np.diff(begin)[right]),
                     pa.array([sh[begin[r] : begin[r + 1]].tobytes() for r in right], pa.binary()), pa.array([signature[r].tobytes() for r in right], pa.binary()),
                     pa.array([_histogram(sh[begin[r] : begin[r + 1]]) for r in right], pa.binary())],
                    names=["set", "n", "shingles", "signature", "cells"])

    return joined.mapInArrow(run, "set long, n long, shingles binary, signature binary, cells binary")
