"""Removal of repeated passages: blockwise suffix sorting with difference-cover samples."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import begun, finished, only_touched, partitions, saved
from rollcall.llm._text import Prefix, U, find_words, mix, names, pieces, rows_of, spread, text_buffer, trimmed, union_length
from rollcall.llm.suffix_order import cover_for, tied_in_segments

#: Names, or bytes, that one bucket holds on average: what a task sorts at once.
BUCKET = 3_000_000
#: Bytes whose smallest hash in a match deals it to a bucket; segments that a task remembers, and bytes that it gathers before it sends them.
GRAM, SEEN, GATHERED = 32, 400_000, 8 << 20
#: Cells into which the rows of a group of copies are dealt where they learn its size.
CELLS = 64


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


SUFFIXES = "bucket int, known boolean, width int, keys binary, ids binary, counts binary, places binary"


def dealt(keys: np.ndarray, ids: np.ndarray, place: np.ndarray, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Suffixes, ordered by text and place, as rows of SUFFIXES: one for each bucket of their keys.

    Suffixes of one call with equal keys are tied already: they go on as known, and one of them stands for all.  So a
    passage of very many texts fills no bucket.
    """
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    alone = head & np.append(head[1:], True)
    one_text = np.zeros(len(k), bool)  # a run of copies of one suffix of one text isn't tied
    start = np.flatnonzero(head)
    if len(start):
        run = np.cumsum(head) - 1
        same = (ids[order] == ids[order][start][run]) & (place[order] == place[order][start][run])
        one_text = np.logical_and.reduceat(same, start)[run]
    tied = np.sort(order[~alone & ~one_text])
    sent = np.sort(order[head])
    bucket = ((keys[sent] >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    sent, bucket = sent[by], bucket[by]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    groups = [(int(bucket[a]), False, sent[a:b]) for a, b in zip(cut, np.append(cut[1:], len(sent)), strict=True)]
    if len(tied):
        groups.append((int(ids[tied[0]] % buckets), True, tied))
    out = []
    for b, known, at in groups:
        key = b"" if known else (keys[at] if width == 8 else (keys[at] & U(0xFFFFFFFF)).astype(np.uint32)).tobytes()
        out.append((b, known, width, key, *_listed(ids[at], place[at])))
    if out:
        kinds = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 4]
        names = [x.split()[0] for x in SUFFIXES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _listed(ids: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Suffixes, ordered by text, packed: texts, suffixes of each, and steps between their places."""
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    return _packed(ids[first]), _packed(np.diff(np.append(first, len(ids))).astype(np.uint32)), _packed(step.astype(np.uint32))


def _suffixes(ids: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    many = _unpacked(counts, np.uint32).astype(np.int64)
    step = _unpacked(places, np.uint32).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(many) - many
    return np.repeat(_unpacked(ids, np.int64), many), total - np.repeat(total[first] - step[first], many)


def _parcels(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    """Tied suffixes as one row for each of n parts of the texts."""
    if not found:
        return
    ids, place = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    part = (mix(ids.astype(U)) % U(n)).astype(np.int32)
    o = np.lexsort((place, ids, part))
    ids, place, part = ids[o], place[o], part[o]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    rows = [(int(part[a]), *_listed(ids[a:b], place[a:b])) for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True)]
    kinds = [pa.int32(), *[pa.binary()] * 3]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "ids", "counts", "places"])


def ties(suffixes: DataFrame) -> DataFrame:
    """id and places (packed) of the suffixes whose key another suffix shares; one bucket at a time is sorted."""
    n = partitions(suffixes.sparkSession)

    def sort(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray] | None:
        width = np.uint64 if rows[0][2] == 8 else np.uint32
        key = np.concatenate([np.frombuffer(r[3], width) for r in rows])
        o = np.argsort(key)
        k = key[o]
        same = k[1:] == k[:-1]
        o = o[np.append(same, False) | np.append(False, same)]
        if not len(o):
            return None
        parts = [_suffixes(*r[4:]) for r in rows]
        ids, place = (np.concatenate([p[i] for p in parts])[o] for i in (0, 1))
        key = key[o]
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        differ = (ids != ids[start][run]) | (place != place[start][run])
        tied = np.logical_or.reduceat(differ, start)[run]
        return ids[tied], place[tied]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = tuple(c[i].as_py() for c in batch.columns)
                if r[1]:
                    found.append(_suffixes(*r[4:]))
                    held += len(found[-1][0])
                else:
                    if rows and rows[0][0] != r[0]:
                        if got := sort(rows):
                            found.append(got)
                            held += len(got[0])
                        rows = []
                    rows.append(r)
                if held > BUCKET:
                    yield from _parcels(found, n)
                    found, held = [], 0
        if rows and (got := sort(rows)):
            found.append(got)
        yield from _parcels(found, n)

    def open_(rows: list[tuple]) -> pa.RecordBatch:
        parts = [_suffixes(*r[1:]) for r in rows]
        ids, place = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        o = np.lexsort((place, ids))
        ids, place = ids[o], place[o].astype(np.uint32)
        cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[cut]), pa.array([_packed(place[a:b]) for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True)], pa.binary())], names=["id", "places"])

    @trimmed
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = tuple(c[i].as_py() for c in batch.columns)
                if rows and rows[0][0] != r[0]:
                    yield open_(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield open_(rows)

    parts = suffixes.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "part int, ids binary, counts binary, places binary")
    return parts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(gather, "id long, places binary")


def _merged(places: bytes | None) -> np.ndarray:
    return np.unique(_unpacked(places, np.uint32).astype(np.int64)) if places else np.zeros(0, np.int64)


def _starts(places: np.ndarray, v: int, n: int, length: int) -> np.ndarray:
    """The starts of length bytes of which one of the next v places is in places."""
    ok = union_length(n, np.maximum(places - v + 1, 0), places + 1)
    return np.flatnonzero(ok[: max(0, n - length + 1)])


SEGMENTS = "bucket int, ids binary, places binary, counts binary, bytes binary"
RANGES = "part int, ids binary, places binary, counts binary"


def _rows(columns: list[tuple], spec: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in spec.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*columns, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _ranges(found: list[tuple[int, int, int]], parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of tied suffixes (text, first place, how many) as one row for each of some parts of the texts."""
    if not found:
        return
    ids, places, counts = np.array(found, np.int64).T
    part = (mix(ids.astype(U)) % U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        yield _rows([(int(part[group[0]]), *(_packed(np.ascontiguousarray(x[group])) for x in (ids, places, counts)))], RANGES)


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours of x, by running minima from both sides of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _segmenter(length: int, v: int, buckets: int, parts: int) -> Callable:
    """Texts with tied samples into the segments that hold suffixes which may tie, by bucket.

    Each suffix goes to the bucket of the least hash among the GRAM-byte strings in its first length bytes: equal ones meet,
    and neighbours mostly go together, so that a bucket gets their bytes once, as one segment.  Segments that a task has
    met before are tied: they go on as known, and the first stands for all, so a passage of very many texts
    fills no bucket.
    """
    gram = min(GRAM, max(1, length // 4))

    def cut(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places and numbers of suffixes of each segment, and the hashes that deal them."""
        hashes = Prefix(data).of(np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
        least = least_in_windows(hashes >> U(32) << U(32) | np.arange(len(hashes), dtype=U), length - gram + 1)[start]
        head = np.ones(len(start), bool)
        head[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(head)
        return start[first], np.diff(np.append(first, len(start))), mix(least[first] >> U(32))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int] | None] = {}
        sent: dict[int, list[tuple]] = {}
        known: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for b, rows in sent.items():
                ids, places, counts, raw = zip(*rows, strict=True)
                yield _rows([(b, *(_packed(np.array(x, np.int64)) for x in (ids, places, counts)), zlib.compress(b"".join(raw), 1))], SEGMENTS)
            sent.clear()
            for r in _ranges(known, parts):
                yield _rows([(-1 - r.column(0)[0].as_py(), *(r.column(i)[0].as_py() for i in (1, 2, 3)), b"")], SEGMENTS)
            known.clear()

        for batch, lo, hi, data, at in _texts(batches):
            starts = [at[r] + _starts(_merged(packed), v, int(at[r + 1] - at[r]), length) for r, packed in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist())]
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            start = np.concatenate(starts)
            if not len(start):
                continue
            first, count, least = cut(data, start)
            row = np.searchsorted(at, first, "right") - 1
            raw = data.tobytes()
            bucket = ((least >> U(32)) * U(buckets) >> U(32)).tolist()
            for a, n, r, b in zip(first.tolist(), count.tolist(), row.tolist(), bucket, strict=True):
                segment = raw[a : a + n + length - 1]
                name = xxhash.xxh3_128_digest(segment)
                mine = ids[r], a - int(at[r]), n
                if name not in seen:
                    seen[name] = mine
                    sent.setdefault(b, []).append((*mine, segment))
                    held += len(segment)
                else:
                    known.append(mine)
                    if seen[name]:
                        known.append(seen[name])
                        seen[name] = None
            if len(seen) > SEEN:
                seen.clear()
            if held > GATHERED or len(known) > SEEN:
                yield from flush()
                held = 0
        yield from flush()

    return run


def bucket_runs(rows: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """The runs of tied suffixes (text, first place, how many) of one bucket's rows of SEGMENTS."""
    where: dict[bytes, list[tuple[int, int, int]]] = {}
    for r in rows:
        raw, at = zlib.decompress(r[4]), 0
        for mine in zip(*(_unpacked(r[k], np.int64).tolist() for k in (1, 2, 3)), strict=True):
            size = mine[2] + length - 1
            where.setdefault(raw[at : at + size], []).append(mine)
            at += size
    segment = list(where)
    count = np.array([len(x) - length + 1 for x in segment])
    size = count + length - 1
    start = np.cumsum(size) - size
    flag = tied_in_segments(np.frombuffer(b"".join(segment), np.uint8), start, count, length)
    found = [x for own in where.values() if len(own) > 1 for x in own]
    alone = np.array([len(own) == 1 for own in where.values()])
    flag &= np.repeat(alone, count)
    begin = np.cumsum(count) - count
    edge = np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8))
    cuts = np.zeros(len(flag) + 1, bool)
    cuts[begin] = True
    head = np.flatnonzero(flag & ((edge[:-1] == 1) | cuts[:-1]))
    tail = np.flatnonzero(flag & ((edge[1:] == -1) | np.append(cuts[1:-1], True)))
    owner = np.searchsorted(begin, head, "right") - 1
    own = list(where.values())
    for k, a, b in zip(owner.tolist(), head.tolist(), tail.tolist(), strict=True):
        i, place, _ = own[k][0]
        found.append((i, place + a - int(begin[k]), b - a + 1))
    return found


def tied_runs(segments: DataFrame, length: int) -> DataFrame:
    """id and runs (packed places and numbers) of the suffixes whose first length bytes another one shares.

    One bucket at a time is put in the order of its suffixes, by bytes: equal segments are one, and the rest is sorted by
    the cover period, longer ties by the ranks of cover samples.
    """
    n = partitions(segments.sparkSession)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found: list[tuple[int, int, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = tuple(c[i].as_py() for c in batch.columns)
                if r[0] < 0:
                    yield _rows([(-1 - r[0], *r[1:4])], RANGES)
                    continue
                if rows and rows[0][0] != r[0]:
                    found += bucket_runs(rows, length)
                    rows = []
                rows.append(r)
                if len(found) > SEEN:
                    yield from _ranges(found, n)
                    found = []
        yield from _ranges(found + (bucket_runs(rows, length) if rows else []), n)

    @trimmed
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                i, p, c = (np.concatenate(held[k]) for k in range(3))
                o = np.lexsort((p, i))
                i, p, c = i[o], p[o], c[o]
                cut = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                runs = [_packed(np.stack([p[a:b], c[a:b]])) for a, b in zip(cut, np.append(cut[1:], len(i)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(i[cut]), pa.array(runs, pa.binary())], names=["id", "runs"])
                held.clear()

        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if part != last:
                    yield from out()
                    last = part
                for k in range(3):
                    held.setdefault(k, []).append(_unpacked(batch.column(k + 1)[i].as_py(), np.int64))
        yield from out()

    # Known runs have a negative bucket: they only pass through.
    found = segments.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, RANGES)
    return found.repartition(n, "part").sortWithinPartitions("part").mapInArrow(gather, "id long, runs binary")


def _id(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, words: int | None = None, cut_words: bool = True,
) -> DataFrame:
    """The bytes of each text that lie in a string of length bytes that also starts anywhere else.

    With words, runs of so many words that start anywhere else are found too, however few their bytes and whatever the white
    space between their words; with cut_words, their bytes count as repeated as well.

    Texts are UTF-8 bytes; strings never cross texts and are judged on the input; occurrences may overlap.

    1. Equal texts are one class: each copy of length bytes or more goes as a whole, and one text stands for all.
    2. Cover samples: the suffixes at the places of a difference cover (5.9 % for 400 bytes).  Two equal strings of length
       bytes have a sample at the same distance, followed by a window that is equal too.  Samples are ranked by fingerprints
       of their windows, dealt into buckets by rank, a bucket at a time is sorted, and suffixes without a tied
       sample go no further.
    3. The other suffixes are dealt into buckets by their content, neighbours together with their bytes, and one bucket at a
       time is sorted (suffix_order): by bytes up to a cover's period, longer ties by ranks of cover samples that are
       computed first, and by the last bytes.  All of this compares bytes, so a tie is equality of length bytes, whatever the
       fingerprints of step 2; those only thin.
    4. The union of the spans of tied suffixes is removed.
    5. Runs of words go through 1 and 2 with places counted in words; those with a tied sample tie by 64 bits of a
       cryptographic digest of their words' bytes.

    Returns key, sha256 (of the text), n_bytes, n_removed, n_spans, kept_sha256, kept, the remaining text: null where it is
    the text itself, and n_run_words, the words of runs of words (null without words).  A null text counts as empty; repeated
    rows are copies of each other; texts shorter than length (and words) stay; an empty table gives no rows; a null key is
    a key like any other; other columns are not read.
    """
    mark = begun()
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("+"), docs[key].cast("string")), F.lit("-"))
    long, run = F.octet_length(body) >= length, F.lit(0)
    if words:  # so many words have 2 * words - 1 bytes at least; only texts of that size are counted
        run = F.when(F.octet_length(body) >= 2 * words - 1, F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0)
    narrow = saved(docs.select(docs[key].alias("_key"), name.alias("name"), F.sha2(body.cast("binary"), 256).alias("sha256"), F.octet_length(body).cast("long").alias("n_bytes"),
                               run.cast("long").alias("n_words"), long.alias("long"), F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).cast("int").alias("cell")), "texts")
    classes = narrow.filter(F.col("long") | (F.col("n_words") >= words) if words else F.col("long")).groupBy("sha256").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"))
    size = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    rows = docs.select(F.concat(name, F.sha2(body.cast("binary"), 256)).alias("who"), body.alias("text"))

    window = max(16, length // 5)
    v, cover = cover_for(length, window)
    window = length - v + 1
    samples = rows.filter(F.octet_length("text") >= length).select("text").mapInArrow(_sampler(length, v, cover, window, _buckets(size * len(cover) / v)), SUFFIXES)
    tied = ties(samples)
    columns = ["sha256", "text", "places"]
    if words:
        some = rows.filter(F.octet_length("text") >= 2 * words - 1).select("text").mapInArrow(_word_sampler(words, _buckets(size / 20)), SUFFIXES)
        tied = tied.join(ties(some).withColumnRenamed("places", "word_places"), "id", "full")
        columns.append("word_places")

    wanted = tied.withColumnRenamed("id", "_id").join(classes.withColumn("_id", _id(F.col("sha256"))), "_id").select(F.concat("name", "sha256").alias("who"), *[c for c in columns if c != "text"])
    wanted = saved(wanted, "tied")
    joined = only_touched(rows, F.col("who"), wanted, F.col("who")).join(wanted, "who")
    every = saved(joined.select(F.monotonically_increasing_id().alias("id"), *columns), "candidates")
    found = every.filter("places is not null")

    many = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions(docs.sparkSession)
    starts = tied_runs(found.select("id", "text", "places").mapInArrow(_segmenter(length, v, _buckets(2 * many), parts), SEGMENTS), length)
    columns = ["sha256", "text", "runs"]
    if words:
        runs = every.filter("word_places is not null").select("id", "text", "word_places")
        held = runs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        runs = ties(runs.mapInArrow(_word_starts(words, _buckets(held / 5)), SUFFIXES))
        starts = starts.join(runs.withColumnRenamed("places", "word_places"), "id", "full")
        columns.append("word_places")
    cut = every.select("id", "sha256", "text").join(starts, "id").select(*columns).mapInArrow(
        _cutter(length, words, cut_words), "sha256 string, n_removed long, n_spans long, kept_sha256 string, kept string, n_run_words long")
    cut = cut.dropDuplicates(["sha256"])

    # Copies need no more than to know that they are; they are dealt into cells, so that a large group is no task's.
    repeated = classes.filter("copies > 1").select("sha256", "copies", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    out = narrow.join(repeated, ["sha256", "cell"], "left")
    out = out.withColumn("_cut", F.when(F.col("copies").isNull(), F.col("sha256")).otherwise(F.concat_ws("#", "sha256", "cell"))).join(
        cut.withColumnRenamed("sha256", "_cut"), "_cut", "left")
    whole = F.col("copies").isNotNull() & (F.col("long") | F.lit(bool(words and cut_words)))
    in_runs = F.when(F.col("copies").isNotNull() & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.coalesce("n_run_words", F.lit(0))) if words else F.lit(None)
    return finished(out.select(
        F.col("_key").alias(key), "sha256", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"), in_runs.cast("long").alias("n_run_words")), "passages", mark)


def _buckets(suffixes: float) -> int:
    return max(24, int(suffixes / BUCKET) + 1)


def _sampler(length: int, v: int, cover: np.ndarray, window: int, buckets: int) -> Callable:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            for lo, hi in pieces(off):
                data, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                raw = memoryview(data.tobytes())
                ids = np.array([int(hashlib.sha256(raw[a:b]).hexdigest()[:15], 16) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
                n = np.diff(at) - window + 1
                # Places of the cover in each text, text by text.
                rounds = -(-n // v) * len(cover)
                k = spread(rounds)
                place = k // len(cover) * v + cover[k % len(cover)]
                row = np.repeat(np.arange(hi - lo), rounds)
                ok = place < n[row]
                place, row = place[ok], row[ok]
                begin = at[row] + place
                yield from dealt(Prefix(data).of(begin, begin + window), ids[row], place, buckets, 4)

    return run


def _word_names(data: np.ndarray, at: np.ndarray) -> tuple[Prefix, np.ndarray]:
    """Fingerprints of ranges of words, and each text's first word's number (len + 1)."""
    start, end, first = find_words(data, at)
    return Prefix(names(data, start, end)), first


def _run_names(data: np.ndarray, at: np.ndarray, begin: np.ndarray, words: int) -> np.ndarray:
    """64 bits of a cryptographic digest of each run of so many words, joined by one space; begin: the number of its first word."""
    start, end, _ = find_words(data, at)
    length = end - start
    to = np.cumsum(length + 1)
    joined = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    joined[np.repeat(to - length - 1, length) + spread(length)] = data[np.repeat(start, length) + spread(length)]
    raw = memoryview(joined.tobytes())
    ends = zip((to[begin] - length[begin] - 1).tolist(), (to[begin + words - 1] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in ends), U)


def _word_cover(words: int) -> tuple[int, np.ndarray, int]:
    v, cover = cover_for(words, max(1, words // 5))
    return v, cover, words - v + 1


def _word_sampler(words: int, buckets: int) -> Callable:
    v, cover, window = _word_cover(words)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.zeros(v, bool)
        inside[cover] = True
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            for lo, hi in pieces(off):
                data, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                raw = memoryview(data.tobytes())
                ids = np.array([int(hashlib.sha256(raw[a:b]).hexdigest()[:15], 16) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
                prints, first = _word_names(data, at)
                n = np.diff(first)
                row, place = rows_of(first), spread(n)
                ok = inside[place % v] & (place + window <= n[row]) & (n >= words)[row]
                place, row = place[ok], row[ok]
                begin = first[row] + place
                yield from dealt(prints.of(begin, begin + window), ids[row], place, buckets, 4)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Buffers of a few texts at a time, with the batch and the range of rows."""
    for batch in batches:
        buf, off = text_buffer(batch.column(1))
        for lo, hi in pieces(off):
            yield batch, lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _word_starts(words: int, buckets: int) -> Callable:
    v, _, _ = _word_cover(words)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, at in _texts(batches):
            first = find_words(data, at)[2]
            near = [_starts(_merged(packed), v, int(n), words) for n, packed in zip(np.diff(first), batch.column(2).slice(lo, hi - lo).to_pylist(), strict=True)]
            row, place = np.repeat(np.arange(hi - lo), [len(x) for x in near]), np.concatenate(near)
            ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            begin = first[row] + place
            yield from dealt(_run_names(data, at, begin, words), ids[row], place, buckets, 8)

    return run


def _cutter(length: int, words: int | None = None, cut_words: bool = True) -> Callable:
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            removed, spans, shas, kept, in_runs = [], [], [], [], []
            for r, packed in enumerate(batch.column(2).to_pylist()):
                own = buf[off[r] : off[r + 1]]
                place, count = _unpacked(packed, np.int64).reshape(2, -1) if packed else np.zeros((2, 0), np.int64)
                gone = union_length(len(own), place, place + count + length - 1)
                in_runs.append(0)
                if words and len(run_at := _merged(batch.column(3)[r].as_py())):
                    begin, end, _ = find_words(own, np.array([0, len(own)]))
                    in_runs[-1] = int(union_length(len(begin), run_at, run_at + words).sum())
                    if cut_words:
                        gone |= union_length(len(own), begin[run_at], end[run_at + words - 1])
                rest = own[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if removed[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string()), pa.array(in_runs, pa.int64())],
                names=["sha256", "n_removed", "n_spans", "kept_sha256", "kept", "n_run_words"])

    return run
