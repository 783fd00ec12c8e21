"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rollcall.llm._frames import ranked, saved
from rollcall.llm._text import SPACE, find_words, names, pieces, spread, text_buffer, trimmed

#: Units whose ids a worker remembers at most in each of two generations; units encoded as one text; cells into which the pieces of one length are cut for ranking.
REMEMBERED, TOGETHER, CELLS = 600_000, 128, 256
#: Fixed value: the pattern of the tokenizers whose words can be parted further, see units().
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: white space; letters; digits; ASCII marks but the apostrophe; all else.
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = MARK
_KIND[39] = OTHER
_KIND[48:58] = DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[SPACE] = BLANK
_known: dict[str, "WordIds"] = {}


class Lexicon:
    """Ids of units by fingerprint: sorted runs that are merged as they grow, and one array of ids that doubles."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.flat, self.used, self.size = np.zeros(1 << 16, np.uint32), 1, 0  # the first is the id 0 at a document's end

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key start (-1: unknown), and how many they are."""
        begin, length = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for own, start, n in self.runs:
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = own[at] == keys
            begin[hit], length[hit] = start[at[hit]], n[at[hit]]
        return begin, length

    def add(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Adds sorted, unknown keys with their ids, one after another; returns where each key's ids start."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        start = self.used + np.cumsum(length) - length
        self.flat[self.used : self.used + len(ids)] = ids
        self.used, self.size = self.used + len(ids), self.size + len(keys)
        run = keys, start, length
        while self.runs and len(self.runs[-1][0]) < 2 * len(run[0]):
            both = [np.concatenate(x) for x in zip(self.runs.pop(), run, strict=True)]
            order = np.argsort(both[0])
            run = tuple(x[order] for x in both)
        self.runs.append(run)
        return start


class WordIds:
    """Ids of units, each encoded once and then looked up by fingerprint.

    Units are the words between white space, right for tokenizers that drop white space and never join what it parts; for
    tokenizers that part text by PARTED, words are parted further (see units), and many units are encoded as one text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.parted = bool(suffix) and (first.get("pattern") or {}).get("Regex") == PARTED
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.parted:
            self.closes[[i for x, i in self.tokenizer.get_vocab(False).items() if x.endswith(suffix)]] = True
        self.young, self.old = Lexicon(), Lexicon()

    def units(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, whether each is one pre-token for sure, and each row's first unit (len + 1).

        The tokenizer's pattern never joins a letter with a mark other than the apostrophe, and takes digits one by one;
        so words are parted there.  Beside bytes of other kinds (apostrophes, characters that may be composed with
        their neighbours, added tokens) nothing is parted but digits.
        """
        if not self.parted:
            starts, ends, first = find_words(buf, off)
            return starts, ends, np.zeros(len(starts), bool), first
        kind = _KIND[buf]
        accented = np.flatnonzero(buf[:-1] == 0xC3)  # U+00C0 to U+00FF are letters but for two signs
        accented = accented[(buf[accented + 1] != 0x97) & (buf[accented + 1] != 0xB7)]
        kind[accented] = kind[accented + 1] = LETTER
        raw = buf.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                kind[at : at + len(token)] = OTHER
                at = raw.find(token, at + len(token))
        edge = np.ones(len(buf) + 1, bool)
        a, b = kind[:-1], kind[1:]
        edge[1:-1] = (a == DIGIT) | (b == DIGIT) | (a == BLANK) | (b == BLANK) | (a != b) & (a != OTHER) & (b != OTHER)
        edge[off] = True
        inside = kind != BLANK
        starts, ends = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & edge[1:]) + 1
        others = np.concatenate([[0], np.cumsum(kind == OTHER)])
        return starts, ends, others[starts] == others[ends], np.searchsorted(starts, off)

    def encoded(self, texts: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and how many each has; plain ones are one pre-token each."""
        length = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        where: list[np.ndarray] = []
        at = np.flatnonzero(plain)
        groups = [at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)]
        for group, x in zip(groups, self.encode([" ".join([texts[i] for i in group]) for group in groups], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.uint32)
            end = np.flatnonzero(self.closes[ids]) + 1
            if len(end) != len(group) or end[-1] != len(ids):
                plain = plain.copy()
                plain[group] = False  # not as expected: encode them one by one
                continue
            length[group] = np.diff(end, prepend=0)
            parts.append(ids)
            where.append(group)
        alone = np.flatnonzero(~plain)
        for i, x in zip(alone, self.encode([texts[i] for i in alone], add_special_tokens=False), strict=True):
            length[i] = len(x.ids)
            parts.append(np.array(x.ids, np.uint32))
        where.append(alone)
        order = np.concatenate(where)
        begin = np.empty(len(texts), np.int64)
        begin[order] = np.cumsum(length[order]) - length[order]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return flat[np.repeat(begin, length) + spread(length)], length

    def look(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in young.flat the ids of each key, sorted and different, start, and how many they are."""
        if self.young.size > REMEMBERED:
            self.young, self.old = Lexicon(), self.young
        begin, length = self.young.find(keys)
        new = np.flatnonzero(begin < 0)
        if len(new):
            there, n = self.old.find(keys[new])
            kept, gone = there >= 0, np.flatnonzero(there < 0)
            if kept.any():
                at, many = there[kept], n[kept]
                begin[new[kept]] = self.young.add(keys[new[kept]], self.old.flat[np.repeat(at, many) + spread(many)], many)
                length[new[kept]] = many
            if len(gone):
                gone = new[gone]
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[gone].tolist(), ends[gone].tolist(), strict=True)]
                ids, length[gone] = self.encoded(texts, plain[gone])
                begin[gone] = self.young.add(keys[gone], ids, length[gone])
        return begin, length

    def documents(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each closed by id 0, and each row's first (len + 1)."""
        starts, ends, plain, first = self.units(buf, off)
        prints = names(buf, starts, ends)
        keys, one, unit = np.unique(prints, return_index=True, return_inverse=True)
        begin, length = self.look(keys, buf.tobytes(), starts[one], ends[one], plain[one])
        unit = np.insert(unit, first[1:], len(keys))
        begin, length = np.append(begin, 0)[unit], np.append(length, 1)[unit]
        ids = self.young.flat[np.repeat(begin, length) + spread(length)]
        total = np.concatenate([[0], np.cumsum(length)])
        return ids, total[first + np.arange(len(first))]


def token_pieces(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32 of each document's pieces of limit tokens at most.

    A document is its text's ids, without special tokens, then id 0; a null text is
    empty.  tokenizer: path of a file of the tokenizers library, on every executor.
    """
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.get(tokenizer) or _known.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in pieces(off):
                ids, first = known.documents(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                size = np.diff(first)
                count = -(-size // limit)
                row, piece = np.repeat(np.arange(hi - lo), count), spread(count)
                start = piece * limit
                length = np.minimum(size[row] - start, limit)
                raw, at = memoryview(ids.astype("<u4").tobytes()), (first[row] + start).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + lo)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["_key", "piece", "start", "length", "ids_crc32"])

    schema = StructType([rows.schema["_key"], StructField("piece", IntegerType()), *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32")]])
    return rows.mapInArrow(run, schema)


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, each, first sequence, offset).

    Piece r of the length goes to sequence first + (r - first rank) // each, at offset +
    length * ((r - first rank) % each).  Sequences with equal room are kept as
    ranges, so the work and the plan depend on the number of lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {limit: []}
    rows, opened = [], 0

    def put(length: int, rank: int, first: int, bins: int, each: int, left: int) -> None:
        rows.append((length, rank, bins * each, each, first, limit - left))
        room.setdefault(left - length * each, []).append((first, bins))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            left = min((r for r, ranges in room.items() if r >= length and ranges), default=limit)
            if room[left]:
                first, bins = room[left].pop()
            else:
                first, bins = opened, -(-todo // (limit // length))
                opened += bins
            each = left // length
            full = min(bins, todo // each)
            if full:
                put(length, rank, first, full, each, left)
                todo, rank = todo - full * each, rank + full * each
            if full < bins and todo:
                put(length, rank, first + full, 1, todo, left)
                rank, todo, full = rank + todo, 0, full + 1
            if full < bins:
                room[left].append((first + full, bins - full))
    return rows


def pack(found: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (see token_pieces): as few sequences of limit tokens as best-fit needs.

    Only the counts of at most limit lengths reach the driver, and a plan whose
    size depends on the lengths alone is broadcast.  Pieces are ranked within their
    length, in cells so that one length may hold most pieces, and join the
    plan's slots on the rank.
    """
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, limit), "length long, _first long, _ranks long, _each long, _sequence long, _offset long")
    order = [F.xxhash64(key, "piece"), F.col(key), F.col("piece"), F.col("ids_crc32")]
    salt = F.pmod(F.xxhash64(key, "piece"), F.lit(CELLS)).cast("int")
    rows = ranked(found, ["length"], order, salt, CELLS, "_rank")
    at = F.col("_rank") - F.col("_first")
    joined = rows.join(F.broadcast(slots), "length").filter((at >= 0) & (at < F.col("_ranks")))
    return joined.select(
        *found.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.col("length") * (at % F.col("_each"))).cast("long").alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents in sequences of at most limit tokens.

    Returns key, piece, start, length, ids_crc32, sequence_id and offset.  A null or empty
    text is one piece of one token (id 0); repeated rows are packed one by one; a null key is
    a key like any other; an empty table gives no rows; other columns are not read.
    """
    found = saved(token_pieces(docs, tokenizer, limit, key, text), "pieces")
    return pack(found, limit, "_key").withColumnRenamed("_key", key)
