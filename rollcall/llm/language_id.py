"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm._text import pieces, rows_of, text_buffer, trimmed

#: Dimensions of the vectors; letters in an n-gram; cells of a count matrix, and vectors of n-grams, at once.
DIMENSIONS, LETTERS, CELLS, VECTORS = 1024, 3, 1 << 21, 1 << 13


@lru_cache(1)
def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            out[c] = ord(y) if len(y) == 1 else c
    return out


@lru_cache(16_384)
def _signs(letter: int, dimensions: int) -> np.ndarray:
    return (np.random.default_rng([7919, letter]).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)


def letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """The letter's random vector of +1 and -1; 0 stands for what lies between words."""
    return _signs(letter, dimensions).astype(np.float32)


class GramVectors:
    """The vectors of the n-grams of a piece of text, made in blocks: their memory doesn't grow with the number of n-grams."""

    def __init__(self, alphabet: np.ndarray, parts: list[np.ndarray], dimensions: int):
        letters = np.stack([_signs(int(c), dimensions) for c in alphabet]) if len(alphabet) else np.zeros((0, dimensions), np.int8)
        self.parts, self.dimensions = parts, dimensions
        self.letters = [np.roll(letters, len(parts) - 1 - d, axis=1) for d in range(len(parts))]

    def __len__(self) -> int:
        return len(self.parts[0])

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """From, to and the vectors between."""
        for lo in range(0, len(self), VECTORS):
            hi = min(len(self), lo + VECTORS)
            out = np.ones((hi - lo, self.dimensions), np.int8)
            for letters, part in zip(self.letters, self.parts, strict=True):
                out *= letters[part[lo:hi]]
            yield lo, hi, out.astype(np.float32)


def letters_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of each row, with one 0 for each run of other characters, and each row's first (len + 1)."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    first = lead[off]
    x = _folding()[points]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    keep[first[:-1][np.diff(first) > 0]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def framed(x: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row with n - 1 separators on either side, so that the shortest text has an n-gram too."""
    pad, rows = n - 1, np.arange(len(first))
    y = np.zeros(len(x) + 2 * pad * (len(first) - 1), x.dtype)
    y[np.arange(len(x)) + 2 * pad * rows_of(first) + pad] = x
    return y, first + 2 * pad * rows


def grams(x: np.ndarray, first: np.ndarray, n: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, GramVectors]:
    """The row and the number of each n-gram, and the vectors by number: the bound, permuted vectors of its letters."""
    row = rows_of(first)
    at = np.flatnonzero(np.arange(len(x)) + n <= first[1:][row]) if len(x) else np.zeros(0, np.int64)
    alphabet, small = np.unique(x, return_inverse=True)
    size = len(alphabet)
    if size**n <= 1 << 22:
        code = np.zeros(len(at), np.int64)
        for d in range(n):
            code = code * size + small[at + d]
        there = np.bincount(code, minlength=size**n) > 0
        number = (np.cumsum(there) - 1)[code]
        kinds = np.flatnonzero(there)
        parts = [(kinds // size ** (n - 1 - d)) % size for d in range(n)]
    else:
        kinds, number = np.unique(np.stack([small[at + d] for d in range(n)], 1), axis=0, return_inverse=True)
        number = number.reshape(-1)
        parts = [kinds[:, d] for d in range(n)]
    return row[at], number, GramVectors(alphabet, parts, dimensions)


def bundles(row: np.ndarray, number: np.ndarray, vectors: GramVectors, rows: int) -> np.ndarray:
    """The sum of each row's n-gram vectors."""
    out = np.zeros((rows, vectors.dimensions), np.float32)
    for first, last, block in vectors.blocks():
        here = slice(None) if last - first == len(vectors) else (number >= first) & (number < last)
        of, kind, kinds = row[here], number[here] - first, last - first
        step = max(1, CELLS // kinds)
        edges = np.searchsorted(of, np.arange(0, rows + step, step))
        for k, lo in enumerate(range(0, rows, step)):
            hi, part = min(rows, lo + step), slice(edges[k], edges[k + 1])
            if part.start < part.stop:
                cells = np.bincount((of[part] - lo) * kinds + kind[part], minlength=(hi - lo) * kinds)
                out[lo:hi] += cells.reshape(hi - lo, kinds).astype(np.float32) @ block
    return out


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, letters: int = LETTERS) -> dict[str, np.ndarray]:
    """Each language's vector: the sum of the n-gram vectors of all its documents.

    Tasks sum up their own documents; the sums meet by language and dimension.
    What reaches the driver is dimensions numbers for each language.  Rows
    whose text or language is null add nothing.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            buf, off = text_buffer(batch.column(1))
            for lo, hi in pieces(off):
                x, first = framed(*letters_of(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), letters)
                row, number, vectors = grams(x, first, letters, dimensions)
                of = code[lo:hi][row]
                counts = {k: np.bincount(number[of == k], minlength=len(vectors)).astype(np.float64) for k in np.unique(of)}
                for first_gram, last_gram, block in vectors.blocks():
                    for k, n in counts.items():
                        sums[names[k]] = sums.get(names[k], np.zeros(dimensions)) + n[first_gram:last_gram] @ block
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("d", "x"))
    total = parts.groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in total:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["d"]] = r["x"]
    return dict(sorted(out.items()))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], keys: list[str | Column], text: str = "text",
    dimensions: int = DIMENSIONS, letters: int = LETTERS,
) -> DataFrame:
    """The language whose profile has the largest cosine with the whole text's vector.

    Returns keys, lang_pred and score (the cosine, at least 0).  und with score 0: the text
    is null, empty or has no letter, or no language is known.  A tie goes to the
    first language in alphabetical order; repeated rows are judged one by one; an
    empty table gives no rows; other columns are not read.
    """
    own = docs.select(*keys)
    names = own.columns
    rows = docs.select(*[F.col(k).alias(f"_{i}") if isinstance(k, str) else k.alias(f"_{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("_text"))
    model = docs.sparkSession.sparkContext.broadcast(
        (list(profiles), np.array([v / max(np.linalg.norm(v), 1e-300) for v in profiles.values()], np.float32).reshape(len(profiles), dimensions)))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for batch in batches:
            buf, off = text_buffer(batch.column(len(names)))
            for lo, hi in pieces(off):
                x, first = letters_of(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                has = np.add.reduceat(np.append(x != 0, False), first[:-1]) * (np.diff(first) > 0) > 0
                sums = bundles(*grams(*framed(x, first, letters), letters, dimensions), hi - lo)
                near = (sums @ matrix.T) / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
                best = near.argmax(1) if langs else np.zeros(hi - lo, int)
                score = np.clip(near.max(1), 0, 1) if langs else np.zeros(hi - lo)
                has &= bool(langs)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(len(names))),
                     pa.array([langs[b] if h else "und" for b, h in zip(best, has, strict=True)], pa.string()),
                     pa.array(np.where(has, score, 0).astype(np.float64))],
                    names=[*(f"_{i}" for i in range(len(names))), "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*[out[f"_{i}"].alias(c) for i, c in enumerate(names)], "lang_pred", "score")
