"""Quality rules on repetition, by a suffix array over each text's words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm._text import (
    SYMBOLS, U, find_words, mix, names, pieces, rows_of, text_buffer, trimmed, union_length,
)

#: A repeat counts from this many words; the share of word characters that repeats may cover;
#: the longest repeat in words, and the share of the text's words it must also exceed.
REPEAT_WORDS, MAX_COVERED, MAX_REPEAT, MAX_REPEAT_SHARE = 5, 0.30, 50, 0.20
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_repeats long, "
    "covered_chars long, longest_repeat long, base_failed boolean, kept boolean"
)


def repeat_lengths(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix, in words, that the suffix there shares with another suffix of its row.

    A suffix array by prefix doubling over all rows at once: ranks of the first
    1, 2, 4, ... words, sorting again only suffixes that are still tied.  A
    row's words and its end are symbols of its own, so no match leaves it.
    The shared prefix of neighbours is read off the ranks of each doubling.
    """
    n, out = len(words), np.zeros(len(words), np.int64)
    if not n:
        return out
    row = rows_of(first)
    symbol = mix(words ^ mix((row + 1).astype(U)))
    order = np.argsort(symbol)
    ranked = symbol[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = ranked[1:] != ranked[:-1]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(2 * n, np.int64)
    rank[n:] = -1 - np.arange(n)  # ends
    rank[order] = group
    tied = np.append(fresh[1:], True) & fresh
    at = order[~tied]
    if not len(at):
        return out
    stop = first[1:][row]
    ever, levels, h = at, [rank[:n].copy()], 1
    while len(at):
        ahead = at + h
        second = np.where(ahead < stop[at], rank[np.minimum(ahead, n - 1)], rank[n + at])
        o = np.lexsort((second, rank[at]))
        at, second = at[o], second[o]
        old = rank[at]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        of_old = np.empty(len(at), bool)
        of_old[0] = True
        of_old[1:] = old[1:] != old[:-1]
        here = np.arange(len(at))
        rank[at] = old + np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(of_old, here, 0))
        levels.append(rank[:n].copy())
        at = at[~(np.append(new[1:], True) & new)]
        h *= 2
    ever = ever[np.argsort(rank[ever])]
    a, b = ever[:-1].copy(), ever[1:].copy()
    shared = np.zeros(len(a), np.int64)
    left = np.minimum(stop[a] - a, stop[b] - b)
    for k in range(len(levels) - 1, -1, -1):
        same = left >= (1 << k)
        i = np.flatnonzero(same)
        same = i[levels[k][a[i]] == levels[k][b[i]]]
        shared[same] += 1 << k
        left[same] -= 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
    longest = np.zeros(len(ever), np.int64)
    longest[:-1] = shared
    longest[1:] = np.maximum(longest[1:], shared)
    out[ever] = longest
    return out


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each row's values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def most_per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.int64)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled] = np.maximum.reduceat(values, first[:-1][filled])
    return out


def repeated_lines(buf: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row, its lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(buf == 10)
    row = np.searchsorted(off, breaks, "right") - 1
    n = np.arange(len(off) - 1)
    order = np.lexsort((np.concatenate([breaks, off[1:]]), np.concatenate([row, n])))
    end = np.concatenate([breaks, off[1:]])[order]
    line_row = np.concatenate([row, n])[order]
    begin = np.empty_like(end)
    begin[1:] = end[:-1] + 1
    head = np.ones(len(end), bool)
    head[1:] = line_row[1:] != line_row[:-1]
    begin[head] = off[:-1][line_row[head]]
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, line_row = begin[filled], end[filled], line_row[filled]
    mark = mix(names(buf, begin, end) ^ mix((line_row + 7).astype(U)))
    _, one = np.unique(mark, return_index=True)
    k = len(off) - 1
    return np.bincount(line_row, minlength=k) - np.bincount(line_row[one], minlength=k)


def measure(buf: np.ndarray, off: np.ndarray, limits: tuple) -> dict[str, np.ndarray]:
    least, max_covered, max_repeat, max_share = limits
    starts, ends, first = find_words(buf, off)
    words = names(buf, starts, ends)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    size = chars[ends] - chars[starts]
    n_words = np.diff(first)
    longest = repeat_lengths(words, first)
    three = np.flatnonzero(longest >= 3)
    in_three = union_length(len(words), three, three + 3)
    row = rows_of(first)
    # Repeats that can't be extended to the left; their spans cover what all repeats cover.
    begins = np.flatnonzero(longest >= least)
    extends = (begins > 0) & (longest[begins - 1] == longest[begins] + 1) & (row[begins - 1] == row[begins]) if len(begins) else begins.astype(bool)
    begins = begins[~extends]
    covered = union_length(len(words), begins, begins + longest[begins])
    symbol = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    out = {
        "n_words": n_words,
        "word_chars": per_row(size, first),
        "n_symbols": symbol[off[1:]] - symbol[off[:-1]],
        "n_dup_lines": repeated_lines(buf, off, starts),
        "n_repeat_words": per_row(in_three, first),
        "n_repeats": np.bincount(row[begins], minlength=len(off) - 1),
        "covered_chars": per_row(np.where(covered, size, 0), first),
        "longest_repeat": most_per_row(longest, first),
    }
    failed = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    bad = (out["covered_chars"] > max_covered * out["word_chars"]) | (
        (out["longest_repeat"] > max_repeat) & (out["longest_repeat"] > max_share * n_words))
    return {k: v.astype(np.int64) for k, v in out.items()} | {"base_failed": failed, "kept": ~failed & ~bad}


def repetition_rules(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, repeat_words: int = REPEAT_WORDS,
    max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, max_repeat_share: float = MAX_REPEAT_SHARE,
) -> DataFrame:
    """Measures of each row's whole text, and whether it is kept.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Longest-common-prefix intervals of a suffix
    array over the words give the maximal repeated runs of repeat_words words or
    more; the union of their spans (first occurrence included) may cover at most
    max_covered of the word characters, and the longest repeat may not exceed
    both max_repeat words and max_repeat_share of the words.  base_failed: fewer
    than 50 words, or over half of the words lie in three-word windows that
    occur twice.

    Returns the columns in keep (default: all but text) and MEASURES; a kept column with
    the name of a measure is replaced.  A null or empty text has no words and
    fails; rows that repeat are measured one by one; an empty table gives no rows.
    """
    from pyspark.sql.types import StructType

    measures = StructType.fromDDL(MEASURES)
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in measures.names]
    limits = (repeat_words, max_covered, max_repeat, max_repeat_share)
    rows = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(kept)], docs[text].cast("string").alias("_text"))
    at = len(kept)
    if text in kept and dict(docs.dtypes)[text] == "string":  # sent once
        at, rows = kept.index(text), rows.drop("_text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(at))
            for lo, hi in pieces(off, 1 << 19):
                found = measure(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], limits)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), *(pa.array(found[c]) for c in measures.names)],
                    names=[*(f"_{i}" for i in range(len(kept))), *measures.names])

    out = rows.mapInArrow(run, StructType([*rows.schema.fields[: len(kept)], *measures.fields]))
    return out.select(*[out[f"_{i}"].alias(c) for i, c in enumerate(kept)], *measures.names)
