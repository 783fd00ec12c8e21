"""Ranked lexical search: an inverted index in segments, and MaxScore whose bounds join the maxima of term pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm._frames import saved
from rollcall.llm._text import LOWER, PLAIN, find_words, names, pieces, spread, text_buffer, trimmed

#: Bytes of text in a segment (one longer text is a segment of its own), and terms of all items of one block.
SEGMENT_BYTES, BLOCK_TERMS = 4 << 20, 200_000
#: A block's terms go to every task up to so many bytes; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: One segment in so many is searched first, for the scores that all others have to reach.
SEED_EVERY = 16
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """All terms of a text: runs of letters and digits, only A-Z lower-cased."""
    low = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _postings(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, each one's first posting (len + 1), postings as (row, occurrences), and each row's number of terms."""
    low = LOWER[buf]
    start, end, first = find_words(low, off, PLAIN)
    name, row = names(low, start, end), np.repeat(np.arange(len(off) - 1), np.diff(first))
    order = np.argsort(name, kind="stable")
    name, row = name[order], row[order]
    term = np.ones(len(name), bool)
    term[1:] = name[1:] != name[:-1]
    fresh = term.copy()
    fresh[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(fresh)
    postings = np.stack([row[at], np.diff(np.append(at, len(row)))], 1).astype(np.int32)
    own = order[np.flatnonzero(term)]
    length = end[own] - start[own]
    data = low[np.repeat(start[own], length) + spread(length)]
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(own), pa.py_buffer(bounds), pa.py_buffer(data))
    return words, np.append(np.searchsorted(at, np.flatnonzero(term)), len(at)), postings, np.diff(first)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The inverted index of docs, saved: a row for each segment and term, and one without a term for each segment.

    A segment is a run of neighbouring documents, cut where they are read, so no text is shuffled and none of its
    lists is longer than the segment.  A term's row has df and postings (pairs of 32-bit integers: a document's
    place in the segment and the term's occurrences there); a segment's own row has its documents' keys, their
    numbers of terms (64-bit integers, as postings), df (documents that have a term) and n_terms (all its terms).
    """
    kind = docs.schema[key].dataType.simpleString()

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in pieces(off, segment_bytes):
                words, first, postings, n = _postings(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                data = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(postings)])
                keys = batch.column(0).slice(lo, hi - lo)
                nothing = pa.array([None] * len(words), pa.list_(keys.type))
                own = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words) + 1, segment)), pa.concat_arrays([words, pa.nulls(1, pa.string())]),
                     pa.array(np.append(np.diff(first), np.count_nonzero(n))), pa.concat_arrays([data, pa.array([n.astype(np.int64).tobytes()], pa.binary())]),
                     pa.concat_arrays([nothing, own]), pa.array(np.append(np.zeros(len(words), np.int64), n.sum()))],
                    names=["segment", "term", "df", "postings", "keys", "n_terms"])
                segment += 1

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return saved(rows.mapInArrow(cut, f"segment long, term string, df long, postings binary, keys array<{kind}>, n_terms long"), "index")


class Segment:
    """One segment's lists for the terms of a block of items, with the impacts and the pair lists that bound their sums."""

    def __init__(self, keys: pa.Array, lists: dict[int, tuple[np.ndarray, np.ndarray]], pairs: dict[tuple[int, int], tuple[int, np.ndarray]]):
        self.keys, self.lists, self.pairs = keys, lists, pairs
        self.most = {t: int(impact.max()) for t, (_, impact) in lists.items()}
        self._score, self._seen = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        self._order: np.ndarray | None = None

    @property
    def order(self) -> np.ndarray:
        """Each document's place among the sorted keys, nulls last."""
        if self._order is None:
            self._order = np.empty(len(self.keys), np.int64)
            self._order[pc.array_sort_indices(self.keys, null_placement="at_end").to_numpy()] = np.arange(len(self.keys))
        return self._order

    def bounds(self, terms: list[int]) -> list[int]:
        """What the first 0, 1, ... terms add at most to any document's score.

        Each term is bounded by its own maximum or, with its neighbour, by the larger of their joint maximum over the
        documents that hold both and of either maximum alone; the best of all such splits.
        """
        out = [0]
        for i, t in enumerate(terms):
            least = out[i] + self.most[t]
            if i and (pair := self.pairs.get((terms[i - 1], t))) is not None:
                least = min(least, out[i - 1] + max(pair[0], self.most[terms[i - 1]], self.most[t]))
            out.append(max(least, out[i]))
        return out

    def best(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents with a score of least or more, which is at least 1; terms by ascending weight."""
        terms = [t for t in terms if t in self.lists]
        bound = self.bounds(terms)
        rest = int(np.searchsorted(np.array(bound), least, "left")) - 1  # the first terms that alone can't reach least
        if rest == len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score, seen = self._score, self._seen
        score[:], seen[:] = 0, False
        for t in terms[rest:]:
            at, impact = self.lists[t]
            score[at] += impact
            seen[at] = True
        some = np.flatnonzero(seen)
        for i in range(rest, 0, -1):
            some = some[score[some] + bound[i] >= least]
            if i > 1 and (pair := self.pairs.get((terms[i - 2], terms[i - 1]))) is not None and len(some):
                both = np.isin(some, pair[1], assume_unique=True)  # the others hold one of the two at most
                alone = max(self.most[terms[i - 2]], self.most[terms[i - 1]])
                some = some[score[some] + bound[i - 2] + np.where(both, max(pair[0], alone), alone) >= least]
            at, impact = self.lists[terms[i - 1]]
            score[at] += impact
        some = some[score[some] >= least]
        some = some[np.lexsort((self.order[some], -score[some]))[:k]]
        return some, score[some]


def _impacts(postings: bytes, length: np.ndarray, n_docs: int, n_terms: int, weight: int, k1_tenths: int, b_percent: int) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.frombuffer(postings, np.int32).astype(np.int64).reshape(-1, 2).T
    m = 100 - b_percent + (b_percent * length[at] * n_docs) // n_terms
    return at, weight * ((1_000_000_000 * tf) // (1000 * tf + k1_tenths * m))


def _joined(lists: dict[int, tuple[np.ndarray, np.ndarray]], pairs: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """For each pair of terms that some documents hold both: the highest sum of their impacts, and these documents' places."""
    for a, b in pairs:
        if a in lists and b in lists:
            both, x, y = np.intersect1d(lists[a][0], lists[b][0], assume_unique=True, return_indices=True)
            yield a, b, int((lists[a][1][x] + lists[b][1][y]).max()) if len(both) else 0, both


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    k1_tenths: int = 8, b_percent: int = 90, segment_bytes: int = SEGMENT_BYTES, block_terms: int = BLOCK_TERMS, seed_every: int = SEED_EVERY,
) -> DataFrame:
    """The k documents of docs with the highest scores above 0 for each item.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact in a document the weight times
    (10^9 tf) div (1000 tf + k1_tenths m), m = 100 - b_percent + (b_percent n N) div L, with N documents that have terms,
    L terms in all, n in the document; an item's score for a document sums its distinct terms' impacts.

    1. ``build_index`` writes lists for all terms.
    2. Items (equal sets of terms once) are searched in blocks of bounded size.  A block's terms get df and weight from the
       index, and each segment its lists for them with pair lists: for terms that stand side by side when an item's terms
       are ordered by weight, the documents that hold both and their highest joint impact.
    3. Within a segment, terms are split by MaxScore: the first, lightest ones, whose bound falls short of the k-th best score so far, are looked
       up only for documents that others have brought up and that can still reach it.  The bound is the best combination of maxima of
       single terms and of pairs.
    4. One segment in ``seed_every`` goes first; the k-th best score of each item there is where the others start, and every
       task raises it with what it finds.  This changes how much is skipped, never the result.

    Returns item_key, rank (from 1), key and score, a row for each pair.  A null or empty text, document or item, has no terms; equal
    scores are ranked by ascending key, null last; repeated documents are ranked one after the other, repeated items each get
    their rows; a null item key stays; an empty table gives no rows; a very long text is a segment of its own; other columns are not read.
    """
    index = build_index(docs, key, text, segment_bytes)
    n_docs, n_terms = index.filter("term is null").agg(F.sum("df"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    asked = items.select(F.col(item_key).alias("_item"), F.array_sort(F.array_distinct(terms_of(F.col(item_text)))).alias("_terms")).filter(F.size("_terms") > 0)
    asked = saved(asked.withColumn("_set", F.sha2(F.concat_ws(" ", "_terms"), 256)), "items")
    sets = asked.dropDuplicates(["_set"]).select("_set", "_terms")
    blocks = max(1, -(-(sets.agg(F.sum(F.size("_terms"))).first()[0] or 0) // block_terms))
    found = []
    for b in range(blocks):
        block = saved(sets.filter(F.pmod(F.xxhash64("_set"), F.lit(blocks)) == b), "block")
        found.append(_searched(index, block, n_docs, n_terms, k, k1_tenths, b_percent, seed_every))
    out = asked.select("_item", "_set").join(reduce(DataFrame.unionAll, found), "_set")
    return out.select(F.col("_item").alias(item_key), "rank", F.col("_key").alias(key), "score")


def _searched(index: DataFrame, block: DataFrame, n_docs: int, n_terms: int, k: int, k1_tenths: int, b_percent: int, seed_every: int) -> DataFrame:
    spark = index.sparkSession
    lists = index.filter("term is not null")
    terms = saved(block.select(F.explode("_terms").alias("term")).distinct(), "terms")
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    df = lists.join(small(terms), "term").groupBy("term").agg(F.sum("df").alias("_df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("_df") + 1)))
    # At most as many terms as a block has.
    known = sorted((r.weight, r.term) for r in df.select("term", weight.cast("long").alias("weight")).filter("weight > 0").collect())
    number = {t: i for i, (_, t) in enumerate(known)}
    weights = [w for w, _ in known]
    queries = [(r["_set"], sorted(number[t] for t in r["_terms"] if t in number)) for r in block.toLocalIterator()]
    pairs = {p for _, q in queries for p in zip(q[:-1], q[1:], strict=True)}
    numbered = spark.createDataFrame([(t, i) for t, i in number.items()], "term string, _number int")
    shared = spark.sparkContext.broadcast((weights, pairs, [q for _, q in queries]))
    kind = index.schema["keys"].dataType.simpleString()

    def segment(group: pa.Table) -> pa.Table:
        """A segment's lists for the block's terms, side by side, and its pair lists."""
        of, own_pairs, _ = shared.value
        own = group.filter(pc.is_null(group["_number"]))
        length = np.frombuffer(own["postings"][0].as_py(), np.int64)
        group = group.filter(pc.is_valid(group["_number"])).sort_by("_number")
        some = {i: _impacts(p, length, n_docs, n_terms, of[i], k1_tenths, b_percent) for i, p in zip(group["_number"].to_pylist(), group["postings"].to_pylist(), strict=True)}
        joined = list(_joined(some, own_pairs))
        ints = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind).tobytes()
        return pa.table({
            "segment": own["segment"].slice(0, 1), "keys": own["keys"].slice(0, 1),
            "terms": [np.array([(i, len(a)) for i, (a, _) in some.items()], np.int64).tobytes()],
            "places": [ints([a for a, _ in some.values()], np.int32)], "impacts": [ints([x for _, x in some.values()], np.int64)],
            "pairs": [np.array([(a, b, most, len(at)) for a, b, most, at in joined], np.int64).tobytes()],
            "pair_places": [ints([at for *_, at in joined], np.int32)]})

    rows = lists.join(small(numbered), "term").select("segment", "_number", "postings", F.lit(None).cast(kind).alias("keys")).unionAll(
        index.filter("term is null").select("segment", F.lit(None).cast("int"), "postings", "keys"))
    segments = saved(rows.groupBy("segment").applyInArrow(segment, f"segment long, keys {kind}, terms binary, places binary, impacts binary, pairs binary, pair_places binary"), "segments")
    seeds = segments.filter(F.pmod(F.xxhash64("segment"), F.lit(seed_every)) == 0)
    first = _best(_scan(seeds, shared, [1] * len(queries), k), k).filter(F.col("rank") == k).select("_query", "score").collect()
    least = [1] * len(queries)
    for r in first:
        least[r["_query"]] = r["score"]
    named = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(queries)], "_query int, _set string")
    return _best(_scan(segments, shared, least, k), k).join(named, "_query").select("_set", "rank", "_key", "score")


def _scan(segments: DataFrame, shared, least: list[int], k: int) -> DataFrame:
    """For each query, the k best documents of each task among those that reach least."""
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value[2]
        floor = list(least)
        top = [np.zeros(0, np.int64) for _ in queries]  # scores of the k best of this task
        for batch in batches:
            for r in range(batch.num_rows):
                own = {n: batch.column(n)[r].as_py() for n in ("terms", "places", "impacts", "pairs", "pair_places")}
                terms, pairs = np.frombuffer(own["terms"], np.int64).reshape(-1, 2), np.frombuffer(own["pairs"], np.int64).reshape(-1, 4)
                cut = np.cumsum(terms[:, 1])[:-1]
                places, impacts = np.split(np.frombuffer(own["places"], np.int32), cut), np.split(np.frombuffer(own["impacts"], np.int64), cut)
                joint = np.split(np.frombuffer(own["pair_places"], np.int32), np.cumsum(pairs[:, 3])[:-1])
                here = Segment(
                    batch.column("keys")[r].values, {int(t): (places[i], impacts[i]) for i, (t, _) in enumerate(terms)},
                    {(int(a), int(b)): (int(most), joint[i]) for i, (a, b, most, _) in enumerate(pairs)})
                query, place, score = [], [], []
                for q, wanted in enumerate(queries):
                    at, points = here.best(wanted, k, floor[q])
                    if len(at):
                        query.append(np.full(len(at), q))
                        place.append(at)
                        score.append(points)
                        top[q] = -np.sort(-np.concatenate([top[q], points]))[:k]
                        if len(top[q]) == k:
                            floor[q] = max(floor[q], int(top[q][-1]))
                if query:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(query).astype(np.int32)), here.keys.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(score))], names=["_query", "_key", "score"])

    return segments.drop("segment").mapInArrow(scan, f"_query int, _key {kind}, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("_key").asc_nulls_last()))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)
