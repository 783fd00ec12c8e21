"""Records that are nearly the same, compared as sets of words."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cached_property, reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from rollcall.functions.text import distinct_tokens, norm_dedupe, norm_layout, tokens
from rollcall.sources.parts import by_document, kept_by_document, shared_path

#: Share of the smaller set that must be common, and the smallest set that counts at all.
SHARE, LEAST = 0.9, 8


def same(a: Column, b: Column) -> Column:
    """Whether two arrays of distinct words are nearly the same."""
    smaller = F.least(F.size(a), F.size(b))
    return (smaller >= LEAST) & (F.size(F.array_intersect(a, b)) >= SHARE * smaller)


def fuzzy_pairs(left: DataFrame, right: DataFrame, key: str, content: str, share: float = SHARE, least: int = LEAST, within: str | None = None) -> DataFrame:
    """Pairs (key_a, key_b) of a row of left and a row of right whose words are nearly the same, with the common share.

    within: a column that both rows must share, as their document.

    If the smaller set has m words, at most d = m - ceil(share * m) of them are missing from the other; so among any d + 1 of
    them one is common, and of bits that words set, at most d are missing from the other's.  Each side in turn gives its
    rarest words as blocking keys, which meet the other side's words; the bits of both sets lie beside the word, so pairs that
    can't be are dropped where they meet, before any shuffle.  The others are compared in full.  No pair is lost and no block is capped.

    Sets are stored once, equal ones as one; pairs are spread over their members at the end.  The right ones are stored without
    the words that no left one has, so give the side with fewer words as left.
    """
    a, b, found = _alike(left, right, key, content, share, least, within)
    return found.join(a.members("key_a", "one"), "one").join(b.members("key_b", "other"), "other").select("key_a", "key_b", "share")


def fuzzy_counts(left: DataFrame, right: DataFrame, key: str, content: str, share: float = SHARE, least: int = LEAST, within: str | None = None) -> DataFrame:
    """How many pairs of fuzzy_pairs (documents) each key_a of them has.

    A set knows how many rows have it, so copies are counted and not made into pairs.
    """
    a, _, found = _alike(left, right, key, content, share, least, within)
    counts = found.groupBy("one").agg(F.sum("copies").alias("documents"))
    return a.members("key_a", "one").join(counts, "one").groupBy("key_a").agg(F.sum("documents").alias("documents"))


def _alike(left: DataFrame, right: DataFrame, key: str, content: str, share: float, least: int, within: str | None) -> tuple[_Sets, _Sets, DataFrame]:
    """The sets of left and right, and which of them (one, other) are nearly the same."""
    a = _Sets(left, key, content, least, within)
    b = _Sets(right, key, content, least, within, a, share)
    return a, b, _confirmed(_meeting(*_blocked(a, b, share)).unionAll(_turned(_meeting(*_blocked(b, a, share)))).distinct(), a, b, share)


#: Bits of a hash that say whether a word is known (a bitmap of 2 MB), and how many frequent words are told by their counts at most.
KNOWN, FREQUENT = 24, 1 << 19
_SIGNS = ("s0", "s1", "s2", "s3")


class _Sets:
    """The sets of words of a table: rows (key, id) and, once for each id, its size, its words as sorted 64-bit hashes and how many rows have it, both stored.

    met: the other side's sets.  Words that none of them has are counted in the size and left out of the hashes, and sets with too few of
    the others to nearly equal any go at once.  A text is read for its words once: nothing of them is filtered before they are here.
    """

    def __init__(self, df: DataFrame, key: str, content: str, least: int, within: str | None, met: _Sets | None = None, share: float = SHARE):
        df = df if within is None else df.filter(F.col(within).isNotNull())
        # The document is part of a word: sets of different documents are never one.
        hashed = lambda w: F.xxhash64(F.col(within), w) if within else F.xxhash64(w)
        # Repeats are dropped as numbers, which is cheaper than as words.
        words = F.array_distinct(F.array_remove(F.transform(tokens(content), hashed), hashed(F.lit(""))))
        least = max(least, 1)
        fewest = 1 if met is None else max(int(np.ceil(share * least)), 1)
        known = None if met is None else met.known

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes, first = _flat(batch.column(1))
                there = np.ones(len(hashes), bool) if known is None else _is_known(known.value, hashes)
                size, held = np.diff(first), _counts(there, first)
                keep = np.flatnonzero((size >= least) & (held >= fewest))
                ids = [hashlib.blake2b(hashes[first[i] : first[i + 1]], digest_size=16).digest() for i in keep]
                alive = np.zeros(len(size), bool)
                alive[keep] = True
                lists = pa.ListArray.from_arrays(pa.array(_offsets(held[keep]), pa.int32()), pa.array(hashes[there & np.repeat(alive, size)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(ids, pa.binary()), pa.array(size[keep]), lists], names=["key", "id", "size", "hashes"])

        kind = df.select(F.col(key).alias("key")).schema["key"]
        schema = StructType([kind, StructField("id", BinaryType()), StructField("size", LongType()), StructField("hashes", ArrayType(LongType(), False))])
        hashes = F.coalesce(F.sort_array(words), F.array().cast("array<bigint>"))
        self.rows = _stored(df.select(F.col(key).alias("key"), hashes.alias("hashes")).mapInArrow(named, schema), "fuzzy-rows")
        self.sets = by_document(self.rows.groupBy("id").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes"), F.count(F.lit(1)).alias("copies")), "fuzzy_sets", "id")

    @cached_property
    def listed(self) -> DataFrame:
        """The sets in tasks of like size: a task a bucket, which Python in a plan keeps, is dear for a small table."""
        files = self.sets.inputFiles()
        return self.sets.sparkSession.read.schema(self.sets.schema).parquet(os.path.dirname(unquote(files[0]))) if files else self.sets

    @cached_property
    def words(self) -> DataFrame:
        """Each word of the sets (word, n) with how many hold it."""
        return _stored(self.sets.select(F.explode("hashes").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "fuzzy-words")

    @cached_property
    def known(self) -> Broadcast[np.ndarray]:
        return self.sets.sparkSession.sparkContext.broadcast(_known(self.words))

    def members(self, key: str, name: str) -> DataFrame:
        return self.rows.select(F.col("key").alias(key), F.col("id").alias(name))


def _stored(df: DataFrame, what: str) -> DataFrame:
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _known(words: DataFrame) -> np.ndarray:
    """The hashes in words as a bitmap, whose size does not depend on how many there are."""
    place = words.select((F.shiftrightunsigned("word", 64 - KNOWN) + 1).alias("place")).distinct()
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros((1 << KNOWN) // 8, np.uint8)
    for r in parts:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _is_known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes.view(np.uint64) >> np.uint64(64 - KNOWN)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _frequent(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of words (word, n), in order, and their counts; at most FREQUENT, as each makes up that share of all words."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = words.filter(F.col("n") >= max(2, -(-total // FREQUENT))).orderBy("word").toArrow()
    return rows["word"].to_numpy(), rows["n"].to_numpy()


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements, and where each row's start (len + 1)."""
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[off[0] : off[-1]], off - off[0]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _counts(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each row's elements are marked."""
    return np.diff(_offsets(marks)[first])


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches (id, hashes, size) in pieces of about so many words, or one larger set."""
    for batch in batches:
        first = batch.column(1).offsets.to_numpy()
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _signs(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """256 bits for each set, as four numbers; each word sets one."""
    bits = np.uint64(1) << ((hashes.view(np.uint64) >> np.uint64(2)) & np.uint64(63))
    return [np.bitwise_or.reduceat(np.where(hashes & 3 == k, bits, np.uint64(0)), first[:-1]).view(np.int64) for k in range(4)]


def _spread(ids: pa.Array, row: np.ndarray, words: np.ndarray, numbers: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words), ids.take(pa.array(row)), *[pa.array(x[row]) for x in numbers]], names=["word", *names])


def _blocked(small: _Sets, large: _Sets, share: float) -> tuple[DataFrame, DataFrame]:
    """Blocking words of the sets of small, as the smaller ones (word, one, m, d and bits), and the words of large that they may meet (word, other, n and bits).

    A set that lacks more than d of its words in all of large goes at once; one that lacks g of them needs d - g + 1 blocking words.  The
    bits are those of words that large has, of which at most d - g are missing from the other; d stands for that.
    """
    spark = small.sets.sparkSession
    known, often = large.known, spark.sparkContext.broadcast(_frequent(large.words))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = often.value
        for batch in _pieces(batches):
            hashes, first = _flat(batch.column(1))
            m = batch.column(2).to_numpy()
            there = _is_known(known.value, hashes)
            held = _counts(there, first)
            spare = held - np.ceil(share * m).astype(np.int64)  # d less the words that large lacks
            keep = np.flatnonzero((spare >= 0) & (held > 0))
            hashes, first = hashes[there & np.repeat((spare >= 0) & (held > 0), np.diff(first))], _offsets(held[keep])
            if not len(keep):
                continue
            row = np.repeat(np.arange(len(keep)), held[keep])
            n = np.zeros(len(hashes), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                n = np.where(frequent[at] == hashes, counts[at], 0)
            order = np.lexsort((hashes, n, row))
            chosen = order[np.arange(len(hashes)) - first[row] <= spare[keep][row]]  # row is in order already
            yield _spread(batch.column(0).take(pa.array(keep)), row[chosen], hashes[chosen], [m[keep], spare[keep], *_signs(hashes, first)], ["one", "m", "d", *_SIGNS])

    signs = ", ".join(f"{x} long" for x in _SIGNS)
    keys = _stored(small.listed.select("id", "hashes", "size").mapInArrow(choose, f"word long, one binary, m long, d long, {signs}"), "fuzzy-keys")
    wanted = spark.sparkContext.broadcast(_known(keys))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            hashes, first = _flat(batch.column(1))
            chosen = np.flatnonzero(_is_known(wanted.value, hashes))
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))[chosen]
            yield _spread(batch.column(0), row, hashes[chosen], [batch.column(2).to_numpy(), *_signs(hashes, first)], ["other", "n", *[f"t{x}" for x in _SIGNS]])

    held = ", ".join(f"t{x} long" for x in _SIGNS)
    return keys, large.listed.select("id", "hashes", "size").mapInArrow(give, f"word long, other binary, n long, {held}")


def _meeting(keys: DataFrame, words: DataFrame) -> DataFrame:
    """one and other, perhaps more than once, of sets that share a blocking word and whose sizes and bits allow it."""
    missing = reduce(Column.__add__, [F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(f"t{x}"))) for x in _SIGNS])
    return keys.join(words, "word").filter((F.col("m") <= F.col("n")) & (missing <= F.col("d"))).select("one", "other")


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("other").alias("one"), F.col("one").alias("other"))


def _confirmed(pairs: DataFrame, a: _Sets, b: _Sets, share: float) -> DataFrame:
    """The pairs (one, other) of a set of a and one of b whose words are nearly the same, with the common share and the copies of other."""
    x, y = (t.sets.select(F.col("id").alias(c), F.col("size").alias(f"n_{c}"), F.col("hashes").alias(f"w_{c}"), *more) for t, c, more in ((a, "one", []), (b, "other", ["copies"])))
    common, smaller = F.size(F.array_intersect("w_one", "w_other")), F.least("n_one", "n_other")
    found = pairs.join(x, "one").join(y, "other").withColumn("common", common).withColumn("smaller", smaller).filter(F.col("common") >= share * F.col("smaller"))
    return found.select("one", "other", (F.col("common") / F.col("smaller")).alias("share"), "copies")


def without_fuzzy_copies(df: DataFrame, of: DataFrame, key: str, content: str, when: Column | None = None, within: str | None = None) -> DataFrame:
    """df without rows (for which when holds) that nearly equal a row of the other table.

    One partner is enough: each set is compared with one candidate first, and only sets that this leaves are compared with
    all of theirs.  So a group of near copies costs one comparison a set and not one a pair.
    """
    b = _Sets(of, key, content, LEAST, within)
    a = _Sets(df if when is None else df.filter(when), key, content, LEAST, within, b)
    (keys, words), (others, own) = _blocked(a, b, SHARE), _blocked(b, a, SHARE)
    one = _meeting(keys, words).unionAll(_turned(_meeting(others, own))).groupBy("one").agg(F.max("other").alias("other"))
    gone = _stored(_confirmed(one, a, b, SHARE).select("one"), "fuzzy-gone")
    rest = lambda rows, c: rows.join(gone.select(F.col("one").alias(c)), c, "left_anti")
    more = _meeting(rest(keys, "one"), words).unionAll(_turned(_meeting(others, rest(own, "other")))).distinct()
    gone = gone.unionAll(_confirmed(more, a, b, SHARE).select("one"))
    keys_gone = a.members("_gone", "one").join(gone, "one", "left_semi").select("_gone").distinct()
    return df.join(keys_gone, df[key] == keys_gone["_gone"], "left_anti")


def guarded_append(held: Column, candidates: Column) -> Column:
    """held without repeats, with each candidate text appended that nearly equals none so far, earlier candidates included.

    The outcome depends on the order, so it is a fold inside the document's row; its cost is the product of both lengths.
    """
    # A one-element array binds what each step reads many times, so that a text's forms are made once.
    known = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("text"), norm_dedupe(x).alias("norm"), distinct_tokens(x).alias("words")))
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    unlike = lambda own: bound(F.transform(own, lambda x: x["norm"]), lambda norms: F.filter(own, lambda x, i: (x["norm"] != "") & (F.array_position(norms, x["norm"]) == i + 1)))
    folded = F.aggregate(
        known(candidates), bound(known(held), unlike),
        lambda acc, c: F.when(F.exists(acc, lambda x: same(x["words"], c["words"])), acc).otherwise(F.concat(acc, F.array(c))))
    return F.transform(folded, lambda x: x["text"])


def best_match(records: DataFrame, paragraphs: DataFrame, doc: str, record: str, paragraph: str, content: str, least: float = 0.72) -> DataFrame:
    """For each record the paragraph of its document that matches best, the first of equals.

    Scores: 1 for equal normal forms, 0.9 if one holds the other, else the common share of the larger set of words of
    three letters or more; under least there is no match.  Texts without a normal form, null texts and null documents match nothing.

    Normal forms are made once and stored by document with a number in place of the text.  A record whose form is a paragraph's too is settled there,
    unless an earlier paragraph has the same words in another order, which scores 1 as well.
    The others look for candidates, in one order of words, rare ones first: the shares need a common word among the first
    few of *both* sides, at places and set sizes that leave room for enough common ones; for containment, the held side's
    rarest inner word must be a word of the other.  Texts of one or two words, which have no inner word, are looked up by
    their rarest three letters among all runs of three letters.  Nothing is lost, and texts are compared for candidates only.
    """
    slack = 1e-9  # shares such as 18 of 25 must not fall short of 0.72 by rounding
    kinds = {c.name: c.dataType.simpleString() for c in (records.schema[record], paragraphs.schema[paragraph])}
    form = norm_layout(content).alias("_form")
    none = lambda c: F.lit(None).cast(kinds[c])
    both = records.select(doc, F.col(record).alias("_record"), none(paragraph).alias("_held"), form).unionAll(
        paragraphs.select(doc, none(record), F.col(paragraph), form)).filter(F.col(doc).isNotNull())
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)
    rows = both.withColumn("_id", F.dense_rank().over(Window.partitionBy(doc).orderBy("_form"))).withColumn("_held", F.min("_held").over(Window.partitionBy(doc, "_form")))
    rows = kept_by_document(rows, "forms", doc).filter("_form <> ''")
    asked = rows.filter("_record is not null")
    # A form is either a paragraph's (_held) or only a record's, which asks.
    forms = rows.groupBy(doc, "_id", "_form").agg(F.first("_held").alias("_held"))
    exact = asked.filter("_held is not null").join(_earlier_equals(forms.filter("_held is not null"), doc), [doc, "_id"], "left").select(
        doc, F.col("_record").alias(record), F.coalesce("_before", "_held").alias(paragraph), F.lit(1.0).alias("score"))
    pairs = _match_candidates(forms, doc, least, slack)
    a, b = _long_words(F.col("_r")), _long_words(F.col("_s"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))), F.lit(0.0))
    score = F.when(F.col("_s").contains(F.col("_r")) | F.col("_r").contains(F.col("_s")), 0.9).otherwise(share)
    asks, holds = forms.filter("_held is null").select(doc, "_id", F.col("_form").alias("_r")), forms.filter("_held is not null").select(doc, F.col("_id").alias("_other"), F.col("_form").alias("_s"), "_held")
    scored = pairs.join(asks, [doc, "_id"]).join(holds, [doc, "_other"]).withColumn("score", score).filter(F.col("score") >= least)
    best = scored.groupBy(doc, "_id").agg(F.max_by(F.struct("_held", "score"), F.struct("score", -F.col("_held"))).alias("_best"))
    near = asked.filter("_held is null").select(doc, "_record", "_id").join(best, [doc, "_id"])
    return exact.unionAll(near.select(doc, "_record", "_best._held", F.round("_best.score", 6)))


def _long_words(form: Column) -> Column:
    return F.filter(F.array_distinct(F.split(form, " ")), lambda w: F.length(w) > 2)


def _earlier_equals(held: DataFrame, doc: str) -> DataFrame:
    """doc, _id and _before: the first of the earlier forms with the same long words, of which neither holds the other."""
    each = held.withColumn("_set", F.array_sort(_long_words(F.col("_form")))).filter("size(_set) > 0")
    alike = each.groupBy(doc, "_set").agg(F.collect_list(F.struct("_held", "_id", "_form")).alias("_all")).filter("size(_all) > 1")
    rivals = alike.select(doc, F.explode("_all").alias("_x"), "_all").select(doc, "_x.*", F.filter(
        "_all", lambda y: (y["_held"] < F.col("_x._held")) & ~y["_form"].contains(F.col("_x._form")) & ~F.col("_x._form").contains(y["_form"])).alias("_rivals"))
    return rivals.filter("size(_rivals) > 0").select(doc, "_id", F.array_min(F.transform("_rivals", lambda y: y["_held"])).alias("_before"))


def _match_candidates(forms: DataFrame, doc: str, least: float, slack: float) -> DataFrame:
    """doc, _id of a form that asks and _other, one that is held, for all pairs that best_match may score; forms lie by document."""
    size, inside = F.length("_form"), Window.partitionBy(doc)
    words = F.split("_form", " ")
    short = F.size(words) <= 2
    gram = F.when(short, F.least(F.lit(3), size))
    here = forms.withColumn("_ask", F.col("_held").isNull())
    here = here.withColumn("_grams", F.collect_set(gram).over(inside)).withColumn("_any", F.bool_or("_ask").over(inside)).filter("_any")
    key = lambda kind, x, counts, may: F.struct(kind.cast("int").alias("kind"), x.alias("key"), counts.alias("counts"), may.alias("may"))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    own = F.transform(F.array_distinct(words), lambda w: key(F.lit(0), w, F.length(w) > 2, F.array_contains(inner, w)))
    runs = lambda q: F.array_distinct(F.transform(F.sequence(F.lit(1), size - q + 1), lambda i: F.substr(F.col("_form"), i, q)))
    grams = F.flatten(F.transform(F.filter("_grams", lambda q: q <= size), lambda q: F.transform(runs(q), lambda g: key(q, g, F.lit(False), F.coalesce(gram == q, F.lit(False))))))
    spread = here.select(doc, "_id", "_ask", F.size(_long_words(F.col("_form"))).alias("m"), F.explode(F.concat(own, grams)).alias("_x")).select(doc, "_id", "_ask", "m", "_x.*")
    spread = spread.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy(doc, "kind", "key")))
    of = Window.partitionBy(doc, "_id")
    chosen = F.struct("_df", "kind", "key")
    spread = spread.withColumn("k", F.row_number().over(of.orderBy(F.desc("counts"), "_df", "key"))).withColumn("_least", F.min(F.when(F.col("may"), chosen)).over(of))
    first = F.col("counts") & (F.col("k") <= F.col("m") - F.ceil(F.lit(least) * F.col("m") - slack) + 1)
    entry = F.struct(F.col("_id").alias("id"), "m", F.when(first, F.col("k")).alias("k"), (F.col("may") & (chosen == F.col("_least"))).alias("must"))
    met = spread.groupBy(doc, "kind", "key").agg(F.collect_list(F.when(F.col("_ask"), entry)).alias("_a"), F.collect_list(F.when(~F.col("_ask"), entry)).alias("_b"))

    def may_match(a: Column, b: Column) -> Column:
        wanted = F.lit(least) * F.greatest(a["m"], b["m"]) - slack
        room = (F.least(a["m"], b["m"]) >= wanted) & (1 + F.least(a["m"] - a["k"], b["m"] - b["k"]) >= wanted)
        return a["must"] | b["must"] | (a["k"].isNotNull() & b["k"].isNotNull() & room)

    one = met.filter("size(_a) > 0 and size(_b) > 0").select(doc, F.explode("_a").alias("_x"), "_b")
    return one.select(doc, F.col("_x.id").alias("_id"), F.explode(F.filter("_b", lambda b: may_match(F.col("_x"), b))).alias("_y")).select(doc, "_id", F.col("_y.id").alias("_other")).distinct()
