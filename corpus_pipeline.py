"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of docs.

In every stage: a null text counts as empty; doc_id may be null or repeat, and rows are told apart by a number or by
doc_id and text; other columns are carried along whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm._frames import flagged, saved, table
from rollcall.llm.decontamination import contained_items
from rollcall.llm.near_duplicates import near_duplicates
from rollcall.llm.packing import best_fit_packing
from rollcall.llm.quality_rules import repetition_rules
from rollcall.llm.queries import tokenizer_path
from rollcall.llm.suffix_dedup import repeated_passages

#: No SQL expresses packing or exact near-duplicate groups over these texts at this size; the tests hold run() against a brute-force version.
ORACLE_SQL = None
#: Passages of over 50 words that start elsewhere too are removed.
PASSAGE_WORDS = 51
#: Bytes of rows that go to a Python worker at once; a batch is held by both sides, so it bounds an executor's memory.
BATCH_BYTES = 8 << 20
#: The name of the column that tells rows apart within a stage.
ROW = "_row_of_stage"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_BYTES while a stage's jobs run; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written: numbers of one scan needn't be those of the next."""
    return saved(docs.withColumn(ROW, F.struct(F.col("doc_id"), F.monotonically_increasing_id().alias("at"))), "numbered")


def _named(docs: DataFrame) -> DataFrame:
    """docs with what a row is known by whenever it is read; rows of equal doc_id and text share it."""
    return docs.withColumn(ROW, F.struct(F.col("doc_id"), F.sha2("text", 256).alias("at")))


def _known(df: DataFrame, *more: Column) -> DataFrame:
    """One row for each of df's rows' names, with more."""
    return df.select(F.col(f"{ROW}.doc_id").alias("_id"), F.col(f"{ROW}.at").alias("_at"), *more).dropDuplicates(["_id", "_at"])


def _same(docs: DataFrame, known: DataFrame) -> Column:
    return docs[ROW]["at"].eqNullSafe(known["_at"]) & docs[ROW]["doc_id"].eqNullSafe(known["_id"])


def _split(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs without the rows in known, as far as a bitmap tells, and the others: only these need a shuffle."""
    marked = flagged(docs, F.col(ROW), known, F.struct("_id", "_at"), "_row_may_be_known")
    return marked.filter("not _row_may_be_known").drop("_row_may_be_known"), marked.filter("_row_may_be_known").drop("_row_may_be_known")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, numbered or named, without the rows in gone."""
    known = saved(_known(gone), "gone")
    stay, rest = _split(docs, known)
    return stay.unionAll(rest.join(known, _same(rest, known), "left_anti")).drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on length and repetition; a null or empty text fails."""
    named = {f"_column{i}": c for i, c in enumerate(docs.columns)}  # none is named like a measure
    rows = docs.select(*[F.col(c).alias(n) for n, c in named.items()])
    kept = repetition_rules(rows, f"_column{docs.columns.index('text')}", keep=list(named)).filter("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in named.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies; documents without words all stay.

    Repeated rows are copies of each other: one stays.  A null doc_id comes before all others.
    """
    with _small_batches(spark):
        rows = _numbered(docs)
        return _without(rows, near_duplicates(rows, key=ROW).filter(~F.col("kept")))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages, of over 50 words or of 400 bytes, that start anywhere else too, n_chars counted again.

    A document of which only white space remains goes, so all copies of a text of that size go; null, empty and shorter texts
    stay as they are.
    """
    rows = _named(docs)
    with _small_batches(spark):
        passages = repeated_passages(rows, key=ROW, words=PASSAGE_WORDS)
    changed = _known(passages.filter("n_removed > 0"), F.col("kept").alias("_kept"))
    stay, rest = _split(rows, changed)
    joined = stay.withColumn("_kept", F.lit(None).cast("string")).unionAll(rest.join(changed, _same(rest, changed), "left").select(*rest.columns, "_kept"))
    joined = joined.filter(F.col("_kept").isNull() | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    text = F.coalesce("_kept", "text")
    fresh = {"text": text} | ({"n_chars": F.when(F.col("_kept").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return joined.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and repeated rows go or stay together."""
    rows = _named(docs)
    with _small_batches(spark):
        return _without(rows, contained_items(rows, table(spark, sf_dir, "benchmark"), key=ROW))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a null or empty text is one piece of one token."""
    with _small_batches(spark):
        return best_fit_packing(docs, tokenizer_path(), 2048)


STAGES = [("quality_rules", quality), ("near_duplicates", near_copies), ("suffix_dedup", repeats), ("decontamination", leaks), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with _small_batches(spark):
            docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
