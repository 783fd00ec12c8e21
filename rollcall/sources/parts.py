"""Results parsed once and stored by document, each section a VARIANT column of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import patterns as p
from rollcall.sources import ingest

#: The sections that are lists, each stored as a column.
SECTIONS = ("employment", "education", "universityService", "grants", "studentInstructionalGroups", *p.STRING_BUCKETS, *p.PUBLICATION_BUCKETS)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below the one that driver and executors share; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def by_document(df: DataFrame, what: str, doc: str = "doc_id") -> DataFrame:
    """df written into buckets of doc, as many as shuffle partitions, and read again: what groups, orders or joins by doc needs no exchange.

    A bucket is one file: a df that lies otherwise is dealt by doc first, or each task would write a file a bucket, and the driver would
    hold as many files as the square of the partitions; one that lies by doc already gets no exchange from this.  The table's files
    stay in the shared folder; its name leaves the catalog at once.
    """
    spark = df.sparkSession
    name, n = f"{what}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, doc).write.format("parquet").bucketBy(n, doc).sortBy(doc).option("path", shared_path(spark, what)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def kept_by_document(df: DataFrame, what: str, doc: str = "doc_id") -> DataFrame:
    """by_document for what was made from a table by document."""
    return by_document(df, what, doc)


def shredded(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """The columns in keep, problem, metadata, specialization, sections (a struct with a VARIANT for each of SECTIONS), gaps and reviewNotes.

    The body, JSON text that may stand in a code fence, is parsed here and nowhere else.  problem says why a body is none (not JSON, not an
    object; the body is kept as refused then) and is null otherwise.  A section that isn't there is null; sections of other names are
    left out; a repeated name makes the body no JSON.
    """
    v = ingest.parsed(df.select(*keep, body), body)
    at = lambda path: F.try_variant_get("_v", path, "variant")
    problem = F.when(F.col("_v").isNull(), F.lit("not JSON")).when(~F.col("is_object"), F.lit("not an object"))
    inside = F.when(F.schema_of_variant(at("$.sections")).startswith("OBJECT"), F.lit(True))
    return v.select(
        *keep, problem.alias("problem"), F.when(problem.isNotNull(), F.col(body)).alias("refused"), at("$.metadata").alias("metadata"), F.when(inside, at("$.sections.specialization")).alias("specialization"),
        F.struct(*[F.when(inside, at(f"$.sections.{c}")).alias(c) for c in SECTIONS]).alias("sections"), at("$.gaps").alias("gaps"), at("$.reviewNotes").alias("reviewNotes"))


def stored(df: DataFrame, body: str = "body", doc: str = "doc_id", part: str = "part") -> DataFrame:
    """shredded(df), by document: the one exchange of a merge, after which each reader takes its sections' columns only."""
    return by_document(shredded(df, body, (doc, part)), "parts", doc)


def elements(parts: DataFrame, buckets: tuple[str, ...], keep: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """keep, bucket, pos and value for each element of the sections named, of stored parts."""
    lists = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"sections.{b}").alias("_list")) for b in buckets])).alias("_x")
    return ingest.listed(parts.select(*keep, lists).select(*keep, "_x.bucket", "_x._list"))


def listed(parts: DataFrame, column: str, keep: tuple[str, ...] = ("doc_id", "part")) -> DataFrame:
    """keep, pos and value for each element of gaps or reviewNotes."""
    return ingest.listed(parts.select(*keep, F.col(column).alias("_list")))


def metadata(parts: DataFrame, doc: str = "doc_id", order: str = "part") -> DataFrame:
    """One row a document with a part that is an object: a later part's values win, blank ones too; the specialization is the first that isn't blank."""
    held = F.when(F.schema_of_variant("metadata").startswith("OBJECT"), F.col(order))
    last = lambda c: F.coalesce(F.max_by(ingest.text_of("metadata", f"$.{c}"), held), F.lit("")).alias(c)
    special: Column = ingest.text_of("specialization", "$")
    return parts.filter("problem is null").groupBy(doc).agg(
        last("name"), last("department"), last("title"), F.coalesce(F.min_by(special, F.when(special != "", F.col(order))), F.lit("")).alias("specialization"))
