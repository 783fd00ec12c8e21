"""Files and tables that the jobs read and write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.functions.text import squeeze, trim

#: The largest file that is taken, in bytes, and the ending of its name.
MAX_BYTES, ENDING = 50 << 20, ".docx"


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of files, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def admit_files(files: DataFrame, ending: str = ENDING, most: int = MAX_BYTES) -> DataFrame:
    """files (path, length) with reject: why a file isn't taken, or null."""
    reason = F.when(~F.lower("path").endswith(ending), F.lit(f"only {ending} files are taken")).when(F.col("length") > most, F.lit(f"larger than {most >> 20} MB"))
    return files.withColumn("reject", reason)


def write_partials(parts: DataFrame, path: str, by: str = "slice_key") -> None:
    """Adds or replaces the partitions that parts holds; other slices stay, so a repeated delivery changes nothing."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_partials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def purge_sources(sources: DataFrame, finished: DataFrame, key: str = "job_id") -> DataFrame:
    """sources without rows of jobs that are finished."""
    return sources.join(finished.select(key).distinct(), key, "left_anti")


def write_sources(sources: DataFrame, path: str, key: str = "job_id", buckets: int = 64) -> None:
    """Sources of jobs in partitions by a hash of the job, so that their number doesn't grow with the jobs; adds to what is there."""
    sources.withColumn("job_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("job_bucket").parquet(f"{path}/sources")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_sources(spark: SparkSession, path: str, schema: str, key: str = "job_id") -> DataFrame:
    """The sources of jobs that are not purged, nor about to be: a purge that broke off hides its jobs all the same."""
    rows = spark.read.schema(f"{schema}, job_bucket int").parquet(f"{path}/sources").drop("job_bucket")
    return purge_sources(rows, spark.read.parquet(f"{path}/purging"), key) if _exists(spark, f"{path}/purging/_SUCCESS") else rows


def purge(spark: SparkSession, path: str, schema: str, ended: DataFrame | None, key: str = "job_id", step: Callable[[str], None] = lambda name: None) -> int:
    """Removes the sources of ended jobs from the files, rows of other jobs in the same partitions stay; the number of partitions touched.

    1. The jobs are written down (purging); from here on readers don't see them.  2. What stays of the partitions that hold
    such jobs is written aside (kept).  3. These partitions are replaced or, where nothing stays, deleted.
    4. The notes go.  If a run breaks off anywhere, purge(..., None) or the next purge finishes it: each step reads only
    what the steps before it left whole, and step 3 can be repeated.  Partitions without an ended job are neither read nor written.
    step: called with each step's name before it, for tests.
    """
    notes, kept = f"{path}/purging", f"{path}/kept"
    if not _exists(spark, f"{notes}/_SUCCESS"):
        _delete(spark, kept)
        if ended is None:
            return 0
        step("note")
        own = spark.read.schema(f"{schema}, job_bucket int").parquet(f"{path}/sources")
        own.join(ended.select(key).distinct(), key, "left_semi").select(key, "job_bucket").distinct().write.mode("overwrite").parquet(notes)
    elif ended is not None:
        purge(spark, path, schema, None, key, step)
        return purge(spark, path, schema, ended, key, step)
    gone = spark.read.parquet(notes)
    touched = sorted(r.job_bucket for r in gone.select("job_bucket").distinct().collect())  # at most the number of buckets
    rows = spark.read.schema(f"{schema}, job_bucket int").parquet(f"{path}/sources").filter(F.col("job_bucket").isin(touched))
    if not _exists(spark, f"{kept}/_SUCCESS"):
        step("keep")
        rows.join(gone.select(key), key, "left_anti").write.mode("overwrite").parquet(kept)
    step("swap")
    rest = spark.read.parquet(kept)
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_bucket").parquet(f"{path}/sources")
    held = {r.job_bucket for r in rest.select("job_bucket").distinct().collect()}
    for b in touched:
        if b not in held:
            _delete(spark, f"{path}/sources/job_bucket={b}")
    step("forget")
    _delete(spark, notes)
    _delete(spark, kept)
    return len(touched)


def decode_entities(c: Column, ampersand_first: bool) -> Column:
    """The five entities of XML; &amp; first (so that &amp;lt; becomes <) or last."""
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
    for a, b in [("&amp;", "&"), *pairs] if ampersand_first else [*pairs, ("&amp;", "&")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markup_to_text(c: Column | str, paragraph: str = "p") -> Column:
    """Markup as text: a line for each paragraph, no tags, entities decoded, no white space before a line end."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.replace(c, F.lit(f"</{paragraph}>"), F.lit("\n"))
    return trim(F.regexp_replace(decode_entities(F.regexp_replace(lines, "<[^>]+>", ""), True), r"\s+\n", "\n"))


def rich_paragraphs(df: DataFrame, doc: str, xml: str, prefix: str = "w:") -> DataFrame:
    """Paragraphs with raised or lowered runs: doc, paragraph, text and runs (text, vertical_align), equal neighbours joined."""
    q = prefix
    paragraphs = df.select(doc, F.posexplode(F.regexp_extract_all(xml, F.lit(f"(?s)(<{q}p[ >].*?</{q}p>)"), 1)).alias("paragraph", "_p"))
    runs = paragraphs.select(doc, "paragraph", F.posexplode(F.regexp_extract_all("_p", F.lit(f"(?s)(<{q}r[ >].*?</{q}r>)"), 1)).alias("run", "_r"))
    broken = F.regexp_replace("_r", f"<{q}(?:tab|br)\\s*/>", f"<{q}t> </{q}t>")
    bits = F.regexp_extract_all(broken, F.lit(f"(?s)<{q}t(?:\\s[^>]*)?>(.*?)</{q}t>"), 1)
    align = F.nullif(F.regexp_extract("_r", f"<{q}vertAlign\\b[^>]*{q}val=\"(subscript|superscript)\"[^>]*/>", 1), F.lit(""))
    runs = runs.select(doc, "paragraph", "run", F.array_join(F.transform(bits, lambda x: decode_entities(x, False)), "").alias("text"), align.alias("vertical_align")).filter("text <> ''")
    w = Window.partitionBy(doc, "paragraph").orderBy("run")
    changed = ~F.lag("vertical_align").over(w).eqNullSafe(F.col("vertical_align")) | (F.row_number().over(w) == 1)
    islands = runs.withColumn("_new", changed.cast("int")).withColumn("island", F.sum("_new").over(w))
    joined = islands.groupBy(doc, "paragraph", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "").alias("text"), F.first("vertical_align").alias("vertical_align"))
    whole = joined.groupBy(doc, "paragraph").agg(F.array_sort(F.collect_list(F.struct("island", "text", "vertical_align"))).alias("_runs"))
    text = squeeze(F.array_join(F.transform("_runs", lambda x: x["text"]), ""))
    return whole.filter(F.exists("_runs", lambda x: x["vertical_align"].isNotNull())).select(
        doc, "paragraph", text.alias("text"), F.transform("_runs", lambda x: F.struct(x["text"].alias("text"), x["vertical_align"].alias("vertical_align"))).alias("runs"),
    ).filter(F.length("text") >= 12)


def content_hash(parts: DataFrame, doc: str, name: str, body: str) -> DataFrame:
    """SHA-256 of each document over its parts in the order of their names: name, NUL, body, NUL."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(body).alias("body"))))
    joined = F.array_join(F.transform(listed, lambda x: F.concat(x["name"], F.lit("\0"), x["body"], F.lit("\0"))), "")
    return parts.groupBy(doc).agg(F.sha2(joined.cast("binary"), 256).alias("hash"))


def write_result_json(records: DataFrame, doc: str, order: str = "ord") -> DataFrame:
    """One JSON text a document: its buckets, each a list of texts in order."""
    lists = records.groupBy(doc, "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("items"))
    whole = lists.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "items")))).alias("sections"))
    return whole.select(doc, F.to_json(F.struct("sections")).alias("result"))
