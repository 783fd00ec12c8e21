"""Jobs made of slices: what to run, which attempt counts, and how far a job has come."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.operators.lines import slice_marks

#: Seconds after which a pending slice counts as failed, a finishing step as stale, and a missing result as lost.
SLICE_SECONDS, FINISH_SECONDS, RESULT_SECONDS = 620, 90, 90
#: Classes of extractors with their token limits and attempts; the order in which a slice tries them depends on its class.
TIERS = (("cloud", 12_000, 1), ("onPrem", 16_000, 2))


def route_candidates(slices: DataFrame, available: dict[str, bool] | None = None) -> DataFrame:
    """slice_key, rank, provider, max_tokens, attempts: the extractors that a slice tries in turn, unavailable ones left out."""
    here = [x for x in TIERS if (available or {}).get(x[0], True)]
    tiers = slices.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(TIERS) if x in here], "provider string, max_tokens int, attempts int, tier int")
    order = F.when(F.col("high_fidelity"), F.col("tier")).otherwise(-F.col("tier"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("slice_key").orderBy(order))
    return slices.select("slice_key", "high_fidelity").crossJoin(F.broadcast(tiers)).withColumn("rank", rank).select("slice_key", "rank", "provider", "max_tokens", "attempts")


def resolve_attempts(attempts: DataFrame, group: list[str], ok: Column, value: str, order: list[str], message: str) -> DataFrame:
    """The first attempt that succeeded, or all messages in order."""
    place = F.struct(*order)
    failed = F.transform(F.array_sort(F.collect_list(F.when(~ok, F.struct(place.alias("at"), F.col(message).alias("m"))))), lambda x: x["m"])
    found = attempts.groupBy(*group).agg(F.min_by(value, F.when(ok, place)).alias(value), F.bool_or(ok).alias("succeeded"), F.array_join(failed, " | ").alias("_failed"))
    return found.withColumn("error", F.when(~F.col("succeeded"), F.col("_failed"))).drop("_failed")


def slice_states(slices: DataFrame, outcomes: DataFrame, job: str, key: str, kind: str = "kind") -> DataFrame:
    """done, failed or pending for each slice that is due; a result counts more than an error."""
    seen = outcomes.groupBy(job, key).agg(F.bool_or(F.col(kind) == "done").alias("_done"))
    state = F.when(F.col("_done"), "done").when(F.col("_done").isNotNull(), "failed").otherwise("pending")
    return slices.join(seen, [job, key], "left").withColumn("state", state).drop("_done")


def final_state(states: DataFrame, job: str, key: str, message: Column | None = None) -> DataFrame:
    """complete, failed_partial or failed, and which slices failed; a slice without an outcome counts as failed."""
    bad = F.col("state") != "done"
    names = F.array_join(F.array_sort(F.collect_list(F.when(bad, F.concat(key, F.lit(": "), F.coalesce(message, F.lit("unknown")) if message is not None else F.lit("unknown"))))), "; ")
    out = states.groupBy(job).agg(F.count_if(~bad).alias("done"), F.count_if(bad).alias("failed"), names.alias("_names"))
    state = F.when(F.col("failed") == 0, "complete").when(F.col("done") > 0, "failed_partial").otherwise("failed")
    return out.select(job, state.alias("state"), "done", "failed", F.when(F.col("failed") > 0, F.concat(F.lit("Slices failed: "), "_names")).alias("error"))


def job_status(jobs: DataFrame, states: DataFrame, job: str, now: Column, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """How far each job has come at a moment.

    jobs: job, started, final_state, finished, has_result, locked.  In order: a final state, but merging while its result is on the way
    and failed if it never comes; slices all ended and the finishing step locked: merging, failed once both limits have
    passed; all ended: merging; too old: pending slices fail, merging if one is done, else failed; else pending.
    """
    counts = states.groupBy(job).agg(F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "pending").alias("pending"))
    age = lambda c: (F.unix_micros(now) - F.unix_micros(c.cast("timestamp"))) / 1e6
    ended = F.col("pending") == 0
    lacks = F.col("final_state").isin("complete", "failed_partial") & ~F.col("has_result")
    old = age(F.col("started")) > slice_seconds
    status = (
        F.when(lacks & (age(F.col("finished")) < RESULT_SECONDS), "merging").when(lacks, "failed").when(F.col("final_state").isNotNull(), F.col("final_state"))
        .when(ended & F.col("locked") & (age(F.col("started")) > FINISH_SECONDS + slice_seconds), "failed").when(ended, "merging")
        .when(old & (F.col("done") > 0), "merging").when(old, "failed").otherwise("pending"))
    shown = F.when(F.col("final_state").isNull() & old, F.col("failed") + F.col("pending")).otherwise(F.col("failed"))
    return jobs.join(counts, job, "left").na.fill(0, ["done", "failed", "pending"]).select(job, status.alias("status"), "done", shown.alias("failed"))


def plan_reprocess(docs: DataFrame, store: DataFrame, doc: str, content_hash: str = "hash") -> DataFrame:
    """docs with action: reuse where the store has the document with the same hash, else full; a year asked for counts more than the stored one."""
    known = store.select(doc, content_hash, F.col("since_year").alias("_stored")).withColumn("_known", F.lit(True))
    out = docs.join(known, [doc, content_hash], "left")
    return out.withColumn("action", F.when(F.col("_known"), "reuse").otherwise("full")).withColumn("since_year", F.coalesce("since_year", "_stored")).drop("_known", "_stored")


def build_requests(docs: DataFrame, slices: DataFrame, excerpts: DataFrame, done: DataFrame, doc: str, text: str, excerpt_only: Column) -> DataFrame:
    """doc, slice_key and body for each slice still due: the excerpt where excerpt_only holds, else the whole text.

    excerpts: doc, slice_key, n, line.  The slices are a broadcast table of fixed size; slices with an outcome in done are left out.
    """
    due = docs.select(doc).crossJoin(F.broadcast(slices)).join(done.select(doc, "slice_key").distinct(), [doc, "slice_key"], "left_anti")
    cut = excerpts.groupBy(doc, "slice_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("_excerpt"))
    short = due.filter(excerpt_only).join(cut, [doc, "slice_key"], "left")
    # Texts are fetched last, and only for slices that need a whole one.
    whole = due.filter(~excerpt_only).select(doc, "slice_key").unionAll(short.filter("_excerpt is null").select(doc, "slice_key"))
    return short.filter("_excerpt is not null").select(doc, "slice_key", F.col("_excerpt").alias("body")).unionAll(
        whole.join(docs.select(doc, F.col(text).alias("body")), doc).select(doc, "slice_key", "body"))


def lines_as_records(body: str, bucket: str) -> list[str]:
    """The extractor without a model: each line is a record of the slice's first bucket."""
    return [x for x in (line.strip() for line in body.split("\n")) if x]


def _extracted(fn: Callable[[str, str], list[str]], doc: object, key: str, bucket: str, body: str) -> list[tuple]:
    try:
        return [(doc, key, i, x, None) for i, x in enumerate(fn(body, bucket))]
    except Exception as e:
        return [(doc, key, -1, None, f"{type(e).__name__}: {e}")]


def extract_slices(requests: DataFrame, doc: str, fn: Callable[[str, str], list[str]] = lines_as_records) -> DataFrame:
    """Runs a caller's extractor on requests (doc, slice_key, bucket, body): rows (doc, slice_key, pos, text, error).

    fn gets a body and a bucket and returns texts; what it raises becomes a row with the error and fails nothing else.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [x for r in f.itertuples(index=False) for x in _extracted(fn, *r)]
            yield pd.DataFrame(rows, columns=["doc", "slice_key", "pos", "text", "error"]).astype({"pos": "int32"})

    kind = requests.schema[doc].dataType.simpleString()
    out = requests.select(doc, "slice_key", "bucket", "body").mapInPandas(run, f"doc {kind}, slice_key string, pos int, text string, error string")
    return out.withColumnRenamed("doc", doc)


def extract_excerpts(lines: DataFrame, slices: DataFrame, doc: str, fn: Callable[[str, str], list[str]] = lines_as_records) -> DataFrame:
    """extract_slices on each slice's excerpt of each document's lines (doc, n, line).

    A line goes through with the numbers of the slices that keep it, and the excerpts are joined where the document's lines lie, in
    order; so no excerpt is grouped, sorted or shuffled, though a line is in most of them.  A task holds one document's lines at a time.
    """
    names = {r.slice_seq: (r.slice_key, r.bucket) for r in slices.select("slice_seq", "slice_key", "bucket").collect()}
    kind = lines.schema[doc].dataType.simpleString()
    out = f"doc {kind}, slice_key string, pos int, text string, error string"
    marked = slice_marks(lines, slices, lambda r: r.slice_seq, doc).sortWithinPartitions(doc, "n")  # as the last window left it
    types = to_arrow_schema(marked.select(F.col(doc).alias("doc"), F.lit("").alias("slice_key"), F.lit(0).alias("pos"), F.lit("").alias("text"), F.lit("").alias("error")).schema)

    def of_document(at: object, own: list[tuple]) -> Iterator[tuple]:
        cut: dict[int, list[str]] = {}
        for _, line, wanted in sorted(own, key=lambda r: (r[0], r[1] or "")):
            for k in wanted:
                cut.setdefault(k, []).append(line)
        for k, kept in cut.items():
            yield from _extracted(fn, at, *names[k], "\n".join(x for x in kept if x is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, at = [], [], None
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], names=types.names)
        for batch in batches:
            for x, *line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and x != at:
                    rows += of_document(at, own)
                    own = []
                    if len(rows) > 20_000:
                        yield packed()
                        rows = []
                at = x
                own.append(tuple(line))
        if own:
            rows += of_document(at, own)
        if rows:
            yield packed()

    return marked.mapInArrow(run, out).withColumnRenamed("doc", doc)


ATTEMPT = "slice_key string, rank int, provider string, attempt int, ok boolean, texts array<string>, error string"


def extract_attempts(requests: DataFrame, doc: str, candidates: DataFrame, extractors: dict[str, Callable[[str, str, int, int], list[str]]], concurrency: int = 4) -> DataFrame:
    """Runs each request through its slice's candidates in order until one succeeds; a row for each attempt that was made.

    requests: doc, slice_key, bucket, body; candidates: as route_candidates gives them.  An extractor gets body, bucket, its
    token limit and the number of the attempt, and returns texts; what it raises is the attempt's error, and the candidate's next attempt follows, then
    the next candidate.  A slice without candidates has one row of rank 0.  A task has so many requests under way at once as concurrency says,
    as extractors mostly wait for others; nothing outlives a batch.  resolve_attempts tells what counts.
    """
    tiers = candidates.groupBy("slice_key").agg(F.array_sort(F.collect_list(F.struct("rank", "provider", "max_tokens", "attempts"))).alias("_tiers"))
    kind = requests.schema[doc].dataType.simpleString()

    def one(request: tuple) -> list[tuple]:
        key, slice_key, bucket, body, tiers = request
        out: list[tuple] = []
        for tier in tiers if tiers is not None else ():
            for attempt in range(1, tier["attempts"] + 1):
                try:
                    texts = list(extractors[tier["provider"]](body, bucket, tier["max_tokens"], attempt))
                    return [*out, (key, slice_key, tier["rank"], tier["provider"], attempt, True, texts, None)]
                except Exception as e:
                    out.append((key, slice_key, tier["rank"], tier["provider"], attempt, False, None, f"{type(e).__name__}: {e}"))
        return out or [(key, slice_key, 0, None, 0, False, None, "no extractor")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for f in frames:
                rows = [r for found in pool.map(one, f.itertuples(index=False, name=None)) for r in found]
                yield pd.DataFrame(rows, columns=["doc", "slice_key", "rank", "provider", "attempt", "ok", "texts", "error"]).astype({"rank": "int32", "attempt": "int32"})

    rows = requests.join(tiers, "slice_key", "left").select(doc, "slice_key", "bucket", "body", "_tiers")
    return rows.mapInPandas(run, f"doc {kind}, {ATTEMPT}").withColumnRenamed("doc", doc)
