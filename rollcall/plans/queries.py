"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import dates, text as t
from rollcall.operators import audit, fuzzy, jobs, layout, lines as ln, records as rec
from rollcall.plans import views as v
from rollcall.sources import files, ingest, parts as stored_parts, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CUTOFF, SINCE = "1998-07-01", 1999
NOW = "2024-01-01 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def big(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that results compare with other engines."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if k in ("int", "smallint", "tinyint") else F.col(c) for c, k in df.dtypes])


def orders(spark: SparkSession, d: str) -> DataFrame:
    return v.view(spark, d, v.REC_ORDERS)


def pubs(spark: SparkSession, d: str) -> DataFrame:
    return v.view(spark, d, v.PUBS)


def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    return ln.read_lines(v.table(spark, d, "documents"), keep=("lang", "source"))


@query
def chrono_numbered_records(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's records: cleaned, without repeats, oldest first, numbered, with the divider before what is new."""
    clean = orders(spark, d).withColumn("text", dates.clean_record("text"))
    kept = rec.dedupe_first(clean, ["doc_id", "bucket"], t.norm_dedupe("text"), ["ord"])
    numbered = rec.number_by_date(kept, ["doc_id", "bucket"], F.col("text"), ["ord"])
    return big(rec.review_divider(numbered, ["doc_id", "bucket"], F.col("text"), "number", CUTOFF).select("doc_id", "bucket", "ord", "number", "text", "is_new", "divider"))


@query
def initial_dates(spark: SparkSession, d: str) -> DataFrame:
    x = dates.initial_date("text")
    return big(orders(spark, d).select("ord", x["sort_key"].alias("sort_key"), x["label"].alias("label"), x["year"].alias("year"), x["month"].alias("month"), x["day"].alias("day")))


@query
def leading_date_moved(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("ord", dates.clean_record("text").alias("text"))


@query
def since_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("ord", dates.on_or_after("text", CUTOFF).alias("since"), dates.before("text", CUTOFF).alias("earlier"))


@query
def active_since(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).filter(dates.active_since("text", SINCE)).select("doc_id", "ord", "text")


@query
def valid_dates(spark: SparkSession, d: str) -> DataFrame:
    x = orders(spark, d).select("ord", F.substring(F.trim("text"), 1, 10).alias("day"), F.regexp_extract("text", r"(\d+)", 1).alias("year"))
    return x.select("ord", dates.valid_iso_date("day").alias("day_ok"), dates.valid_since_year("year", 2030).alias("year_ok"))


@query
def normalised_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = {"by_case": t.norm_dedupe, "by_words": t.norm_compare, "by_record": t.norm_record, "by_citation": t.norm_citation, "bare": t.strip_source_number}
    return big(ln.read_lines(v.table(spark, d, "documents")).select("doc_id", "n", *[f("line").alias(k) for k, f in keys.items()]))


@query
def service_clean(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.ACTIVITIES)
    both = dates.clean_service("description", "dates")
    return x.select("ord", t.norm_service("description", F.col("dates")).alias("service_key"), t.activity_core("description").alias("core"),
                    both["description"].alias("description"), both["dates"].alias("dates"))


@query
def contribution_split(spark: SparkSession, d: str) -> DataFrame:
    s = t.split_contribution("text")
    return pubs(spark, d).select("ord", s["citation"].alias("citation"), F.coalesce("note", s["note"]).alias("note"), t.citation_key("text").alias("key"))


@query
def display_forms(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.POSTS)
    return x.select("ord", t.display_period("start", "finish").alias("period"), t.display_cell("institution").alias("institution"), t.sentence_case(F.upper("rank")).alias("rank"),
                    t.display_degree(F.concat("rank", F.lit(" ("), "start", F.lit(")")), "start").alias("degree"), t.previously_listed("rank").alias("listed"),
                    t.contribution_note("rank", "institution").alias("note"), t.unwrap(F.concat(F.lit("("), "start", F.lit(")"))).alias("bare"))


@query
def lines(spark: SparkSession, d: str) -> DataFrame:
    return big(ln.read_lines(v.table(spark, d, "documents")))


@query
def segments(spark: SparkSession, d: str) -> DataFrame:
    return big(ln.segments(v.table(spark, d, "documents").withColumn("text", F.replace(F.col("text"), F.lit(". "), F.lit(".  ")))))


@query
def doc_headers(spark: SparkSession, d: str) -> DataFrame:
    x = orders(spark, d).select("doc_id", rec.F.row_number().over(rec.Window.partitionBy("doc_id").orderBy("ord")).alias("k"), F.trim("text").alias("line")).select("doc_id", (F.col("k") - 1).alias("n"), "line")
    return ln.doc_header(x)


@query
def cut_tail(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nConversion Review Summary \n"), F.lit(ln.p.APPENDIX_INTRO), "text")).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("\nConversion Review Summary\nno intro "), "text")).otherwise("")
    docs = v.table(spark, d, "documents").withColumn("whole", F.concat("text", tail))
    return docs.select("doc_id", ln.cut_generated_tail("whole").alias("text"))


@query
def section_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Per document and line, what lies between a line with 'shed' and a later one with 'thing'."""
    return big(ln.lines_between(ln.read_lines(v.table(spark, d, "documents")), ["doc_id"], "shed", "thing"))


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    w = rec.Window.partitionBy("doc_id").orderBy("ord")
    head = F.when(F.col("ord") % 17 == 0, F.lit("Invited Lectures at Institutions")).when(F.col("ord") % 19 == 0, F.lit("Abstracts and Contributed Talks")).when(
        F.col("ord") % 23 == 0, F.lit("University Service")).otherwise(F.trim("text"))
    return orders(spark, d).select("doc_id", (F.row_number().over(w) - 1).alias("n"), head.alias("line"))


@query
def context_excerpt(spark: SparkSession, d: str) -> DataFrame:
    hit = ln.has_year_between("line", 1996, 1996)
    return big(ln.context(order_lines(spark, d), ["doc_id"], hit, F.col("line").rlike("(?i)lectures")))


@query
def slice_requests(spark: SparkSession, d: str) -> DataFrame:
    return big(ln.slice_excerpts(order_lines(spark, d), ln.slice_dim(spark)))


@query
def slice_routes(spark: SparkSession, d: str) -> DataFrame:
    """The extractors that each slice of each document with an error outcome tries next."""
    s = ln.slice_dim(spark)
    routes = jobs.route_candidates(s)
    failed = v.view(spark, d, v.OUTCOMES).filter("state = 'failed'").groupBy("job_id").agg(F.count(F.lit(1)).alias("failures"))
    return big(failed.crossJoin(F.broadcast(routes)).filter(F.col("rank") <= F.least(F.col("failures"), F.lit(2))))


@query
def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """What is sent for each slice that is due: an excerpt for the cheaper class, the whole text otherwise."""
    li = order_lines(spark, d)
    s = ln.slice_dim(spark)
    whole = li.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    done = li.filter("n = 0 and doc_id % 2 = 0").select("doc_id", F.lit("II_grants").alias("slice_key"))
    out = jobs.build_requests(whole, s.select("slice_key", "high_fidelity"), ln.slice_excerpts(li, s), done, "doc_id", "text", ~F.col("high_fidelity"))
    return out.select("doc_id", "slice_key", F.md5("body").alias("body_md5"))


@query
def extracted_slices(spark: SparkSession, d: str) -> DataFrame:
    """The rule-based extractor on every slice's excerpt."""
    return big(jobs.extract_excerpts(order_lines(spark, d), ln.slice_dim(spark), "doc_id"))


@query
def markup_text(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages").select("page_id", F.md5(files.markup_to_text("html")).alias("text_md5"), F.length(files.markup_to_text("html")).cast("bigint").alias("n_chars"))


LEAKS = {"references": r"&[a-z]+;", "scripts": r"track\([0-9]+\)", "numbers": r"^\s*(?:\([0-9]+\)|[0-9]+[.)])"}


@query
def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return audit.leak_scan(v.table(spark, d, "pages").select(files.markup_to_text("html").alias("text")), "text", LEAKS)


@query
def rich_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    up = '<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>{}</w:t></w:r>'.split("{}")
    run = lambda c: F.concat(F.lit("<w:r><w:t xml:space=\"preserve\">"), c, F.lit("</w:t></w:r>"))
    x = v.table(spark, d, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc"),
        F.concat(F.lit("<w:p >"), run(F.regexp_replace("text", "[<&]", "")), run(F.lit(" a &amp;")), F.lit(up[0]), "role", F.lit(up[1]),
                 F.when(F.col("turn") % 2 == 0, run(F.lit(" tail"))).otherwise(""), F.lit("</w:p><w:p >"), run(F.lit("plain")), F.lit("</w:p>")).alias("xml"))
    p = files.rich_paragraphs(x, "doc", "xml")
    return big(p.select("doc", "paragraph", "text", F.to_json("runs").alias("runs")))


@query
def ingest_partials(spark: SparkSession, d: str) -> DataFrame:
    x = ingest.publications(v.view(spark, d, v.BODIES), "body", "books")
    return big(x.select("id", "pos", "number", "citation", "pub_type", "is_new"))


@query
def ingest_strings(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.string_list(v.view(spark, d, v.BODIES), "body", "awards").select("id", "pos", "text"))


@query
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return ingest.quarantine(v.view(spark, d, v.BODIES), "body").select("id", "reason")


def dealt_bodies(spark: SparkSession, d: str, sql: str = v.FULL_BODIES) -> DataFrame:
    """Results made by as many tasks as there are shuffle partitions: the table that they are made from is one small file, the results are thousands of times its size."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return v.view(spark, d, sql.replace("select c_custkey as o_orderkey", f"select /*+ REPARTITION({n}) */ c_custkey as o_orderkey"))


@query
def ingest_services(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.services(dealt_bodies(spark, d), "body").select("id", "pos", "description", "dates", "category"))


@query
def ingest_grants(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.grants(dealt_bodies(spark, d), "body").select("id", "pos", "title", "funder", "period", "status", "amount", "role", "coPIsShare"))


@query
def ingest_employment(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.employment(dealt_bodies(spark, d), "body").select("id", "pos", "rank", "institution", "location", "start", "finish"))


@query
def ingest_education(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.education(dealt_bodies(spark, d), "body").select("id", "pos", "school", "degree", "datesFrom", "datesTo", "location", "major", "dateReceived"))


@query
def ingest_groups(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.groups(dealt_bodies(spark, d), "body").select("id", "pos", "heading", "entry_pos", "entry"))


@query
def ingest_gaps(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.gaps(dealt_bodies(spark, d), "body").select("id", "pos", "section", "field", "instruction", "severity"))


@query
def ingest_notes(spark: SparkSession, d: str) -> DataFrame:
    return big(ingest.review_notes(dealt_bodies(spark, d), "body").select("id", "pos", "section", "topic", "instruction"))


@query
def ingest_sections(spark: SparkSession, d: str) -> DataFrame:
    """Texts and citations of all buckets from one reading of each body."""
    e = ingest.section_elements(dealt_bodies(spark, d), "body")
    texts = ingest.string_rows(e.filter(F.col("bucket").isin(*STRINGS))).select("id", "bucket", "pos", "text", F.lit(None).cast("string").alias("pub_type"), F.lit(None).cast("boolean").alias("is_new"))
    cited = ingest.publication_rows(e.filter(F.col("bucket").isin(*CITED))).select("id", "bucket", "pos", "citation", "pub_type", "is_new")
    return big(texts.unionAll(cited))


@query
def stored_sections(spark: SparkSession, d: str) -> DataFrame:
    """Texts and citations of all buckets from stored parts, whose bodies are parsed once and of which each reader takes its sections."""
    stored = stored_parts.by_document(stored_parts.shredded(dealt_bodies(spark, d), keep=("id", "doc_id")), "parts")
    of = lambda names: stored_parts.elements(stored, names, ("id",))
    texts = ingest.string_rows(of(STRINGS)).select("id", "bucket", "pos", "text", F.lit(None).cast("string").alias("pub_type"), F.lit(None).cast("boolean").alias("is_new"))
    return big(texts.unionAll(ingest.publication_rows(of(CITED)).select("id", "bucket", "pos", "citation", "pub_type", "is_new")))


@query
def stored_gaps(spark: SparkSession, d: str) -> DataFrame:
    stored = stored_parts.by_document(stored_parts.shredded(dealt_bodies(spark, d), keep=("id", "doc_id")), "parts")
    return big(ingest.gap_rows(stored_parts.listed(stored, "gaps", ("id",))).select("id", "pos", "section", "field", "instruction", "severity"))


@query
def refused_parts(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that are no results, kept beside the others with the reason."""
    return stored_parts.shredded(v.view(spark, d, v.BODIES), keep=("id",)).filter("problem is not null").select("id", "problem", F.md5("refused").alias("refused_md5"))


@query
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    return ingest.metadata(dealt_bodies(spark, d), "doc_id", "body", "part")


@query
def validate_result(spark: SparkSession, d: str) -> DataFrame:
    """Whole results taken or refused as they are, with the checks of their hash and first year."""
    out = ingest.validate_result(dealt_bodies(spark, d, v.WHOLE_BODIES), "body")
    return out.select("id", "valid", ingest.validate_snapshot(out, "hash", "since_year").alias("header_ok"))


@query
def placement_inventory(spark: SparkSession, d: str) -> DataFrame:
    """What the results list twice, or as a service and as an activity."""
    x = dealt_bodies(spark, d)
    e = ingest.section_elements(x, "body")
    activities = ingest.string_rows(e.filter(F.col("bucket").isin("professionalActivities", "externalProfessionalActivities")))
    cited = ingest.publication_rows(e.filter(F.col("bucket").isin(*CITED))).withColumnRenamed("citation", "text")
    return audit.placement_inventory(ingest.services(x, "body"), activities, cited, "doc_id")


@query
def folded_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with the flat texts that name one folded in, as one list a document."""
    x = dealt_bodies(spark, d)
    groups = ingest.groups(x, "body").withColumn("ord", F.struct("part", "pos", "entry_pos"))
    flat = ingest.string_list(x, "body", "studentInstructionalActivities").withColumn("ord", F.struct("part", "pos", F.lit(0).alias("entry_pos")))
    return rec.nested_groups(rec.fold_groups(groups, flat, "doc_id", "text"), "doc_id").select("doc_id", F.to_json("groups").alias("groups"))


@query
def record_views(spark: SparkSession, d: str) -> DataFrame:
    """How many services and grants each document shows in which list."""
    x = dealt_bodies(spark, d)
    of = ingest.services(x, "body").select("doc_id", rec.service_view("category").alias("view")).unionAll(ingest.grants(x, "body").select("doc_id", rec.grant_view("status")))
    return of.groupBy("doc_id", "view").agg(F.count(F.lit(1)).alias("n"))


STRINGS, CITED = t.p.STRING_BUCKETS, t.p.PUBLICATION_BUCKETS


@query
def validate_strict(spark: SparkSession, d: str) -> DataFrame:
    x = v.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('", "key": '), F.when(F.col("o_orderkey") % 3 == 0, F.lit('"x"')).otherwise(
        F.col("o_orderkey").cast("string")), F.lit(', "new": '), F.when(F.col("o_orderkey") % 2 == 0, F.lit("true")).otherwise(F.lit("1")), F.lit("}")).alias("body"))
    out = ingest.validate_strict(x, "body", {"status": "STRING", "key": "BIGINT", "new": "BOOLEAN"}, {"status": ("O", "F")})
    return out.select("o_orderkey", "valid")


@query
def metadata_last_wins(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.BODIES).withColumn("part", F.col("id"))
    return ingest.metadata(x, "doc_id", "body", "part")


@query
def turns_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return ingest.later_wins(v.table(spark, d, "conversations"), "conv_id", ["turn"], ["role", "text"])


@query
def grouped_entries(spark: SparkSession, d: str) -> DataFrame:
    return big(rec.merge_groups(v.view(spark, d, v.TURNS), "conv_id", "heading", "entry", "turn"))


@query
def flat_groups(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.TURNS).select("conv_id", "turn", F.concat("heading", F.lit(" "), "entry").alias("item"))
    return rec.flat_groups(x, "item").select("conv_id", "turn", F.trim("heading").alias("heading"), "entry")


@query
def in_progress_split(spark: SparkSession, d: str) -> DataFrame:
    return big(rec.move_in_progress(pubs(spark, d)).select("ord", "bucket", "moved"))


@query
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    return rec.reclassify(pubs(spark, d)).select("ord", "bucket", "pub_type")


@query
def routed_presentations(spark: SparkSession, d: str) -> DataFrame:
    x = orders(spark, d).withColumn("bucket", F.lit("invitedPresentations"))
    return rec.route_presentations(x).select("ord", "bucket")


@query
def employment_kept(spark: SparkSession, d: str) -> DataFrame:
    return rec.applicable_employment(v.view(spark, d, v.POSTS)).select("doc_id", "ord", "rank", "institution")


@query
def honorific(spark: SparkSession, d: str) -> DataFrame:
    return rec.honorific_awards(v.view(spark, d, v.POSTS)).select("doc_id", "ord", "award")


@query
def display_filters(spark: SparkSession, d: str) -> DataFrame:
    x = orders(spark, d)
    return x.filter(rec.is_rendered_talk("text")).select("ord", rec.is_mentoring("text").alias("mentoring"))


@query
def split_views(spark: SparkSession, d: str) -> DataFrame:
    x = rec.own_theses(pubs(spark, d), "is_new").withColumn("view", rec.in_progress_view("pub_type"))
    return x.groupBy("doc_id", "view").agg(F.count(F.lit(1)).alias("n"))


@query
def exact_anti(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.ACTIVITIES)
    out = rec.without_keys_of(x, ["doc_id"], "professionalActivities", "universityService", t.norm_service("description", F.col("dates")))
    return out.select("doc_id", "ord", "bucket")


@query
def core_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return rec.core_conflicts(v.view(spark, d, v.ACTIVITIES), ["doc_id"])


@query
def proceedings_anti(spark: SparkSession, d: str) -> DataFrame:
    return rec.proceedings_anti(rec.reclassify(pubs(spark, d)), ["doc_id"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("total"))


BUCKET_ORDER = ("5-LOW", "1-URGENT", "4-NOT SPECIFIED", "2-HIGH", "3-MEDIUM")


@query
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """All buckets of a customer as one list: in the order given for the buckets, then of the records."""
    return big(rec.concat_buckets(orders(spark, d), "doc_id", BUCKET_ORDER, ["ord"]).select("doc_id", "bucket", "ord", "number"))


@query
def merged_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return rec.merge_duplicates(pubs(spark, d), ["doc_id"]).select("doc_id", "bucket", "text", "pub_type", "note", "is_new", "ord", "copies")


def passages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The items of benchmark and the documents, both as (key, body)."""
    left = v.table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("body"))
    return left, v.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body"))


@query
def fuzzy_same(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.fuzzy_pairs(*passages(spark, d), "key", "body").select("key_a", "key_b", F.round("share", 6).alias("share"))


@query
def fuzzy_check(spark: SparkSession, d: str) -> DataFrame:
    """How many documents nearly equal or hold a passage."""
    return fuzzy.fuzzy_counts(*passages(spark, d), "key", "body")


@query
def abstract_anti(spark: SparkSession, d: str) -> DataFrame:
    """Turns that no other conversation's opening turn nearly repeats."""
    x = v.table(spark, d, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    opening = x.filter("turn = 0").select("key", "text")
    return fuzzy.without_fuzzy_copies(x.filter("turn > 0"), opening, "key", "text").select("key")


@query
def guarded_append(spark: SparkSession, d: str) -> DataFrame:
    x = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("texts"))
    out = fuzzy.guarded_append(F.slice("texts", 1, 1), F.slice("texts", F.lit(2), F.size("texts")))
    return x.select("conv_id", F.posexplode(out).alias("pos", "text")).select("conv_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query
def best_rich_match(spark: SparkSession, d: str) -> DataFrame:
    """For each cleaned record of a customer the raw record that it comes from."""
    x = orders(spark, d)
    return fuzzy.best_match(x.select("doc_id", F.col("ord").alias("record"), dates.clean_record("text").alias("text")), x.select("doc_id", F.col("ord").alias("paragraph"), "text"),
                            "doc_id", "record", "paragraph", "text")


@query
def cross_bucket_notes(spark: SparkSession, d: str) -> DataFrame:
    x = corpus_lines(spark, d)
    return big(audit.cross_bucket_notes(x, "lang", "source", "line", audit.review_key("line"), ["source", "doc_id", "n"]).select("lang", "section", "doc_id", "n", "item"))


@query
def notes_deduped(spark: SparkSession, d: str) -> DataFrame:
    x = corpus_lines(spark, d)
    return big(audit.dedupe_notes(x, "lang", ("source", "line"), ["doc_id", "n"]).select("lang", "source", "doc_id", "n", "line"))


@query
def structural_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps that the records of the results open, as far as the results don't list them."""
    x = dealt_bodies(spark, d)
    opened = audit.record_gaps(ingest.employment(x, "body"), ingest.education(x, "body"), ingest.grants(x, "body"), "doc_id")
    return audit.structural_gaps(opened, ingest.gaps(x, "body"), "doc_id")


GROUPS = {"journals": ["peerReviewedJournals"], "other": ["otherArticles", "otherProceedings", "refereedProceedings"], "rest": ["abstracts", "workInProgress", "books"]}


@query
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.section_counts(pubs(spark, d), "doc_id", "bucket", GROUPS)


@query
def section_summary(spark: SparkSession, d: str) -> DataFrame:
    gaps = v.view(spark, d, v.GAPS_SRC).select((F.col("doc_id") % 100).alias("doc_id"), "severity")
    notes = v.table(spark, d, "conversations").select((F.col("conv_id") % 100).alias("doc_id"))
    return audit.section_summary(pubs(spark, d), gaps, notes, "doc_id", "bucket", GROUPS)


@query
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.GAPS_SRC).select((F.col("doc_id") % 50).alias("group_id"), "severity", "section", "field", F.col("doc_id").cast("string").alias("instruction"), "doc_id")
    return big(audit.summary_order(x, "group_id", ["doc_id"]).drop("doc_id"))


@query
def gap_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many gaps the whole corpus has, by section and severity, by severity, by document and in all."""
    return audit.gap_totals(v.view(spark, d, v.GAPS_SRC).select("doc_id", "section", "severity"), "doc_id")


def due(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.OUTCOMES)
    kinds = x.select("slice_key").distinct()
    return x.select("job_id").distinct().crossJoin(kinds)


def states(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.OUTCOMES)
    return jobs.slice_states(due(spark, d), x, "job_id", "slice_key", "state")


@query
def final_state(spark: SparkSession, d: str) -> DataFrame:
    return big(jobs.final_state(states(spark, d), "job_id", "slice_key", F.col("state")))


@query
def job_status(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.OUTCOMES)
    last = F.max("ts").alias("finished")
    j = x.groupBy("job_id").agg(F.min("ts").alias("started"), last, F.count(F.lit(1)).alias("k"))
    final = F.when(F.col("job_id") % 5 == 0, F.lit("complete")).when(F.col("job_id") % 5 == 1, F.lit("failed_partial")).when(F.col("job_id") % 5 == 2, F.lit("failed"))
    j = j.select("job_id", "started", final.alias("final_state"), "finished", (F.col("job_id") % 2 == 0).alias("has_result"), (F.col("job_id") % 3 == 0).alias("locked"))
    return big(jobs.job_status(j, states(spark, d), "job_id", F.to_timestamp(F.lit(NOW))))


def _fails(*when: tuple[int, int]) -> Callable[[str, str, int, int], list[str]]:
    """An extractor for the query below: attempt n fails on bodies whose length the n-th number divides, others give their lines."""

    def run(body: str, bucket: str, max_tokens: int, attempt: int) -> list[str]:
        name, divisor = when[attempt - 1]
        if len(body) % divisor == 0:
            raise ValueError(f"{name} {attempt}")
        return body.split("\n")

    return run


@query
def extract_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Each document through its language's extractors, with second attempts and fallbacks, and what came of it."""
    docs = v.table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("slice_key"), F.col("source").alias("bucket"), F.coalesce("text", F.lit("")).alias("body"))
    tiers = jobs.route_candidates(docs.select("slice_key", (F.col("slice_key") == "en").alias("high_fidelity")).distinct())
    made = jobs.extract_attempts(docs, "doc_id", tiers, {"cloud": _fails(("cloud", 3)), "onPrem": _fails(("onPrem", 2), ("onPrem", 5))})
    made = saved(made.withColumn("n_texts", F.size("texts")).drop("texts"), "attempts")  # an attempt is made once, whatever reads it
    found = jobs.resolve_attempts(made, ["doc_id", "slice_key"], F.col("ok"), "n_texts", ["rank", "attempt"], "error")
    return big(found.join(made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempts")), "doc_id"))


#: Slices in these tables lie years apart, so they turn stale after a year; the moment at which jobs are looked at.
LIVE_SECONDS, LIVE_NOW = 365 * 86400, "2001-01-01 00:00:00"


@query
def live_status(spark: SparkSession, d: str) -> DataFrame:
    """How far orders have come, a line a slice, whose shipping is its outcome: pending, merging, failed, with slices that turned stale."""
    from rollcall.streaming import outcomes as so

    now = F.to_timestamp(F.lit(LIVE_NOW))
    lines = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("string").alias("slice_key"), F.col("l_shipdate").cast("timestamp").alias("ts"),
                                                 F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("state"))
    started = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("started"))
    wanted = saved(lines.join(started, "job_id").select("job_id", "slice_key", "started").distinct().filter(F.col("started") <= now), "due")
    outcomes = lines.filter(F.col("ts") <= now)
    paths = {x: _shared(spark, x) for x in ("due-stream", "outcome-stream", "live", "live-checkpoint")}
    cuts = [None, "1997-01-01", "1999-01-01", None]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # what has come by then, before the next
        for df, at, path in ((wanted, "started", "due-stream"), (outcomes, "ts", "outcome-stream")):
            between = (F.lit(True) if lo is None else F.col(at) > lo) & (F.lit(True) if hi is None else F.col(at) <= hi)
            df.filter(between).write.mode("append").parquet(paths[path])
        streams = [so.read_outcomes(spark, paths[p], df.schema) for p, df in (("due-stream", wanted), ("outcome-stream", outcomes))]
        so.live_slices(*streams, LIVE_SECONDS).writeStream.format("parquet").option("path", paths["live"]).option("checkpointLocation", paths["live-checkpoint"]).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination()
    live = spark.read.parquet(paths["live"])
    stale = live.filter("state = 'stale'").groupBy("job_id").agg(F.count_distinct("slice_key").alias("stale"))
    known = jobs.slice_states(wanted.select("job_id", "slice_key"), live.filter("state <> 'stale'"), "job_id", "slice_key", "state")
    every = wanted.groupBy("job_id").agg(F.min("started").alias("started")).select(
        "job_id", "started", F.lit(None).cast("string").alias("final_state"), F.lit(None).cast("timestamp").alias("finished"), F.lit(False).alias("has_result"), (F.col("job_id") % 3 == 0).alias("locked"))
    out = jobs.job_status(every, known, "job_id", now, LIVE_SECONDS).join(stale, "job_id", "left")
    # The watermark stands at the last event, so slices of the last moments may be over age and not yet told.
    return big(out.select("job_id", "status", "done", "failed", (F.coalesce("stale", F.lit(0)) <= F.col("failed")).alias("stale_counted")))


@query
def purged_store(spark: SparkSession, d: str) -> DataFrame:
    """Sources of jobs kept in files, of which those of every ended job are removed; what is left."""
    path, schema = _shared(spark, "job-sources"), "doc_id bigint, text string, job_id bigint"
    files.write_sources(v.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 200).alias("job_id")), path)
    ended = jobs.final_state(states(spark, d), "job_id", "slice_key")
    files.purge(spark, path, schema, ended)
    return files.read_sources(spark, path, schema).select("doc_id", "job_id", F.md5("text").alias("text_md5"))


@query
def resolved_attempts(spark: SparkSession, d: str) -> DataFrame:
    x = v.view(spark, d, v.OUTCOMES)
    return jobs.resolve_attempts(x, ["job_id", "slice_key"], F.col("state") == "done", "event_id", ["attempt", "event_id"], "message").withColumnRenamed("event_id", "result")


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    x = v.table(spark, d, "conversations").select("conv_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("name"), "text")
    return files.content_hash(x, "conv_id", "name", "text")


@query
def reprocess_plan(spark: SparkSession, d: str) -> DataFrame:
    x = v.table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), F.when(F.col("doc_id") % 4 == 0, 2001).alias("since_year"))
    store = x.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("edited")).otherwise(F.col("hash")).alias("hash"), F.lit(1990).alias("since_year"))
    return big(jobs.plan_reprocess(x, kept_run(store, ["doc_id", "hash"]), "doc_id").select("doc_id", "action", "since_year"))


@query
def purged_sources(spark: SparkSession, d: str) -> DataFrame:
    done = jobs.final_state(states(spark, d), "job_id", "slice_key").filter("state = 'complete'")
    x = v.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 200).alias("job_id"))
    return files.purge_sources(x, done).select("doc_id", "job_id")


ORDER_LAYOUT = (("Urgent", "1-URGENT", "None."), ("High", "2-HIGH", None), ("Low", "5-LOW", "None submitted with file."), ("Medium", "3-MEDIUM", None), ("Unspecified", "4-NOT SPECIFIED", "None."))


@query
def rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    return big(layout.render_lines(docs, chrono_numbered_records(spark, d), "doc_id", ORDER_LAYOUT))


@query
def result_json(spark: SparkSession, d: str) -> DataFrame:
    return files.write_result_json(orders(spark, d), "doc_id").select("doc_id", F.md5("result").alias("result_md5"))


@query
def explode_buckets(spark: SparkSession, d: str) -> DataFrame:
    parts = orders(spark, d).withColumn("slice_seq", F.col("ord") % 3).groupBy("doc_id", "slice_seq").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") % 2 == 0, F.struct("ord", "status")))), lambda x: x["status"]).alias("even"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") % 2 == 1, F.struct("ord", "status")))), lambda x: x["status"]).alias("odd"))
    return big(ingest.buckets(parts, "doc_id", {"even": "evens", "odd": "odds"}, ["slice_seq"]))


@query
def anchor_counts(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each whole passage, and each short phrase from it, stands."""
    b = v.table(spark, d, "benchmark").select("text")
    anchors = b.select(F.col("text").alias("anchor")).unionAll(b.select(F.substring_index("text", " ", 8))).unionAll(b.select(F.concat(F.substring_index("text", " ", 2), F.lit("|"), F.substring_index("text", " ", -5)).alias("anchor"))).distinct()
    return audit.anchor_counts(v.table(spark, d, "documents"), anchors, "text")


@query
def duplicate_inventory(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_inventory(corpus_lines(spark, d), ["source"], t.norm_record("line"))


RENAMED = "Talk at the World Congress|Prize for teaching|Visiting Scholar"


def kept_run(df: DataFrame, keys: list[str]) -> DataFrame:
    """df as a stored run, opened again."""
    path = _shared(df.sparkSession, "run")
    runs.write_run(df, path, keys)
    return runs.open_run(df.sparkSession, path)


@query
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    """What differs between two stored runs."""
    keys = ["doc_id", "bucket", "number"]
    return audit.diff_runs(kept_run(chrono_numbered_records(spark, d), keys), kept_run(second_run(spark, d), keys), keys, ["text"])


def second_run(spark: SparkSession, d: str) -> DataFrame:
    """Another run over the same records, in which talks at a congress lost their words: records change and become repeats."""
    clean = orders(spark, d).withColumn("text", dates.clean_record(F.regexp_replace("text", RENAMED, "Seminar (poster)")))
    return big(rec.number_by_date(rec.dedupe_first(clean, ["doc_id", "bucket"], t.norm_dedupe("text"), ["ord"]), ["doc_id", "bucket"], F.col("text"), ["ord"]))


@query
def new_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Repeats, dates left aside, that the second run has and the first one had not."""
    of = lambda x: kept_run(audit.duplicate_inventory(x, ["doc_id"], t.activity_core("text")), ["doc_id", "key"])
    return audit.new_duplicates(of(chrono_numbered_records(spark, d)), of(second_run(spark, d)), ["doc_id", "key"])


@query
def count_tolerance(spark: SparkSession, d: str) -> DataFrame:
    x = pubs(spark, d)
    a, b = (y.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")) for y in (x, rec.reclassify(rec.move_in_progress(x))))
    share = F.when(F.col("bucket") == "peerReviewedJournals", F.lit(0.02)).otherwise(F.lit(0.1))
    return audit.count_tolerance(a, b, "bucket", "n", share)


@query
def date_precision(spark: SparkSession, d: str) -> DataFrame:
    x = orders(spark, d)
    checks = spark.createDataFrame([("topic 3", "1997)"), ("topic 5", "topic 5"), ("no such", "1999")], "anchor string, date string")
    return audit.date_precision(x.select("ord", dates.clean_record("text").alias("text")), checks, "text")


@query
def file_admission(spark: SparkSession, d: str) -> DataFrame:
    """Which of the documents would be taken as files, by name and size, and why the others wouldn't."""
    return files.admit_files(v.view(spark, d, v.FILES)).select("path", "length", "reject")


@query
def partials(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes kept by slice: all slices are written, then some again with what is done; the others stay."""
    x = v.view(spark, d, v.OUTCOMES).select("job_id", "event_id", "state", "slice_key")
    path = _shared(spark, "partials")
    files.write_partials(x, path)
    files.write_partials(x.filter("state = 'done' and slice_key < 'm'"), path)
    return files.read_partials(spark, path, "job_id bigint, event_id bigint, state string, slice_key string")


_shared = stored_parts.shared_path


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = _shared(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def outcome_parts(spark: SparkSession, d: str, by_delivery: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Outcomes, and the same as parts that arrive one after another: by time, or each slice's first outcome before its repeats."""
    out = v.view(spark, d, v.OUTCOMES).select("job_id", "slice_key", "state", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    if by_delivery:
        w = rec.Window.partitionBy("job_id", "slice_key").orderBy("ts", "event_id")
        ranked = out.withColumn("_k", F.row_number().over(w))
        return out, [ranked.filter(when).drop("_k") for when in ("_k = 1", "_k > 1")]
    at = F.unix_micros("ts")
    cuts = [None, *map(int, out.select(at.alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01)), None]
    between = lambda lo, hi: (F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi)
    return out, [out.filter(between(lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def run_stream(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs a stream over parts as they arrive, into Parquet (append) or the last value of each key (update)."""
    at = _shared(spark, "stream")

    def start(stream: DataFrame, check: str):
        if mode == "append":
            return stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", check).outputMode("append")
        return stream.writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/b={i}")).option("checkpointLocation", check).outputMode("update")

    feed(spark, parts, lambda stream, check: start(make(stream), check))
    return spark.read.parquet(at)


def feed(spark: SparkSession, parts: list[DataFrame], writer: Callable) -> None:
    """Writes each part into a folder that a stream reads, and lets the stream take it before the next one comes."""
    from rollcall.streaming import outcomes as so

    source, check = _shared(spark, "outcomes"), _shared(spark, "stream-checkpoint")
    for part in parts:
        part.write.mode("append").parquet(source)
        writer(so.read_outcomes(spark, source, part.schema), check).trigger(availableNow=True).start().awaitTermination()


@query
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Which outcome of each slice is kept."""
    from rollcall.streaming import outcomes as so

    _, parts = outcome_parts(spark, d, by_delivery=True)
    out = run_stream(spark, parts, lambda x: so.first_outcomes(x, "3650 days"), "append")
    return out.select("job_id", "slice_key", "event_id", "state")


@query
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    from rollcall.streaming import outcomes as so

    _, parts = outcome_parts(spark, d)
    out = run_stream(spark, parts, lambda x: so.progress(x, "30 days", "3650 days"), "update")
    return out.groupBy("start", "state").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "state", "n")


#: Outcomes of a job in these tables lie days apart, so its time is counted in days here.
BARRIER_SLICES, BARRIER_SECONDS, BARRIER_KEPT = 5, 3 * 86400, 60 * 86400


@query
def stream_barrier(spark: SparkSession, d: str) -> DataFrame:
    """Jobs released once each, by completion or by time; the closing pass takes what the finite log leaves open."""
    from rollcall.streaming import outcomes as so

    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        x, parts = outcome_parts(spark, d)
        released = run_stream(spark, parts, lambda y: so.completion_barrier(y, BARRIER_SLICES, seconds=BARRIER_SECONDS, keep_seconds=BARRIER_KEPT), "append")
    finally:
        spark.conf.set(name, held) if held else spark.conf.unset(name)
    return released.unionByName(so.close_open_jobs(x, released, BARRIER_SLICES, BARRIER_SECONDS)).select("job_id", "done", "failed", "complete")


@query
def stream_finalize(spark: SparkSession, d: str) -> DataFrame:
    """Each job's merged slices with the status that was written last."""
    from rollcall.streaming import outcomes as so

    x, parts = outcome_parts(spark, d)
    at = _shared(spark, "final")
    # A job that a batch names is merged again from the whole log.
    of = lambda b: x.join(b.select("job_id").distinct(), "job_id")
    whole = lambda b: of(b).groupBy("job_id", "slice_key").agg(F.count(F.lit(1)).alias("n"))
    kinds = v.view(spark, d, v.OUTCOMES).select("slice_key").distinct()
    ended = lambda b: jobs.final_state(jobs.slice_states(of(b).select("job_id").distinct().crossJoin(F.broadcast(kinds)), of(b), "job_id", "slice_key", "state"), "job_id", "slice_key")
    feed(spark, parts, lambda stream, check: so.finalize(so.first_outcomes(stream, "3650 days"), whole, ended, at, check))
    results, status = so.read_final(spark, at)
    return results.join(status, "job_id").select("job_id", "slice_key", "n", "state")


@query
def consolidated_citations(spark: SparkSession, d: str) -> DataFrame:
    """The merge over citations: in progress, reclassified, cleaned, copies merged, numbered by date."""
    from rollcall.plans.consolidate import consolidate

    return big(consolidate(pubs(spark, d)).select("doc_id", "bucket", "number", "text", "pub_type"))


@query
def consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The whole merge of all kinds of records: moved, cleaned, reconciled, without repeats, in order, with notes and gaps."""
    from rollcall.plans.consolidate import merge_results

    return merge_results(dealt_bodies(spark, d)).long()


@query
def rendered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's whole form as lines, with the summary of what is left to do."""
    from rollcall.plans.consolidate import merge_results

    return big(layout.render_documents(merge_results(dealt_bodies(spark, d)).kept(stored_parts.kept_by_document), "doc_id", CUTOFF, SINCE, "Form", ("Signature: ________", "Date: ________"), stored_parts.kept_by_document))


@query
def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's whole result as one nested JSON text: sections with typed records, gaps, notes and metadata."""
    from rollcall.plans.consolidate import merge_results

    return merge_results(dealt_bodies(spark, d)).kept(stored_parts.kept_by_document).documents().select("doc_id", F.md5("result").alias("result_md5"))
