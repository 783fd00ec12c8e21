"""The merge of extraction results, in the order in which its steps depend on each other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import dates, patterns as p, text as t
from rollcall.functions.text import squeeze, strip_source_number
from rollcall.operators import audit, fuzzy, records as rec
from rollcall.sources import ingest, parts as stored_parts

DOC = "doc_id"
SERVICE, ACTIVITIES, TALKS = "universityService", ("professionalActivities", "externalProfessionalActivities"), ("presentations", "invitedPresentations")


def consolidate(pubs: DataFrame) -> DataFrame:
    """Citations (doc_id, bucket, ord, text, pub_type, note, is_new) as numbered bibliographies.

    Unpublished ones are moved first, as they are not reclassified; copies are merged after the dates are known, since the first copy is the
    oldest; numbers come last.  All steps work within a document, and after the first exchange on it no step needs
    another but the merge on (document, bucket, citation).
    """
    moved = rec.reclassify(rec.move_in_progress(pubs))
    kept = rec.proceedings_anti(moved, [DOC])
    clean = kept.withColumn("text", squeeze(strip_source_number("text")))
    ordered = rec.number_by_date(clean, [DOC, "bucket"], F.col("text"), ["moved", "ord", "text"], "place").drop("ord").withColumnRenamed("place", "ord")
    flags = tuple(c for c in ("is_new", "is_own_thesis") if c in pubs.columns)
    optional = tuple(c for c in ("note", "article_kind", "originalNumber", "previouslyListedAs", "reviewMaterialUrl") if c in pubs.columns)
    merged = rec.merge_duplicates(ordered, [DOC], optional=optional, flags=flags)
    return rec.renumber(merged, [DOC, "bucket"], ["ord"])


@dataclass
class Merged:
    """The tables of all documents' results; each has doc_id, and number where its records are in order."""

    publications: DataFrame
    texts: DataFrame
    services: DataFrame
    grants: DataFrame
    groups: DataFrame
    employment: DataFrame
    education: DataFrame
    notes: DataFrame
    gaps: DataFrame
    metadata: DataFrame

    def kept(self, saved: Callable[[DataFrame, str], DataFrame]) -> Merged:
        """The same tables written and read again, for what reads them many times."""
        return Merged(**{f.name: saved(getattr(self, f.name), f.name) for f in fields(self)})

    def long(self) -> DataFrame:
        """All records as doc_id, bucket, number, text and detail."""
        rows = lambda df, bucket, text, *detail: df.select(DOC, bucket.alias("bucket"), F.col("number").cast("long").alias("number"), F.col(text).alias("text"), F.concat_ws("|", *detail).alias("detail"))
        lit = F.lit
        parts = [rows(self.publications, F.col("bucket"), "text", "pub_type", "note", "article_kind", F.col("is_new").cast("string")), rows(self.texts, F.col("bucket"), "text", lit("")),
                 rows(self.services, lit("universityService"), "description", "category", "dates"), rows(self.grants, lit("grants"), "title", "funder", "period", "status", "role", "coPIsShare"),
                 rows(self.groups, lit("studentInstructionalGroups"), "entry", "heading"), rows(self.employment, lit("employment"), "rank", "institution", "location", "start", "finish"),
                 rows(self.education, lit("education"), "school", "degree", "location"), rows(self.notes, lit("reviewNotes"), "instruction", "section", "topic"),
                 rows(self.gaps, lit("gaps"), "instruction", "section", "field", "severity")]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionAll(x)
        return out


    def documents(self) -> DataFrame:
        """doc_id and result: JSON of a document's metadata, sections (lists of typed records, empty ones too), gaps and notes.

        Lists are merged where their documents lie.  Left to the planner they would be broadcast: it takes their size from the stored
        files, in which like records take next to nothing, and all documents' lists would pass through the driver.
        """
        struct = lambda names: F.struct(*[F.col(c).alias(n) for c, n in names.items()])

        def listed(df: DataFrame, name: str, names: dict[str, str], by: str | None = None) -> DataFrame:
            """One row a document: its records as a list, or lists by bucket, in order."""
            items = F.transform(F.array_sort(F.collect_list(F.struct("number", struct(names).alias("r")))), lambda x: x["r"])
            if by is None:
                return df.groupBy(DOC).agg(items.alias(name))
            return df.groupBy(DOC, by).agg(items.alias("l")).groupBy(DOC).agg(F.map_from_entries(F.collect_list(F.struct(by, "l"))).alias(name))

        same = lambda *names: {c: c for c in names}
        nested = rec.nested_groups(self.groups, DOC)
        whole = self.metadata
        for df in (
                listed(self.employment, "employment", {"start": "from", "finish": "to"} | same("institution", "location", "rank")),
                listed(self.education, "education", same("school", "datesFrom", "datesTo", "location", "major", "degree", "dateReceived")),
                listed(self.services, "services", same("description", "dates", "category")),
                listed(self.grants, "grants", same("title", "funder", "period", "status", "amount", "totalAward", "role", "coPIsShare")),
                nested, listed(self.texts.withColumn("r", F.col("text")), "texts", {"text": "text"}, "bucket"),
                listed(self.publications, "cited", {"number": "number", "text": "citation", "pub_type": "type", "article_kind": "articleKind", "note": "contributionNote", "is_new": "isNewSinceLastReview"}, "bucket"),
                listed(self.notes, "reviewNotes", same("section", "topic", "instruction")), listed(self.gaps, "gaps", same("section", "field", "instruction", "severity"))):
            whole = whole.join(df.hint("merge"), DOC, "left")
        or_none = lambda c: F.coalesce(c, F.array())
        texts = [or_none(F.transform(F.try_element_at("texts", F.lit(b)), lambda x: x["text"])).alias(b) for b in p.STRING_BUCKETS]
        cited = [or_none(F.try_element_at("cited", F.lit(b))).alias(b) for b in p.PUBLICATION_BUCKETS]
        sections = F.struct(or_none(F.col("employment")).alias("employment"), or_none(F.col("education")).alias("education"), "specialization", or_none(F.col("services")).alias("universityService"), *texts,
                            or_none(F.col("groups")).alias("studentInstructionalGroups"), or_none(F.col("grants")).alias("grants"), *cited)
        body = F.struct(F.struct("name", "department", "title").alias("metadata"), sections.alias("sections"), or_none(F.col("gaps")).alias("gaps"), or_none(F.col("reviewNotes")).alias("reviewNotes"))
        return whole.select(DOC, F.to_json(body, {"ignoreNullFields": "false"}).alias("result"))


def merge_results(parts: DataFrame, body: str = "body", saved: Callable[[DataFrame, str], DataFrame] = stored_parts.kept_by_document) -> Merged:
    """Parts of documents' results (doc_id, part, body: JSON text) as one result for each document.

    Later parts come after earlier ones.  Bad elements are left out one by one, parts that are no objects as a whole.
    Bodies are parsed once and stored in buckets of documents (sources.parts), from which each kind of record reads its own columns;
    windows and aggregates by document need no exchange from there on.  saved: writes a table that several steps read, by document, and reads it again.
    """
    given = stored_parts.stored(parts, body)
    named = lambda *buckets: stored_parts.elements(given, buckets).withColumn("ord", F.struct("part", "pos"))

    pubs = ingest.publication_rows(named(*p.PUBLICATION_BUCKETS)).withColumnsRenamed({"citation": "text", "contributionNote": "note"}).drop("number")
    publications = saved(consolidate(pubs), "publications")
    employed = ingest.employment_rows(named("employment"))
    texts = ingest.string_rows(named(*p.STRING_BUCKETS)).select(DOC, "bucket", "ord", "text")
    texts = _with_awards(texts, employed).withColumn("text", dates.clean_record("text"))
    settled = saved(_settled(texts, _services(ingest.service_rows(named("universityService")))), "records")
    service, talk = F.col("bucket") == SERVICE, F.col("bucket").isin(*TALKS)
    conflicts = rec.core_conflicts(
        settled.filter(service | (F.col("bucket") == ACTIVITIES[0])).select(DOC, "bucket", F.struct("external", "ord").alias("ord"), F.col("text").alias("description"), "dates"), [DOC])
    talks = _talks(settled.filter(talk), publications.filter("bucket = 'abstracts'"), saved).withColumn("external", F.col("moved"))
    numbered = lambda df: rec.number_by_date(df.select(DOC, "bucket", "ord", "text", "external"), [DOC, "bucket"], F.col("text"), ["external", "ord"]).drop("external", "ord")
    listed = saved(numbered(settled.filter(~service & ~talk)).unionByName(numbered(talks)), "texts")

    services = settled.filter(service).withColumnRenamed("text", "description")
    service_key = F.concat_ws("|", "category", t.norm_dedupe("description"), t.norm_dedupe("dates"))
    unique_services = rec.dedupe_first(services, [DOC], service_key, ["ord"])
    unique_services = rec.number_by_date(unique_services, [DOC], F.concat_ws(" ", "dates", "description"), ["ord"])
    grants = rec.dedupe_first(ingest.grant_rows(named("grants")), [DOC], F.concat_ws("|", t.norm_dedupe("title"), t.norm_dedupe("funder"), t.norm_dedupe("period")), ["ord"])
    grants = rec.number_by_date(grants, [DOC], F.concat_ws(" ", "period", "title"), ["ord"])
    groups = ingest.group_rows(named("studentInstructionalGroups")).withColumn("entry", dates.clean_record("entry")).withColumn("ord", F.struct("ord", "entry_pos"))
    groups = rec.merge_groups(groups, DOC, "heading", "entry")
    employment = rec.renumber(rec.applicable_employment(employed), [DOC], ["ord"])
    education = rec.renumber(ingest.education_rows(named("education")), [DOC], ["ord"])

    notes = _notes(ingest.note_rows(stored_parts.listed(given, "reviewNotes")), conflicts, listed, groups, publications)
    gaps = _gaps(ingest.gap_rows(stored_parts.listed(given, "gaps")), employment, education, grants)
    return Merged(publications, listed, unique_services, grants, groups, employment, education, notes, gaps, stored_parts.metadata(given))


def _services(rows: DataFrame) -> DataFrame:
    both = dates.clean_service("description", "dates")
    return rows.withColumn("_both", both).withColumns({"description": F.col("_both.description"), "dates": F.col("_both.dates")}).drop("_both")


def _with_awards(texts: DataFrame, employed: DataFrame) -> DataFrame:
    """texts with honorific appointments as awards, unless one like it is there."""
    listed = lambda df, text: df.groupBy(DOC).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", text))), lambda x: x[text]).alias(text))
    held = listed(texts.filter("bucket = 'awards'"), "text")
    both = held.join(listed(rec.honorific_awards(employed), "award"), DOC, "full")
    out = both.select(DOC, F.posexplode(fuzzy.guarded_append(F.coalesce("text", F.array()), F.coalesce("award", F.array()))).alias("pos", "text"))
    part = texts.schema["ord"].dataType["part"].dataType.simpleString()
    awards = out.select(DOC, F.lit("awards").alias("bucket"), F.struct(F.lit(0).cast(part).alias("part"), "pos").alias("ord"), "text")
    return texts.filter("bucket <> 'awards'").unionByName(awards)


def _settled(texts: DataFrame, services: DataFrame) -> DataFrame:
    """All texts and services in one table: doc_id, bucket, ord, text, dates, category, external.

    Both buckets of activities are one; no list holds a text twice, and no activity is there that a service equals as a whole.
    """
    rows = texts.select(DOC, "bucket", "ord", "text", F.lit("").alias("dates"), F.lit(None).cast("string").alias("category")).unionByName(
        services.select(DOC, F.lit(SERVICE).alias("bucket"), "ord", F.col("description").alias("text"), "dates", "category"))
    rows = rows.withColumn("external", (F.col("bucket") == ACTIVITIES[1]).cast("int")).withColumn("bucket", F.when(F.col("external") == 1, ACTIVITIES[0]).otherwise(F.col("bucket")))
    activity, service = F.col("bucket") == ACTIVITIES[0], F.col("bucket") == SERVICE
    rows = rows.repartition(DOC)  # the union lies no longer by document; windows and the table written take this one exchange
    key = F.when(activity, t.norm_record("text")).when(~service, t.norm_dedupe("text"))
    first = F.row_number().over(rec.Window.partitionBy(DOC, "bucket", "_key").orderBy("external", "ord"))
    once = rows.withColumn("_key", key).withColumn("_n", first).filter(service | (F.col("_key") != "") & (F.col("_n") == 1)).drop("_key", "_n")
    return rec.without_keys_of(once, [DOC], ACTIVITIES[0], SERVICE, F.when(activity | service, t.norm_service("text", F.col("dates"))))


def _talks(once: DataFrame, abstracts: DataFrame, saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Talks, none twice in a list, in the bucket where they belong, without repeats and without dated ones that an abstract nearly equals."""
    routed = saved(rec.dedupe_first(rec.route_presentations(once), [DOC, "bucket"], t.norm_dedupe("text"), ["moved", "ord"]), "talks")
    keyed = routed.withColumn("_talk", F.md5(F.concat_ws("\n", F.col(DOC).cast("string"), "bucket", t.norm_dedupe("text"))))
    of = abstracts.select(DOC, F.concat_ws("/", DOC, "number").alias("_talk"), "text")
    dated = F.col("text").rlike(rf"{p.LEFT}(?:19|20)\d{{2}}{p.RIGHT}")
    return fuzzy.without_fuzzy_copies(keyed, of, "_talk", "text", dated, within=DOC).select(DOC, "bucket", "ord", "text", "moved")


def _placed(df: DataFrame, sections: tuple[tuple[str, str], ...], order: list[str]) -> DataFrame:
    """Rows of the buckets named in sections, with the section and their order over all of them."""
    name = F.create_map(*[F.lit(x) for s, b in sections for x in (b, s)])
    place = F.create_map(*[F.lit(x) for i, (_, b) in enumerate(sections) for x in (b, i)])
    rows = df.filter(F.col("bucket").isin(*[b for _, b in sections]))
    return rows.select(DOC, name[F.col("bucket")].alias("section"), F.struct(place[F.col("bucket")].alias("a"), *order).alias("place"), "text")


def _notes(given: DataFrame, conflicts: DataFrame, texts: DataFrame, groups: DataFrame, publications: DataFrame) -> DataFrame:
    at = lambda stage, *more: F.struct(F.lit(stage).alias("stage"), *[m.cast("long").alias(f"o{i}") for i, m in enumerate(more)])
    none = F.lit(0)
    incoming = given.select(DOC, "section", "topic", "instruction", at(0, F.col("part"), F.col("pos"), none, none).alias("place"))
    section, topic, lead = p.CONFLICT_NOTE
    o = F.col("ord")
    wording = conflicts.select(DOC, F.lit(section).alias("section"), F.lit(topic).alias("topic"), F.concat(F.lit(lead), "conflict").alias("instruction"),
                               at(1, o["external"], o["ord"]["part"], o["ord"]["pos"], none).alias("place"))
    entries = groups.select(DOC, F.lit("studentInstructionalGroups").alias("bucket"), F.col("entry").alias("text"),
                            F.row_number().over(rec.Window.partitionBy(DOC).orderBy("heading_order", "number")).alias("number"))
    listed = texts.select(DOC, "bucket", "text", "number").unionByName(entries)
    repeats = []
    for stage, rows, sections, (topic, lead), key in (
            (2, listed, p.ACTIVITY_SECTIONS, p.ACTIVITY_NOTE, audit.review_key("text")), (3, publications, p.PUBLICATION_SECTIONS, p.PUBLICATION_NOTE, t.norm_citation("text"))):
        found = audit.cross_bucket_notes(_placed(rows, sections, ["number"]), DOC, "section", "text", key, ["place"])
        repeats.append(found.select(DOC, "section", F.lit(topic).alias("topic"), F.concat(F.lit(lead), "item").alias("instruction"),
                                    at(stage, F.col("place.a"), F.col("place.number"), none, none).alias("place")))
    every = incoming.unionByName(wording).unionByName(repeats[0]).unionByName(repeats[1])
    return rec.renumber(audit.dedupe_notes(every, DOC, ("section", "topic", "instruction"), ["place"]), [DOC], ["place"])


def _gaps(given: DataFrame, employment: DataFrame, education: DataFrame, grants: DataFrame) -> DataFrame:
    own = audit.structural_gaps(audit.record_gaps(employment, education, grants, DOC), given, DOC)
    rule = F.create_map(*[F.lit(x) for i, r in enumerate(audit.GAP_RULES) for x in (r[3], i)])
    place = lambda late, a, b: F.struct(F.lit(late).alias("late"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    columns = [DOC, "section", "field", "instruction", "severity"]
    every = given.select(*columns, place(0, F.col("part"), F.col("pos")).alias("place")).unionByName(own.select(*columns, place(1, rule[F.col("field")], F.lit(0)).alias("place")))
    return rec.renumber(every, [DOC], ["place"])
