"""Untrusted extraction results into typed rows, and what was wrong with the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import patterns as p
from rollcall.functions.text import trim


def without_fences(c: Column | str) -> Column:
    """JSON text without a Markdown code fence around it; only texts with a fence in them are searched for one."""
    c = F.col(c) if isinstance(c, str) else c
    bare = trim(F.regexp_replace(F.regexp_replace(trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.when(c.contains("```"), bare).otherwise(trim(c))


def _kind(v: str) -> Column:
    return F.schema_of_variant(F.col(v))


def text_of(v: str, path: str) -> Column:
    """A field's text: strings trimmed, finite numbers as text, anything else ''."""
    field = F.try_variant_get(F.col(v), path, "variant")
    kind = F.schema_of_variant(field)
    good = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(good, trim(F.try_variant_get(F.col(v), path, "string"))).otherwise(F.lit(""))


def _flag(v: str, path: str) -> Column:
    field = F.try_variant_get(F.col(v), path, "variant")
    return F.when(F.schema_of_variant(field) == "BOOLEAN", F.try_variant_get(F.col(v), path, "boolean"))


def _optional(v: str, path: str) -> Column:
    return F.nullif(text_of(v, path), F.lit(""))


def _one_of(c: Column, known: tuple[str, ...], other: str) -> Column:
    return F.when(c.isin(*known), c).otherwise(F.lit(other))


def parsed(df: DataFrame, body: str) -> DataFrame:
    """df with doc, the body as VARIANT, and is_object."""
    doc = df.withColumn("_v", F.try_parse_json(without_fences(body)))
    return doc.withColumn("is_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))


def quarantine(df: DataFrame, body: str) -> DataFrame:
    """Rows whose body is no JSON object, with the reason."""
    bad = parsed(df, body).filter(~F.col("is_object"))
    return bad.withColumn("reason", F.when(F.col("_v").isNull(), "not JSON").otherwise("not an object")).drop("_v", "is_object")


def elements(df: DataFrame, path: str) -> DataFrame:
    """One row for each element of the array at path of doc: pos and value.

    What is no array, or lies in a body that is no object, has no elements, so nothing is filtered before: a filter
    would be moved below the parsing and parse each body again.
    """
    view = df.withColumn("_list", F.try_variant_get("_v", path, "variant")).drop("_v", "is_object")
    return listed(view)


def listed(view: DataFrame, pos: str = "pos") -> DataFrame:
    """A row for each element of _list, an array: its position and value; none for anything else, an object's fields neither."""
    from pyspark.sql import SparkSession

    inner = SparkSession.active().tvf.variant_explode(F.col("_list").outer()).select(F.col("pos").alias(pos), F.col("key").alias("_key"), "value")
    return view.lateralJoin(inner).filter("_key is null").drop("_key", "_list")


def section_elements(df: DataFrame, body: str) -> DataFrame:
    """One row for each element of each section that is an array: bucket, pos and value; the body is parsed once for all of them."""
    from pyspark.sql import SparkSession

    view = parsed(df, body).withColumn("_sections", F.try_variant_get("_v", "$.sections", "variant")).drop("_v", "is_object", body)
    fields = SparkSession.active().tvf.variant_explode(F.col("_sections").outer()).select(F.col("key").alias("bucket"), F.col("value").alias("_list"))
    return listed(view.lateralJoin(fields).drop("_sections").filter("bucket is not null"))


def _objects(e: DataFrame) -> DataFrame:
    return e.filter(_kind("value").startswith("OBJECT"))


def _with_texts(e: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return _objects(e).withColumns({c: text_of("value", f"$.{c}") for c in names})


def _of(df: DataFrame, body: str, bucket: str) -> DataFrame:
    return elements(parsed(df, body), f"$.sections.{bucket}").drop(body).withColumn("bucket", F.lit(bucket))


def publication_rows(e: DataFrame) -> DataFrame:
    """Elements as publications: one that is no object or has no citation is left out, and only it."""
    rows = _with_texts(e, ("citation",)).filter("citation <> ''")
    # A whole number, or text that is one; else the position.
    number = F.coalesce(text_of("value", "$.number").try_cast("double"), (F.col("pos") + 1).cast("double"))
    kind = _optional("value", "$.articleKind")
    return rows.select(
        "*", number.alias("number"), _one_of(text_of("value", "$.type"), p.PUBLICATION_TYPES, "other").alias("pub_type"),
        F.when(kind.isin("research", "review", "creative", "other"), kind).alias("article_kind"),
        *[_optional("value", f"$.{c}").alias(c) for c in ("originalNumber", "previouslyListedAs", "contributionNote", "reviewMaterialUrl")],
        _flag("value", "$.isNewSinceLastReview").alias("is_new"), _flag("value", "$.isFacultyThesis").alias("is_own_thesis")).drop("value")


def string_rows(e: DataFrame) -> DataFrame:
    """Elements as texts; blanks and values that are no text or number are left out."""
    return e.withColumn("text", text_of("value", "$")).filter("text <> ''").drop("value")


def service_rows(e: DataFrame) -> DataFrame:
    rows = _with_texts(e, ("description", "dates", "category")).filter("description <> ''")
    return rows.withColumn("category", _one_of(F.col("category"), p.SERVICE_CATEGORIES, "other")).drop("value")


def grant_rows(e: DataFrame) -> DataFrame:
    rows = _with_texts(e, ("title", "funder", "period")).filter("title <> '' or funder <> ''")
    return rows.withColumns({"status": _one_of(text_of("value", "$.status"), ("current",), "past")} | {
        c: _optional("value", f"$.{c}") for c in ("amount", "totalAward", "role", "coPIsShare")}).drop("value")


def employment_rows(e: DataFrame) -> DataFrame:
    rows = _with_texts(e, ("from", "to", "institution", "location", "rank")).filter("institution <> '' or rank <> ''")
    return rows.withColumnsRenamed({"from": "start", "to": "finish"}).drop("value")


def education_rows(e: DataFrame) -> DataFrame:
    names = ("school", "datesFrom", "datesTo", "location", "major", "degree", "dateReceived")
    return _with_texts(e, names).filter("school <> '' or degree <> ''").drop("value")


def group_rows(e: DataFrame) -> DataFrame:
    """Student groups, a row for each entry (entry_pos, entry); a group without a heading or an entry is left out."""
    rows = _with_texts(e, ("heading",)).filter("heading <> ''").withColumn("_list", F.try_variant_get("value", "$.entries", "variant")).drop("value")
    return listed(rows, "entry_pos").withColumn("entry", text_of("value", "$")).filter("entry <> ''").drop("value")


def gap_rows(e: DataFrame) -> DataFrame:
    rows = _with_texts(e, ("section", "field", "instruction", "severity")).filter("section <> '' or field <> '' or instruction <> ''")
    return rows.withColumn("severity", _one_of(F.col("severity"), p.SEVERITIES, "optional")).drop("value")


def note_rows(e: DataFrame) -> DataFrame:
    return _with_texts(e, ("section", "topic", "instruction")).filter("instruction <> ''").drop("value")


def publications(df: DataFrame, body: str, bucket: str) -> DataFrame:
    """Publication rows of one bucket."""
    return publication_rows(_of(df, body, bucket))


def string_list(df: DataFrame, body: str, bucket: str) -> DataFrame:
    """Texts of one string bucket."""
    return string_rows(_of(df, body, bucket))


def services(df: DataFrame, body: str) -> DataFrame:
    return service_rows(_of(df, body, "universityService"))


def grants(df: DataFrame, body: str) -> DataFrame:
    return grant_rows(_of(df, body, "grants"))


def employment(df: DataFrame, body: str) -> DataFrame:
    return employment_rows(_of(df, body, "employment"))


def education(df: DataFrame, body: str) -> DataFrame:
    return education_rows(_of(df, body, "education"))


def groups(df: DataFrame, body: str) -> DataFrame:
    return group_rows(_of(df, body, "studentInstructionalGroups"))


def gaps(df: DataFrame, body: str) -> DataFrame:
    return gap_rows(elements(parsed(df, body), "$.gaps").drop(body))


def review_notes(df: DataFrame, body: str) -> DataFrame:
    return note_rows(elements(parsed(df, body), "$.reviewNotes").drop(body))


def metadata(df: DataFrame, doc: str, body: str, order: str) -> DataFrame:
    """One row a document: a later part's values win, blank ones too; the specialization is the first that isn't blank."""
    v = parsed(df, body).withColumn("_meta", F.schema_of_variant(F.try_variant_get("_v", "$.metadata", "variant")).startswith("OBJECT"))
    last = lambda c: F.coalesce(F.max_by(text_of("_v", f"$.metadata.{c}"), F.when(F.col("_meta"), F.col(order))), F.lit("")).alias(c)
    special = text_of("_v", "$.sections.specialization")
    # Documents without a part that is an object go after the aggregate, as a filter before it would parse each body again.
    out = v.groupBy(doc).agg(last("name"), last("department"), last("title"), F.coalesce(F.min_by(special, F.when(special != "", F.col(order))), F.lit("")).alias("specialization"), F.bool_or("is_object").alias("_any"))
    return out.filter("_any").drop("_any")


def validate_strict(df: DataFrame, body: str, fields: dict[str, str], enums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """df with valid: the body is an object, each field has its type (STRING, BIGINT, DOUBLE, BOOLEAN) and enumerated ones a known value."""
    v = parsed(df, body)
    ok = F.col("is_object")
    for name, kind in fields.items():
        found = F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
        number = found.isin("BIGINT", "DOUBLE") | found.startswith("DECIMAL")
        ok &= F.coalesce(number if kind == "DOUBLE" else found == kind, F.lit(False))
    for name, known in (enums or {}).items():
        ok &= F.coalesce(F.try_variant_get("_v", f"$.{name}", "string").isin(*known), F.lit(False))
    return v.withColumn("valid", ok).drop("_v", "is_object")


def _is(c: Column, *kinds: str) -> Column:
    """Whether a variant is there and of one of the kinds; a JSON null is a value of its own kind."""
    kind = F.schema_of_variant(c)
    return F.coalesce(reduce(Column.__or__, [kind.startswith(k) for k in kinds]), F.lit(False))


def _list_of(c: Column, check: Callable[[Column], Column]) -> Column:
    return _is(c, "ARRAY") & F.coalesce(F.forall(F.try_variant_get(c, "$", "array<variant>"), check), F.lit(False))


def _entry(texts: tuple[str, ...], optional: tuple[str, ...] = (), known: dict[str, tuple[str, ...]] | None = None, flags: tuple[str, ...] = (),
           maybe_known: dict[str, tuple[str, ...]] | None = None, numbers: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """A check of one object: its texts are there, optional ones are texts if they are there, known ones have a known value."""

    def check(x: Column) -> Column:
        get = lambda name: F.try_variant_get(x, f"$.{name}", "variant")
        word = lambda name: F.try_variant_get(x, f"$.{name}", "string")
        ok = [_is(x, "OBJECT"), *[_is(get(c), "STRING") for c in texts], *[get(c).isNull() | _is(get(c), "STRING") for c in optional],
              *[get(c).isNull() | _is(get(c), "BOOLEAN") for c in flags], *[_is(get(c), "BIGINT", "DOUBLE", "DECIMAL") for c in numbers],
              *[_is(get(c), "STRING") & word(c).isin(*values) for c, values in (known or {}).items()],
              *[get(c).isNull() | (_is(get(c), "STRING") & word(c).isin(*values)) for c, values in (maybe_known or {}).items()]]
        return F.coalesce(reduce(Column.__and__, ok), F.lit(False))

    return check


_CHECKS = {
    "employment": _entry(("from", "to", "institution", "location", "rank")),
    "education": _entry(("school", "datesFrom", "datesTo", "location", "major", "degree", "dateReceived")),
    "universityService": _entry(("description", "dates"), known={"category": p.SERVICE_CATEGORIES}),
    "grants": _entry(("title", "funder", "period"), ("amount", "totalAward", "role", "coPIsShare"), known={"status": ("current", "past")}),
}
_PUBLICATION = _entry(
    ("citation",), ("originalNumber", "previouslyListedAs", "contributionNote", "reviewMaterialUrl"), known={"type": p.PUBLICATION_TYPES},
    flags=("isNewSinceLastReview", "isFacultyThesis"), maybe_known={"articleKind": ("research", "review", "creative", "other")}, numbers=("number",))


def _is_text(x: Column) -> Column:
    return _is(x, "STRING")


def validate_result(df: DataFrame, body: str) -> DataFrame:
    """df with valid: the body is a whole result, every list there and every element of every list as it has to be.

    Whole results are taken or refused as they are; nothing is repaired.  A field that may be absent mustn't be null.
    """
    v = parsed(df, body)
    get = lambda path: F.try_variant_get("_v", path, "variant")
    group = lambda x: _entry(("heading",))(x) & _list_of(F.try_variant_get(x, "$.entries", "variant"), _is_text)
    ok = [F.col("is_object"), _is(get("$.sections"), "OBJECT"), _entry(("name", "department", "title", "processedAt"), ("reviewPeriodStart",))(get("$.metadata")),
          get("$.sections.specialization").isNull() | _is(get("$.sections.specialization"), "STRING"),
          *[_list_of(get(f"$.sections.{c}"), check) for c, check in _CHECKS.items()], _list_of(get("$.sections.studentInstructionalGroups"), group),
          *[_list_of(get(f"$.sections.{c}"), _is_text) for c in p.STRING_BUCKETS], *[_list_of(get(f"$.sections.{c}"), _PUBLICATION) for c in p.PUBLICATION_BUCKETS],
          _list_of(get("$.gaps"), _entry(("section", "field", "instruction"), known={"severity": p.SEVERITIES})),
          get("$.reviewNotes").isNull() | _list_of(get("$.reviewNotes"), _entry(("section", "topic", "instruction")))]
    return v.withColumn("valid", F.coalesce(reduce(Column.__and__, ok), F.lit(False))).drop("_v", "is_object")


def validate_snapshot(df: DataFrame, hash_: str, since_year: str) -> Column:
    """Whether a stored result's hash is one (64 small hexadecimal digits) and its first year, if any, lies in 1950 to 2200."""
    return F.coalesce(df[hash_].rlike("^[a-f0-9]{64}$"), F.lit(False)) & (df[since_year].isNull() | df[since_year].between(1950, 2200))


def later_wins(df: DataFrame, doc: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last value of each column for each document."""
    return df.groupBy(doc).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in columns])


def buckets(parts: DataFrame, doc: str, columns: dict[str, str], order: list[str]) -> DataFrame:
    """Array columns of parts (bucket name by column) as rows in the order of parts and positions: doc, bucket, ord, text."""
    rows = [parts.select(doc, F.lit(b).alias("bucket"), *order, F.posexplode(c).alias("pos", "text")) for c, b in columns.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    w = Window.partitionBy(doc, "bucket").orderBy(*order, "pos")
    return out.withColumn("ord", F.row_number().over(w)).select(doc, "bucket", "ord", "text")
