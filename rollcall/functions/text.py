"""Text expressions: normal forms that serve as keys, clean-up of single records, and display forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions import patterns as p

LIST_NUMBER = p.LIST_NUMBER


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it; keeps nested expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def drop(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def trim(c: Column | str) -> Column:
    """Without white space of any kind at the ends; F.trim only knows the space."""
    return drop(_col(c), r"^\s+|\s+$")


def plain_spaces(c: Column | str) -> Column:
    """No-break and other wide spaces as ordinary ones; apply it once, when text is read."""
    return drop(_col(c), "[   -   　﻿]", " ")


def squeeze(c: Column | str) -> Column:
    return trim(drop(_col(c), r"\s+", " "))


def has_text(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"\S"), F.lit(False))


def norm_dedupe(c: Column | str) -> Column:
    return squeeze(F.lower(_col(c)))


def norm_compare(c: Column | str) -> Column:
    return F.trim(drop(F.lower(_col(c)), "[^a-z0-9]+", " "))


def norm_layout(c: Column | str) -> Column:
    return norm_compare(drop(F.lower(_col(c)), LIST_NUMBER))


def norm_record(c: Column | str) -> Column:
    return norm_compare(drop(drop(_col(c), LIST_NUMBER), p.words("current"), "present"))


def norm_service(c: Column | str, dates: Column | None = None) -> Column:
    prefix = f"(?i)^(?:(?:{'|'.join(p.SERVICE_PREFIXES)}){p.RIGHT}[\\s,:;–—-]*)+"
    bare = drop(drop(_col(c), LIST_NUMBER), prefix)
    return norm_record(F.concat(bare, F.lit(" "), F.coalesce(dates, F.lit("")) if dates is not None else F.lit("")))


def strip_source_number(c: Column | str) -> Column:
    """Without a number in front, as in ``(22)``, ``71.`` or ``71)``; so ``2010. Title`` loses its year."""
    return trim(drop(trim(c), p.SOURCE_NUMBER))


def activity_core(c: Column | str) -> Column:
    """The record's identity without its dates."""
    return norm_service(drop(drop(strip_source_number(c), p.YEARS, " "), p.words("present", "current"), " "))


def norm_citation(c: Column | str) -> Column:
    return F.trim(drop(drop(norm_dedupe(c), LIST_NUMBER), "[^a-z0-9]+", " "))


NOTE = p.CONTRIBUTION


def split_contribution(c: Column | str) -> Column:
    """struct(citation, note): a trailing authorship note apart from its citation; note is null without one.

    The pattern is searched once, and only in texts with an asterisk.
    """
    c = _col(c)
    # A note reaches to the end, so what stands before it is known by its length.
    note = F.when(c.contains("*"), F.nullif(F.regexp_extract(c, NOTE, 2), F.lit("")))
    return bind(note, lambda n: F.struct(
        trim(F.when(n.isNull(), c).otherwise(c.substr(F.lit(1), F.length(c) - F.length(n)))).alias("citation"), trim(n).alias("note")))


def citation_key(c: Column | str) -> Column:
    return norm_citation(split_contribution(c)["citation"])


def canonical_heading(c: Column | str) -> Column:
    clean = trim(drop(_col(c), ":$"))
    low = F.lower(clean)
    chain = F.when(clean == "", clean)
    for parts, heading in p.GROUP_HEADINGS:
        chain = chain.when(reduce(Column.__and__, [low.contains(x) for x in parts]), F.lit(heading))
    return chain.otherwise(clean)


def strip_group_prefix(c: Column | str, heading: Column | str) -> Column:
    quoted = F.concat(F.lit(r"(?i)^\s*\Q"), F.replace(_col(heading), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\s*:?\s*"))
    bare = F.regexp_replace(drop(_col(c), LIST_NUMBER), quoted, F.lit(""))
    return trim(drop(bare, p.GROUP_PREFIX))


def unwrap(c: Column | str) -> Column:
    """``(1999)`` as ``1999``."""
    return trim(drop(trim(c), r"^\((.*)\)$", "$1"))


def display_cell(c: Column | str, fallback: str = p.NOT_LISTED) -> Column:
    return F.coalesce(F.nullif(trim(c), F.lit("")), F.lit(fallback))


def display_period(start: Column | str, end: Column | str) -> Column:
    """``a – b`` without stray dashes; one side alone if the other is blank."""
    a, b = (drop(drop(trim(F.coalesce(_col(x), F.lit(""))), rf"^{p.DASH}\s*"), rf"\s*{p.DASH}$") for x in (start, end))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(" – "), b)).when(a != "", a).otherwise(b)


def display_degree(degree: Column | str, received: Column | str) -> Column:
    degree, received = _col(degree), F.coalesce(_col(received), F.lit(""))
    tail = F.concat(F.lit(r"\s*\(\Q"), received, F.lit(r"\E\)\s*$"))
    return F.when(received == "", degree).otherwise(trim(F.regexp_replace(degree, tail, F.lit(""))))


def article_kind(c: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in p.ARTICLE_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(trim(c))), F.lit(""))


def publication_note(c: Column | str, hidden: tuple[str, ...] = p.HIDDEN_NOTE) -> Column:
    """A note fit for print: '' if it holds extraction metadata."""
    clean = drop(squeeze(F.coalesce(_col(c), F.lit(""))), r"[.;]\s*$")
    return F.when(clean.rlike(f"(?i){p.LEFT}(?:{'|'.join(hidden)})"), F.lit("")).otherwise(clean)


def previously_listed(c: Column | str) -> Column:
    note = publication_note(c)
    return F.when(note == "", note).otherwise(F.concat(F.lit("Previously listed as "), note))


def sentence_case(c: Column | str) -> Column:
    """Text in capitals only, of four letters or more, with one capital."""
    c = _col(c)
    letters = drop(c, "[^A-Za-z]")
    shout = (F.length(letters) >= 4) & (letters == F.upper(letters))
    return F.when(shout, F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))).otherwise(c)


def contribution_note(note: Column | str, citation: Column | str) -> Column:
    """The authorship note, or '' if the citation says it already."""
    clean = publication_note(note)
    said = norm_compare(citation).contains(norm_compare(clean))
    return F.when((clean == "") | said, F.lit("")).otherwise(sentence_case(clean))


def tokens(c: Column | str) -> Column:
    """The words of norm_compare, split where it puts its spaces: repeats too, and an empty one at an end without a word."""
    return F.split(F.lower(_col(c)), "[^a-z0-9]+")


def distinct_tokens(c: Column | str) -> Column:
    return F.array_remove(F.array_distinct(tokens(c)), "")
