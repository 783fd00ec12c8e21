"""SQL for DuckDB of the ingest of whole results and of their merge, written apart from the operators."""

from __future__ import annotations

from rollcall.functions import patterns as p
from rollcall.operators import audit, layout
from rollcall.plans import queries as q, views as v
from rollcall.plans.oracles import (
    CUT, NOTE, PROGRESS, bare, by_case, by_citation, by_record, by_service, by_words, core, dated, first, has, heading, lit, merged, moved, no_list_number, numbered, reclassified, rx, squeeze, tokens, trim,
    without_proceedings, word)


def names(xs: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(lit, xs)) + ")"


def _plain(rows: str) -> str:
    """rows with b, the body's JSON text if it is an object, else null."""
    b = trim(rx(rx(trim("body"), r"^```(?:json)?\s*", "", False), r"\s*```$", "", False))
    return f"select * exclude (b_), case when json_valid(b_) and json_type(b_) = 'OBJECT' then b_ end as b from (select *, {b} as b_ from ({rows}))"


BODIES = _plain(v.FULL_BODIES)


def text(x: str, path: str = "$") -> str:
    kind, value = f"json_type({x}, {lit(path)})", f"json_extract_string({x}, {lit(path)})"
    return f"case when {kind} = 'VARCHAR' then {trim(value)} when {kind} in ('UBIGINT', 'BIGINT', 'DOUBLE') then {value} else '' end"


def items(path: str, rows: str = BODIES) -> str:
    """Elements of the array at a path: x, pos."""
    return f"""select * exclude (l_, b, body), unnest(l_) as x, unnest(range(len(l_))) as pos from (select *, case when json_type(b, {lit(path)}) = 'ARRAY' then json_extract(b, {lit(path + '[*]')}) end as l_ from ({rows}))
 where l_ is not null"""


def objects(path: str, fields: tuple[str, ...]) -> str:
    cols = ", ".join(f"""{text('x', '$.' + f)} as "{f}\"""" for f in fields)
    return f"select * exclude (x), {cols}, x as j from ({items(path)}) where json_type(x) = 'OBJECT'"


def sections(buckets: tuple[str, ...]) -> str:
    return " union all ".join(f"select *, {lit(b)} as bucket from ({items('$.sections.' + b)})" for b in buckets)


STRINGS = f"select * from (select id, doc_id, part, pos, bucket, {text('x')} as text, part * 1000 + pos as ord from ({sections(p.STRING_BUCKETS)})) where text <> ''"
CITED = f"""select id, doc_id, part, pos, bucket, part * 1000 + pos as ord, c as text, case when t in {names(p.PUBLICATION_TYPES)} then t else 'other' end as pub_type, nullif({text('x', '$.contributionNote')}, '') as note,
 case when {text('x', '$.articleKind')} in ('research', 'review', 'creative', 'other') then {text('x', '$.articleKind')} end as article_kind,
 case when json_type(x, '$.isNewSinceLastReview') = 'BOOLEAN' then cast(json_extract_string(x, '$.isNewSinceLastReview') as boolean) end as is_new
 from (select *, {text('x', '$.citation')} as c, {text('x', '$.type')} as t from ({sections(p.PUBLICATION_BUCKETS)}) where json_type(x) = 'OBJECT') where c <> ''"""
SERVICES = f"""select * exclude (category, j), case when category in {names(p.SERVICE_CATEGORIES)} then category else 'other' end as category, part * 1000 + pos as ord
 from ({objects('$.sections.universityService', ('description', 'dates', 'category'))}) where description <> ''"""
GRANTS = f"""select * exclude (status, amount, role, "coPIsShare", j), case when status = 'current' then 'current' else 'past' end as status, nullif(amount, '') as amount, nullif(role, '') as role, nullif("coPIsShare", '') as "coPIsShare",
 part * 1000 + pos as ord from ({objects('$.sections.grants', ('title', 'funder', 'period', 'status', 'amount', 'role', 'coPIsShare'))}) where title <> '' or funder <> ''"""
EMPLOYMENT = f"""select * exclude ("from", "to", j), "from" as start, "to" as finish, part * 1000 + pos as ord from ({objects('$.sections.employment', ('from', 'to', 'institution', 'location', 'rank'))}) where institution <> '' or rank <> ''"""
EDUCATION = f"""select * exclude (j), part * 1000 + pos as ord from ({objects('$.sections.education', ('school', 'degree', 'datesFrom', 'datesTo', 'location', 'major', 'dateReceived'))}) where school <> '' or degree <> ''"""
GROUPS = f"""select id, doc_id, part, pos, heading, entry_pos, {text('e_')} as entry from (select id, doc_id, part, pos, heading, unnest(range(len(l_))) as entry_pos, unnest(l_) as e_ from (
 select *, case when json_type(j, '$.entries') = 'ARRAY' then json_extract(j, '$.entries[*]') end as l_ from ({objects('$.sections.studentInstructionalGroups', ('heading',))}) where heading <> '') where l_ is not null) where {text('e_')} <> ''"""
GAPS = f"""select * exclude (severity, j), case when severity in {names(p.SEVERITIES)} then severity else 'optional' end as severity from ({objects('$.gaps', ('section', 'field', 'instruction', 'severity'))})
 where section <> '' or field <> '' or instruction <> ''"""
NOTES = f"select * exclude (j) from ({objects('$.reviewNotes', ('section', 'topic', 'instruction'))}) where instruction <> ''"


def opened_gaps(employment: str, education: str, grants: str, gaps: str) -> str:
    """The structural gaps with the number of their rule."""
    blank = lambda c: f"coalesce({trim(c)}, '') = ''"
    conditions = [(employment, blank("location")), (education, f"{blank('\"datesFrom\"')} and {blank('\"datesTo\"')}"), (education, blank("location")), (grants, f"{blank('role')} or {blank('\"coPIsShare\"')}")]
    rules = " union all ".join(
        f"select distinct doc_id, {i} as rule, {lit(r[2])} as section, {lit(r[3])} as field, {lit(r[4])} as instruction, 'recommended' as severity from ({rows}) where {when}" for i, (r, (rows, when)) in enumerate(zip(audit.GAP_RULES, conditions, strict=True)))
    key = lambda x: f"lower(concat({x}.section, '|', {x}.field, '|', {x}.instruction))"
    return f"select o.* from ({rules}) o where not exists (select 1 from ({gaps}) g where g.doc_id = o.doc_id and {key('g')} = {key('o')})"


def consolidated(rows: str, kinds: str = "") -> str:
    """Citations moved, cleaned, merged and numbered."""
    home = f"select * exclude (h_, b_) replace (h_ as bucket), cast(h_ <> b_ as int) as m1 from (select *, bucket as b_, case when bucket in {names(p.PRIMARY_BUCKETS)} and {PROGRESS} then 'workInProgress' else bucket end as h_ from ({rows}))"
    again = reclassified(home).replace("select * exclude (home) replace (", "select * exclude (home) replace (m1 + cast(home <> bucket as int) as m1, ", 1)
    place = numbered(f"select * replace ({squeeze(bare('text'))} as text) from ({without_proceedings(again)})", "doc_id, bucket", "m1, ord, text", "place")
    once = merged(f"select * exclude (ord, place, m1, sort_key), place as ord from ({place})")
    if kinds:
        once = once.replace("count(*) as copies", "count(*) as copies, arg_min(article_kind, ord) filter (where article_kind is not null) as article_kind", 1)
    return f"select *, row_number() over (partition by doc_id, bucket order by ord) as number from ({once})"


def honorific(rows: str) -> str:
    both = "concat(rank, ' ', institution)"
    when = f"({has(both, word('distinguished professor'))} or ({has(both, word(*p.HONORIFIC))} and not {has(both, word(*p.ORDINARY_POST))}))"
    a, b = trim("start"), trim("finish")
    period = f"case when {a} <> '' and {b} <> '' and {a} <> {b} then concat({a}, ' – ', {b}) when {a} <> '' then {a} else {b} end"
    return f"select doc_id, ord, trim(concat(concat_ws(', ', nullif(rank, ''), nullif(institution, '')), ' ', {period})) as award from ({rows}) where {when}"


def guarded(held: str, more: str) -> str:
    """held without repeats (lists), and each of more that nearly equals none before it."""
    once = f"list_transform(list_filter(list_transform({held}, lambda x, i: {{'x': x, 'n': len(list_filter({held}[:i - 1], lambda y: {by_case('y')} = {by_case('x')}))}}), lambda r: r.n = 0 and {by_case('r.x')} <> ''), lambda r: r.x)"
    near = f"least(len({tokens('y')}), len({tokens('c[1]')})) >= 8 and len(list_intersect({tokens('y')}, {tokens('c[1]')})) >= 0.9 * least(len({tokens('y')}), len({tokens('c[1]')}))"
    return f"list_reduce(list_prepend({once}, list_transform({more}, lambda x: [x])), lambda acc, c: case when len(list_filter(acc, lambda y: {near})) > 0 then acc else list_concat(acc, c) end)"


def merge() -> dict[str, str]:
    """Named steps of the whole merge, each a SELECT over those before it."""
    two = ("professionalActivities", "externalProfessionalActivities")
    talks = ("presentations", "invitedPresentations")
    year = has("text", r"\b(?:19|20)\d{2}\b")
    service_date = dated("select *, concat(dates, ' ', description) as w_ from u", "w_")
    grant_date = dated("select *, concat(period, ' ', title) as w_ from u", "w_")
    unwrap = lambda x: trim(rx(trim(x), r"^\((.*)\)$", r"\1", False))
    entry = trim(rx(f"regexp_replace({no_list_number('text')}, concat('(?i)^\\s*', regexp_escape(h), '\\s*:?\\s*'), '')",
                    r"(?i)^\s*(?:Current|Former)\s+(?:Ph\.?D\.?|Masters?|Postdoctoral|Staff|Undergraduate|Visiting)[^:]{0,80}:\s*", "", False))
    sections_of = lambda xs: "(values " + ", ".join(f"({i}, {lit(s)}, {lit(b)})" for i, (s, b) in enumerate(xs)) + ") s(place, section, bucket)"
    review = f"trim({rx(by_case(bare('text')), '[^a-z0-9]+', ' ')})"
    placed = lambda rows, xs, key, stage, topic, lead: f"""select doc_id, concat(f, '; ', section) as section, {lit(topic)} as topic, concat({lit(lead)}, {bare('text')}) as instruction, {stage} as stage, place as o0, number as o1, 0 as o2
 from (select *, first_value(section) over (partition by doc_id, k order by place, number) as f from (select r.doc_id, s.section, s.place, r.number, r.text, {key} as k from ({rows}) r join {sections_of(xs)} on r.bucket = s.bucket) where k <> '') where f <> section"""  # noqa: E731
    return {
        "publications": consolidated(CITED, "kinds"),
        "employed": EMPLOYMENT,
        "services": f"select * exclude (lead, label, rest, cleaned, dt, sort_key) replace (case when lead <> '' then rest else {squeeze('cleaned')} end as description, {unwrap("case when lead <> '' and dates = '' then label else dates end")} as dates) from ({dated(SERVICES, 'description')})",
        "given": STRINGS,
        "awarded": f"""select doc_id, 'awards' as bucket, unnest(range(len(l))) as ord, unnest(l) as text from (select doc_id, {guarded("coalesce(h, [])", "coalesce(c, [])")} as l from (select coalesce(a.doc_id, b.doc_id) as doc_id, h, c from
 (select doc_id, list(text order by ord) as h from given where bucket = 'awards' group by 1) a full outer join (select doc_id, list(award order by ord) as c from ({honorific('from_employed')}) group by 1) b on a.doc_id = b.doc_id))""".replace("(from_employed)", "(select * from employed)"),
        "clean": moved("select doc_id, bucket, ord, text from given where bucket <> 'awards' union all select doc_id, bucket, ord, text from awarded"),
        "activities": f"select doc_id, ord, text, e from (select *, (bucket = '{two[1]}')::int as e, {by_record('text')} as k from clean where bucket in {names(two)}) where k <> '' qualify row_number() over (partition by doc_id, k order by e, ord) = 1",
        "kept": f"select * from activities a where not exists (select 1 from services s where s.doc_id = a.doc_id and {by_service('s.description', 's.dates')} = {by_service('a.text')})",
        "conflicts": f"""select k.doc_id, k.e, k.ord, concat(s.d, ' (', s.t, ') / ', {bare('k.text')}) as conflict from (select *, {core('text')} as c from kept) k join
 (select doc_id, {core('description')} as c, arg_max(description, ord) as d, arg_max(dates, ord) as t from services group by all) s on k.doc_id = s.doc_id and k.c = s.c""",
        "others": first(f"select doc_id, bucket, ord, text from clean where bucket not in {names(two + talks)}", "doc_id, bucket", by_case("text"), "ord"),
        "once": first(f"select doc_id, bucket, ord, text from clean where bucket in {names(talks)}", "doc_id, bucket", by_case("text"), "ord"),
        "routed": first(f"select doc_id, ord, text, case when bucket = 'invitedPresentations' and w then 'presentations' else bucket end as bucket, (bucket = 'invitedPresentations' and w)::int as m from (select *, {has('text', word(*p.WIDE_AUDIENCE))} as w from once)",
                        "doc_id, bucket", by_case("text"), "m, ord"),
        "talks": f"""select * from routed r where not ({year} and exists (select 1 from publications a where a.bucket = 'abstracts' and a.doc_id = r.doc_id
 and least(len({tokens('a.text')}), len({tokens('r.text')})) >= 8 and len(list_intersect({tokens('a.text')}, {tokens('r.text')})) >= 0.9 * least(len({tokens('a.text')}), len({tokens('r.text')}))))""",
        "texts": numbered(f"select doc_id, '{two[0]}' as bucket, e, ord, text from kept union all select doc_id, bucket, 0, ord, text from others union all select doc_id, bucket, m, ord, text from talks", "doc_id, bucket", "e, ord"),
        "served": f"select *, row_number() over (partition by doc_id order by sort_key asc nulls last, ord) as number from ({service_date.replace('from u', f'from ({first("select * from services", "doc_id", f"concat(category, {chr(39)}|{chr(39)}, {by_case('description')}, {chr(39)}|{chr(39)}, {by_case('dates')})", "ord")})')})",
        "granted": f"select *, row_number() over (partition by doc_id order by sort_key asc nulls last, ord) as number from ({grant_date.replace('from u', f'from ({first(GRANTS, "doc_id", f"concat({by_case('title')}, {chr(39)}|{chr(39)}, {by_case('funder')}, {chr(39)}|{chr(39)}, {by_case('period')})", "ord")})')})",
        "grouped": numbered(first(f"select *, min(ord) over (partition by doc_id, heading) as heading_order from (select doc_id, ord, h as heading, {entry} as text from (select *, {heading('heading')} as h from ({moved(f'select doc_id, part * 1000000 + pos * 1000 + entry_pos as ord, heading, entry as text from ({GROUPS})')})) where h <> '')",
                                  "doc_id, heading", by_case("text"), "ord"), "doc_id, heading", "ord"),
        "employment": f"""select *, row_number() over (partition by doc_id order by ord) as number from employed where {trim('rank')} = '' or (not {has(trim('rank'), word(*p.NOT_EMPLOYMENT))}
 and ({has(trim('rank'), word(*p.ACADEMIC_RANK))} or not {has("concat(rank, ' ', institution)", word(*p.NOT_EMPLOYMENT))}))""",
        "education": f"select *, row_number() over (partition by doc_id order by ord) as number from ({EDUCATION})",
        "noted": f"""select doc_id, section, topic, instruction, 0 as stage, part as o0, pos as o1, 0 as o2 from ({NOTES}) union all
 select doc_id, {lit(p.CONFLICT_NOTE[0])}, {lit(p.CONFLICT_NOTE[1])}, concat({lit(p.CONFLICT_NOTE[2])}, conflict), 1, e, ord, 0 from conflicts union all
 {placed("select doc_id, bucket, number, text from texts union all select doc_id, 'studentInstructionalGroups', row_number() over (partition by doc_id order by heading_order, number), text from grouped", p.ACTIVITY_SECTIONS, f"case when length({review}) >= 24 then {review} else '' end", 2, *p.ACTIVITY_NOTE)} union all
 {placed("select doc_id, bucket, number, text from publications", p.PUBLICATION_SECTIONS, by_citation('text'), 3, *p.PUBLICATION_NOTE)}""",
        "notes": f"select *, row_number() over (partition by doc_id order by stage, o0, o1, o2) as number from (select * from noted qualify row_number() over (partition by doc_id, {by_case('section')}, {by_case('topic')}, {by_case('instruction')} order by stage, o0, o1, o2) = 1)",
        "gaps": f"""select *, row_number() over (partition by doc_id order by late, a, b) as number from (select doc_id, section, field, instruction, severity, 0 as late, part as a, pos as b from ({GAPS}) union all
 select doc_id, section, field, instruction, severity, 1, rule, 0 from ({opened_gaps('select * from employment', 'select * from education', 'select * from granted', GAPS)}))""",
    }


def whole() -> str:
    row = lambda table, bucket, text, *detail: f"select doc_id, {bucket} as bucket, number, {text} as text, concat_ws('|', {', '.join(detail)}) as detail from {table}"
    ctes = ",\n ".join(f"{k} as materialized ({x})" for k, x in merge().items())
    rows = [row("publications", "bucket", "text", "pub_type", "note", "article_kind", "cast(is_new as varchar)"), row("texts", "bucket", "text", "''"), row("served", "'universityService'", "description", "category", "dates"),
            row("granted", "'grants'", "title", "funder", "period", "status", "role", '"coPIsShare"'), row("grouped", "'studentInstructionalGroups'", "text", "heading"), row("employment", "'employment'", "rank", "institution", "location", "start", "finish"),
            row("education", "'education'", "school", "degree", "location"), row("notes", "'reviewNotes'", "instruction", "section", "topic"), row("gaps", "'gaps'", "instruction", "section", "field", "severity")]
    return f"with {ctes}\n select * from ({' union all '.join(rows)})"


def _ctes(more: dict[str, str]) -> str:
    return "with " + ",\n ".join(f"{k} as materialized ({x})" for k, x in (merge() | more).items())


METADATA = f"""select doc_id, {', '.join(f"coalesce(arg_max(v_{c}, part) filter (where m), '') as {c}" for c in ('name', 'department', 'title'))}, coalesce(arg_min(s, part) filter (where s <> ''), '') as specialization from (
 select doc_id, part, coalesce(json_type(b, '$.metadata') = 'OBJECT', false) as m, {', '.join(f"{text('b', '$.metadata.' + c)} as v_{c}" for c in ('name', 'department', 'title'))}, {text('b', '$.sections.specialization')} as s
 from ({BODIES}) where b is not null) group by 1"""


def rendered() -> str:
    """The whole form, line by line."""
    cell = lambda x: f"coalesce(nullif({trim(f'coalesce({x}, {chr(39)}{chr(39)})')}, ''), 'Not listed')"
    row = lambda *xs: "concat_ws(' | ', " + ", ".join(map(cell, xs)) + ")"
    part = lambda x: rx(rx(trim(f"coalesce({x}, '')"), r"^[-–—]\s*", "", False), r"\s*[-–—]$", "", False)
    period = lambda a, b: f"case when {part(a)} <> '' and {part(b)} <> '' then concat({part(a)}, ' – ', {part(b)}) when {part(a)} <> '' then {part(a)} else {part(b)} end"
    degree = "case when \"dateReceived\" = '' then degree else regexp_replace(degree, concat('\\s*\\(', regexp_escape(\"dateReceived\"), '\\)\\s*$'), '') end"
    unwrap = trim(rx(trim("dates"), r"^\((.*)\)$", r"\1", False))
    said = f"concat(description, case when {unwrap} = '' then '' else concat(' (', {unwrap}, ')') end)"
    lists = (*layout.OTHER_ACTIVITIES, *layout.NUMBERED, "studentInstructionalActivities", "teaching")
    ordered = f"list_position([{', '.join(map(lit, layout.OTHER_ACTIVITIES))}], bucket)"
    talk = f"{rx(trim('text'), r'^\s*\d+\s*[.)]\s*', '', False)}"
    view = "case when pub_type in ('book', 'chapter') then 'book' when pub_type in ('journal', 'review', 'proceedings') then pub_type else 'other' end"
    kind = "case article_kind when 'research' then 'Research article' when 'review' then 'Review article' when 'creative' then 'Creative work' else '' end"
    note = rx(squeeze("coalesce(note, '')"), r"[.;]\s*$", "", False)
    note = f"case when {note} = '' or {has(note, r'(?i)\b(?:source\s+no\.?|review\s+material)')} or contains({by_words('text')}, {by_words(note)}) then '' else {note} end"
    dated = lambda rows, x: f"select * exclude (lead, label, rest, cleaned, dt), sort_key as day from ({globals()['dated'](rows, x)})"
    entry = trim(rx(f"regexp_replace({no_list_number('entry')}, concat('(?i)^\\s*', regexp_escape(h), '\\s*:?\\s*'), '')",
                    r"(?i)^\s*(?:Current|Former)\s+(?:Ph\.?D\.?|Masters?|Postdoctoral|Staff|Undergraduate|Visiting)[^:]{0,80}:\s*", "", False))
    form = "'(?s)^\\s*([^:]{4,90}):\\s*(.+)$'"
    outline = "(values " + ", ".join(
        f"({i}, {lit(h)}, {lit(b) if b else 'null'}, {lit(f) if f else 'null'}, {lit(layout.CELL.join(layout.TABLES.get(b, ())))})" for i, (_, h, b, f) in enumerate(layout.OUTLINE)) + ") o(seq, heading, bucket, fallback, head)"
    student = next(i for i, x in enumerate(layout.OUTLINE) if x[2] == "studentInstructionalActivities")
    new = lambda by: f"""select *, coalesce(bool_or(old) over w and f > 1 and number = f, false) as divider from (select *, min(case when is_new then number end) over (partition by {by}) as f from (
 select *, said or coalesce(day >= {CUT}, false) as is_new, coalesce(day < {CUT}, false) as old from ({{}}))) window w as (partition by {by})"""  # noqa: E731
    more = {
        "meta": METADATA,
        "shown": f"""select doc_id, 'employment' as bucket, number, null as w_, [{row(period('start', 'finish'), 'institution', 'location', 'rank')}] as lines, false as said from employment
 union all select doc_id, 'education', number, null, [{row(period('"datesFrom"', '"datesTo"'), 'school', 'location', 'major', degree, '"dateReceived"')}], false from education
 union all select doc_id, 'specialization', 1, null, [specialization], false from meta where specialization <> ''
 union all select doc_id, v, row_number() over (partition by doc_id, v order by number), {said}, [{said}], false from (select *, case when category = 'departmental' then 'departmentalService' else 'otherService' end as v from served)
 union all select doc_id, v, row_number() over (partition by doc_id, v order by number), concat(period, ' ', title), [{row('title', 'funder', 'amount', 'period', 'role', '"coPIsShare"')}], false from (select *, case when status = 'current' then 'currentGrants' else 'pastGrants' end as v from granted)
 union all select doc_id, bucket, number, text, [text], false from texts where bucket not in {names(lists)}
 union all select doc_id, 'otherActivities', row_number() over (partition by doc_id order by {ordered}, number), text, [text], false from texts where bucket in {names(layout.OTHER_ACTIVITIES)}
 union all select doc_id, bucket, n, t, [concat(n, '. ', t)], false from (select *, row_number() over (partition by doc_id, bucket order by number) as n from (select doc_id, bucket, number, {talk} as t from texts where bucket in {names(layout.NUMBERED)})
  where not regexp_matches(lower(t), '\\(poster\\)|poster presentation|contributed talk'))
 union all select doc_id, b, n, text, list_concat([concat(n, '. ', text)], list_filter([{kind}, {note}], lambda x: x <> '')), coalesce(is_new, false) from (
  select *, case when bucket = 'workInProgress' then concat('inProgress ', v) else bucket end as b, case when bucket = 'workInProgress' then row_number() over (partition by doc_id, bucket, v order by number) else number end as n from (select *, {view} as v from publications))""",
        "marked": new("doc_id, bucket").format(dated("select * from shown", "w_")),
        "items": f"""select doc_id, seq, 1 as a, number as b, unnest(range(len(l))) as c, unnest(l) as line from (select *, list_concat(case when divider then ['{layout.DIVIDER}'] else [] end,
  case when is_new and (m.bucket in {names(p.PUBLICATION_BUCKETS)} or starts_with(m.bucket, 'inProgress')) then list_concat([concat('*', lines[1])], lines[2:]) else lines end) as l from marked m join {outline} on m.bucket = o.bucket)""",
        "folded": numbered(first(f"select *, min(late * 1000000000 + ord) over (partition by doc_id, heading) as ho from (select doc_id, late, ord, h as heading, {entry} as text from (select *, {heading('heading')} as h from (select doc_id, 0 as late, dense_rank() over (partition by doc_id order by heading_order) * 1000000 + number as ord, heading, text as entry from grouped union all select doc_id, 1, number, regexp_extract(text, {form}, 1), regexp_extract(text, {form}, 2) from texts where bucket = 'studentInstructionalActivities' and regexp_matches(text, {form}))) where h <> '')",
                                 "doc_id, heading", by_case("text"), "late, ord"), "doc_id, heading", "late, ord"),
        "entries": new("doc_id, heading").format(dated("select doc_id, heading, ho, number, text, false as said from folded", "text")),
        "places": "select doc_id, heading, dense_rank() over (partition by doc_id order by ho) as a from (select distinct doc_id, heading, ho from folded)",
        "students": f"""select doc_id, {student} as seq, a, 0 as b, 0 as c, heading as line from places union all
 select e.doc_id, {student}, a, number, unnest(range(len(l))), unnest(l) from (select *, list_concat(case when divider then ['{layout.DIVIDER}'] else [] end, [concat(number, '. ', text)]) as l from entries) e join places q on e.doc_id = q.doc_id and e.heading = q.heading""",
        "body": "select * from items union all select * from students",
        "slots": f"""select m.doc_id, o.*, exists (select 1 from body x where x.doc_id = m.doc_id and x.seq = o.seq) as held from meta m, {outline}""",
        "todo": f"select *, row_number() over (partition by doc_id, severity order by number) as n, list_position(['required', 'recommended', 'optional'], severity) as r from gaps",
    }
    end = len(layout.OUTLINE)
    blank = lambda c: f"coalesce(nullif({c}, ''), '{layout.BLANK}')"
    labels = "case severity " + " ".join(f"when {lit(s)} then {lit(x)}" for s, x in layout.SEVERITY_LABELS) + " end"
    some = "(select doc_id from gaps union select doc_id from notes)"
    return f"""{_ctes(more)}
 select doc_id, row_number() over (partition by doc_id order by seq, a, b, c) as line_no, line from (
 select doc_id, seq, a, b, c, line from body union all select doc_id, seq, 0, 0, 0, heading from slots where held or bucket is null or fallback is not null union all
 select doc_id, seq, 0, 0, 1, fallback from slots where not held and bucket is not null and fallback is not null union all select doc_id, seq, 0, 0, 2, head from slots where held and head <> '' union all
 select doc_id, -1, 0, unnest(range(5)), 0, unnest(['Form', concat('Name: ', {blank('name')}, '     Department: ', {blank('department')}), concat('Title: ', {blank('title')}), 'Review period (Section II activities): {q.SINCE} – present', 'New since last review date: {q.CUTOFF}']) from meta union all
 select doc_id, {end}, 0, unnest([0, 1]), 0, unnest(['Signature: ________', 'Date: ________']) from meta union all
 select doc_id, {end + 1}, 0, unnest([0, 1]), 0, unnest([{lit(p.APPENDIX_HEADING)}, {lit(layout.SUMMARY_INTRO)}]) from {some} union all
 select distinct doc_id, {end + 1}, 1, 0, 0, {lit(layout.GAPS_HEADING)} from gaps union all select distinct doc_id, {end + 1}, 1, r, 0, {labels} from todo union all
 select doc_id, {end + 1}, 1, r, n, concat(n, '. ', section, ' — ', field, ': ', instruction) from todo union all select distinct doc_id, {end + 1}, 2, 0, 0, {lit(layout.NOTES_HEADING)} from notes union all
 select doc_id, {end + 1}, 3, number, 0, concat(number, '. ', section, ' — ', topic, ': ', instruction) from notes)"""


def documents() -> str:
    """The nested result as JSON, and its checksum."""
    obj = lambda fields: "{" + ", ".join(f"'{n}': {c}" for n, c in fields.items()) + "}"
    of = lambda table, fields: f"coalesce((select list({obj(fields)} order by number) from {table} t where t.doc_id = m.doc_id), [])"
    same = lambda *xs: {x: f't."{x}"' for x in xs}
    texts = {b: f"coalesce((select list(t.text order by number) from texts t where t.doc_id = m.doc_id and t.bucket = {lit(b)}), [])" for b in p.STRING_BUCKETS}
    cite = {"number": "t.number", "citation": "t.text", "type": "t.pub_type", "articleKind": "t.article_kind", "contributionNote": "t.note", "isNewSinceLastReview": "t.is_new"}
    cited = {b: f"coalesce((select list({obj(cite)} order by number) from publications t where t.doc_id = m.doc_id and t.bucket = {lit(b)}), [])" for b in p.PUBLICATION_BUCKETS}
    groups = "coalesce((select list({'heading': heading, 'entries': entries} order by heading_order) from (select doc_id, heading, heading_order, list(text order by number) as entries from grouped group by 1, 2, 3) t where t.doc_id = m.doc_id), [])"
    sections = {
        "employment": of("employment", {"from": "t.start", "to": "t.finish"} | same("institution", "location", "rank")), "education": of("education", same("school", "datesFrom", "datesTo", "location", "major", "degree", "dateReceived")),
        "specialization": "m.specialization", "universityService": of("served", same("description", "dates", "category")), **texts, "studentInstructionalGroups": groups,
        "grants": of("granted", same("title", "funder", "period", "status", "amount") | {"totalAward": "null::varchar"} | same("role", "coPIsShare")), **cited}
    body = obj({"metadata": "{'name': m.name, 'department': m.department, 'title': m.title}", "sections": obj(sections), "gaps": of("gaps", same("section", "field", "instruction", "severity")), "reviewNotes": of("notes", same("section", "topic", "instruction"))})
    return f"{_ctes({'meta': METADATA})}\n select m.doc_id, md5(cast(to_json({body}) as varchar)) as result_md5 from meta m"


def oracle_sql() -> dict[str, str]:
    flat = f"select doc_id, part * 1000000 + pos * 1000 as ord, trim(regexp_extract(text, '(?s)^\\s*([^:]{{4,90}}):\\s*(.+)$', 1)) as heading, regexp_extract(text, '(?s)^\\s*([^:]{{4,90}}):\\s*(.+)$', 2) as entry from ({STRINGS}) where bucket = 'studentInstructionalActivities' and regexp_matches(text, '(?s)^\\s*([^:]{{4,90}}):\\s*(.+)$')"
    entry = trim(rx(f"regexp_replace({no_list_number('entry')}, concat('(?i)^\\s*', regexp_escape(h), '\\s*:?\\s*'), '')",
                    r"(?i)^\s*(?:Current|Former)\s+(?:Ph\.?D\.?|Masters?|Postdoctoral|Staff|Undergraduate|Visiting)[^:]{0,80}:\s*", "", False))
    both = f"select doc_id, 0 as late, part * 1000000 + pos * 1000 + entry_pos as ord, heading, entry from ({GROUPS}) union all select doc_id, 1, ord, heading, entry from ({flat})"
    folded = numbered(first(f"select *, min(late * 1000000000000 + ord) over (partition by doc_id, heading) as heading_order from (select doc_id, late, ord, h as heading, {entry} as text from (select *, {heading('heading')} as h from ({both})) where h <> '')", "doc_id, heading", by_case("text"), "late, ord"), "doc_id, heading", "late, ord")
    activities = f"select * from ({STRINGS}) where bucket in ('professionalActivities', 'externalProfessionalActivities')"
    cited_key = by_record(f"case when {has('text', NOTE)} then {trim(f'regexp_extract(text, {lit(NOTE)}, 1)')} else {trim('text')} end")
    repeats = lambda rows, keys, key: f"(select {keys}, key from (select *, {key} as key from ({rows})) where key <> '' group by all having count(*) > 1)"
    return {
        "ingest_services": f"select id, pos, description, dates, category from ({SERVICES})",
        "ingest_grants": f'select id, pos, title, funder, period, status, amount, role, "coPIsShare" from ({GRANTS})',
        "ingest_employment": f"select id, pos, rank, institution, location, start, finish from ({EMPLOYMENT})",
        "ingest_education": f'select id, pos, school, degree, "datesFrom", "datesTo", location, major, "dateReceived" from ({EDUCATION})',
        "ingest_groups": f"select id, pos, heading, entry_pos, entry from ({GROUPS})",
        "ingest_gaps": f"select id, pos, section, field, instruction, severity from ({GAPS})",
        "stored_gaps": f"select id, pos, section, field, instruction, severity from ({GAPS})",
        "ingest_notes": f"select id, pos, section, topic, instruction from ({NOTES})",
        "ingest_sections": f"select id, bucket, pos, text, null::varchar as pub_type, null::boolean as is_new from ({STRINGS}) union all select id, bucket, pos, text, pub_type, is_new from ({CITED})",
        "stored_sections": f"select id, bucket, pos, text, null::varchar as pub_type, null::boolean as is_new from ({STRINGS}) union all select id, bucket, pos, text, pub_type, is_new from ({CITED})",
        "merged_metadata": METADATA,
        "validate_result": f"""select id, id % 11 not between 2 and 10 as valid, id % 5 <> 0 and coalesce(since_year between 1950 and 2200, true) as header_ok from ({v.WHOLE_BODIES})""",
        "placement_inventory": f"""select distinct a.doc_id, concat('service/external:', a.k) as entry from (select doc_id, {by_service('text')} as k from ({activities})) a join (select doc_id, {by_service('description', 'dates')} as k from ({SERVICES})) s
 on a.doc_id = s.doc_id and a.k = s.k where a.k <> '' union all select doc_id, concat(bucket, ':', key) from {repeats(CITED, 'doc_id, bucket', cited_key)} union all
 select doc_id, concat('external-professional-activities:', key) from {repeats(activities, 'doc_id', by_record('text'))}""",
        "folded_groups": f"""select doc_id, cast(to_json(list({{'heading': heading, 'entries': entries}} order by heading_order)) as varchar) as groups from (
 select doc_id, heading, heading_order, list(text order by number) as entries from ({folded}) group by 1, 2, 3) group by 1""",
        "record_views": f"""select doc_id, case when category = 'departmental' then 'departmentalService' else 'otherService' end as view, count(*) as n from ({SERVICES}) group by 1, 2 union all
 select doc_id, case when status = 'current' then 'currentGrants' else 'pastGrants' end, count(*) from ({GRANTS}) group by 1, 2""",
        "structural_gaps": f"select doc_id, section, field, instruction, severity from ({opened_gaps(EMPLOYMENT, EDUCATION, GRANTS, GAPS)})",
        "consolidated": whole(),
        "rendered_documents": rendered(),
        "result_documents": documents(),
    }

