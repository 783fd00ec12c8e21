"""The same answers in SQL for DuckDB, written apart from the operators.

Small helpers spell out normal forms as SQL text; each entry names one query of rollcall.plans.queries.
"""

from __future__ import annotations



from rollcall.functions import patterns as p
from rollcall.operators import lines as ln
from rollcall.plans import queries as q, views as v


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rx(x: str, pattern: str, by: str = "", every: bool = True) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}{', ' + lit('g') if every else ''})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def word(*alternatives: str) -> str:
    return rf"(?i)\b(?:{'|'.join(alternatives)})\b"


def trim(x: str) -> str:
    return rx(x, r"^\s+|\s+$")


def squeeze(x: str) -> str:
    return trim(rx(x, r"\s+", " "))


def by_case(x: str) -> str:
    return squeeze(f"lower({x})")


def by_words(x: str) -> str:
    return f"trim({rx(f'lower({x})', '[^a-z0-9]+', ' ')})"


def no_list_number(x: str) -> str:
    return rx(x, r"^\s*\d+\s*[.)]\s*", "", False)


def by_record(x: str) -> str:
    return by_words(rx(no_list_number(x), word("current"), "present"))


def bare(x: str) -> str:
    return trim(rx(trim(x), r"^\s*(?:\(\d+\)|\d+[.)])\s*", "", False))


def by_citation(x: str) -> str:
    return f"trim({rx(no_list_number(by_case(x)), '[^a-z0-9]+', ' ')})"


PREFIX = rf"(?i)^(?:(?:{'|'.join(p.SERVICE_PREFIXES)})\b[\s,:;–—-]*)+"
NOTE = rf"(?is)^(.*?)\s+(\*{{1,2}}\s*(?:{'|'.join(p.AUTHORSHIP_NOTES)})[^.]*\.?)$"
LEAD = (
    rf"(?i)^(?:(?:{p.MONTH})\s+\d{{1,2}},\s*\d{{4}}\b|(?:{p.MONTH})\s+\d{{4}}\b|\d{{4}}-\d{{2}}-\d{{2}}\b|\d{{4}}\s*,\s*\d{{4}}\b|\d{{4}}\s*[-–—]\s*(?:\d{{4}}|current|present|tenure)\b"
    rf"|\d{{4}}\b)[\s,.:;-]*")
FULL, MY, ISO = rf"({p.MONTH})\s+(\d{{1,2}}),\s*(\d{{4}})", rf"({p.MONTH})\s+(\d{{4}})", r"(\d{4})-(\d{2})-(\d{2})"


def by_service(x: str, dates: str = "''") -> str:
    return by_record(f"concat({rx(no_list_number(x), PREFIX, '', False)}, ' ', {dates})")


def core(x: str) -> str:
    years = r"(?i)\b(?:19|20)\d{2}\b(?:\s*(?:-|–|—|to)\s*(?:present|current|(?:19|20)\d{2}))?"
    return by_service(rx(rx(bare(x), years, " "), word("present", "current"), " "))


def month(x: str) -> str:
    return f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({x}, 1, 3)))"


def dated(rows: str, text: str = "text") -> str:
    """rows with lead, label, rest, cleaned (without number), y, m, d and sort_key of its text; a SELECT."""
    get = lambda pattern, i, x: f"regexp_extract({x}, {lit(pattern)}, {i})"
    cases = []
    for anchor, x, when, kinds in (("^", "label", "lead <> ''", (("f", FULL), ("m", MY), ("i", ISO), ("y", r"((?:19|20)\d{2})"))),
                                   ("\\b", "cleaned", "lead = ''", (("f", FULL), ("i", ISO), ("m", MY), ("r", r"((?:19|20)\d{2})\s*[-–—]\s*(?:(?:19|20)\d{2}|current|present|tenure)"), ("y", r"((?:19|20)\d{2})")))):
        for k, pat in kinds:
            end = "" if anchor == "^" and k == "y" else "$" if anchor == "^" else "\\b"
            full = f"(?i){anchor}{pat}{end}"
            y, m, d = {"f": (3, 1, 2), "m": (2, 1, 0), "i": (1, 2, 3), "r": (1, 0, 0), "y": (1, 0, 0)}[k]
            mon = "0" if not m else f"cast({get(full, m, x)} as int)" if k == "i" else month(get(full, m, x))
            day = f"cast({get(full, d, x)} as int)" if d else "0"
            name = "label" if anchor == "^" else get(full, 0, x)
            cases.append(f"when {when} and {has(x, full)} then {{'y': cast({get(full, y, x)} as int), 'm': cast({mon} as int), 'd': {day}, 'l': {name}}}")
    return f"""select *, dt.y * 10000 + dt.m * 100 + dt.d as sort_key from (select *, case {' '.join(cases)} end as dt from (
 select *, {rx('lead', r'[\s,.:;-]+$', '', False)} as label, {trim('substr(cleaned, length(lead) + 1)')} as rest from (
  select *, regexp_extract(cleaned, {lit(LEAD)}) as lead from (select *, {bare(text)} as cleaned from ({rows})))))"""


def moved(rows: str, text: str = "text") -> str:
    """rows with their text cleaned and its leading date moved to the end."""
    x = dated(f"select * replace ({squeeze(bare(text))} as {text}) from ({rows})", text)
    # The number is gone already; a second one stays.
    x = x.replace(f"select *, {bare(text)} as cleaned", f"select *, {text} as cleaned")
    ends = "regexp_matches(rest, concat('(?i)\\(', regexp_escape(label), '\\)\\s*[.;]?$'))"
    return f"""select * exclude (lead, label, rest, cleaned, dt, sort_key) replace (case when lead = '' then {text} when rest = '' then label when {ends} then rest
 else concat(rest, ' (', label, ')') end as {text}) from ({x})"""


def first(rows: str, keys: str, key: str, order: str) -> str:
    return f"select * exclude (k_) from (select *, {key} as k_ from ({rows})) where k_ <> '' qualify row_number() over (partition by {keys}, k_ order by {order}) = 1"


def numbered(rows: str, keys: str, order: str, name: str = "number") -> str:
    x = dated(rows)
    return f"select * exclude (lead, label, rest, cleaned, dt), row_number() over (partition by {keys} order by sort_key asc nulls last, {order}) as {name} from ({x})"


CLEAN = moved(v.REC_ORDERS)
KEPT = first(CLEAN, "doc_id, bucket", by_case("text"), "ord")
NUMBERED = numbered(KEPT, "doc_id, bucket", "ord")
CUT = int(q.CUTOFF.replace("-", ""))
CHRONO = f"""select doc_id, bucket, ord, number, text, is_new, coalesce(bool_or(old) over w and f > 1 and number = f, false) as divider from (
 select *, min(case when is_new then number end) over (partition by doc_id, bucket) as f from (
  select *, coalesce(sort_key >= {CUT}, false) as is_new, coalesce(sort_key < {CUT}, false) as old from ({NUMBERED}))) window w as (partition by doc_id, bucket)"""
SECOND = numbered(first(moved(f"select * replace ({rx('text', q.RENAMED, 'Seminar (poster)')} as text) from ({v.REC_ORDERS})"), "doc_id, bucket", by_case("text"), "ord"), "doc_id, bucket", "ord")
LINES = v.LINES_DUCK
ORDER_LINES = f"""select doc_id, row_number() over (partition by doc_id order by ord) - 1 as n, case when ord % 17 = 0 then 'Invited Lectures at Institutions' when ord % 19 = 0
 then 'Abstracts and Contributed Talks' when ord % 23 = 0 then 'University Service' else trim(text) end as line from ({v.REC_ORDERS})"""
PROGRESS = f"({has('text', word(*p.IN_PROGRESS))} or not {has('text', r'\b(?:19|20)\d{2}\b')})"
MOVED = f"""select *, case when bucket in ({', '.join(map(lit, p.PRIMARY_BUCKETS))}) and {PROGRESS} then 'workInProgress' else bucket end as home from ({v.PUBS})"""
_BOOK = f"({has('text', word('review of'))} and {has('text', r'(?i)\b(?:book\b|ed\.|eds\.|john wiley\b|press\b|volume\b|vol\.)')})"
_REFEREED = has("text", r"(?i)(?:\bproceedings\b|\bproc\.|\bconference proceedings\b|\bconf\.?\s+proc\.?|\bspie conference\b|\brarefied gas dynamics\b|\binternational\b.{0,80}\bsymposium\b|\bintl\.?\s+conf\.?|\bj\.?\s*phys\.?\s*b\.?\s*conf\.?\s*proc\.?|\bradiocarbon\s+\d+\b)")
_CONF = has("text", r"(?i)\b(?:conference\b|symposium\b|meeting\b|workshop\b|proceedings\b|proc\.)")
_HOME = f"case when bucket = 'otherArticles' and {_BOOK} then 'popularWorks' when bucket in ('otherArticles', 'otherProceedings') and {_REFEREED} then 'refereedProceedings' when bucket = 'otherArticles' and {_CONF} then 'otherProceedings' else bucket end"


def reclassified(rows: str) -> str:
    return f"""select * exclude (home) replace (home as bucket, case when home <> bucket and home = 'popularWorks' then 'popular' when home <> bucket then 'proceedings' else pub_type end as pub_type)
 from (select *, {_HOME} as home from ({rows}))"""


def merged(rows: str) -> str:
    """Copies of a citation in one row, as the aggregate over (document, bucket, citation)."""
    note = f"case when {has('text', NOTE)} then {trim(f'regexp_extract(text, {lit(NOTE)}, 2)')} end"
    cit = f"case when {has('text', NOTE)} then {trim(f'regexp_extract(text, {lit(NOTE)}, 1)')} else {trim('text')} end"
    types = "[" + ", ".join(map(lit, p.PUBLICATION_TYPES)) + "]"
    return f"""select doc_id, bucket, arg_min(cit, {{'a': length(cit), 'b': ord}}) as text,
 case when bucket = 'workInProgress' then arg_min(pub_type, {{'a': list_position({types}, pub_type), 'b': ord}}) else arg_min(pub_type, ord) end as pub_type,
 arg_min(nt, ord) filter (where nt is not null) as note, bool_or(is_new) as is_new, min(ord) as ord, count(*) as copies
 from (select *, coalesce(note, n2) as nt, case when note is null and n2 is not null then c2 else text end as cit, {by_citation('c2')} as k from (
  select *, {note} as n2, {cit} as c2 from ({rows}))) where k <> '' group by doc_id, bucket, k"""


def without_proceedings(rows: str) -> str:
    return f"""select * exclude (k_, t_) from (select *, bool_or(bucket = 'refereedProceedings') over (partition by doc_id, k_) as t_ from (select *, {by_citation('text')} as k_ from ({rows})))
 where not (t_ and bucket = 'otherProceedings')"""


def tokens(x: str) -> str:
    return f"list_filter(list_distinct(string_split({by_words(x)}, ' ')), lambda w: w <> '')"


def fuzzy(a: str, b: str) -> str:
    """Pairs of rows (key, body) of a and b that are nearly the same, by comparing all."""
    return f"""select * from (select ka as key_a, kb as key_b, len(list_intersect(wa, wb)) as common, least(len(wa), len(wb)) as smaller from
 (select key as ka, {tokens('body')} as wa from ({a})) x, (select key as kb, {tokens('body')} as wb from ({b})) y where len(wa) >= 8 and len(wb) >= 8) where common >= 0.9 * smaller"""


PASSAGES = fuzzy("select item_id as key, text as body from benchmark", "select doc_id as key, text as body from documents")


def slice_rows() -> str:
    edge = lambda x: lit(rf"(?i)\b(?:{x})\b") if x else "null"
    rows = [f"({lit(k)}, {f if f else 'null'}, {l if l else 'null'}, {edge(s)}, {edge(e)}, {edge(h)}, {lit(b)}, {str(high).lower()})" for k, _, f, l, (s, e, h), b, high, _ in ln.SLICES]  # noqa: E741
    return "(values " + ", ".join(rows) + ") s(slice_key, fy, ly, sp, ep, hp, bucket, high)"


def excerpts(rows: str) -> str:
    years = r"regexp_extract_all(line, '\b((?:19|20)\d{2})\b', 1)"
    return f"""select doc_id, slice_key, n, line from (select *, bool_or(keep) over (partition by doc_id, slice_key) as any_ from (
 select *, inside and (coalesce(bool_or(hit) over (partition by doc_id, slice_key order by n rows between 1 preceding and 2 following), false) or head) as keep from (
  select *, inside and (len(list_filter({years}, lambda y: cast(y as int) between coalesce(fy, 0) and coalesce(ly, 9999))) > 0
    or (slice_key = 'III_journals_late' and {has('line', word(*p.SOURCE_IN_PROGRESS))})) as hit,
   inside and length(line) <= 140 and ({has('line', r'(?i)^section\s')} or coalesce(regexp_matches(line, hp), false)) as head from (
   select *, a is null or (n >= a and (z is null or n < z)) as inside from (
    select *, min(case when n > a and regexp_matches(line, ep) then n end) over (partition by doc_id, slice_key) as z from (
     select *, min(case when regexp_matches(line, sp) then n end) over (partition by doc_id, slice_key) as a from ({rows}) l, {slice_rows()}))))))
 where case when fy is not null or ly is not null then keep or not any_ else inside end"""


def heading(x: str) -> str:
    c = trim(rx(x, ":$", "", False))
    rules = " ".join("when " + " and ".join(f"contains(lower({c}), {lit(w)})" for w in parts) + f" then {lit(h)}" for parts, h in p.GROUP_HEADINGS)
    return f"case when {c} = '' then '' {rules} else {c} end"


GROUP_ENTRIES = f"""select conv_id, turn, h as heading, {trim(rx(f"regexp_replace({no_list_number('entry')}, concat('(?i)^\\s*', regexp_escape(h), '\\s*:?\\s*'), '')",
    r'(?i)^\s*(?:Current|Former)\s+(?:Ph\.?D\.?|Masters?|Postdoctoral|Staff|Undergraduate|Visiting)[^:]{0,80}:\s*', '', False))} as text from (select *, {heading('heading')} as h from ({v.TURNS})) where h <> ''"""
GROUPED = f"""select conv_id, heading, heading_order, number, text as entry from ({numbered(first("select *, min(turn) over (partition by conv_id, heading) as heading_order from (" + GROUP_ENTRIES + ")", "conv_id, heading", by_case("text"), "turn"), "conv_id, heading", "turn")})"""
STATES = f"""select d.job_id, d.slice_key, case when s.done then 'done' when s.done is not null then 'failed' else 'pending' end as state from
 (select * from (select distinct user_id as job_id from events), (select distinct event_type as slice_key from events)) d left join
 (select job_id, slice_key, bool_or(state = 'done') as done from ({v.OUTCOMES}) group by all) s on d.job_id = s.job_id and d.slice_key = s.slice_key"""
def _live() -> str:
    """Orders as jobs at a moment: a line is done or failed if it was shipped within a year of the order, and open else."""
    now, year = "timestamp '2001-01-01 00:00:00'", "interval 365 days"
    return f"""with due as (select distinct l_orderkey as job_id, l_linenumber as slice_key, o_orderdate::timestamp as started from lineitem join orders on l_orderkey = o_orderkey where o_orderdate <= {now}),
 seen as (select job_id, slice_key, started, bool_or(l_returnflag <> 'R') as done from due left join lineitem on l_orderkey = job_id and l_linenumber = slice_key and l_shipdate between started and least(started + {year}, {now}) group by all),
 jobs as (select job_id, min(started) + {year} < {now} as old, count(*) filter (done) as done, count(*) filter (not done) as failed, count(*) filter (done is null) as pending,
   min(started) + {year} + interval 90 seconds < {now} and job_id % 3 = 0 as late from seen group by 1)
 select job_id, case when pending = 0 then case when late then 'failed' else 'merging' end when old then case when done > 0 then 'merging' else 'failed' end else 'pending' end as status, done,
  case when old then failed + pending else failed end as failed, true as stale_counted from jobs"""


FINAL = f"""select job_id, case when failed = 0 then 'complete' when done > 0 then 'failed_partial' else 'failed' end as state, done, failed, case when failed > 0 then concat('Slices failed: ', names) end as error
 from (select job_id, count(*) filter (where state = 'done') as done, count(*) filter (where state <> 'done') as failed,
  string_agg(concat(slice_key, ': ', state), '; ' order by concat(slice_key, ': ', state)) filter (where state <> 'done') as names from ({STATES}) group by job_id)"""


def posts() -> dict[str, str]:
    both = "concat(rank, ' ', institution)"
    honor = f"({has(both, word('distinguished professor'))} or ({has(both, word(*p.HONORIFIC))} and not {has(both, word(*p.ORDINARY_POST))}))"
    a, b = trim("start"), trim("finish")
    period = f"case when {a} <> '' and {b} <> '' and {a} <> {b} then concat({a}, ' – ', {b}) when {a} <> '' then {a} else {b} end"
    title = "concat_ws(', ', nullif(rank, ''), nullif(institution, ''))"
    rank = trim("rank")
    return {
        "honorific": f"select doc_id, ord, trim(concat({title}, ' ', {period})) as award from ({v.POSTS}) where {honor}",
        "employment_kept": f"""select doc_id, ord, rank, institution from ({v.POSTS}) where {rank} = '' or (not {has(rank, word(*p.NOT_EMPLOYMENT))}
 and ({has(rank, word(*p.ACADEMIC_RANK))} or not {has(both, word(*p.NOT_EMPLOYMENT))}))""",
        "display_forms": f"""select ord, case when {b} <> '' then concat({a}, ' – ', {b}) else {a} end as period, case when trim(institution) = '' then '{p.NOT_LISTED}' else trim(institution) end as institution,
 case when length({rx('rank', '[^A-Za-z]')}) >= 4 then concat(upper(substr(rank, 1, 1)), lower(substr(rank, 2))) else upper(rank) end as rank, trim(rank) as degree,
 case when trim(rank) = '' then '' else concat('Previously listed as ', rank) end as listed,
 case when trim(rank) = '' or contains({by_words('institution')}, {by_words('rank')}) then '' else rank end as note, start as bare from ({v.POSTS})""",
    }


ACT = v.ACTIVITIES
_SERVICE_DESC = f"case when lead <> '' then rest else {squeeze('cleaned')} end"
_UNWRAP = lambda x: trim(rx(trim(x), r"^\((.*)\)$", r"\1", False))
_REVIEW = f"trim({rx(by_case(bare('line')), '[^a-z0-9]+', ' ')})"


def oracle_sql() -> dict[str, str]:
    out = {
        "chrono_numbered_records": CHRONO,
        "initial_dates": f"select ord, sort_key::bigint as sort_key, trim(dt.l) as label, dt.y::bigint as year, dt.m::bigint as month, dt.d::bigint as day from ({dated(v.REC_ORDERS)})",
        "leading_date_moved": f"select ord, text from ({CLEAN})",
        "since_cutoff": f"select ord, coalesce(sort_key >= {CUT}, false) as since, coalesce(sort_key < {CUT}, false) as earlier from ({dated(v.REC_ORDERS)})",
        "active_since": f"""select doc_id, ord, text from ({v.REC_ORDERS}) where len(regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b')) + len(regexp_extract_all(text, {lit(word('present', 'current', 'ongoing'))})) > 0
 and ({has('text', word('present', 'current', 'ongoing'))} or list_max(list_transform(regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b'), lambda y: cast(y as int))) >= {q.SINCE})""",
        "valid_dates": f"""select ord, {has('x', r'^\d{4}-\d{2}-\d{2}$')} and try_cast(x as date) is not null as day_ok, coalesce(try_cast(y as bigint) between 1950 and 2030, false) as year_ok
 from (select ord, substr(trim(text), 1, 10) as x, regexp_extract(text, '(\\d+)', 1) as y from ({v.REC_ORDERS}))""",
        "normalised_keys": f"select doc_id, n, {by_case('line')} as by_case, {by_words('line')} as by_words, {by_record('line')} as by_record, {by_citation('line')} as by_citation, {bare('line')} as bare from ({LINES})",
        "service_clean": f"""select ord, {by_service('description', 'dates')} as service_key, {core('description')} as core, {_SERVICE_DESC} as description_,
 {_UNWRAP("case when lead <> '' and dates = '' then label else dates end")} as dates_ from ({dated(ACT, 'description')})""",
        "contribution_split": f"""select ord, case when {has('text', NOTE)} then {trim(f'regexp_extract(text, {lit(NOTE)}, 1)')} else {trim('text')} end as citation,
 coalesce(note, case when {has('text', NOTE)} then {trim(f'regexp_extract(text, {lit(NOTE)}, 2)')} end) as note,
 {by_citation(f"case when {has('text', NOTE)} then regexp_extract(text, {lit(NOTE)}, 1) else text end")} as key from ({v.PUBS})""",
        "lines": f"select doc_id, n, line from ({LINES})",
        "segments": f"""select doc_id, row_number() over (partition by doc_id order by k) - 1 as n, line from (select doc_id, k, {trim('line')} as line from (
 select doc_id, unnest(string_split_regex(replace(replace(text, '. ', '.  '), chr(13), ''), '\\n|\\s{{2,}}')) as line,
 unnest(range(len(string_split_regex(replace(replace(text, '. ', '.  '), chr(13), ''), '\\n|\\s{{2,}}')))) as k from documents)) where line <> ''""",
        "doc_headers": f"""select doc_id, arg_min(line, n) as name, coalesce(arg_min(line, n) filter (where regexp_matches(lower(line), 'department|dept')), '') as department,
 coalesce(arg_min(line, n) filter (where regexp_matches(lower(line), 'professor|lecturer|associate|assistant')), '') as title
 from (select doc_id, row_number() over (partition by doc_id order by ord) - 1 as n, trim(text) as line from ({v.REC_ORDERS})) where n < 20 group by doc_id""",
        "cut_tail": f"""select doc_id, case when doc_id % 3 = 0 then {rx('text', r'\s+$', '', False)} when doc_id % 3 = 1 then concat(text, chr(10), 'Conversion Review Summary', chr(10), 'no intro ', text) else text end as text from documents""",
        "section_excerpt": f"""select doc_id, n, line from (select *, min(case when n > a and contains(line, 'thing') then n end) over (partition by doc_id) as z from (
 select *, min(case when contains(line, 'shed') then n end) over (partition by doc_id) as a from ({LINES}))) where a is null or (n >= a and (z is null or n < z))""",
        "context_excerpt": f"""select doc_id, n, line from (select *, bool_or(keep) over (partition by doc_id) as any_ from (
 select *, bool_or({has('line', r'\b1996\b')}) over (partition by doc_id order by n rows between 1 preceding and 2 following) or {has('line', '(?i)lectures')} as keep from ({ORDER_LINES}))) where keep or not any_""",
        "slice_requests": excerpts(ORDER_LINES),
        "slice_routes": f"""select f.job_id, f.failures, s.slice_key, r.rank::bigint as rank, r.provider, r.max_tokens::bigint as max_tokens, r.attempts::bigint as attempts from (select job_id, count(*) as failures from ({v.OUTCOMES}) where state = 'failed' group by 1) f,
 {slice_rows()}, lateral (select * from (values (true, 1, 'cloud', 12000, 1), (true, 2, 'onPrem', 16000, 2), (false, 1, 'onPrem', 16000, 2), (false, 2, 'cloud', 12000, 1)) r(h, rank, provider, max_tokens, attempts)
  where r.h = s.high) r where r.rank <= least(f.failures, 2)""",
        "request_bodies": f"""select d.doc_id, d.slice_key, md5(case when not d.high then coalesce(e.body, d.text) else d.text end) as body_md5 from
 (select * from (select doc_id, string_agg(line, chr(10) order by n) as text from ({ORDER_LINES}) group by 1), {slice_rows()}) d left join
 (select doc_id, slice_key, string_agg(line, chr(10) order by n) as body from ({excerpts(ORDER_LINES)}) group by all) e on d.doc_id = e.doc_id and d.slice_key = e.slice_key
 where not (d.doc_id % 2 = 0 and d.slice_key = 'II_grants')""",
        "extracted_slices": f"""select doc_id, slice_key, row_number() over (partition by doc_id, slice_key order by n) - 1 as pos, line as text, null::varchar as error from ({excerpts(ORDER_LINES)})
 where line <> ''""",
        "markup_text": f"select page_id, md5(t) as text_md5, length(t) as n_chars from (select page_id, {_markup()} as t from pages)",
        "leak_scan": f"select {', '.join(f'count(*) filter (where {has("t", x)}) as {k}' for k, x in q.LEAKS.items())} from (select {_markup()} as t from pages)",
        "rich_paragraphs": """select concat(conv_id, '/', turn) as doc, 0::bigint as paragraph, trim(regexp_replace(concat(a, ' a &', role, case when turn % 2 = 0 then ' tail' else '' end), '\\s+', ' ', 'g')) as text,
 concat('[{"text":', to_json(concat(a, ' a &')), '},{"text":"', role, '","vertical_align":"superscript"}', case when turn % 2 = 0 then ',{"text":" tail"}' else '' end, ']') as runs
 from (select *, regexp_replace(text, '[<&]', '', 'g') as a from conversations) where length(trim(regexp_replace(concat(a, ' a &', role, case when turn % 2 = 0 then ' tail' else '' end), '\\s+', ' ', 'g'))) >= 12""",
        "ingest_partials": """select o_orderkey as id, 0::bigint as pos, 4.0::double as number, concat('Book ', o_orderkey) as citation, 'book' as pub_type, true as is_new from orders where o_orderkey % 6 = 0
 union all select o_orderkey, 3, 4.0, '12', 'other', null from orders where o_orderkey % 6 = 0 union all select o_orderkey, 0, 1.0, concat('Fenced ', o_orderkey), 'other', null from orders where o_orderkey % 6 = 1""",
        "ingest_strings": "select o_orderkey as id, unnest([0, 2])::bigint as pos, unnest(['A', '3']) as text from orders where o_orderkey % 6 = 0",
        "quarantine": "select o_orderkey as id, case when o_orderkey % 6 = 2 then 'not an object' else 'not JSON' end as reason from orders where o_orderkey % 6 in (2, 3)",
        "validate_strict": "select o_orderkey, o_orderstatus in ('O', 'F') and o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 as valid from orders",
        "metadata_last_wins": """select o_custkey as doc_id, coalesce(max(concat('N', o_custkey)) filter (where o_orderkey % 6 = 0), '') as name, '' as department, '' as title, '' as specialization from orders
 where o_orderkey % 6 not in (2, 3) group by 1""",
        "turns_last_wins": "select conv_id, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by 1",
        "grouped_entries": GROUPED,
        "flat_groups": f"""select conv_id, turn, trim(regexp_extract(x, '(?s)^\\s*([^:]{{4,90}}):\\s*(.+)$', 1)) as heading, regexp_extract(x, '(?s)^\\s*([^:]{{4,90}}):\\s*(.+)$', 2) as entry
 from (select conv_id, turn, concat(heading, ' ', entry) as x from ({v.TURNS})) where regexp_matches(x, '(?s)^\\s*([^:]{{4,90}}):\\s*(.+)$')""",
        "in_progress_split": f"select ord, home as bucket, cast(home <> bucket as bigint) as moved from ({MOVED})",
        "reclassified": f"select ord, bucket, pub_type from ({reclassified(v.PUBS)})",
        "routed_presentations": f"select ord, case when {has('text', word(*p.WIDE_AUDIENCE))} then 'presentations' else 'invitedPresentations' end as bucket from ({v.REC_ORDERS})",
        "display_filters": f"select ord, {has('text', word(*p.MENTORING))} as mentoring from ({v.REC_ORDERS}) where not regexp_matches(lower(text), '\\(poster\\)|poster presentation|contributed talk')",
        "split_views": f"""select doc_id, case when pub_type in ('book', 'chapter') then 'book' when pub_type in ('journal', 'review', 'proceedings') then pub_type else 'other' end as view, count(*) as n
 from ({v.PUBS}) where coalesce(is_new, true) group by 1, 2""",
        "exact_anti": f"""select a.doc_id, a.ord, a.bucket from (select *, {by_service('description', 'dates')} as k from ({ACT})) a where a.bucket = 'universityService'
 or not exists (select 1 from (select *, {by_service('description', 'dates')} as k from ({ACT})) s where s.bucket = 'universityService' and s.doc_id = a.doc_id and s.k = a.k)""",
        "core_conflicts": f"""select a.doc_id, a.ord, concat(s.d, ' (', s.t, ') / ', {bare('a.description')}) as conflict from (select *, {core('description')} as k from ({ACT}) where bucket <> 'universityService') a join
 (select doc_id, {core('description')} as k, arg_max(description, ord) as d, arg_max(dates, ord) as t from ({ACT}) where bucket = 'universityService' group by all) s on a.doc_id = s.doc_id and a.k = s.k""",
        "proceedings_anti": f"select bucket, count(*) as n, sum(ord)::bigint as total from ({without_proceedings(reclassified(v.PUBS))}) group by 1",
        "ordered_union": f"select doc_id, bucket, ord, row_number() over (partition by doc_id order by list_position([{', '.join(map(lit, q.BUCKET_ORDER))}], bucket), ord) as number from ({v.REC_ORDERS})",
        "merged_duplicates": merged(v.PUBS),
        "fuzzy_same": f"select key_a, key_b, round(common / smaller, 6) as share from ({PASSAGES})",
        "fuzzy_check": f"select key_a, count(*) as documents from ({PASSAGES}) group by 1",
        "abstract_anti": f"""select concat(conv_id, '/', turn) as key from conversations where turn > 0 and concat(conv_id, '/', turn) not in (select key_a from ({fuzzy(
            "select concat(conv_id, '/', turn) as key, text as body from conversations where turn > 0", "select concat(conv_id, '/', turn) as key, text as body from conversations where turn = 0")}))""",
        "best_rich_match": _best(),
        "cross_bucket_notes": f"""select lang, concat(f, '; ', source) as section, doc_id, n, item from (select *, first_value(source) over (partition by lang, k order by source, doc_id, n) as f from (
 select *, {bare('line')} as item, {_REVIEW} as k from ({LINES})) where length(k) >= 24) where f <> source""",
        "notes_deduped": f"""select lang, source, doc_id, n, line from ({LINES}) qualify row_number() over (partition by lang, {by_case('source')}, {by_case('line')} order by doc_id, n) = 1""",
        "section_counts": _counts(),
        "section_summary": f"""select c.*, cast(journals > 0 as bigint) + cast(other > 0 as bigint) + cast(rest > 0 as bigint) as filled, coalesce(g.required, 0) as required, coalesce(g.recommended, 0) as recommended,
 coalesce(g.optional, 0) as optional, coalesce(m.notes, 0) as notes from ({_counts()}) c left join (select doc_id % 100 as doc_id, count(*) filter (where severity = 'required') as required,
 count(*) filter (where severity = 'recommended') as recommended, count(*) filter (where severity = 'optional') as optional from ({v.GAPS_SRC}) group by 1) g on c.doc_id = g.doc_id
 left join (select conv_id % 100 as doc_id, count(*) as notes from conversations group by 1) m on c.doc_id = m.doc_id""",
        "gap_report": f"""select doc_id % 50 as group_id, severity, section, field, cast(doc_id as varchar) as instruction, case severity when 'required' then 1 when 'recommended' then 2 else 3 end::bigint as severity_rank,
 row_number() over (partition by doc_id % 50, severity order by doc_id) as number from ({v.GAPS_SRC})""",
        "final_state": FINAL,
        "job_status": _status(),
        "resolved_attempts": f"""select job_id, slice_key, arg_min(event_id, {{'a': attempt, 'b': event_id}}) filter (where state = 'done') as result, bool_or(state = 'done') as succeeded,
 case when not bool_or(state = 'done') then string_agg(message, ' | ' order by attempt, event_id) end as error from ({v.OUTCOMES}) group by 1, 2""",
        "content_hash": "select conv_id, sha256(string_agg(concat(lpad(cast(turn as varchar), 6, '0'), chr(0), text, chr(0)), '' order by turn)) as hash from conversations group by 1",
        "reprocess_plan": """select doc_id, case when doc_id % 3 <> 0 and doc_id % 5 <> 0 then 'reuse' else 'full' end as action,
 case when doc_id % 4 = 0 then 2001 when doc_id % 3 <> 0 and doc_id % 5 <> 0 then 1990 end::bigint as since_year from documents""",
        "purged_sources": f"select doc_id, doc_id % 200 as job_id from documents where doc_id % 200 not in (select job_id from ({FINAL}) where state = 'complete')",
        "rendered_lines": _rendered(),
        "result_json": f"""select doc_id, md5(cast(to_json({{'sections': map_from_entries(list((bucket, items) order by bucket))}}) as varchar)) as result_md5 from (
 select doc_id, bucket, list(text order by ord) as items from ({v.REC_ORDERS}) group by 1, 2) group by 1""",
        "explode_buckets": f"""select doc_id, bucket, row_number() over (partition by doc_id, bucket order by s, ord) as ord, status as text from (
 select doc_id, ord % 3 as s, ord, status, case when ord % 2 = 0 then 'evens' else 'odds' end as bucket from ({v.REC_ORDERS}))""",
        "file_admission": f"""select path, length, case when not ends_with(lower(path), '.docx') then 'only .docx files are taken' when length > {50 << 20} then 'larger than 50 MB' end as reject from ({v.FILES})""",
        "gap_totals": f"""select case when grouping(section) = 0 then 'section and severity' when grouping(severity) = 0 then 'severity' when grouping(doc_id) = 0 then 'document' else 'all' end as level,
 section, severity, doc_id, count(*) as gaps from ({v.GAPS_SRC}) group by grouping sets ((section, severity), (severity), (doc_id), ())""",
        "extract_attempts": """select doc_id, lang as slice_key, case when succeeded then n end as n_texts, succeeded, case when not succeeded then case when lang = 'en' then 'ValueError: cloud 1 | ValueError: onPrem 1 | ValueError: onPrem 2'
 else 'ValueError: onPrem 1 | ValueError: onPrem 2 | ValueError: cloud 1' end end as error, case when lang = 'en' then case when not c then 1 when not o1 then 2 else 3 end else case when not o1 then 1 when not o2 then 2 else 3 end end as attempts
 from (select *, not (c and o1 and o2) as succeeded from (select doc_id, coalesce(lang, '-') as lang, length(t) - length(replace(t, chr(10), '')) + 1 as n, length(t) % 3 = 0 as c, length(t) % 2 = 0 as o1, length(t) % 5 = 0 as o2
  from (select doc_id, lang, coalesce(text, '') as t from documents)))""",
        "live_status": _live(),
        "purged_store": f"select doc_id, doc_id % 200 as job_id, md5(text) as text_md5 from documents where doc_id % 200 not in (select job_id from ({FINAL}))",
        "refused_parts": f"select id, case when id % 6 = 2 then 'not an object' else 'not JSON' end as problem, md5(body) as refused_md5 from ({v.BODIES}) where id % 6 in (2, 3)",
        "partials": f"select job_id, event_id, state, slice_key from ({v.OUTCOMES}) where slice_key >= 'm' or state = 'done'",
        "anchor_counts": _anchors(),
        "duplicate_inventory": f"select source, key, count(*) as copies from (select source, {by_record('line')} as key from ({LINES})) where key <> '' group by all having count(*) > 1",
        "run_diff": f"""select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.bucket, b.bucket) as bucket, coalesce(a.number, b.number) as number,
 case when b.doc_id is null then 'removed' when a.doc_id is null then 'added' else 'changed' end as change from ({CHRONO}) a full outer join
 ({SECOND}) b
 on a.doc_id = b.doc_id and a.bucket = b.bucket and a.number = b.number where a.text is distinct from b.text""",
        "new_duplicates": f"""select b.* from {_repeats(SECOND)} b anti join {_repeats(CHRONO)} a on a.doc_id = b.doc_id and a.key = b.key""",
        "guarded_append": f"""select conv_id, unnest(range(len(kept))) as pos, unnest(kept) as text from (select conv_id, list_reduce(list_prepend(
  list_filter(texts[1:1], lambda x: {by_case('x')} <> ''), list_transform(texts[2:], lambda x: [x])), lambda acc, c: case when len(list_filter(acc, lambda y:
   least(len({tokens('y')}), len({tokens('c[1]')})) >= 8 and len(list_intersect({tokens('y')}, {tokens('c[1]')})) >= 0.9 * least(len({tokens('y')}), len({tokens('c[1]')})))) > 0 then acc else list_concat(acc, c) end) as kept
 from (select conv_id, list(text order by turn) as texts from conversations group by 1))""",
        "count_tolerance": f"""select bucket, expected, actual, case when expected = 0 then actual = 0 else abs(actual - expected) <= (case when bucket = 'peerReviewedJournals' then 0.02::double else 0.1::double end) * expected end as within
 from (select coalesce(a.bucket, b.bucket) as bucket, coalesce(a.n, 0) as expected, coalesce(b.n, 0) as actual from (select bucket, count(*) as n from ({v.PUBS}) group by 1) a full outer join
 (select bucket, count(*) as n from ({reclassified(f"select * exclude (home) replace (home as bucket) from ({MOVED})")}) group by 1) b on a.bucket = b.bucket)""",
        "date_precision": f"""select c.anchor, c.date, coalesce(f.ok, false) as ok from (values ('topic 3', '1997)'), ('topic 5', 'topic 5'), ('no such', '1999')) c(anchor, date) left join
 (select anchor, ends_with(arg_min(trim(text), ord), any_value(date)) as ok from ({CLEAN}), (values ('topic 3', '1997)'), ('topic 5', 'topic 5'), ('no such', '1999')) x(anchor, date)
  where contains(text, anchor) group by anchor) f on c.anchor = f.anchor""",
        "stream_dedup": f"""select job_id, slice_key, arg_min(event_id, {{'a': ts, 'b': event_id}}) as event_id, arg_min(state, {{'a': ts, 'b': event_id}}) as state from ({v.OUTCOMES}) group by 1, 2""",
        "stream_progress": f"""select strftime(time_bucket(interval '30 days', ts, timestamp '1970-01-01'), '%Y-%m-%d') as start, state, count(*) as n from ({v.OUTCOMES}) group by 1, 2""",
        "stream_barrier": f"""select job_id, count(*) filter (where state = 'done') as done, {q.BARRIER_SLICES} - count(*) filter (where state = 'done') as failed, count(*) >= {q.BARRIER_SLICES} as complete from (
 select job_id, slice_key, arg_min(state, {{'a': ms, 'b': event_id}}) as state from (select *, epoch_ms(ts) as ms, min(epoch_ms(ts)) over (partition by job_id) as begun from ({v.OUTCOMES}))
 where ms <= begun + {q.BARRIER_SECONDS * 1000} group by 1, 2) group by 1""",
        "stream_finalize": f"""select o.job_id, slice_key, n, state from (select user_id as job_id, event_type as slice_key, count(*) as n from events group by 1, 2) o
 join ({FINAL}) f on o.job_id = f.job_id""",
        "consolidated_citations": _consolidated(),
    } | posts()
    from rollcall.plans import merge_oracles  # it is built from the forms above

    out |= merge_oracles.oracle_sql()
    out["service_clean"] = f"select ord, service_key, core, description_ as description, dates_ as dates from ({out['service_clean']})"
    return out


def _repeats(rows: str) -> str:
    return f"(select doc_id, key, count(*) as copies from (select doc_id, {core('text')} as key from ({rows})) where key <> '' group by 1, 2 having count(*) > 1)"


def _markup() -> str:
    x = rx("replace(html, '</p>', chr(10))", "<[^>]+>")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return trim(rx(x, r"\s+\n", "\n"))


def _best() -> str:
    norm = lambda x: f"trim({rx(no_list_number(f'lower({x})'), '[^a-z0-9]+', ' ')})"
    long = lambda x: f"list_filter(list_distinct(string_split({x}, ' ')), lambda w: length(w) > 2)"
    return f"""select doc_id, record, arg_max(paragraph, {{'a': score, 'b': -paragraph}}) as paragraph, round(max(score), 6) as score from (
 select doc_id, record, paragraph, case when r = s then 1.0::double when contains(s, r) or contains(r, s) then 0.9::double
  else coalesce(len(list_intersect(lr, ls)) / nullif(greatest(len(lr), len(ls)), 0), 0)::double end as score from (
  select x.doc_id, record, paragraph, r, s, {long('r')} as lr, {long('s')} as ls from (select doc_id, ord as record, {norm('text')} as r from ({CLEAN})) x
   join (select doc_id, ord as paragraph, {norm('text')} as s from ({v.REC_ORDERS})) y on x.doc_id = y.doc_id where r <> '' and s <> '')) where score >= 0.72 group by 1, 2"""


def _counts() -> str:
    cols = ", ".join(f"count(*) filter (where bucket in ({', '.join(map(lit, b))})) as {g}" for g, b in q.GROUPS.items())
    return f"select doc_id, {cols} from ({v.PUBS}) group by 1"


def _status() -> str:
    now = f"timestamp '{q.NOW}'"
    age = lambda x: f"(epoch_us({now}) - epoch_us({x})) / 1e6"
    return f"""select job_id, case when lacks and {age('finished')} < 90 then 'merging' when lacks then 'failed' when fs is not null then fs when pending = 0 and locked and {age('started')} > 710 then 'failed'
 when pending = 0 then 'merging' when {age('started')} > 620 and done > 0 then 'merging' when {age('started')} > 620 then 'failed' else 'pending' end as status, done,
 case when fs is null and {age('started')} > 620 then failed + pending else failed end as failed from (
 select j.*, s.done, s.failed, s.pending, coalesce(fs in ('complete', 'failed_partial'), false) and not has_result as lacks from (
  select user_id as job_id, min(ts) as started, max(ts) as finished, case user_id % 5 when 0 then 'complete' when 1 then 'failed_partial' when 2 then 'failed' end as fs, user_id % 2 = 0 as has_result,
   user_id % 3 = 0 as locked from events group by user_id) j join (select job_id, count(*) filter (where state = 'done') as done, count(*) filter (where state = 'failed') as failed,
   count(*) filter (where state = 'pending') as pending from ({STATES}) group by 1) s on j.job_id = s.job_id)"""


def _rendered() -> str:
    dim = "(values " + ", ".join(f"({i}, {lit(h)}, {lit(b)}, {lit(f) if f else 'null'})" for i, (h, b, f) in enumerate(q.ORDER_LAYOUT)) + ") d(seq, heading, bucket, fallback)"
    return f"""with r as (select c.*, d.seq from ({CHRONO}) c join {dim} on c.bucket = d.bucket),
 h as (select c_custkey as doc_id, d.*, exists (select 1 from r where r.doc_id = c_custkey and r.seq = d.seq) as held from customer, {dim})
 select doc_id, row_number() over (partition by doc_id order by seq, kind, number, sub) as line_no, line from (
 select doc_id, seq, 0 as kind, 0 as number, 0 as sub, heading as line from h where held or fallback is not null union all
 select doc_id, seq, 0, 0, 1, fallback from h where not held and fallback is not null union all
 select doc_id, seq, 1, number, 0, 'New since last review' from r where divider union all
 select doc_id, seq, 1, number, 1, concat(case when is_new then '*' else '' end, number, '. ', text) from r)"""


def _anchors() -> str:
    parts = "string_split(text, ' ')"
    a = f"""select distinct anchor from (select text as anchor from benchmark union all select array_to_string(list_slice({parts}, 1, 8), ' ') as anchor from benchmark union all
 select concat(array_to_string(list_slice({parts}, 1, 2), ' '), '|', array_to_string(list_slice({parts}, -5, -1), ' ')) from benchmark)"""
    return f"""select anchor, count(doc_id) as matches from (select anchor, list_transform(string_split(anchor, '|'), lambda x: {by_words('x')}) as ps from ({a})) left join
 (select doc_id, {by_words('text')} as t from documents) on len(list_filter(ps, lambda x: not contains(t, x))) = 0 group by 1"""


def _consolidated() -> str:
    rows = without_proceedings(reclassified(f"select * exclude (home) replace (home as bucket) from (select *, cast(home <> bucket as int) as m1 from ({MOVED}))").replace(
        "select * exclude (home) replace (home as bucket, case", "select * exclude (home), m1 + cast(home <> bucket as int) as moved replace (home as bucket, case", 1))
    rows = rows.replace("select * exclude (home), m1 + cast(home <> bucket as int) as moved replace (", "select * exclude (home) replace (m1 + cast(home <> bucket as int) as m1, ")
    place = numbered(f"select * replace ({squeeze(bare('text'))} as text) from ({rows})", "doc_id, bucket", "m1, ord, text", "place")
    return f"select doc_id, bucket, row_number() over (partition by doc_id, bucket order by ord) as number, text, pub_type from ({merged(f'select * exclude (ord, place, m1, sort_key), place as ord from ({place})')})"
