"""Views that give the driver's tables the shape of the jobs' inputs.

Each is one SELECT that Spark and DuckDB both read, so that both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages")

_MONTH = "rtrim(substr('January  February March    April    May      June     July     August   SeptemberOctober  November December ', cast(month(o_orderdate) as int) * 9 - 8, 9))"
_YEAR = "cast(year(o_orderdate) as string)"
_TWO = "lpad(cast({} as string), 2, '0')"
_TITLE = """concat(case o_orderkey % 9 when 0 then 'Invited lecture' when 1 then 'Chair, Academic Senate panel' when 2 then 'Member of departmental review board'
 when 3 then 'Talk at the World Congress' when 4 then 'Seminar (poster)' when 5 then 'Journal paper under review' when 6 then 'International   Symposium keynote'
 when 7 then 'Prize for teaching' else 'Visiting Scholar' end, ' on topic ', cast(o_orderkey % 13 as string))"""

#: Numbered, dated records of a customer: doc_id, ord, bucket, text.
REC_ORDERS = f"""select o_custkey as doc_id, o_orderkey as ord, o_orderpriority as bucket, o_orderstatus as status,
 case o_orderkey % 8
  when 0 then concat(cast(o_orderkey % 90 + 1 as string), '. ', {_MONTH}, ' ', cast(day(o_orderdate) as string), ', ', {_YEAR}, ' ', {_TITLE})
  when 1 then concat('(', cast(o_orderkey % 90 + 1 as string), ') ', {_TITLE}, ', ', {_MONTH}, ' ', {_YEAR})
  when 2 then concat({_YEAR}, '-', {_TWO.format('month(o_orderdate)')}, '-', {_TWO.format('day(o_orderdate)')}, ': ', {_TITLE})
  when 3 then concat({_YEAR}, ' - present ', {_TITLE})
  when 4 then concat({_TITLE}, ' (', {_YEAR}, ')')
  when 5 then concat('1750 drawings, shown ', {_YEAR}, ' ', {_TITLE})
  when 6 then concat('  ', {_TITLE}, ', ', cast(day(o_orderdate) as string), ' ', {_MONTH}, ' ', {_YEAR}, ' ')
  else {_TITLE} end as text
 from orders"""

#: Citations of a supplier, with copies: doc_id, ord, bucket, text, pub_type, note, is_new.
PUBS = """select l_suppkey as doc_id, l_orderkey * 10 + l_linenumber as ord,
 case l_linenumber when 1 then 'peerReviewedJournals' when 2 then 'otherArticles' when 3 then 'otherProceedings' when 4 then 'refereedProceedings'
  when 5 then 'abstracts' when 6 then 'workInProgress' else 'books' end as bucket,
 concat(case when l_orderkey % 3 = 0 then concat(cast(l_orderkey % 50 as string), '. ') else '' end, 'Study of ', p_name, ', ', p_brand,
  case p_partkey % 8 when 0 then ', Journal of Parts, 1999' when 1 then ', Proc. of the Part Meeting, 2001' when 2 then ': review of a book, Press, 1998'
   when 3 then ', submitted' when 4 then ', national workshop 2005' when 5 then ', International Parts Symposium, 2003' when 6 then ' (no date)' else ', Letters, 2010' end,
  case when l_orderkey % 11 = 0 then ' *Co-author with students.' else '' end) as text,
 case l_orderkey % 4 when 0 then 'other' when 1 then 'journal' when 2 then 'book' else 'proceedings' end as pub_type,
 case when l_orderkey % 5 = 0 then concat('note ', l_linestatus) end as note,
 case when l_returnflag = 'N' then true when l_returnflag = 'R' then false end as is_new
 from lineitem join part on l_partkey = p_partkey"""

#: Activities and services of a customer, whose wording and dates differ: doc_id, ord, bucket, description, dates.
ACTIVITIES = f"""select o_custkey % 300 as doc_id, o_orderkey as ord, case when o_orderkey % 3 = 0 then 'universityService' else 'professionalActivities' end as bucket,
 concat(case o_orderkey % 4 when 0 then 'Chair, ' when 1 then 'Member of ' when 2 then '3. Campus ' else '' end, 'board on topic ', cast(o_orderkey % 13 as string),
  case when o_orderkey % 3 = 0 then '' else concat(' ', {_YEAR}) end) as description,
 case when o_orderkey % 3 = 0 then case when o_orderkey % 5 = 0 then '' else concat('(', {_YEAR}, ')') end else '' end as dates
 from orders"""

#: Posts of a person: doc_id, ord, rank, institution, start, finish.
POSTS = """select c_nationkey as doc_id, c_custkey as ord,
 case c_custkey % 8 when 0 then 'Professor' when 1 then 'Visiting Professor' when 2 then 'Distinguished Professor' when 3 then 'Postdoctoral Fellow' when 4 then ''
  when 5 then 'Chair' when 6 then 'Fellow' else 'Staff Scientist' end as rank,
 concat(case when c_custkey % 5 = 0 then '' else concat('University of ', n_name) end, case when c_custkey % 7 = 0 then ' Council' else '' end) as institution,
 cast(1980 + c_custkey % 30 as string) as start, case when c_custkey % 3 = 0 then cast(1980 + c_custkey % 30 as string) when c_custkey % 3 = 1 then '' else ' 2015' end as finish
 from customer join nation on c_nationkey = n_nationkey"""

#: Outcomes of slices: job_id, slice_key, state, ts, event_id, message.
OUTCOMES = """select user_id as job_id, event_type as slice_key, case when event_id % 7 < 2 then 'failed' else 'done' end as state, ts, event_id,
 concat('code ', cast(event_id % 10 as string)) as message, event_id % 3 as attempt from events"""

#: Lines of the corpus: doc_id, n, line; written for DuckDB, as Spark makes them with read_lines.
LINES_DUCK = r"""select doc_id, lang, source, row_number() over (partition by doc_id order by k) - 1 as n, line from (
 select doc_id, lang, source, k, regexp_replace(line, '^\s+|\s+$', '', 'g') as line from (
  select doc_id, lang, source, unnest(string_split_regex(text, '\r?\n')) as line, unnest(range(len(string_split_regex(text, '\r?\n')))) as k from documents)) where line <> ''"""

#: Documents as if they were files: path, length.
FILES = """select concat(source, '/', cast(doc_id as string), case doc_id % 4 when 0 then '.DOCX' when 1 then '.pdf' else '.docx' end) as path, n_chars * 9000 as length from documents"""

#: Turns of conversations as student-group entries: conv_id, turn, heading, entry.
TURNS = """select conv_id, turn, case turn % 5 when 0 then 'Current Ph.D. Students:' when 1 then 'Undergraduate researchers' when 2 then 'Masters students' when 3 then concat('Group ', role)
 else '' end as heading, case turn % 4 when 0 then concat('1. ', text) when 1 then concat('Current Ph.D. Students: ', text) when 2 then text
 else concat(role, ' ', cast(2000 + turn as string)) end as entry, role, text from conversations"""

#: What documents lack: doc_id, kind, severity, section.
GAPS_SRC = """select d.doc_id, case d.doc_id % 3 when 0 then 'employment' when 1 then 'education' else 'grants' end as kind, l.quality, l.toxic,
 case when l.quality is null then 'required' when l.quality = 0 then 'recommended' else 'optional' end as severity, d.source as section, d.lang as field
 from documents d left join labels l on d.doc_id = l.doc_id"""

#: Results of an extractor as text, good and bad: id, part, body.
BODIES = """select o_orderkey as id, o_custkey as doc_id, case o_orderkey % 6
 when 0 then concat('{"metadata": {"name": "N', cast(o_custkey as string), '", "title": ""}, "sections": {"books": [{"citation": "  Book ', cast(o_orderkey as string),
   ' ", "type": "book", "number": "4", "isNewSinceLastReview": true}, 7, {"citation": {}}, {"citation": 12, "type": "nonsense", "isNewSinceLastReview": "yes"}], "awards": [" A ", "", 3, {"x": 1}]}}')
 when 1 then concat('```json', chr(10), '{"sections": {"books": [{"citation": "Fenced ', cast(o_orderkey as string), '"}]}}', chr(10), '```')
 when 2 then '[1, 2]' when 3 then 'no JSON' when 4 then '{"sections": {"books": {"citation": "not a list"}}}' else '{"sections": {"books": []}}' end as body from orders"""


_FULL = """{"metadata": {"name": "N@D", "department": "Dept @B", "title": "", "processedAt": "now"}, "sections": {"specialization": "@S",
"employment": [{"from": "19@N", "to": "@Y", "institution": "College @B", "location": "", "rank": "Professor"}, {"from": "@Y", "to": "@Y", "institution": "Academy of Number @A Sciences and Letters of the Far North",
"location": "Town", "rank": "Visiting Scholar"}, {"rank": "", "institution": " "}, "x"],
"education": [{"school": "School @B", "degree": "PhD (1980)", "datesFrom": "", "datesTo": " ", "location": " ", "major": "", "dateReceived": "1980"}, {"major": "m"}],
"universityService": [{"description": "@P. Chair, board on topic @A", "dates": "(@Y)", "category": "departmental"}, {"description": "@M @Y Member of campus panel @B", "dates": "", "category": "nonsense"}, {"dates": "x"}],
"professionalActivities": ["@P. board on topic @A @Y", "Panel of the society for number @C things"], "externalProfessionalActivities": ["board on topic @A", "Panel of the society for number @C things"],
"reviewerActivities": ["Panel of the society for number @C things", "@Y Journal @A"], "memberships": ["Society @C"], "outreach": ["@Y School visit @C"], "otherActivities": ["Club @C, @Y"],
"grants": [{"title": "Grant @A", "funder": " F ", "period": "@Y", "status": "current", "role": "", "coPIsShare": 12}, {"title": "Fund @C", "status": "over", "role": "PI", "coPIsShare": "all"}, {"period": "none"}],
"studentInstructionalGroups": [{"heading": "Current Ph.D. Students:", "entries": ["1. Student @A, @Y", 3, "", " "]}, {"heading": "", "entries": ["x"]}, {"heading": "Empty", "entries": []}],
"studentInstructionalActivities": ["Masters students: Student @B, 1999", "no group"], "awards": ["@Y Prize @C", " "],
"presentations": ["@M @Y Talk number @A at the annual world meeting of makers and users of things"],
"invitedPresentations": ["@Y Talk at College @B", "National workshop talk number @A, @Y", "@P. @M @Y Talk number @A at the annual world meeting of makers and users of things"],
"peerReviewedJournals": [{"citation": "@P. Study of thing @A, Journal of Things, @Y", "type": "journal", "number": "4", "isNewSinceLastReview": true}, {"citation": "Study of part @B, submitted"}, 7, {"citation": {}}],
"otherArticles": [{"citation": "Paper @A, Proc. of the Things, @Y", "type": "other", "contributionNote": "n @B"}, {"citation": "Study of thing @A, Journal of Things, @Y", "articleKind": "review"}],
"abstracts": [{"citation": "Talk number @A at the annual world meeting of makers and users of things, @Y", "type": "abstract"}]},
"gaps": [{"section": "Section I: Education", "field": "School Location", "instruction": "Review education rows marked @QNot listed@Q and add school locations when available.", "severity": "odd"}, {"severity": "required"}],
"reviewNotes": [{"section": "S", "topic": "T", "instruction": "Check  @C"}, {"topic": "no"}]}"""
_SOME = """{"metadata": {"name": "", "title": "T@D"}, "sections": {"specialization": "", "grants": "no list", "employment": {"rank": "Professor"}, "awards": ["1990 Medal @C"], "abstracts": [{"citation": "Piece @B, 2001"}]},
"gaps": [{"section": "Other", "severity": "required"}]}"""


def _filled(template: str) -> str:
    """The template as SQL text, its marks replaced by values of the row."""
    x = "'" + template.replace("\n", " ").replace("'", "''") + "'"
    year, key = "cast(year(o_orderdate) as string)", "o_orderkey"
    for mark, value in (("@D", "cast(o_custkey as string)"), ("@B", f"cast({key} % 7 as string)"), ("@C", f"cast({key} % 4 as string)"), ("@A", f"cast({key} % 13 as string)"), ("@P", f"cast({key} % 90 + 1 as string)"),
                        ("@N", f"cast(60 + {key} % 40 as string)"), ("@S", f"case when {key} % 3 = 0 then concat('Field ', cast({key} as string)) else '' end"), ("@M", _MONTH), ("@Y", year), ("@Q", "concat(chr(92), chr(34))")):
        x = f"replace({x}, '{mark}', {value})"
    return x


#: Parts of documents, ten each, with a date: o_orderkey, o_custkey, o_orderdate.
_PARTS = """(select c_custkey as o_orderkey, cast((c_custkey - c_custkey % 10) / 10 as bigint) as o_custkey,
 make_date(cast(1985 + c_custkey * 7 % 35 as int), cast(c_custkey % 12 + 1 as int), 1) as o_orderdate from customer) x"""
#: Results with every kind of record, good and bad: id, doc_id, part, body.
FULL_BODIES = f"""select o_orderkey as id, o_custkey as doc_id, o_orderkey as part, case o_orderkey % 8 when 2 then '[1, 2]' when 3 then {_filled(_SOME)}
 when 5 then concat('```json', chr(10), {_filled(_FULL)}, chr(10), '```') when 6 then 'no JSON' else {_filled(_FULL)} end as body from {_PARTS}"""


_WHOLE = """{"metadata": {"name": "N@D", "department": "", "title": "", "processedAt": "now"@E1}, "sections": {"employment": [{"from": "", "to": "", "institution": "", "location": "", "rank": @E2}],
"education": [], "universityService": [{"description": "", "dates": "", "category": "@E3"}], "studentInstructionalGroups": [{"heading": "", "entries": ["a"@E4]}], "grants": [{"title": "", "funder": "", "period": "", "status": "past"@E5}],
"publicService": [], "professionalActivities": [], "memberships": [@E6], "awards": ["a", "b"], "teaching": [], "studentInstructionalActivities": [], "externalProfessionalActivities": [], "consulting": [], "reviewerActivities": [],
"presentations": [], "invitedPresentations": [], "diversityContributions": [], "outreach": [], "clinicalActivities": [], "otherActivities": [], @E7
"peerReviewedJournals": [{"number": 1, "citation": "c", "type": "journal"@E8}], "reviewAndInvited": [], "books": [], "chapters": [], "refereedProceedings": [], "otherArticles": [], "otherProceedings": [], "abstracts": [],
"popularWorks": [], "additionalProducts": [], "theses": [], "patents": [], "workInProgress": []}, "gaps": [@E9]}"""
#: One fault in each of these results, in turn; the first two have none.
_FAULTS = (
    ("E1", "", ', "reviewPeriodStart": null'), ("E2", '""', "7"), ("E3", "other", "none"), ("E4", "", ", null"), ("E5", ', "amount": "1"', ', "role": false'), ("E6", '"m"', "{}"),
    ("E7", '"externalReviews": [],', ""), ("E8", ', "isNewSinceLastReview": true', ', "articleKind": "odd"'), ("E9", "", '{"section": "", "field": "", "instruction": "", "severity": "odd"}'))


def _faulty() -> str:
    x = "'" + _WHOLE.replace("\n", " ") + "'"
    for i, (mark, good, bad) in enumerate(_FAULTS):
        x = f"replace({x}, '@{mark}', case when o_orderkey % 11 = {i + 2} then '{bad}' else '{good}' end)"
    return f"replace({x}, '@D', cast(o_custkey as string))"


#: Whole results, most of them with a fault, with the hash and year kept beside them: id, body, hash, since_year.
WHOLE_BODIES = f"""select o_orderkey as id, {_faulty()} as body, case when o_orderkey % 5 = 0 then 'nohash' else repeat(concat(md5(cast(o_orderkey as string))), 2) end as hash,
 case when o_orderkey % 3 = 0 then 1900 + o_orderkey % 400 end as since_year from {_PARTS}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SELECT over the tables of a folder, without leaving names behind in the session."""
    import re

    names = [n for n in TABLES if re.search(rf"\b(?:from|join) {n}\b", sql)]
    for n in names:
        sql = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}_}}", sql)
    parts = re.split(r"(\{\w+_\})", sql)
    kept = {f"{n}_" for n in names}
    escaped = "".join(x if x[1:-1] in kept and x.startswith("{") else x.replace("{", "{{").replace("}", "}}") for x in parts)
    return spark.sql(escaped, **{f"{n}_": table(spark, sf_dir, n) for n in names})
