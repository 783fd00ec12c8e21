"""Tables that grow with the documents are never broadcast, however small their files are."""

import json

from rollcall.operators import audit
from rollcall.plans.consolidate import merge_results
from rollcall.sources import parts

BODY = {"metadata": {"name": "N"}, "sections": {
    "employment": [{"from": "1999", "to": "2001", "institution": "University of X", "location": "", "rank": "Professor"}], "education": [{"school": "S", "degree": "PhD"}],
    "universityService": [{"description": "Chair of a panel", "dates": "1999"}], "grants": [{"title": "T", "funder": "F", "period": "2000"}],
    "studentInstructionalGroups": [{"heading": "PhD students", "entries": ["One Person, 2001"]}], "memberships": ["m"], "books": [{"citation": "A book on things (2001)"}]},
    "gaps": [{"section": "s", "field": "f", "instruction": "i", "severity": "optional"}], "reviewNotes": [{"section": "s", "topic": "t", "instruction": "i"}]}
LISTS = ("employment", "education", "universityService", "grants", "studentInstructionalGroups", "memberships", "books")


def test_whole_results_are_joined_where_their_documents_lie(spark):
    rows = spark.createDataFrame([(i // 2, i, json.dumps(BODY) if i < 38 else "{}") for i in range(40)], "doc_id long, part long, body string")
    out = merge_results(rows).kept(parts.kept_by_document).documents()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" not in plan
    got = {r.doc_id: json.loads(r.result) for r in out.collect()}
    assert set(got) == set(range(20))
    for i, x in got.items():
        held = {c: bool(x["sections"][c]) for c in LISTS} | {c: bool(x[c]) for c in ("gaps", "reviewNotes")}
        assert held == dict.fromkeys(held, i < 19) and x["metadata"]["name"] == ("N" if i < 19 else "")


def test_gaps_are_merged_and_only_the_rules_broadcast(spark, tmp_path):
    def stored(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    *_, section, field, instruction = audit.GAP_RULES[0]
    records = stored([(i, "employment", ["location"]) for i in range(6)], "doc_id long, kind string, missing array<string>", "records")
    gaps = stored([(i, section.upper(), field, instruction) for i in (1, 4)] + [(2, section, "other", instruction)], "doc_id long, section string, field string, instruction string", "gaps")
    out = audit.structural_gaps(records, gaps, "doc_id")
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
    assert sorted((r.doc_id, r.field) for r in out.collect()) == [(i, field) for i in (0, 2, 3, 5)]
