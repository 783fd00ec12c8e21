"""Results are made and parsed by many tasks, and each reading of them parses a body once."""

import pytest

from rollcall.plans.queries import QUERIES
from rollcall.sources import ingest

READINGS = {"ingest_services": 1, "ingest_notes": 1, "ingest_groups": 1, "ingest_sections": 2, "merged_metadata": 1, "validate_result": 1, "record_views": 2, "structural_gaps": 4}


@pytest.mark.parametrize("name", list(READINGS))
def test_parsed_once(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == READINGS[name]
    assert plan.count("REPARTITION_BY_NUM") == READINGS[name]


def test_what_is_no_list_has_no_elements(spark):
    odd = ['{"sections": {"awards": {"a": "b"}, "books": null}}', '{"sections": ["awards"]}', '[{"sections": {"awards": ["x"]}}]', '{"sections": {"awards": ["x", {"y": 1}]}}', "no JSON", None,
           ' ```json\n{"sections": {"awards": ["z ```"]}}\n``` ']
    df = spark.createDataFrame(list(enumerate(odd)), "id int, body string")
    found = ingest.string_list(df, "body", "awards").select("id", "pos", "text").collect()
    assert sorted(map(tuple, found)) == [(3, 0, "x"), (6, 0, "z ```")]
    assert sorted(map(tuple, ingest.section_elements(df, "body").select("id", "bucket", "pos").collect())) == [(3, "awards", 0), (3, "awards", 1), (6, "awards", 0)]


def test_a_document_of_no_object_has_no_metadata(spark):
    df = spark.createDataFrame([(1, 1, "[1]"), (1, 2, '{"metadata": {"name": "A"}}'), (2, 3, "[1]"), (2, 4, None)], "doc_id int, part int, body string")
    assert [(r["doc_id"], r["name"]) for r in ingest.metadata(df, "doc_id", "body", "part").collect()] == [(1, "A")]
