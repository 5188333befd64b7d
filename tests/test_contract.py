"""Faults of canonical papers as JSON lines on literal cases."""

import json

from corpusmill.operators import contract

GOOD = {"canonical_id": "c1", "title": "T", "reconciliation_key": "k", "doc_ids": ["a", "b"], "authors": [], "year": 2020, "published_at": "2020-01-02T03:04:05Z", "source_ids": {"x": "1"}, "is_survey": False, "metadata_completeness_score": 0.5, "doi": None}


def faults(spark, *lines):
    df = spark.createDataFrame([(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "n int, value string")
    return sorted(((r.n, r.rule, r.detail) for r in contract.faults(df, "n").collect()), key=str)


def test_nothing_wrong(spark):
    assert faults(spark, GOOD, " ", None, {**GOOD, "canonical_id": "c2", "doc_ids": [], "year": " 1999 ", "metadata_completeness_score": 1}) == []
    assert faults(spark, None) == []


def test_whole_lines(spark):
    assert faults(spark, "{", "[1]", "3", '"x"', "null") == [(0, "unreadable", None), (1, "not_an_object", None), (2, "not_an_object", None), (3, "not_an_object", None), (4, "not_an_object", None)]


def test_fields(spark):
    got = faults(spark, {**GOOD, "canonical_id": "", "title": None, "color": 1, "a b": 2}, {**GOOD, "year": 1.5, "authors": "x", "source_ids": [], "is_survey": "no", "published_at": "soon", "doi": 7})
    assert [x for x in got if x[0] == 0] == [(0, "extra_field", "a b"), (0, "extra_field", "color"), (0, "missing_field", "title"), (0, "missing_id", None)]
    assert {x[2] for x in got if x[0] == 1} == {"year", "authors", "source_ids", "is_survey", "published_at", "doi"} and {x[1] for x in got if x[0] == 1} == {"wrong_type"}


def test_ids(spark):
    got = faults(spark, {**GOOD, "doc_ids": ["a", "a", "b", "b", "", ""]}, {**GOOD, "canonical_id": "c2", "doc_ids": ["b", "z"]}, {**GOOD, "canonical_id": "c2", "doc_ids": "b"})
    assert set(got) == {(0, "repeated_doc_id", "a"), (0, "repeated_doc_id", "b"), (2, "ids_not_a_list", None), (None, "repeated_id", "c2"), (None, "doc_id_of_several", "b")}


def test_counts(spark):
    df = spark.createDataFrame([(i, json.dumps({**GOOD, "canonical_id": f"c{i}", "doc_ids": [], "x": 1, "y": 1})) for i in range(4)], "n int, value string")
    assert sorted(map(tuple, contract.counts(contract.faults(df, "n"), "n").collect())) == [("extra_field", "x", 4, 4), ("extra_field", "y", 4, 4)]
