"""Containment and walks over JSON documents on literal cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import documents


def jsonb_contains(a, b, top=True):
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and jsonb_contains(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(jsonb_contains(x, y, False) for x in a) for y in b)
    if isinstance(a, list):
        return top and any(jsonb_contains(x, b, False) for x in a)
    return type(a) is type(b) and a == b if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None else isinstance(a, (int, float)) == isinstance(b, (int, float)) and a == b


DOCUMENTS = [
    {"a": 1, "b": {"c": [1, 2, {"d": "x"}]}}, {"tags": ["nlp", "vision"]}, {"tags": "nlp"}, [1, [2, 3]], ["x", "y"], "x", 7, True, None, {}, [], {"a": None}, {"a": 1.0}, {"a": "1"},
    {"it's": {'say "hi"': "esc\\aped é\n"}}, {"a": [{"b": 1, "c": 2}, {"b": 2}]}, {"a": {"a": {"a": [[["deep"]]]}}},
]
NEEDLES = [{}, [], {"a": 1}, {"b": {"c": [2]}}, {"b": {"c": [{"d": "x"}]}}, {"tags": ["nlp"]}, {"tags": "nlp"}, [2], [[2]], "x", 7, True, None, {"a": None}, {"a": "1"}, {"it's": {'say "hi"': "esc\\aped é\n"}}, {"a": [{"b": 1}]}, {"a": [{"b": 1, "c": 3}]}, {"a": {"a": {"a": [[["deep"]]]}}}, ["y", "x", "x"], 1]


def test_containment_equals_its_definition(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCUMENTS)] + [(98, "no json"), (99, None)], "id int, t string").select("id", documents.parsed(F.col("t")).alias("v"))
    got = df.select("id", *[documents.contains_json(F.col("v"), json.dumps(n)).alias(f"n{i}") for i, n in enumerate(NEEDLES)]).collect()
    for r in got:
        want = [r.id < 98 and jsonb_contains(DOCUMENTS[r.id], n) for n in NEEDLES]
        assert [r[f"n{i}"] for i in range(len(NEEDLES))] == want, DOCUMENTS[r.id] if r.id < 98 else r.id
    with pytest.raises(ValueError, match="both kinds"):
        documents.contains(F.col("v"), {"'\"": 1})


def test_keys_that_come_twice_make_no_document(spark):
    r = spark.createDataFrame([('{"a": 1, "a": 2}',)], "t string").select(documents.parsed(F.col("t")).alias("v")).select(documents.contains(F.col("v"), {"a": 1}).alias("c"), documents.value_at(F.col("v"), "a").alias("x")).first()
    assert (r.c, r.x) == (False, None)


def test_paths(spark):
    v = documents.parsed(F.lit(json.dumps(DOCUMENTS[0])))
    r = spark.range(1).select(documents.value_at(v, "b.c[2].d").alias("a"), documents.value_at(v, "b.c[1]", "int").alias("b"), documents.value_at(v, "b.z").alias("c"), documents.value_at(v, "b.c[2].d", "int").alias("d")).first()
    assert tuple(r) == ("x", 2, None, None)


def test_all_strings_of_a_document(spark):
    rnd = random.Random(2)

    def made(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.4:
            return rnd.choice(["s1", "s2", "", 3, None, True])
        return [made(depth - 1) for _ in range(rnd.randint(0, 3))] if kind < 0.7 else {rnd.choice("pqr"): made(depth - 1) for _ in range(rnd.randint(0, 3))}

    def walk(x):
        return [x] if isinstance(x, str) else [s for y in (x.values() if isinstance(x, dict) else x) for s in walk(y)] if isinstance(x, (dict, list)) else []

    docs = [made(4) for _ in range(40)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, t string").select("id", documents.parsed(F.col("t")).alias("v"))
    rows = documents.strings(df, "id", "v", depth=5).collect()
    assert sorted((r.id, r.value) for r in rows) == sorted((i, s) for i, d in enumerate(docs) for s in walk(d))
    assert {r.id: sorted(r["values"]) for r in documents.flattened(df, "id", "v", depth=5).collect()} == {i: sorted(set(walk(d))) for i, d in enumerate(docs) if walk(d)}
    with pytest.raises(Exception, match="nested deeper"):
        documents.strings(df, "id", "v", depth=1).collect()
