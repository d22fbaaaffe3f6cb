"""Distinct counts from sketches, against plain counting."""

import itertools

import pytest

from erario.operators import sketches

SCHEMA = "ano int, uf string, funcao string, nome_autor string"
QUESTIONS = "id_consulta string, ano int, uf string, funcao string"


@pytest.fixture(scope="module")
def facts():
    return [(2019 + i % 4 if i % 13 else None, ("AC", "AM", None)[i % 3], ("10", "12")[i % 2], f"autor {i * i % 97}" if i % 10 else None) for i in range(600)]


def asked():
    values = itertools.product((None, 2019, 2021, 1900), (None, "AC", "XX"), (None, "12"))
    return [(f"{k}|{copy}", *v) for k, v in enumerate(values) for copy in range(2)]


def by_definition(facts, question):
    return len({r[3] for r in facts if r[3] is not None and all(q is None or q == v for q, v in zip(question[1:], r[:3], strict=True))})


def test_counts_under_any_filter(spark, facts):
    stored = sketches.distinct_sketches(spark.createDataFrame(facts, SCHEMA))
    questions = spark.createDataFrame(asked(), QUESTIONS)
    got = sketches.count_distinct_many(questions, stored)
    assert {r.id_consulta: r.distintos for r in got.collect()} == {q[0]: by_definition(facts, q) for q in asked()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_loads_merge_into_stored_sketches(spark, facts):
    """Overlapping loads count no value twice."""
    first, second = (sketches.distinct_sketches(spark.createDataFrame(part, SCHEMA)) for part in (facts[:400], facts[300:]))
    merged = sketches.merge_sketches(first, second)
    assert merged.count() == len({r[:3] for r in facts})
    got = sketches.count_distinct_many(spark.createDataFrame(asked(), QUESTIONS), merged)
    assert {r.id_consulta: r.distintos for r in got.collect()} == {q[0]: by_definition(facts, q) for q in asked()}


def test_large_counts_stay_within_the_error(spark):
    rows = spark.range(200_000).selectExpr("cast(2000 + id % 2 as int) AS ano", "'AC' AS uf", "cast(id % 3 as string) AS funcao", "concat('a', id % 60000) AS nome_autor")
    questions = spark.createDataFrame([("all", None, None, None), ("year", 2001, None, None), ("both", 2000, "AC", "1")], QUESTIONS)
    want = {"all": 60_000, "year": 30_000, "both": 10_000}
    got = {r.id_consulta: r.distintos for r in sketches.count_distinct_many(questions, sketches.distinct_sketches(rows)).collect()}
    error = 1.04 / 2 ** (sketches.PRECISION / 2)
    assert got.keys() == want.keys() and all(abs(got[k] - n) <= 5 * error * n for k, n in want.items()), got


def test_no_questions_and_no_rows(spark, facts):
    nothing = sketches.distinct_sketches(spark.createDataFrame([], SCHEMA))
    questions = spark.createDataFrame(asked(), QUESTIONS)
    assert {r.distintos for r in sketches.count_distinct_many(questions, nothing).collect()} == {0}
    assert sketches.count_distinct_many(questions.limit(0), sketches.distinct_sketches(spark.createDataFrame(facts, SCHEMA))).count() == 0
