"""Claim reports of a batch of texts at once (F8): no step of Spark's for each text, and few evaluations."""

import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_claims_once import TEXTS, brute
from tracemill.functions import evaluator
from tracemill.functions import markers as M

TEXTS = TEXTS + ["[[calc: 0/0]] -> 1\u2028[[calc: 3/0.5]] -> +6\x1e[[calc: 1.0000001+1]] -> 2", "[[calc: 1+1]] -> " + "9" * 400, "[[calc: 2+2]] -> 5\n" * 3000]


def test_a_batch_is_judged_as_its_lines():
    got = M.arrow_report(pa.array(TEXTS, "string")).to_pylist()
    assert [(r["ok"], r["checked"], r["failed"], [tuple(m.values()) for m in r["mismatches"]]) for r in got] == [brute(t) for t in TEXTS]
    assert M.arrow_report(pa.array([], "string")).to_pylist() == []


def test_few_expressions_reach_the_evaluator(monkeypatch):
    seen = []
    monkeypatch.setattr(evaluator, "safe_calc", lambda e, dialect, plain=evaluator.safe_calc: seen.append(e) or plain(e, dialect))
    exprs = ["1+1", "2**3", None, " 7 / 2", "1/0", "01+1", "2**3", "12345678901234567*1", "x", "0.5-3"]
    assert evaluator.arrow_values(pa.array(exprs)).to_pylist() == [2.0, 8.0, None, 3.5, None, None, 8.0, 12345678901234567.0, None, -2.5]
    assert seen == ["2**3", "01+1", "12345678901234567*1", "x"]


def test_no_text_is_taken_apart_in_the_plan(spark):
    """Patterns and lambdas of Spark cost each text several times what the batch costs."""
    x = M.verify_claims(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k long, t string"), "t", ["k"])
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan and "lambda" not in plan, plan


def test_texts_that_are_no_utf8(spark):
    df = spark.sql("SELECT CAST(concat(unhex('ff'), encode('[[calc: 1+1]] -> 3', 'utf-8'), unhex('c3')) AS STRING) AS t, 1 AS k")
    assert [(r.n_checked, r.n_mismatch) for r in M.verify_claims(df, "t", ["k"]).collect()] == [(1, 1)]
