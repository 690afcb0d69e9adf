"""Claims found in one pass over a text, judged as line by line, and what is handed to Python for it."""

import re

from pyspark.sql import functions as F

from tracemill.functions import markers as M
from tracemill.functions import text as X
from tracemill.functions.evaluator import calc_each, safe_calc
from tracemill.operators import quality_rules

TEXTS = [None, "", "none", "a [[calc: 1+1]] -> 2 and [[calc: 2+2]] -> 5\n[[calc:3*3 ]]->-9.5x\r\n[[calc: 1/0]] -> 1", "[[calc: x [[calc: 1+1]] -> 3", "[[calc:\n1+1]] -> 2", "[[calc: 1+1]]\n-> 2", "[[calc: 1+1]] ->\t2 [[calc: (1+2)*3]] -> 9\x0b[[calc: 01+1]] -> 2\x85[[calc: 0.5*2]] -> 1", "[[calc: 1]] -> a [[calc: 2**3]] -> 8 [[calc: 9]] -> 9", "[[calc: ]] -> 4"]


def brute(text):
    found = [m for line in re.split(X.LINE_ENDS, text or "") if (m := re.search(M.LINE_CLAIM, line))]
    got = [(m[1].strip(" "), float(m[2]), safe_calc(m[1].strip(" "))) for m in found]
    wrong = [g for g in got if g[2] is not None and abs(g[2] - g[1]) > M.TOLERANCE]
    failed = sum(g[2] is None for g in got)
    return not wrong and not failed, len(got), failed, wrong


def test_reports_are_those_of_the_lines(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    got = M.with_claim_report(df, F.col("t"), "r").collect()
    assert {r.i: (r.r.ok, r.r.checked, r.r.failed, [tuple(m) for m in r.r.mismatches]) for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_python_is_given_no_lists(spark):
    """Spark measures an Arrow batch after each row, and a list column at the cost of all rows before."""
    df = spark.createDataFrame([(["1+1", None, "2**3"],), (None,), ([],), (["1+1"],)], "e array<string>").select(calc_each(F.col("e")).alias("v"))
    assert [r.v for r in df.collect()] == [[2.0, None, 8.0], None, [], [2.0]]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"slow\([^\n]*to_json|to_json[^\n]*\n[^\n]*slow|slow\([^\n]*structstojson", plan, re.I), plan


def test_quality_as_a_column_and_as_an_expression(spark):
    block = "<<VERDICT: {}>>\n<<EVIDENCE: e>>\n<<FIXED_ANSWER: {}>>"
    rows = [(block.format("CORRECT", "1"), "CORRECT", "1"), (block.format("INCORRECT", "2"), "INCORRECT", "1"), (block.format("CORRECT", "2"), "INCORRECT", "2.0"), ("<<VERDICT: so", "CORRECT", None), (None, "CORRECT", "1"), ("<<FIXED: 3>>", None, "3")]
    df = spark.createDataFrame(rows, "b string, l string, g string").withColumn("own", quality_rules.verifier_quality(F.col("b"), F.col("l"), F.col("g")))
    for r in quality_rules.with_verifier_quality(df, F.col("b"), F.col("l"), F.col("g"), "qc").collect():
        assert r.own == r.qc
