"""Expected values derived from the semantics of each function."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import markers as M
from tracemill.functions import text as X
from tracemill.functions.evaluator import calc, evaluate_plan, safe_calc
from tracemill.operators import fields, joins, metrics, quality_rules, sampling


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("expr", "dialect", "value"), [
    ("7 % -3", "verifier", -2.0), ("round(2.5)", "verifier", 2.0), ("1/0", "eval", None), ("007", "eval", None), ("1,000", "eval", None), ("(-8)**(1/3)", "eval", None), ("", "eval", None),
    ("7//2", "verifier", 3.0), ("7//2", "normalizer", 3.0), ("7//2", "router", None), ("7//2", "repair", None), ("2^3", "reasoner", 8.0), ("2^3", "eval", None), ("10**20+1-10**20", "eval", 1.0), ("sin(0)", "normalizer", 0.0), ("sin(0)", "eval", None), ("9**9**9", "eval", None), ("1e3", "eval", 1000.0), ("0x10", "eval", 16.0),
])
def test_evaluator(expr, dialect, value):
    assert safe_calc(expr, dialect) == value


def test_plans():
    assert evaluate_plan("1. 3+4\n2. _1*2\n<stop>\n3. 9")[0] == [7, 14]
    values, logs = evaluate_plan("1. 5\njunk\n2. _2+1")
    assert values == [5, 1]
    assert [g["error"] for g in logs].count("line_parse") == 1


@given(st.integers(-999, 999), st.integers(-999, 999), st.sampled_from(["+", "-", "*"]))
def test_evaluator_agrees_with_python(a, b, op):
    assert safe_calc(f"({a}){op}({b})") == {"+": a + b, "-": a - b, "*": a * b}[op]


def test_calc_column(spark):
    rows = spark.createDataFrame([("3+4",), ("2*(3+4)",), ("1/0",), ("007+1",), (None,)], "e string").select(calc(F.col("e")).alias("v")).collect()
    assert [r.v for r in rows] == [7.0, 14.0, None, None, None]


def test_markers():
    assert M.recomputed("[[calc: sqrt(4)]] -> 2") == ""
    assert M.recomputed("[[calc: 3*4]] -> 13.") == "[[calc: 3*4]] -> 12"
    assert M.repaired("1. Total [[calc: ]] -> 60") == "1. Total [[calc: 1.0*60.0]] -> 60"
    assert M.patched("[[calc: 2+2]] -> 5 and x -> 7") == "[[calc: 2+2]] -> 4.0 and x -> 4.0"
    assert M.repaired(M.repaired("a [[calc: 2+2]] -> 5")) == M.repaired("a [[calc: 2+2]] -> 5")


@pytest.mark.parametrize(("a", "b", "same"), [("2, 3", "3,2", True), ("10\\sqrt{3}", "17.3205", False), ("\\frac{1}{2}", "0.5", True), ("1,000", "1000", False), ("", "", False), ("x", "x", True), ("2*3", "6", True), ("(1+2)/3", "1", True), ("x.", "x", True), ("\\frac{3}{4}.", "0.75", True), ("007", "7", False), ("1, 2", "1", False), ("90^\\degree", "90", False), ("90°", "90", True)])
def test_answers_equal(spark, a, b, same):
    assert one(spark, A.answers_equal(F.lit(a), F.lit(b)))[0] is same


def test_answers(spark):
    r = one(spark, A.answers_match(F.lit("5"), F.lit("5.0")), A.answers_match(F.lit("5."), F.lit("5")), A.numeric_text(F.lit("$1,200 dollars")), A.normal_answer(F.lit("#### 1"), F.lit("<<VERDICT: INCORRECT>>\n<<FIXED_ANSWER: >>"), F.lit("7"))["final"])
    assert tuple(r) == (False, True, "1200", "")


def test_finals(spark):
    r = one(spark, X.final_on_last_line(F.lit("#### 5\nmore")), X.final_last_line_anywhere(F.lit("#### 5\nmore")), fields.clean_final(F.lit("$\\boxed{5}$")), fields.gold_answer(F.lit("a\n#### 42")))
    assert (r[0], r[1], r[2], tuple(r[3])) == (None, "5", "5", ("42", "a"))


def test_sanitizers(spark):
    r = one(spark, X.sanitize_verifier(F.lit("<<VERDICT: CORRECT>>")), X.sanitize_selector(F.lit("CALLS: normalizer, reasoner")), X.looks_multistep(F.lit("Strengthen the wall")), X.sanitize_planner(F.lit("x <<1. a>> y")), X.clip_after_final(F.lit("a\n#### 1\nb")))
    assert tuple(r) == ("", "CALLS: reasoner,normalizer; HALT_AFTER: normalizer", True, "<<\n1. a\n>>", "a\n#### 1")


def test_line_functions(spark):
    r = one(spark, X.lines(F.lit("a\r\nb\n")), X.lines(F.lit("")), X.renumber(F.lit("- a\n\n3. b")))
    assert (r[0], r[1], r[2]) == (["a", "b"], [], "1. a\n2. b")


def test_routing_default(spark):
    r = one(spark, quality_rules.routed_calls(F.lit("q"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False), F.lit(False), F.lit("r"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Level 5"))["text"])
    assert r[0] == "CALLS: reasoner; HALT_AFTER: reasoner"


def test_summary_of_nothing(spark):
    zero = spark.range(1).select(*[F.lit(0).alias(c) for c in ("tp", "tn", "fp", "fn")])
    r = metrics.summary(zero).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0, 0.0)


def test_largest_remainder(spark):
    df = spark.createDataFrame([(i, "A" if i < 5 else "B" if i < 8 else "C") for i in range(10)], "id int, s string")
    got = sampling.largest_remainder(df, "s", 4, 1, "id").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"A": 2, "B": 1, "C": 1}


def test_round_robin(spark):
    df = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "B")], "id int, s string")
    got = sampling.round_robin(df, ["s"], 3, 1, "id").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"A": 2, "B": 1}


def test_balanced(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(40)], "id int, bad boolean")
    got = sampling.balanced(df, 5, 0.5, F.col("bad"), 1, "id")
    assert (got.count(), got.where("bad").count()) == (5, 2)


def test_split_has_no_overlap(spark):
    df = sampling.train_val_split(spark.range(50), 0.1, 42, "id")
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == {"val": 5, "train": 45}


def test_last_wins_and_resume(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 3, 2), ("", 4, 3)], "id string, v int, pos int")
    assert [tuple(r) for r in joins.last_wins(df, "id", "pos").select("id", "v").collect()] == [("a", 2)]
    assert joins.unfinished(df.where("id = 'a'"), df, "id").count() == 0


def test_perturb_keeps_the_final(spark):
    r = one(spark, quality_rules.perturb(F.lit("1. a [[calc: 1+1]] -> 2\n#### 2"), F.lit(True)))[0]
    assert (r.kind, r.text) == ("calc_arrow_tweak", "1. a [[calc: 1+1]] -> 3.0\n#### 2")


def test_line_reports():
    assert M.evaluation_report("[[calc: 2+2]] -> 5 apples", True) == (1, 0, 0, 0, "[[calc: 2+2]] -> 5 apples")
    assert M.evaluation_report("a [[calc: 2+2]] -> 5\n[[calc: x]] -> 1\nb", True) == (2, 1, 1, 1, "a [[calc: 2+2]] -> 4.0\n[[calc: x]] -> 1\nb")
    assert M.evaluation_report("a [[calc: 2+2]] -> 1,005", False) == (1, 1, 0, 0, "a [[calc: 2+2]] -> 1,005")
    ok, notes, text = M.reasoner_report("a [[calc: 2^3]] -> 7\nb [[calc: 1/2]] -> 1/2\nc [[calc: 1+1]] -> many\nd [[calc: 1/0]] -> 1\ne [[calc: 5×2]] -> 1,0")
    assert not ok and text == "a [[calc: 2^3]] -> 8\nb [[calc: 1/2]] -> 1/2\nc [[calc: 1+1]] -> many\nd [[calc: 1/0]] -> 1\ne [[calc: 5×2]] -> 1,0"
    assert notes == ["mismatch: 2^3 -> 7 (calc=8)", "skip symbolic: '1+1' -> 'many'", "eval error: 1/0"]


def test_steps():
    text, notes = M.steps_report("1. a [[calc: 3*4]] -> 13.\n\n- b  [[calc: x+1]] -> 2\n* [[calc: y]] -> 1\n> c [[calc: 1/3]] -> 0\n#### 5\nz")
    assert text == "1. a [[calc: 3*4]] -> 12\n2. b\n3. c [[calc: 1/3]] -> 0.3333333333"
    assert notes == ["fixed '3*4' from 13. to 12", "removed symbolic calc 'x+1'", "removed symbolic calc 'y'", "fixed '1/3' from 0 to 0.3333333333"]


LATEX = [
    ("2 \\times 3", "6", "2 * 3"), ("\\sqrt{16}", "4", "sqrt(16)"), ("√9 + 1", "4", "sqrt(9) + 1"), ("\\left(1+2\\right)\\cdot 2", "6", "(1+2)* 2"), ("6)**2", "36", "(6)**2"),
    ("\\frac{6}{3}", "2", "(6)/(3)"), ("3^2", "9", "3**2"), ("$1,200 kg / 2", "600", "1200 / 2"), ("1 × 2", "2", "1 * 2"), ("[2+3", "5", "2+3"), ("(2+3", "5", "(2+3)"), ("2+3))", "5", "2+3"),
]


@pytest.mark.parametrize(("expr", "value", "clean"), LATEX)
def test_repair_keeps_valid_markers(expr, value, clean):
    assert M.tidy(expr) == clean
    if "[" not in expr:
        assert M.repair_report(f"a [[calc: {expr}]] -> {value}") == (f"a [[calc: {clean}]] -> {value}", [])


def test_clean_expressions_agree(spark):
    more = ["1234,567", "1,234,567 + 1", "x_1 {2}", " a\tb ", "12)**2+(3", ""]
    texts = [e for e, _, _ in LATEX] + more
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.clean_expr(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == {t: M.tidy(t) for t in texts}


def test_marker_columns(spark):
    text = F.lit("1. 3+4 = 7\n2. x = 5\n#### 7")
    r = one(spark, M.inject_markers(text), M.ensure_marker(F.lit("1. so\n#### 9"), F.lit("9")), M.final_expr(F.lit("$2\\sqrt{3}$")), M.clean_expr(F.lit("$1,200 + (3")), M.numbers_outside(F.lit("1. a [[calc: 2+2]] -> 4")), M.normalized_reasoning(F.lit("x <<<BEGIN>>>\n1. 2*3 = 6\n<<<END>>> y"), F.lit("6")))
    assert r[0] == "1. 3+4 = 7 [[calc: 3+4]] -> 7\n2. x = 5\n#### 7"
    assert r[1] == "1. so\n2. Computation: [[calc: 9]] -> 9\n#### 9"
    assert r[2] == "2*sqrt(3)"
    assert r[3] == "1200 + (3)"
    assert r[4] == [1.0, 4.0]
    assert tuple(r[5]) == ("1. 2*3 = 6 [[calc: 2*3]] -> 6\n#### 6", "6")


def test_checked_lines_column(spark):
    r = spark.createDataFrame([("[[calc: 1+1]] -> 3",), (None,)], "t string").select(M.check_lines(F.col("t")).alias("r")).select("r.*").collect()
    assert [(x.ok, len(x.notes), x.text) for x in r] == [(False, 1, "[[calc: 1+1]] -> 2"), (True, 0, None)]


def test_native_steps_agree(spark):
    texts = ["1. a\n\n- b  c\n* d\n> e\n#### 5", "", "a\r\nb", "12. x", None, "\n####"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.normalized_steps(F.col("t")).alias("n")).collect()
    assert {r.t: r.n and r.n.text for r in got} == {t: None if t is None else M.steps_report(t)[0] for t in texts}


def test_claims_fold_in_their_row(spark):
    rows = [(1, "[[calc: 1+1]] -> 2"), (1, "[[calc: 2*(1+1)]] -> 5\n[[calc: 1/0]] -> 1"), (2, None), (3, "[[calc: 1+1]] -> 3 [[calc: 1+1]] -> 2")]
    x = M.verify_claims(spark.createDataFrame(rows, "k int, t string"), "t", ["k"])
    assert sorted((r.k, r.n_checked, r.n_failed, r.n_mismatch, r.ok, [tuple(m) for m in r.mismatches]) for r in x.collect()) == [(1, 1, 0, 0, True, []), (1, 2, 1, 1, False, [("2*(1+1)", 5.0, 4.0)]), (2, 0, 0, 0, True, []), (3, 1, 0, 1, False, [("1+1", 3.0, 2.0)])]
    # A report is a matter of its row.
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


def test_expression_dictionary(spark, monkeypatch, tmp_path):
    from tracemill.functions import evaluator

    rows = [(1, ["2*(1+1)", "1+1"]), (1, ["2*(1+1)", "1+1"]), (2, []), (3, None), (4, ["(3)", None, "2*(1+1)", "1/0"])] * 20
    log = str(tmp_path / "calls")

    def counted(expr, dialect, plain=evaluator.safe_calc):
        with open(log, "a") as f:
            f.write(f"{expr}\n")
        return plain(expr, dialect)

    monkeypatch.setattr(evaluator, "safe_calc", counted)
    got = evaluator.expression_values(spark.createDataFrame(rows, "k int, e array<string>").repartition(7), "e").collect()
    want = {1: [4.0, 2.0], 2: [], 3: None, 4: [3.0, None, 4.0, None]}
    assert len(got) == 100 and all(r["values"] == want[r.k] for r in got)


@pytest.mark.parametrize(("pred", "gold", "why"), [("2, 3", "3,2", "numeric match"), ("1", "1, 2", "set size mismatch 1 vs 2"), ("1, 5", "5, 2", "value mismatch 1.0 vs 2.0"), ("", "1", "missing pred"), ("1", "", "missing gold"), (None, "1", "missing pred"), ("x.", "x", "literal match"), ("x", "y", "literal mismatch 'x' vs 'y'"), ("90°", "90", "numeric match")])
def test_comparison_says_why(spark, pred, gold, why):
    r = one(spark, A.answer_comparison(F.lit(pred).cast("string"), F.lit(gold)))[0]
    assert (r.why, r.equal) == (why, why.endswith(" match"))


def test_verified_rows(spark):
    rows = [("a", "1. [[calc: 3*4]] -> 12\n#### 12", "12"), ("b", "1. [[calc: 3*4]] -> 13\n#### 12", "12"), ("c", "1. [[calc: x]] -> 12\n#### 7", "12"), ("d", None, None)]
    df = spark.createDataFrame(rows, "id string, reasoner_output string, final_answer string")
    got = {r.id: r for r in quality_rules.verified_rows(df, share=0.0).collect()}
    assert got["a"].verifier_output == "<<VERDICT: CORRECT>>\n<<EVIDENCE: Final answer matches gold (12).>>\n<<FIXED_ANSWER: 12>>"
    assert got["b"].verdict_label == "CORRECT" and "Calc mismatch: '3*4' -> 13.0 (recalc 12.0)." in got["b"].verifier_output
    assert got["c"].verifier_output == "<<VERDICT: INCORRECT>>\n<<EVIDENCE: Final answer mismatch: predicted '7' vs gold '12' (value mismatch 7.0 vs 12.0). 1 calc line(s) not evaluable.>>\n<<FIXED_ANSWER: 12>>"
    assert "Missing final answer marker" in got["d"].verifier_output and got["d"].verdict_label == "INCORRECT"
    assert all(got[k].qc.passed for k in "abc")
    spoilt = {r.id: r for r in quality_rules.verified_rows(df, share=1.1).collect()}
    assert spoilt["a"].perturbed and spoilt["a"].perturb_kind == "calc_arrow_tweak" and spoilt["a"].verdict_label == "CORRECT"
    assert not spoilt["d"].perturbed


@pytest.mark.parametrize(("text", "kind", "out"), [("x + 3 apples\n#### 2", "op_flip", "x - 3 apples\n#### 2"), ("no\n#### 2", "replace_final", "no\n#### 0"), ("no", "append_wrong_final", "no\n#### 0"), ("", "none", ""), ("[[calc: 60+1]] -> 61", "calc_arrow_tweak", "[[calc: 60+1]] -> 54.9")])
def test_perturb(spark, text, kind, out):
    r = one(spark, quality_rules.perturb(F.lit(text), F.lit(False)))[0]
    assert (r.kind, r.text, r.changed) == (kind, out, kind != "none")


def test_first_claim_of_a_line(spark):
    df = spark.createDataFrame([(1, "[[calc: 1+1]] -> 2 and [[calc: 2+2]] -> 5"), (2, "[[calc: 1/0]] -> 2\n[[calc: 1+1]] -> 3"), (3, None)], "id int, t string")
    got = {r.id: (r.n_checked, r.n_failed, r.n_mismatch, r.ok, [tuple(m) for m in r.mismatches]) for r in M.verify_claims(df, "t", ["id"]).collect()}
    assert got == {1: (1, 0, 0, True, []), 2: (2, 1, 1, False, [("1+1", 3.0, 2.0)]), 3: (0, 0, 0, True, [])}


def test_routing_halts(spark):
    s = F.lit(None).cast("string")
    route = lambda calc, verdict, norm, plan=s: quality_rules.routed_calls(F.lit("then"), plan, verdict, F.lit(calc), F.lit(False), F.lit("r"), norm, s, s, aggregator=True)["text"]
    r = one(spark, route(True, s, s), route(True, F.lit("<<VERDICT: INCORRECT>>"), s), route(False, s, F.lit("n")), route(False, s, s, F.lit("1. a\n2. b\n3. c\n4. d\n5. e")))
    assert tuple(r) == ("CALLS: reasoner,calculator; HALT_AFTER: reasoner", "CALLS: reasoner,calculator,verifier; HALT_AFTER: verifier", "CALLS: reasoner,normalizer; HALT_AFTER: normalizer", "CALLS: planner,reasoner,aggregator; HALT_AFTER: reasoner")


@pytest.mark.parametrize(("text", "strict", "out", "notes"), [
    ("has 5 and 7 [[calc: ]] -> 12", False, "has 5 and 7 [[calc: 5.0+7.0]] -> 12", ["filled blank calc -> 5.0+7.0 = 12"]),
    ("has 5 [[calc: ]] -> 80", False, "has 5 -> 80", ["dropped blank calc (kept arrow value)"]),
    ("[[calc: x+1]] -> 2", False, "", ["removed symbolic calc marker: x+1"]),
    ("[[calc: 2+2]] -> 5", False, "[[calc: 2+2]] -> 4.0", ["fixed arrow: 2+2 = 4.0 (was 5)"]),
    ("[[calc: 2+2]] -> 5", True, "[[calc: 2+2]] -> 5", []),
    ("1 and 2 [[calc: ]] -> 3", True, "1 and 2 ", ["strict mode: dropped calc in symbolic context"]),
    ("9 [[calc: 9]] -> 9", False, "9 [[calc: 9]] -> 9", []),
    ("9 [[calc: 2+*]] -> 50", False, "9 [[calc: 2+*]] -> 50", ["left malformed calc unchanged: 2+*"]),
    ("[[calc: $1,200 + (3]] -> 1203", False, "[[calc: 1200 + (3)]] -> 1203", []),
])
def test_repair_report(text, strict, out, notes):
    assert M.repair_report(text, strict) == (out, notes)


def test_inferred_orders():
    assert M.inferred([1.0, 3.0, 2.0, 2.0], 4.0) == "1.0+3.0"
    assert M.inferred([1.0, 3.0, 2.0, 2.0], 4.0, last_first=True) == "2.0+2.0"
    assert M.inferred([], 1.0) is None
    assert M.tidy("(2+3))") == "(2+3)"


def test_repair_rows(spark):
    df = spark.createDataFrame([("a", "[[calc: 2+2]] -> 5", (False, ["x"])), ("b", "plain", None), ("c", None, None)], "id string, reasoner_output string, qc struct<passed:boolean,reasons:array<string>>")
    got = {r.id: (r.reasoner_output, r.qc.passed, r.qc.reasons) for r in M.repair_rows(df).collect()}
    assert got == {"a": ("[[calc: 2+2]] -> 4.0", False, ["x", "[repair] fixed arrow: 2+2 = 4.0 (was 5)"]), "b": ("plain", True, []), "c": (None, True, [])}


def test_provenance(spark):
    raw = lambda x: F.try_parse_json(F.lit(x))
    r = one(spark, fields.origin(raw('{"id":"a","source":{"x":1},"meta":{"orig":{"hf_name":"no"}}}')), fields.origin(raw('{"meta":{"hf_name":"h"}}')), fields.kept_source(raw('{"z":1,"level":null,"plan":"p"}')), fields.slim_provenance(raw('{"idx":3,"meta":{"hf_name":"h","original_index":7}}')), fields.provenance(raw("{}"), "none"), fields.provenance(raw('{"a":1}'), "raw"))
    assert r[0] == '{"id":"a"}'
    assert r[1] == '{"id":null,"prov":{"hf_name":"h"}}'
    assert r[2] == '{"plan":"p","level":null}'
    assert tuple(r[3]) == ("3", "h", "", 7, "")
    assert (r[4], r[5]) == ("{}", '{"source":{"a":1}}')


def test_drawn_ranks_keep_null_groups(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(60)], "id int, g string")
    rows = sampling.drawn_ranks(df, ["g"], 1, "id").collect()
    assert sorted(r._r for r in rows if r.g is None) == list(range(1, 41))
    assert {r._n for r in rows if r.g == "a"} == {20}


def test_carve_out(spark):
    train, held = sampling.eval_carve_out(spark.range(10), 0.01, 1, "id")
    assert (train.count(), held.count(), train.join(held, "id").count()) == (9, 1, 0)
    train, held = sampling.eval_carve_out(spark.range(1), 0.5, 1, "id")
    assert (train.count(), held.count()) == (1, 1)
