"""Chains of roles, caps, whole-record joins and batches against plain Python."""

import hashlib
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracemill.operators import joins, metrics, roles, sampling


def spoken(texts):
    """A generator that says, for each question in a prompt, the text of its number."""

    def make():
        def generate(prompts):
            return [texts(p) for p in prompts]

        return generate

    return make


def test_chain_calls_only_who_is_called(spark):
    asked = {r: spark.sparkContext.accumulator(0) for r in ("selector", *roles.CHAIN)}

    def role(name, text):
        def make():
            def generate(prompts):
                asked[name].add(len(prompts))
                return [text(p) for p in prompts]

            return generate

        return make

    calls = {"q0": "CALLS: planner,reasoner,verifier,normalizer; HALT_AFTER: normalizer", "q1": "CALLS: reasoner", "q2": "", "q3": "CALLS: reasoner, verifier; HALT_AFTER: reasoner"}
    of = lambda p: next(q for q in calls if q in p)
    makes = {
        "selector": role("selector", lambda p: calls[of(p)]),
        "planner": role("planner", lambda p: "x <<1. add>> y"),
        "reasoner": role("reasoner", lambda p: "1. a [[calc: 1+1]] -> 3\n#### 3\nmore" if "q3" not in p else "no final"),
        "verifier": role("verifier", lambda p: "<<VERDICT: INCORRECT>>\n<<EVIDENCE: e>>\n<<FIXED_ANSWER: 2>>" if "[[calc: 1+1]] -> 2" in p else "?"),
        "normalizer": role("normalizer", lambda p: "1. n [[calc: 2*2]] -> 5\n#### 5"),
    }
    df = spark.createDataFrame([(q, "2", i) for i, q in enumerate(calls)], "question string, gold_answer string, i int")
    chain = roles.role_chain(df, makes, verify=True, repair=True)
    got = {r.question: r for r in roles.predictions(chain).collect()}
    assert {r: a.value for r, a in asked.items()} == {"selector": 4, "planner": 1, "reasoner": 3, "verifier": 2, "normalizer": 1}
    assert got["q0"].reasoner_output == "1. a [[calc: 1+1]] -> 2.0\n#### 3" and got["q0"].normalizer_output == "1. n [[calc: 2*2]] -> 4.0\n#### 5"
    assert (got["q0"].calc_checked, got["q0"].calc_mismatches, got["q0"].calc_repaired, got["q0"].calc_failed) == (2, 2, 2, 0)
    assert got["q0"].planner_output == "<<\n1. add\n>>" and got["q1"].planner_output == ""
    assert (got["q0"].pred_before_verify, got["q0"].pred_after_verify, got["q0"].final_ok, got["q0"].reasoner_ok) == ("5", "2", True, False)
    assert (got["q2"].calls, got["q2"].reasoner_output, got["q2"].pred_final) == ([], "", "")
    assert (got["q3"].reasoner_final, got["q3"].verdict, got["q3"].pred_final) == (None, "", "no final")
    # Those that call nothing run the default chain; a halt leaves out later roles.
    again = {r.question: r for r in roles.role_chain(df, makes, fallback=True, enforce_halt=True).collect()}
    assert again["q2"].halt_after == "normalizer" and again["q2"].normalizer_output != ""
    assert again["q3"].verifier_output == "" and again["q0"].reasoner_output.startswith("1. a [[calc: 1+1]] -> 3")


def test_generator_in_time(spark):
    def make():
        def generate(prompts):
            if any(p == "slow" for p in prompts):
                time.sleep(5)
            return [p + "!" for p in prompts]

        return generate

    df = spark.createDataFrame([("a",), ("slow",), ("b",)], "p string").coalesce(1)
    began = time.time()
    got = {r.p: r.out for r in roles.generated(df, "p", "out", make, seconds=0.5).collect()}
    assert got == {"a": "a!", "slow": "", "b": "b!"} and time.time() - began < 5


def test_caps_in_a_column(spark):
    rows = [(i, None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 7}") for i in range(6000)]
    caps = {"hot": 700, "g1": 5, "g2": 0, "g3": None, "g4": 10**6, None: 3}
    cap = F.lit(None).cast("int")
    for g, n in caps.items():
        cap = F.when(F.col("g").eqNullSafe(g), F.lit(n).cast("int")).otherwise(cap)
    df = spark.createDataFrame(rows, "id int, g string").repartition(5)
    kept = sampling.capped(df, ["g"], cap, 42, "id")
    want = set()
    groups = defaultdict(list)
    for i, g in rows:
        groups[g].append(i)
    for g, ids in groups.items():
        n = caps.get(g)
        drawn = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        want |= set(drawn[:n] if n and n > 0 else drawn)
    got = [r.id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # The one window over rows has cells of the draw key as partitions.
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "row_number" in x and "Window" in x]
    assert windows and all("_cell" in x for x in windows)


def test_whole_record_anti_join(spark):
    schema = "a int, b string, c array<int>, d map<string,int>, e double"
    pool = spark.createDataFrame([(1, "x", [1], {"k": 1}, 0.0), (1, "x", [1], {"k": 1}, -0.0), (1, None, None, None, None), (1, "y", [1, None], {"k": 2}, 1.0), (2, "x", [1], {"k": 1}, 0.0)], schema)
    chosen = spark.createDataFrame([(1, "x", [1], {"k": 1}, 0.0), (1, None, None, None, None), (7, "z", None, None, None)], schema)
    left = joins.not_chosen(pool, chosen)
    assert sorted((r.a, r.b) for r in left.collect()) == [(1, "y"), (2, "x")] and left.columns == pool.columns
    assert joins.not_chosen(pool, chosen.limit(0)).count() == 5


def test_batches_of_one_hot_group(spark):
    rows = [("g" if i % 10 else None, i, [1] * (i * 37 % 23)) for i in range(500)]
    df = spark.createDataFrame([(g, i, x, x) for g, i, x in rows], "g string, i int, input_ids array<int>, labels array<int>").repartition(6)
    got = roles.padded_batches(df, 16, "i", "g").collect()
    assert len(got) == 500
    sizes = Counter((r.g, r.batch) for r in got)
    for g in ("g", None):
        n = [sizes[k] for k in sorted(k for k in sizes if k[0] == g)]
        assert all(x == 16 for x in n[:-1]) and 0 < n[-1] <= 16
    for r in got:
        length = r.i * 37 % 23
        assert sum(r.attention_mask) == length and len(r.input_ids) == len(r.labels) == len(r.attention_mask) and len(r.labels) % 8 == 0
        assert r.labels[length:] == [-100] * (len(r.labels) - length)
    # Ordered by length, a batch is padded to little more than its shortest text.
    widths = {(r.g, r.batch): len(r.input_ids) for r in got}
    assert sum(widths[r.g, r.batch] - r.i * 37 % 23 for r in got) < 500 * 8


def test_count_report(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("a", "x")], "d string, r string")
    assert [tuple(r) for r in metrics.count_report(df, ["d", "r"]).collect()] == [("a", "unknown", 1), ("a", "x", 2), ("b", "x", 1)]
    assert metrics.count_report(df.limit(0), ["d"]).collect() == []
