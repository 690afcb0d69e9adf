import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators import roles
from tracemill.sources import jsonl, ledger
from tracemill.streaming.resume import ingest

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])


def put(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_permissive_and_silent(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", ['{"id": "a", "v": 1}', "", "{bad", '{"id": "b", "v": null}'])
    good, bad = jsonl.read_permissive(spark, p, SCHEMA)
    assert sorted(r.id for r in good.collect()) == ["a", "b"]
    assert [(r.value, r.line, r.file.endswith("a.jsonl")) for r in bad.collect()] == [("{bad", 3, True)]
    assert jsonl.read_silent(spark, p, SCHEMA).count() == 2


def test_append_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], SCHEMA)
    out = str(tmp_path / "out")
    ledger.append_new(df, out, "id")
    ledger.append_new(df, out, "id")
    assert spark.read.schema(SCHEMA).json(out).count() == 2
    kept = [json.loads(x) for x in spark.read.text(out).toPandas()["value"]]
    assert {"id": "b", "v": None} in kept


def test_replace_keeps_the_first_original(spark, tmp_path):
    path = str(tmp_path / "t")
    jsonl.write_jsonl(spark.createDataFrame([("a", 1)], SCHEMA), path)
    for v in (2, 3):
        jsonl.replace_with_backup(spark.createDataFrame([("a", v)], SCHEMA), path)
    assert spark.read.schema(SCHEMA).json(path).first().v == 3
    assert spark.read.schema(SCHEMA).json(path + ".bak").first().v == 1


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: ingest(spark, str(src), SCHEMA, lambda b: b, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    put(src / "1.json", ['{"id": "a", "v": 1}', '{"id": "a", "v": 1}'])
    run()
    put(src / "2.json", ['{"id": "a", "v": 9}', '{"id": "b", "v": 2}'])
    run()
    assert sorted((r.id, r.v) for r in spark.read.schema(SCHEMA).json(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 2)]


def test_generator_falls_back(spark):
    def make():
        def generate(prompts):
            if len(prompts) > 1 or prompts[0] == "x":
                raise ValueError
            return [p.upper() for p in prompts]

        return generate

    df = roles.generated(spark.createDataFrame([("a",), ("x",)], "p string").coalesce(1), "p", "out", make)
    assert [r.out for r in df.collect()] == ["A", ""]


def test_padding(spark):
    df = spark.createDataFrame([("g", 1, [1, 2, 3], [1, 2, 3]), ("g", 2, [4], [4])], "g string, o int, input_ids array<int>, labels array<int>")
    rows = roles.padded_batches(df, 2, "o", "g").orderBy("o").collect()
    assert rows[1].input_ids == [4] + [0] * 7
    assert rows[1].labels == [4] + [-100] * 7
    assert sum(rows[0].attention_mask) == 3


def test_masked_labels(spark):
    assert spark.range(1).select(roles.masked_labels(F.array(F.lit(7), F.lit(8), F.lit(9)), F.lit(2))).first()[0] == [-100, -100, 9]


def test_generated_skips_nulls_and_unwraps(spark):
    def make():
        return lambda prompts: [[{"generated_text": p + "!"}, {"generated_text": "no"}] if p == "a" else {"generated_text": p} if p == "b" else None for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "c")], "i int, p string").coalesce(1)
    assert {r.i: r.out for r in roles.generated(df, "p", "out", make).collect()} == {1: "a!", 2: None, 3: "b", 4: ""}


def test_repair_loop(spark):
    good = "1. add [[calc: 1+1]] -> 2\n#### 2"

    def make():
        def generate(prompts):
            return ["" if "q3" in p or ("q2" in p and "afresh" not in p) else good for p in prompts]

        return generate

    df = spark.createDataFrame([("q1", "<<\n1. a\n>>", "2"), ("q2", None, None), ("q3", None, None), ("q4", None, " ")], "q string, plan string, final string")
    got = {r.q: r for r in roles.reasoned(df, "q", "plan", "final", make, verify=True).collect()}
    assert set(got) == {"q1", "q2", "q3", "q4"} and got["q4"].reasoner_output == good
    assert (got["q1"].reasoner_output, got["q1"].final_answer, got["q1"].qc.passed) == (good, "2", True)
    assert got["q2"].qc.passed and got["q2"].reasoner_output == good
    assert not got["q3"].qc.passed and got["q3"].final_answer == ""
    assert got["q3"].qc.reasons[-3:] == ["repair failed: empty reply", "repair2 failed: empty reply", "repair3 failed: empty reply"]


def test_repairs_stop_when_nothing_fails(spark):
    asked = spark.sparkContext.accumulator(0)

    def make():
        def generate(prompts):
            asked.add(len(prompts))
            return ["1. x [[calc: 3*4]] -> 13\n#### 13" if "bad" not in p or "DRAFT" in p else "no" for p in prompts]

        return generate

    df = spark.createDataFrame([(i, "bad" if i % 5 == 0 else "q", i) for i in range(20)], "i int, q string, x int").withColumns({"plan": F.lit(None).cast("string"), "final": F.lit(None).cast("string")})
    got = {r.i: r for r in roles.reasoned(df, "q", "plan", "final", make, verify=True).collect()}
    # 20 drafts and 4 repairs: rows that pass are asked for nothing more, and no round follows the last failure.
    assert asked.value == 24
    assert all(r.qc.passed and r.reasoner_output == "1. x [[calc: 3*4]] -> 12\n#### 13" and r.x == i for i, r in got.items())
    assert all(len(r.qc.reasons) == 1 and r.qc.reasons[0].startswith("[calc] ") for r in got.values())


def test_prompt_and_target(spark):
    schema = "i int, role string, messages array<struct<role:string,text:string>>, prompt string, response string, input_question string, plan string, planner_output string, final_answer string"
    own = F.when(F.col("i") == 6, "<<VERDICT: CORRECT>>")
    rows = [
        (1, None, [("system", "S"), ("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", " t ")], "p", "r", None, None, None, None),
        (2, "planner", [], "p", "r", None, None, None, None),
        (3, "planner", None, None, None, "Q", "P", "<<1>>", None),
        (4, "verifier", None, "p", None, "Q", "P", None, "7"),
        (5, None, [("user", "u")], None, None, None, None, None, None),
        (6, "verifier", None, None, None, "Q", None, "<<1>>", None),
    ]
    got = {r.i: (r.prompt, r.target) for r in roles.prompt_and_target(spark.createDataFrame(rows, schema).withColumn("verifier_output", own)).collect()}
    head = f"<system>\n{roles.DEFAULT_SYSTEM}\n\n<user>\n"
    assert got[1] == ("<system>\nS\n\n<user>\nu\n\n<assistant>\na\n\n<user>\nv", "t")
    assert got[2] == (head + "p", "r")
    assert got[3] == (head + "Act as <role:planner>.\n\nPROBLEM:\nQ", "<<1>>")
    assert got[4] == (head + "Act as <role:verifier>.\n\nPROBLEM:\nQ\n\nPLAN:\nP", "7")
    assert got[5] == (head + "u", "u")
    assert got[6] == (head + "Act as <role:verifier>.\n\nPROBLEM:\nQ", "<<VERDICT: CORRECT>>")


def test_supervised_rows(spark):
    spine = spark.createDataFrame([("1", "d", "s", "Q", None, "1. x\n#### 2", "2")], "id string, dataset string, split string, question string, plan string, reasoner_output string, final_answer string")
    role = lambda columns, *row: spark.createDataFrame([row], f"id string, pos int, {columns}")
    rows = roles.supervised_rows(spine, role("planner_output string", "9", 0, "<<>>"), role("reasoner_input string, verifier_output string, final_answer_gold string", "1", 0, "c", "<<VERDICT: CORRECT>>", "2"), role("normalized_rationale string, final_answer_norm string, final_answer_gold string", "9", 0, "n", "2", "2"), role("selector_input string, selector_output string", "1", 0, "<role:selector>\nQ", "CALLS: reasoner"))
    got = {r.role: r for r in rows.collect()}
    assert set(got) == {"reasoner", "verifier", "selector"}
    assert "PLAN:" not in got["reasoner"].prompt and "GOLD:\n2" in got["verifier"].prompt
    assert got["selector"].prompt == "<role:selector>\nQ" and got["selector"].id == "1::selector"
