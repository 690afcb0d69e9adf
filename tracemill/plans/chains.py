"""Queries of generators, role rows and what models are trained on. Generators here are rules, so that results are known."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracemill.operators import joins, quality_rules, roles, sampling
from tracemill.plans.registered import query
from tracemill.session import table

GOOD = "1. a [[calc: 2*3]] -> 7\n#### 6"


def drafts():
    """Questions `Q<k> of <rest>`: good at once, with the draft at hand, afresh, or never, by k % 4."""

    def say(prompt: str) -> str:
        kind = int(re.search(r"Q(\d+) of", prompt)[1]) % 4
        tried = 1 if "DRAFT:" in prompt else 2 if "afresh" in prompt else 3 if "Fill in" in prompt else 0
        return GOOD if kind == 0 or (kind < 3 and tried == kind) else ["so", "", "no steps", "again"][tried] if kind else GOOD

    return lambda prompts: [say(p) for p in prompts]


@query("""SELECT o_orderkey, o_orderkey % 4 <> 3 AS passed, CASE WHEN o_orderkey % 4 <> 3 THEN '1. a [[calc: 2*3]] -> 6' || chr(10) || '#### 6' ELSE 'again' END AS said,
CASE WHEN o_orderkey % 4 <> 3 THEN '[calc] mismatch: 2*3 -> 7 (calc=6)' ELSE 'too few lines|no numbered steps|no calc markers|missing final ####' END AS reasons FROM orders""")
def q_reasoner_repair(spark, sf_dir):
    """UDF-5, TXT-6, CALC-8, CALC-11, QC-2: drafts asked for again until they pass; only failing ones are."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    x = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("Q"), k.cast("string"), F.lit(" of "), "o_orderpriority").alias("q"), none.alias("plan"), none.alias("final"))
    got = roles.reasoned(x, "q", "plan", "final", drafts, verify=True)
    return got.select("o_orderkey", F.col("qc.passed").alias("passed"), F.col("reasoner_output").alias("said"), F.array_join("qc.reasons", "|").alias("reasons"))


def speaker(role: str):
    """What a role says to `Q<k> of <rest>`, by k."""

    def say(prompt: str) -> str:
        k = int(re.search(r"Q(\d+) of", prompt)[1])
        if role == "selector":
            return ["CALLS: planner, reasoner, verifier, normalizer; HALT_AFTER: normalizer", "CALLS: reasoner", "", "CALLS: reasoner, verifier; HALT_AFTER: verifier"][k % 4]
        if role == "planner":
            return f"<<\n1. think {k}\n>>"
        if role == "verifier":
            return f"<<VERDICT: INCORRECT>>\n<<EVIDENCE: e>>\n<<FIXED_ANSWER: {k}>>" if "-> 8.0" in prompt else "<<VERDICT: CORRECT>>\n<<EVIDENCE: e>>\n<<FIXED_ANSWER: >>"
        return f"1. x [[calc: 4*2]] -> {8 + k % 2}\n#### {'8' if role == 'reasoner' else k}"

    return lambda: lambda prompts: [say(p) for p in prompts]


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m FROM orders)
SELECT k, CASE m WHEN 0 THEN 'planner,reasoner,verifier,normalizer' WHEN 1 THEN 'reasoner' WHEN 2 THEN '' ELSE 'reasoner,verifier' END AS calls, CASE m WHEN 0 THEN '<<' || chr(10) || '1. think ' || k || chr(10) || '>>' ELSE '' END AS planner,
CASE m WHEN 2 THEN '' ELSE '1. x [[calc: 4*2]] -> ' || CASE WHEN m % 2 = 1 THEN '8.0' ELSE '8' END || chr(10) || '#### 8' END AS reasoner,
CASE m WHEN 0 THEN 'CORRECT' WHEN 3 THEN 'INCORRECT' ELSE '' END AS verdict, CASE m WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN '8' WHEN 2 THEN '' ELSE CAST(k AS VARCHAR) END AS scored, CASE m WHEN 0 THEN CAST(k AS VARCHAR) WHEN 2 THEN '' ELSE '8' END AS logged,
CASE m WHEN 0 THEN true WHEN 1 THEN k = 8 WHEN 2 THEN false ELSE true END AS right_, CAST(CASE m WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS checked, CAST(CASE m WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS repaired FROM k""")
def q_role_chain(spark, sf_dir):
    """LBL-4, UDF-1, CALC-13, ANS-6, ANS-7: five roles and a calculator, each for the rows that call it."""
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("Q"), k.cast("string"), F.lit(" of "), "o_orderpriority").alias("question"), k.cast("string").alias("gold_answer"))
    chain = roles.role_chain(x, {r: speaker(r) for r in ("selector", *roles.CHAIN)}, verify=True, repair=True)
    p = roles.predictions(chain)
    return p.select("k", F.array_join("calls", ",").alias("calls"), F.col("planner_output").alias("planner"), F.col("reasoner_output").alias("reasoner"), "verdict", F.col("pred_after_verify").alias("scored"), F.col("pred_final").alias("logged"), F.col("final_ok").alias("right_"), F.col("calc_checked").alias("checked"), F.col("calc_repaired").alias("repaired"))


DRAWN = "CAST(CAST('0x' || substr(md5('40:' || l_orderkey || ':' || l_linenumber), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0 < 0.25"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * l_linenumber AS gold, CAST(l_quantity AS BIGINT) * l_linenumber + CASE WHEN l_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS claim, {DRAWN} AS drawn FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN gold = claim THEN 'CORRECT' ELSE 'INCORRECT' END AS label, drawn AS perturbed, CASE WHEN drawn THEN 'calc_arrow_tweak' ELSE '' END AS kind, NOT drawn AND gold = claim AS calc_ok, true AS passed,
CASE WHEN NOT drawn THEN '<<VERDICT: ' || CASE WHEN gold = claim THEN 'CORRECT>>' || chr(10) || '<<EVIDENCE: Final answer matches gold (' || gold || ').' ELSE 'INCORRECT>>' || chr(10) || '<<EVIDENCE: Final answer mismatch: predicted ''' || claim || ''' vs gold ''' || gold || ''' (value mismatch ' || claim || '.0 vs ' || gold || '.0). Calc mismatch: ''' || gold || '*1'' -> ' || claim || '.0 (recalc ' || gold || '.0).' END || '>>' || chr(10) || '<<FIXED_ANSWER: ' || gold || '>>' END AS block FROM t""")
def q_verifier_rows(spark, sf_dir):
    """LBL-1, TXT-19, TXT-28, QC-3, CALC-10, FLT-5: verdicts on traces, a quarter of them spoilt; spoilt calculations change
    the evidence, never the label."""
    li = table(spark, sf_dir, "lineitem")
    gold = F.col("l_quantity").cast("long") * F.col("l_linenumber")
    claim = gold + F.when(F.col("l_orderkey") % 7 == 0, 1000000).otherwise(0)
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("1. x [[calc: "), s(gold), F.lit("*1]] -> "), s(claim), F.lit("\n#### "), s(claim))
    key = F.concat_ws(":", s(F.col("l_orderkey")), s(F.col("l_linenumber")))
    x = li.select("l_orderkey", "l_linenumber", key.alias("id"), text.alias("reasoner_output"), s(gold).alias("final_answer"))
    v = quality_rules.verified_rows(x, share=0.25, seed=40)
    told = F.when(quality_rules.is_verifier_incorrect(F.lit("verifier"), F.col("verifier_output")), "INCORRECT").otherwise("CORRECT")
    return v.select("l_orderkey", "l_linenumber", told.alias("label"), "perturbed", F.col("perturb_kind").alias("kind"), F.col("calc_check.ok").alias("calc_ok"), F.col("qc.passed").alias("passed"), F.when(~F.col("perturbed"), F.col("verifier_output")).alias("block"))


@query("""SELECT o_orderkey AS id, '1. sum [[calc: 2+3]] -> 5' || chr(10) || '2. then' || chr(10) || '#### ' || CASE o_orderkey % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE '9' END AS text, CASE o_orderkey % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE '9' END AS final,
'fixed ''2+3'' from 6 to 5|removed symbolic calc ''x+1''' AS notes, true AS passed FROM orders""")
def q_normalized_rows(spark, sf_dir):
    """LBL-3, TXT-18, CALC-6, ANS-8, QC-4, JOIN-2: steps recomputed and numbered; a fix of an INCORRECT verdict wins over the
    gold answer, that over the text's own."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = "1. sum [[calc: 2+3]] -> 6\n\n- then [[calc: x+1]] -> 2\n#### 9"
    reasoner = o.select(k.alias("id"), F.lit(text).alias("reasoner_output"))
    block = F.when(k % 3 == 0, F.lit("<<VERDICT: INCORRECT>>\n<<EVIDENCE: e>>\n<<FIXED_ANSWER: fixed>>")).otherwise("<<VERDICT: CORRECT>>")
    verifier = o.where(k % 3 != 2).select(k.alias("id"), F.lit(0).alias("pos"), block.alias("verifier_output"), F.col("o_custkey").cast("string").alias("final_answer_gold"))
    x = roles.normalized_rows(reasoner, verifier)
    return x.select("id", F.col("normalized_rationale").alias("text"), F.col("final_answer_norm").alias("final"), F.array_join("step_notes", "|").alias("notes"), F.col("qc.passed").alias("passed"))


@query("""WITH m AS (SELECT doc_id, lang, n_chars % 40 AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 40) AS r FROM documents), b AS (SELECT lang, (r - 1) // 32 AS batch, n FROM m)
SELECT lang, batch, count(*) AS n_rows, CAST(ceil(max(n) / 8) * 8 AS BIGINT) AS width, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(greatest(n - 5, 0)) AS BIGINT) AS n_learned FROM b GROUP BY lang, batch""")
def q_padded_batches(spark, sf_dir):
    """ML-1, ML-2: batches of texts of similar length, prompts masked, padded to a multiple of eight."""
    d = table(spark, sf_dir, "documents")
    ids = F.transform(F.sequence(F.lit(0), (F.col("n_chars") % 40).cast("int")), lambda i: i + 3)
    d = d.select("doc_id", "lang", F.slice(ids, F.lit(1), (F.col("n_chars") % 40).cast("int")).alias("input_ids"))
    x = roles.padded_batches(d.withColumn("labels", roles.masked_labels(F.col("input_ids"), F.lit(5))), 32, "doc_id", "lang")
    learned = F.size(F.filter("labels", lambda v: v != -100))
    return x.groupBy("lang", "batch").agg(F.count("*").alias("n_rows"), F.max(F.size("input_ids")).cast("long").alias("width"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b)).alias("n_tokens"), F.sum(learned).alias("n_learned"))


HEAD = "'<system>' || chr(10) || 'You are a careful assistant that solves problems step by step.' || chr(10) || chr(10) || '<user>' || chr(10)"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {HEAD} || o_orderpriority WHEN 1 THEN {HEAD} || 'given ' || o_custkey ELSE {HEAD} || 'Act as <role:verifier>.' || chr(10) || chr(10) || 'PROBLEM:' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'PLAN:' || chr(10) || 'P' END AS prompt,
CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'said' ELSE '7' END AS target FROM orders""")
def q_prompt_target(spark, sf_dir):
    """TXT-26, TXT-27: messages before prompt and response before the fields of a role."""
    k, none = F.col("o_orderkey") % 3, F.lit(None).cast("string")
    says = lambda r, t: F.struct(F.lit(r).alias("role"), t.alias("text"))
    messages = F.when(k == 0, F.array(says("user", F.col("o_orderpriority")), says("assistant", F.col("o_orderstatus"))))
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("verifier").alias("role"), messages.alias("messages"), F.when(k < 2, F.concat(F.lit("given "), F.col("o_custkey").cast("string"))).alias("prompt"), F.when(k == 1, "said").otherwise(none).alias("response"), F.col("o_orderpriority").alias("input_question"), F.lit("P").alias("plan"), F.when(k == 2, "7").alias("final_answer"))
    return roles.prompt_and_target(x).select("o_orderkey", "prompt", "target")


@query("""SELECT o_orderkey, 'verifier' AS role, 'C' || o_orderkey AS candidate, CAST(o_custkey AS VARCHAR) AS gold, '<<VERDICT: CORRECT>>' AS response FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'reasoner', '', '', 'C' || o_orderkey || chr(10) || '#### ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 'planner', '', '', '<<' || chr(10) || '1. p' || chr(10) || '>>' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'selector', '', '', 'CALLS: reasoner' FROM orders""")
def q_supervised_rows(spark, sf_dir):
    """TXT-20, TXT-22, TXT-24, JOIN-5, JOIN-8: role rows of a spine and four companions, each where it has something."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ids, text = k.cast("string").alias("id"), F.concat(F.lit("C"), k.cast("string"))
    gold = F.col("o_custkey").cast("string")
    spine = o.select(ids, F.lit("d").alias("dataset"), F.lit("s").alias("split"), F.col("o_orderpriority").alias("question"), F.lit(None).cast("string").alias("plan"), text.alias("reasoner_output"), gold.alias("final_answer"))
    planner = o.where(k % 3 == 0).select(ids, F.lit(0).alias("pos"), F.lit("<<\n1. p\n>>").alias("planner_output"))
    verifier = o.where(k % 2 == 0).select(ids, F.lit(0).alias("pos"), text.alias("reasoner_input"), F.lit("<<VERDICT: CORRECT>>").alias("verifier_output"), gold.alias("final_answer_gold"))
    normalizer = o.limit(0).select(ids, F.lit(0).alias("pos"), *[F.lit("").alias(c) for c in ("normalized_rationale", "final_answer_norm", "final_answer_gold")])
    router = o.select(ids, F.lit(0).alias("pos"), F.lit("CALLS: reasoner").alias("selector_output"))
    x = roles.supervised_rows(spine, planner, verifier, normalizer, router)
    part = lambda name: F.regexp_extract("prompt", rf"\n{name}:\n(.*)", 1)
    return x.select(F.split_part("id", F.lit("::"), F.lit(1)).cast("long").alias("o_orderkey"), "role", part("CANDIDATE").alias("candidate"), part("GOLD").alias("gold"), "response")


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderpriority AS q FROM orders), f AS (SELECT *, k % 3 = 0 AS planned, k % 5 = 0 AS wrong, k % 7 = 0 AS normal FROM k)
SELECT k, 'CALLS: ' || array_to_string(list_filter([CASE WHEN planned THEN 'planner' END, 'reasoner', CASE WHEN k % 2 = 0 OR normal THEN 'calculator' END, CASE WHEN wrong OR (k % 4 = 2 AND NOT normal) OR k % 11 = 0 THEN 'verifier' END, CASE WHEN normal THEN 'normalizer' END], lambda x: x IS NOT NULL), ',') || '; HALT_AFTER: ' || CASE WHEN normal THEN 'normalizer' WHEN wrong OR k % 4 = 2 OR k % 11 = 0 THEN 'verifier' ELSE 'reasoner' END AS said,
'<role:selector>' || chr(10) || q || CASE WHEN planned THEN chr(10) || 'PLAN:' || chr(10) || '<<' || chr(10) || '1. a' || chr(10) || '2. b' || chr(10) || '>>' ELSE '' END AS asked, k % 4 = 2 AND NOT normal AS mismatch FROM f""")
def q_router_rows(spark, sf_dir):
    """JOIN-4, LBL-2, CALC-5, CALC-14, TXT-23: plans and verdicts with their fallbacks, calculations found and compared."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ids = k.alias("id")
    text = F.when(k % 4 == 0, "1. a [[calc: 2*(1+1)]] -> 4 [[calc: 1+1]] -> 3").when(k % 4 == 2, "1. a [[calc: 2*(1+1)]]\n2. b [[calc: 3*1]] -> about 4").otherwise("1. a [[calc: x+1]] -> 2 or [[calc: 7]] -> 8")
    plan = F.lit("<<\n1. a\n2. b\n>>")
    block = F.when(k % 11 == 0, "<<VERDICT: INCORRECT>>")
    reasoner = o.select(ids, F.col("o_orderpriority").alias("question"), text.alias("reasoner_output"), F.when(k % 6 == 3, plan).alias("plan"), block.alias("verifier_output"))
    planner = o.where(k % 6 == 0).select(ids, F.lit(0).alias("pos"), plan.alias("planner_output"))
    verifier = o.where((k % 5 == 0) & (k % 11 != 0)).select(ids, F.lit(0).alias("pos"), F.lit("<<VERDICT: INCORRECT>>").alias("verifier_output"))
    normalizer = o.where(k % 7 == 0).select(ids, F.lit(0).alias("pos"), F.lit("1. n [[calc: 2*2]] -> 4").alias("normalized_rationale"))
    x = roles.router_rows(reasoner, planner, verifier, normalizer, include_plan=True)
    return x.select(F.col("id").alias("k"), F.col("selector_output").alias("said"), F.col("selector_input").alias("asked"), F.col("signals.calc_mismatch").alias("mismatch"))


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 10 = 0 AND c.lang IS NOT DISTINCT FROM d.lang AND c.source IS NOT DISTINCT FROM d.source AND c.n_chars % 3 IS NOT DISTINCT FROM d.n_chars % 3)")
def q_whole_record_anti(spark, sf_dir):
    """JOIN-7: records that equal no chosen one in all columns."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 3).alias("m"))
    pool = d.drop("doc_id")
    left = joins.not_chosen(pool, d.where("doc_id % 10 = 0").drop("doc_id")).distinct()
    return d.join(left, [d[c].eqNullSafe(left[c]) for c in left.columns], "left_semi").drop("m")


@query("SELECT lang, CASE lang WHEN 'en' THEN least(count(*), 40) WHEN 'de' THEN count(*) ELSE least(count(*), 9) END AS n, count(*) AS n_all FROM documents GROUP BY lang")
def q_caps_in_a_column(spark, sf_dir):
    """SMP-3, SMP-7, SMP-8: a cap of its own for each group; a null one keeps all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    cap = F.when(F.col("lang") == "en", 40).when(F.col("lang") == "de", F.lit(None)).otherwise(9)
    kept = sampling.capped(d, ["lang"], cap.cast("int"), 42, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
    return kept.join(d.groupBy("lang").agg(F.count("*").alias("n_all")), "lang")
