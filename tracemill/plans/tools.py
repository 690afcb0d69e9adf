"""Queries of text, marker, answer and field functions over texts made of the orders' and lines' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import markers as M
from tracemill.functions import text as X
from tracemill.functions.evaluator import expression_values, plan_values
from tracemill.operators import fields, joins, metrics, quality_rules, sampling
from tracemill.plans.registered import query
from tracemill.session import table

NL = " || chr(10) || "


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, k % 3 as m, and the customer's number as text."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), (k % 3).alias("m"), F.col("o_custkey").cast("string").alias("c"))


ORDERS = "SELECT o_orderkey AS k, o_orderkey % 3 AS m, CAST(o_custkey AS VARCHAR) AS c FROM orders"


def put(*parts: str):
    """A text of parts, each `@` in them the number c."""
    c = F.col("c")
    found = []
    for p in parts:
        for i, piece in enumerate(p.split("@")):
            found += [c] * (i > 0) + [F.lit(piece)]
    return F.concat(*found)


@query(f"""SELECT k, CASE m WHEN 0 THEN '1. a' || c || '|b' ELSE '' END AS blocks, CASE m WHEN 0 THEN '<<1. a' || c || '>> tail <<b>>' WHEN 1 THEN '<<'{NL}'step ' || c{NL}'step two'{NL}'>>' ELSE '<<'{NL}'1. Read problem carefully.'{NL}'2. Compute needed quantities.'{NL}'>>' END AS plan,
CASE m WHEN 0 THEN '<<'{NL}'1. a' || c{NL}'>>' WHEN 1 THEN 'step ' || c{NL}''{NL}' step two' ELSE '' END AS clean, CASE m WHEN 0 THEN 'tail' WHEN 1 THEN 'step ' || c{NL}''{NL}' step two' ELSE '' END AS bare FROM ({ORDERS})""")
def q_plan_texts(spark, sf_dir):
    """TXT-2, TXT-3, TXT-10: chevron blocks, plan texts, planner outputs."""
    o = orders(spark, sf_dir).withColumn("t", F.when(F.col("m") == 0, put("<<1. a@>> tail <<b>>")).when(F.col("m") == 1, put("step @\n\n step two ")).otherwise(""))
    t = F.col("t")
    return o.select("k", F.array_join(X.chevron_blocks(t), "|").alias("blocks"), X.plan_text(t).alias("plan"), X.sanitize_planner(t).alias("clean"), X.without_chevrons(t).alias("bare"))


@query(f"""SELECT k, CASE WHEN m < 2 THEN c END AS anywhere, CASE WHEN m = 1 THEN c END AS last_line, CASE WHEN m < 2 THEN c ELSE 'a ' || c END AS or_text, CASE m WHEN 0 THEN 'a'{NL}'#### ' || c{NL}'more' WHEN 1 THEN 'a'{NL}'#### ' || c ELSE 'a ' || c{NL}'#### F' END AS suffixed,
CASE WHEN m < 2 THEN 'a'{NL}'#### ' || c ELSE 'a ' || c END AS clipped, CASE WHEN m < 2 THEN 'a' ELSE 'a ' || c END{NL}'#### ' || c AS enforced FROM ({ORDERS})""")
def q_finals(spark, sf_dir):
    """TXT-5, TXT-7, TXT-8, TXT-15, WIN-3: final lines read, appended, enforced and clipped after."""
    t = F.col("t")
    o = orders(spark, sf_dir).withColumn("t", F.when(F.col("m") == 0, put("a\n#### @\nmore")).when(F.col("m") == 1, put("a\n#### @")).otherwise(put("a @")))
    return o.select("k", X.final_last_line_anywhere(t).alias("anywhere"), X.final_on_last_line(t).alias("last_line"), X.final_or_text(t).alias("or_text"), X.ensure_final_suffix(t, F.lit("F")).alias("suffixed"), X.clip_after_final(t).alias("clipped"), X.enforce_final(t, F.lit(None).cast("string"))["text"].alias("enforced"))


@query(f"SELECT k, 'x ' || c AS block, 'x ' || c AS clamped, 'x ' || c{NL}'#### ' || c AS reasoner, CASE WHEN m = 0 THEN 'CALLS: planner,verifier; HALT_AFTER: verifier' ELSE 'CALLS: reasoner,calculator; HALT_AFTER: calculator' END AS selector FROM ({ORDERS})")
def q_cleanups(spark, sf_dir):
    """TXT-4, TXT-9, TXT-11, TXT-13: what generated texts lose."""
    said = F.when(F.col("m") == 0, "calls: verifier, planner").otherwise("the Reasoner; halt after: calculator")
    return orders(spark, sf_dir).select("k", X.cleanup_markers(put("<<<BEGIN>>>x @ <<<END>>>>")).alias("block"), X.clamp(put("x @\n<role:y> z")).alias("clamped"), X.sanitize_reasoner(put("<assistant>x @\nx @\n#### @\nz")).alias("reasoner"), X.sanitize_selector(said).alias("selector"))


@query(f"""SELECT k, '(' || c || ')/(2) * 3' AS plain, m <> 0 AS symbolic, '1. ' || c || '+1 = 9 [[calc: ' || c || '+1]] -> 9'{NL}'no' AS injected, '1. so'{NL}'2. Computation: [[calc: ' || c || ']] -> ' || c{NL}'#### ' || c AS ensured,
c || '*sqrt(3)' AS final_expr, CAST(c AS DOUBLE) AS first_number, '[[calc: ' || c || '+1]] -> ' || (CAST(c AS BIGINT) + 1) || '.0 and -> ' || (CAST(c AS BIGINT) + 1) || '.0' AS patched FROM ({ORDERS})""")
def q_marker_tools(spark, sf_dir):
    """CALC-3, CALC-4, CALC-7 to CALC-9, CALC-12, CALC-17: markers found, put in and patched."""
    expr = F.when(F.col("m") == 0, put("@+pi")).otherwise(put("@+x"))
    return orders(spark, sf_dir).select("k", M.plain_numeric(put("\\frac{@}{2} × 3")).alias("plain"), M.is_symbolic(expr).alias("symbolic"), M.inject_markers(put("1. @+1 = 9\nno")).alias("injected"), M.ensure_marker(put("1. so\n#### @"), F.col("c")).alias("ensured"), M.final_expr(put("$@\\sqrt{3}$")).alias("final_expr"), M.numbers_outside(put("@. a [[calc: 2+2]] -> 4"))[0].alias("first_number"), M.patch_arrows(put("[[calc: @+1]] -> 0 and -> 5")).alias("patched"))


@query(f"""SELECT k, c = '4' AS ok, 'a [[calc: 16/4]] -> 4'{NL}'b [[calc: x]] -> 1' AS text, CASE WHEN c = '4' THEN '' ELSE 'mismatch: 16/4 -> ' || c || ' (calc=4)|' END || 'skip symbolic: ''x'' -> ''1''' AS notes,
CAST(2 AS INTEGER) AS checked, CAST(CASE WHEN c = '4' THEN 0 ELSE 1 END AS INTEGER) AS mismatches, CAST(1 AS INTEGER) AS failed, 'a [[calc: 16/4]] -> ' || CASE WHEN c = '4' THEN c ELSE '4.0' END{NL}'b [[calc: x]] -> 1' AS mended FROM ({ORDERS})""")
def q_line_checks(spark, sf_dir):
    """CALC-11, CALC-13, CALC-15: the two checks of lines, with their own flags and counters."""
    t = put("a [[calc: 16/4]] -> @\nb [[calc: x]] -> 1")
    x = orders(spark, sf_dir).withColumn("t", t).withColumns({"r": M.check_lines(F.col("t")), "e": M.evaluated_lines(F.col("t"))})
    return x.select("k", "r.ok", "r.text", F.array_join("r.notes", "|").alias("notes"), "e.checked", "e.mismatches", "e.failed", F.col("e.text").alias("mended"))


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, 'a ' || CASE l_linenumber % 6 WHEN 0 THEN '[[calc: ' || q || ' * 2]] -> ' || q * 2 WHEN 1 THEN '[[calc: sqrt(' || q * q || ')]] -> ' || q WHEN 2 THEN '[[calc: (' || q || '+1)* 2]] -> ' || (q + 1) * 2 WHEN 3 THEN '[[calc: (' || q || ')**2]] -> ' || q * q || '.0' WHEN 4 THEN '[[calc: (' || q * 3 || ')/(3)]] -> ' || q ELSE '' END AS text,
CASE WHEN l_linenumber % 6 = 3 THEN '[repair] fixed arrow: (' || q || ')**2 = ' || q * q || '.0 (was ' || (q * q + 1) || ')' WHEN l_linenumber % 6 = 5 THEN '[repair] removed symbolic calc marker: y ' || chr(92) || 'times 2' ELSE '' END AS note,
'a ' || CASE l_linenumber % 6 WHEN 0 THEN '[[calc: ' || q || ' * 2]] -> ' || q * 2 WHEN 1 THEN '[[calc: sqrt(' || q * q || ')]] -> ' || q WHEN 2 THEN '[[calc: (' || q || '+1)* 2]] -> ' || (q + 1) * 2 WHEN 3 THEN '[[calc: (' || q || ')**2]] -> ' || q * q || '.0' WHEN 4 THEN '[[calc: (' || q * 3 || ')/(3)]] -> ' || q ELSE '' END AS strict FROM q""")
def q_repair_latex(spark, sf_dir):
    """CALC-16, CALC-19, CALC-20: LaTeX in markers becomes an expression before it is judged; strict and plain repairs."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber") % 6
    s = lambda c: c.cast("string")
    claim = lambda expr, v: F.concat(F.lit("a [[calc: "), expr, F.lit("]] -> "), s(v))
    text = F.when(k == 0, claim(F.concat(s(q), F.lit(" \\times 2")), q * 2)).when(k == 1, claim(F.concat(F.lit("\\sqrt{"), s(q * q), F.lit("}")), q))
    text = text.when(k == 2, claim(F.concat(F.lit("\\left("), s(q), F.lit("+1\\right)· 2")), (q + 1) * 2)).when(k == 3, claim(F.concat(s(q), F.lit(")**2")), q * q + 1))
    text = text.when(k == 4, claim(F.concat(F.lit("\\frac{"), s(q * 3), F.lit("}{3}")), q)).otherwise(claim(F.lit("y \\times 2"), q))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), text.alias("strict"))
    x = M.repair_rows(M.repair_rows(x, "text"), "strict", "qc2", strict=True)
    return x.select("l_orderkey", "l_linenumber", "text", F.array_join("qc.reasons", "|").alias("note"), "strict")


@query(f"SELECT k, CAST(c AS DOUBLE) + 1 AS first_, CAST(c AS DOUBLE) * 2 + 2 AS second_, 'line_parse' AS fault, CAST(4 AS INTEGER) AS n_logs FROM ({ORDERS})")
def q_plan_logs(spark, sf_dir):
    """CALC-2, WIN-5: values refer to earlier ones; lines that don't parse are logged; nothing after the stop counts."""
    r = plan_values(put("1. @+1\njunk\n2. _1*2\n3. _9+1\n<stop>\n4. 1"))
    return orders(spark, sf_dir).withColumn("r", r).select("k", F.col("r.values")[0].alias("first_"), F.col("r.values")[1].alias("second_"), F.col("r.logs")[1]["error"].alias("fault"), F.size("r.logs").alias("n_logs"))


@query(f"SELECT k, CASE m WHEN 0 THEN c WHEN 1 THEN '7' ELSE 'f' || c END AS logged, CASE m WHEN 0 THEN c || ' kg' WHEN 1 THEN 'f' || c ELSE 'f' || c END AS scored, CASE WHEN m = 0 THEN c ELSE 'f' || c END AS settled, CASE WHEN m = 0 THEN 'gold' ELSE 'verifier_fix' END AS source FROM ({ORDERS})")
def q_answer_picks(spark, sf_dir):
    """ANS-6 to ANS-8: the logged, the scored and the settled answer."""
    m, none = F.col("m"), F.lit(None).cast("string")
    verifier = F.when(m == 0, F.lit("<<VERDICT: CORRECT>>\n<<FIXED_ANSWER: >>")).otherwise(put("<<VERDICT: INCORRECT>>\n<<EVIDENCE: e>>\n<<FIXED_ANSWER: f@>>"))
    normalizer, reasoner = F.when(m == 0, put("a\n#### @ kg")).otherwise(none), F.when(m == 1, "x\n#### 7").otherwise(none)
    settled = A.normal_answer(reasoner, verifier, F.col("c"))
    return orders(spark, sf_dir).select("k", A.predicted_answer(verifier, reasoner, normalizer).alias("logged"), A.scored_answer(verifier, reasoner, normalizer).alias("scored"), settled["final"].alias("settled"), settled["source"].alias("source"))


@query(f"""SELECT k, 'how many ' || c || '?' AS question, CASE WHEN m = 0 THEN c{NL}'#### 5' END AS solution, CASE WHEN m = 0 THEN '5' ELSE c END AS final, 'Number theory' AS subject, '4' AS level, 'u_' || c AS found, CASE WHEN m = 0 THEN 'h' ELSE 'unknown' END AS hub, 'o_' || k AS slim, 'is it ' || c || '?' AS picked FROM ({ORDERS})""")
def q_record_fields(spark, sf_dir):
    """PRJ-3, PRJ-4, PRJ-10, PRJ-12, PRJ-16: fields wherever loosely typed records keep them."""
    m = F.col("m")
    orig = F.struct(F.concat(F.lit("how  many "), "c", F.lit("?")).alias("problem"), F.when(m == 0, put("@\n#### 5")).otherwise(F.col("c")).alias("answer"), F.lit("x/number_theory/1").alias("unique_id"), F.lit("4").alias("difficulty"))
    meta = F.struct(F.when(m == 0, "h").alias("hf_name"), orig.alias("orig"))
    record = F.to_json(F.struct(F.concat(F.lit("o_"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("u_"), "c").alias("user"), meta.alias("meta")))
    x = orders(spark, sf_dir).withColumn("raw", F.try_parse_json(record))
    d, raw = fields.detected_fields(F.col("raw")), F.col("raw")
    picked = fields.picked_field([F.lit(None).cast("string")], [F.col("c"), put("is it @?")])
    return x.withColumn("d", d).select("k", "d.question", "d.solution", "d.final", "d.subject", "d.level", fields.searched(raw, "user").alias("found"), fields.with_fallback(raw, "hf_name").alias("hub"), fields.slim_provenance(raw)["id"].alias("slim"), picked.alias("picked"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND doc_id < 900 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_filters(spark, sf_dir):
    """FLT-1, FLT-2, FLT-4, SMP-1, SET-4: rows by listed values and by place, less those that are done."""
    d = fields.members(table(spark, sf_dir, "documents").select("doc_id", "lang"), lang=fields.parse_list(" en, de,,"), doc_id=fields.parse_list(""))
    return joins.unfinished(sampling.first_rows(d, 900, "doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0) AS changed, count(*) AS total, round(exp(avg(CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.0 END)), 6) AS perplexity FROM orders GROUP BY o_orderstatus")
def q_changed_counts(spark, sf_dir):
    """AGG-9, AGG-11: rows that a repair changed, nulls told apart; perplexity of a loss."""
    k = F.col("o_orderkey")
    new = F.when(k % 4 == 0, "new").when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    x = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("old"), new.alias("new"), F.when(k % 4 == 0, 0.5).otherwise(1.0).alias("loss"))
    status = [r["o_orderstatus"] for r in x.select("o_orderstatus").distinct().collect()]
    each = [metrics.perplexity(x.where(F.col("o_orderstatus") == s), "loss").select(F.lit(s).alias("o_orderstatus"), F.round("perplexity", 6).alias("perplexity")) for s in status]
    return metrics.changed_counts(x, ["o_orderstatus"], "old", "new").join(joins.concat(each), "o_orderstatus")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, 'Final answer mismatch: predicted ''' || q || ''' vs gold ''0'' (value mismatch ' || q || '.0 vs 0.0). Calc mismatch: ''' || q || '+1'' -> 0.0 (recalc ' || (q + 1) || '.0). Calc mismatch: ''' || q || '+2'' -> 0.0 (recalc ' || (q + 2) || '.0). Calc mismatch: ''' || q || '+3'' -> 0.0 (recalc ' || (q + 3) || '.0).' AS said, 'VERDICT label mismatch INCORRECT vs CORRECT' AS faults FROM q""")
def q_evidence(spark, sf_dir):
    """TXT-28, WIN-4, QC-3: of four wrong calculations the first three are named; a verdict against its label is a fault."""
    q = F.col("l_quantity").cast("long").cast("string")
    text = F.array_join(F.transform(F.array(*[F.lit(str(i)) for i in range(1, 5)]), lambda i: F.concat(i, F.lit(". [[calc: "), q, F.lit("+"), i, F.lit("]] -> 0"))), "\n")
    x = M.verify_claims(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), text.alias("t")), "t", ["l_orderkey", "l_linenumber", "q"])
    x = X.with_computed(x, w=A.answer_comparison(F.col("q"), F.lit("0")))
    x = X.with_computed(x, said=quality_rules.evidence(F.col("q"), F.lit("0"), F.col("w.why"), F.col("mismatches"), F.col("n_failed")))
    block = quality_rules.verifier_block(F.lit("INCORRECT"), F.col("said"), F.lit("0"))
    x = quality_rules.with_verifier_quality(x, block, F.lit("CORRECT"), F.lit("0"), "qc")
    return x.select("l_orderkey", "l_linenumber", "said", F.array_join("qc.reasons", "|").alias("faults"))


@query("SELECT l_orderkey, l_linenumber, [(CAST(l_quantity AS BIGINT) + 3) * 2.0, CAST(l_quantity AS BIGINT) + 1.0, NULL]::DOUBLE[] AS v FROM lineitem")
def q_expression_dictionary(spark, sf_dir):
    """CALC-1: each different expression of the table evaluated once, values joined back by hash."""
    q = F.col("l_quantity").cast("long").cast("string")
    exprs = F.array(F.concat(F.lit("("), q, F.lit("+3)*2")), F.concat(q, F.lit("+1")), F.lit("1/0"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", exprs.alias("e"))
    return expression_values(x, "e", out="v").drop("e")


@query("""SELECT event_id, '{"source":' || CASE event_id % 2 WHEN 0 THEN '{"id":' || event_id || ',"plan":null}' ELSE '{"id":' || event_id || ',"x":1}' END || '}' AS raw, '{}' AS none, CASE event_id % 2 WHEN 0 THEN '{"source":{"id":' || event_id || ',"plan":null}}' ELSE '{"source":{"id":' || event_id || '}}' END AS kept FROM events""")
def q_provenance_modes(spark, sf_dir):
    """PRJ-15: a row's meta with the whole record, without any, and with the kept keys."""
    i = F.col("event_id").cast("string")
    record = F.concat(F.lit('{"id":'), i, F.when(F.col("event_id") % 2 == 0, ',"plan":null}').otherwise(',"x":1}'))
    x = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(record).alias("raw"))
    mode = lambda m, **o: fields.provenance(F.col("raw"), m, **o).alias(m)
    return x.select("event_id", mode("raw"), mode("none"), fields.provenance(F.col("raw"), "minimal", fields.kept_source).alias("kept"))
