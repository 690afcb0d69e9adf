"""Role prompts, supervised rows and generators (TXT-20 to TXT-27, UDF-1 to UDF-5, LBL-3, LBL-4, ML-1, ML-2)."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.answers import answers_match, fixed_answer, normal_answer, predicted_answer, verdict
from tracemill.functions.evaluator import calc_each
from tracemill.functions.markers import TOLERANCE, check_lines, ensure_marker, evaluated_lines, is_trivial, marker_claims, normalized_reasoning, normalized_steps
from tracemill.functions.text import clip_after_final, count_steps, ensure_final_suffix, final_last_line_anywhere, first_filled, once, parse_selector, sanitize_planner, sanitize_reasoner, sanitize_selector, sanitize_verifier, strip, with_computed
from tracemill.operators.joins import union_roles, with_companions
from tracemill.operators.quality_rules import TRACE_SAID, normalizer_quality, reasoner_quality, routed_calls
from tracemill.scratch import written

DEFAULT_SYSTEM = "You are a careful assistant that solves problems step by step."
#: What each role is told, and what evaluation adds.
TASKS = {
    "planner": "Write a numbered plan between << and >>.",
    "reasoner": "Solve it in numbered steps; mark each calculation and end with #### and the answer.",
    "verifier": "Give VERDICT, EVIDENCE and FIXED_ANSWER.",
    "normalizer": "Rewrite it as clean numbered steps that end with #### and the answer.",
    "selector": "Name the roles to call.",
}
STRICT = {
    "planner": "Three to six steps, no results, nothing outside of the block.",
    "reasoner": "Mark numeric expressions only; nothing before the first step or after the answer.",
    "verifier": "Three lines; the evidence is one sentence that names the first wrong calculation, if there is one.",
    "normalizer": "At most eight steps and one final line, without units.",
    "selector": "Two lines: CALLS with roles in order, HALT_AFTER with one of them.",
}
#: The sections of each role's prompt after the question, in order; SHOWN are there even if blank.
SECTIONS = {"planner": ["solution", "hint"], "reasoner": ["plan", "hint"], "verifier": ["candidate", "gold"], "normalizer": ["candidate", "verdict"], "selector": ["plan"]}
SHOWN = ["candidate"]


def stripped(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def role_prompt(role: str, question: Column, strict: bool = False, **parts: Column) -> Column:
    """TXT-20 to TXT-22: the prompt of a role. A section is left out if nothing is given for it or it is blank; strict
    prompts, those of evaluation, have all sections that are given, blank or not."""
    section = lambda name, c: F.concat(F.lit(f"{name.upper()}:\n"), stripped(c))
    given = [(n, parts[n]) for n in SECTIONS[role] if n in parts]
    body = [section(n, c) if strict or n in SHOWN else F.when(stripped(c) != "", section(n, c)) for n, c in given]
    head = f"<role:{role}>\n{TASKS[role]}" + (f"\n{STRICT[role]}" if strict else "")
    return F.concat_ws("\n", F.lit(head), section("question", question), *body)


def planner_request(question: Column, solution: Column, final: Column) -> Column:
    """TXT-20: a planner sees the solution, or where there is none the final answer as a hint."""
    return role_prompt("planner", question, solution=solution, hint=F.when(stripped(solution) == "", final))


def selector_input(problem: Column, plan: Column, include_plan: bool = False, least_steps: int = 2) -> Column:
    """TXT-23: the tag, the problem, and, if wanted, a plan of enough steps."""
    shown = F.lit(include_plan) & (stripped(plan) != "") & (count_steps(plan) >= least_steps)
    return F.concat_ws("\n", F.lit("<role:selector>"), stripped(problem), F.when(shown, F.concat(F.lit("PLAN:\n"), stripped(plan))))


def selector_prompt(said: Column) -> Column:
    """TXT-21: a selector's input with its tag, which is put before it only where it isn't there."""
    said = F.coalesce(said, F.lit(""))
    return F.when(said.startswith("<role:selector>"), said).otherwise(F.concat(F.lit("<role:selector>\n"), said))


def supervised_rows(spine: DataFrame, planner: DataFrame, verifier: DataFrame, normalizer: DataFrame, router: DataFrame, labelled_candidate: bool = True, include_plan: bool = True) -> DataFrame:
    """JOIN-5, SET-1, TXT-24: one row per role of each reasoner row; the normalized rationale is preferred.

    A plan, a gold answer and a verdict are sections only where there is one.
    """
    x = with_companions(spine, {"planner": planner, "verifier": verifier, "normalizer": normalizer, "router": router})
    q = F.col("question")
    plan = first_filled(F.col("planner.planner_output"), F.col("plan"))
    normal = F.nullif(F.trim(F.col("normalizer.normalized_rationale")), F.lit(""))
    final = F.when(normal.isNotNull(), first_filled(F.col("normalizer.final_answer_norm"), F.col("normalizer.final_answer_gold"), F.col("final_answer"))).otherwise(first_filled(F.col("final_answer"), F.col("normalizer.final_answer_gold")))
    candidate = first_filled(F.col("verifier.reasoner_input"), F.col("reasoner_output")) if labelled_candidate else F.col("reasoner_output")
    asked = F.col("router.selector_input") if "selector_input" in router.columns else q
    roles = {
        "planner": {"prompt": role_prompt("planner", q), "response": F.col("planner.planner_output")},
        "reasoner": {"prompt": role_prompt("reasoner", q, **({"plan": plan} if include_plan else {})), "response": ensure_final_suffix(F.coalesce(normal, F.col("reasoner_output")), final)},
        "verifier": {"prompt": role_prompt("verifier", q, candidate=candidate, gold=F.col("verifier.final_answer_gold")), "response": F.col("verifier.verifier_output")},
        "normalizer": {"prompt": role_prompt("normalizer", q, candidate=F.col("reasoner_output"), verdict=F.col("verifier.verifier_output")), "response": normal},
        "selector": {"prompt": selector_prompt(asked), "response": F.col("router.selector_output")},
    }
    rows = union_roles(x, roles, ["id", "dataset", "split"])
    return rows.withColumn("id", F.concat_ws("::", "id", "role"))


def normalized_rows(reasoner: DataFrame, verifier: DataFrame) -> DataFrame:
    """LBL-3: steps recomputed and renumbered (TXT-18), the answer settled, the final line appended, checked; notes of the
    recomputation are kept as step_notes."""
    x = with_companions(reasoner, {"verifier": verifier})
    x = x.withColumn("_n", normalized_steps(F.col("reasoner_output")))
    x = x.withColumn("_a", normal_answer(F.col("reasoner_output"), F.col("verifier.verifier_output"), F.col("verifier.final_answer_gold")))
    x = x.withColumns({"normalized_rationale": ensure_final_suffix(F.col("_n.text"), F.col("_a.final")), "step_notes": F.col("_n.notes")})
    return x.withColumn("final_answer_norm", F.col("_a.final")).withColumn("qc", normalizer_quality(F.col("normalized_rationale"))).drop("_a", "_n", "verifier")


def router_rows(reasoner: DataFrame, planner: DataFrame, verifier: DataFrame, normalizer: DataFrame, include_plan: bool = False, least_steps: int = 2, **options) -> DataFrame:
    """JOIN-4, LBL-2, CALC-5, CALC-14, TXT-23: selector rows of reasoner rows (id, question, reasoner_output).

    A plan is the planner's, else the row's own; a verdict is the row's own only where there is no verifier row. Calculations
    are those of the normalized rationale, else of the reasoner. Adds selector_input, selector_output, calls, halt_after and
    signals; options are those of routed_calls.
    """
    own = lambda name: F.col(name) if name in reasoner.columns else F.lit(None).cast("string")
    theirs = lambda df, role, name: F.col(f"{role}.{name}") if name in df.columns else F.lit(None).cast("string")
    x = with_companions(reasoner, {"planner": planner, "verifier": verifier, "normalizer": normalizer})
    plan = first_filled(theirs(planner, "planner", "planner_output"), theirs(planner, "planner", "plan"), own("plan"), own("planner_output"))
    said = F.when(F.col("verifier").isNotNull(), theirs(verifier, "verifier", "verifier_output")).otherwise(own("verifier_output"))
    normal = theirs(normalizer, "normalizer", "normalized_rationale")
    x = x.withColumns({"_plan": plan, "_said": said, "_normal": normal, "_body": first_filled(normal, F.col("reasoner_output"), F.lit(""))})
    x = with_computed(x, _claims=marker_claims(F.col("_body")))
    x = with_computed(x, _values=calc_each(F.transform("_claims", lambda c: c["expr"]), "router"))
    valued = F.zip_with("_claims", "_values", lambda c, v: F.struct(c["expr"].alias("expr"), c["claimed"].alias("claimed"), v.alias("got")))
    x = with_computed(x, _v=valued)
    has_calc = F.exists("_v", lambda c: ~is_trivial(c["expr"]) & c["got"].isNotNull())
    mismatch = F.exists("_v", lambda c: F.coalesce(F.abs(c["got"] - c["claimed"]) > TOLERANCE, F.lit(False)))
    text = F.col("question")
    routed = routed_calls(text, F.col("_plan"), F.col("_said"), has_calc, mismatch, F.col("reasoner_output"), F.col("_normal"), own("subject"), own("level"), least_steps=least_steps, **options)
    x = with_computed(x, _r=routed)
    x = x.withColumns({"selector_input": selector_input(text, F.col("_plan"), include_plan, least_steps), "selector_output": F.col("_r.text"), "calls": F.col("_r.calls"), "halt_after": F.col("_r.halt_after"), "signals": F.col("_r.signals")})
    return x.drop("planner", "verifier", "normalizer", "_plan", "_said", "_normal", "_body", "_claims", "_values", "_v", "_r")


def message_pair(messages: Column) -> Column:
    """TXT-25: struct(prompt, target) of an array of (role, text), null for none. The last message is the target, and stays
    in the prompt unless it is the assistant's. The last system text leads; other roles than the assistant are users."""
    text = lambda m: F.coalesce(m["text"], F.lit(""))
    role = lambda m: F.lower(F.coalesce(m["role"], F.lit("")))

    def pair(all_: Column) -> Column:
        n = F.size(all_)
        system = F.try_element_at(F.filter(all_, lambda m: role(m) == "system"), F.lit(-1))
        shown = F.filter(all_, lambda m, i: (role(m) != "system") & ((role(m) != "assistant") | (i < n - 1)))
        tag = lambda m: F.concat(F.when(role(m) == "assistant", "<assistant>\n").otherwise("<user>\n"), text(m))
        head = F.concat(F.lit("<system>\n"), first_filled(text(system), F.lit(DEFAULT_SYSTEM)), F.lit("\n\n"))
        return F.struct(strip(F.concat(head, strip(F.array_join(F.transform(shown, tag), "\n\n")))).alias("prompt"), strip(text(F.try_element_at(all_, F.lit(-1)))).alias("target"))

    return F.when(F.size(messages) > 0, once(messages, pair))


def chat_pairs(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """TXT-25: prompt and target of each conversation, its messages in order of turn, role and text."""
    messages = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))).alias("m"))
    return messages.select(key, message_pair(F.col("m")).alias("p")).select(key, "p.prompt", "p.target")


#: Names under which rows keep prompts and targets, and what a role's own target is called.
PROMPTS, TARGETS = ["prompt", "input_text", "source_prompt"], ["response", "target_text", "output_text"]
OWN_TARGETS = {"planner": ["planner_output"], "reasoner": ["reasoner_output"], "verifier": ["verifier_output"], "normalizer": ["normalized_rationale", "aggregated_rationale"], "aggregator": ["normalized_rationale", "aggregated_rationale"]}


def prompt_and_target(df: DataFrame, messages: str = "messages") -> DataFrame:
    """TXT-26: adds `prompt` and `target`: of the messages (role, text), if there are some; else of the first filled names
    of prompt and target, if both are; else put together from the fields of the row's role."""
    pick = lambda names: first_filled(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    headed = lambda c: F.concat(F.lit(f"<system>\n{DEFAULT_SYSTEM}\n\n<user>\n"), c)
    role = F.coalesce(F.col("role"), F.lit("assistant")) if "role" in df.columns else F.lit("assistant")
    asked, said = pick(PROMPTS), pick(TARGETS)
    part = lambda name, names, roles: F.when(role.isin(*roles) if roles else F.lit(True), F.concat(F.lit(f"{name}:\n"), pick(names)))
    parts = [part("PROBLEM", ["input_question", "problem"], []), part("PLAN", ["plan"], ["reasoner", "verifier", "normalizer"]), part("REASONING", ["reasoner_output", "normalized_rationale"], ["verifier", "normalizer"])]
    request = F.concat_ws("\n\n", F.concat(F.lit("Act as <role:"), role, F.lit(">.")), *parts)
    own = F.lit(None).cast("string")
    for r, names in OWN_TARGETS.items():
        own = F.when(role == r, pick(names)).otherwise(own)
    target = F.coalesce(pick(["target_text", "response", "final_answer_norm", "final_answer"]), own, F.lit(""))
    pair = F.when(asked.isNotNull() & said.isNotNull(), F.struct(headed(asked).alias("prompt"), said.alias("target"))).otherwise(F.struct(strip(headed(request)).alias("prompt"), strip(target).alias("target")))
    if messages in df.columns:
        pair = F.coalesce(message_pair(F.col(messages)), pair)
    return df.withColumn("_p", pair).withColumns({"prompt": F.col("_p.prompt"), "target": F.col("_p.target")}).drop("_p")


def masked_labels(ids: Column, prompt_length: Column, ignore: int = -100) -> Column:
    """ML-1."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, ignore).otherwise(x))


def padded_batches(df: DataFrame, batch: int, order: str, group: str, pad: int = 0, multiple: int = 8, ignore: int = -100, cells: int = 64) -> DataFrame:
    """ML-2: ids, mask and labels padded to the longest of their batch, rounded up; batches are numbered in groups.

    A group is ordered by length, so that batches need little padding, then by cells of the hash of `order`, then by it.
    Only counts by length and cell are summed over a group; rows are ranked within a cell and meet in batches. Null ids are
    empty.
    """
    x = df.withColumn("input_ids", F.coalesce("input_ids", F.array().cast(df.schema["input_ids"].dataType)))
    x = x.withColumn("_l", F.size("input_ids")).withColumn("_c", F.pmod(F.xxhash64(order), F.lit(cells)))
    counts = x.groupBy(F.col(group).alias("_g"), F.col("_l").alias("_gl"), F.col("_c").alias("_gc")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_gl", "_gc").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(group, "_l", "_c").orderBy(order)) - 1
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_l") == F.col("_gl")) & (F.col("_c") == F.col("_gc"))
    x = x.withColumn("_own", own).join(counts, same).withColumn("batch", F.floor((F.col("_before") + F.col("_own")) / batch))
    longest = F.max("_l").over(Window.partitionBy(group, "batch"))
    x = x.withColumn("_w", (F.ceil(longest / multiple) * multiple).cast("int"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_w") - F.col("_l")))
    mask = F.transform("input_ids", lambda _: F.lit(1))
    x = x.withColumns({"attention_mask": fill(mask, 0), "labels": fill(F.col("labels"), ignore), "input_ids": fill(F.col("input_ids"), pad)})
    return x.drop("_w", "_l", "_c", "_g", "_gl", "_gc", "_before", "_own")


def first_text(output) -> str:
    """TXT-27: the text of one generator's output: of several sequences the first, `generated_text` of a mapping, else itself."""
    if isinstance(output, list):
        output = output[0] if output and isinstance(output[0], dict) else None
    return str((output.get("generated_text") if isinstance(output, dict) else output) or "")


def _in_time(f: Callable, prompts: list[str], seconds: float | None) -> list:
    """f(prompts); a failure if it takes longer, its thread left to itself."""
    if seconds is None:
        return f(prompts)
    got: list = []
    failed: list = []

    def run() -> None:
        try:
            got.append(f(prompts))
        except BaseException as e:  # noqa: BLE001 - handed on
            failed.append(e)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if failed:
        raise failed[0]
    if not got:
        raise TimeoutError
    return got[0]


def generated(df: DataFrame, prompt: str, out: str, make: Callable[[], Callable[[list[str]], list]], batch: int = 8, seconds: float | None = None) -> DataFrame:
    """UDF-1 to UDF-6: a column of generated texts. `make` builds the generator once per task; a batch that fails, or takes
    longer than `seconds`, is tried one by one, a text that fails or takes longer is empty. Null prompts aren't generated from
    and give null."""

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = make()

        def one(p: str) -> str:
            try:
                return first_text(_in_time(generate, [p], seconds)[0])
            except Exception:  # noqa: BLE001 - a generator may fail in any way
                return ""

        for s in series:
            asked, texts = s.dropna(), []
            for i in range(0, len(asked), batch):
                part = asked.iloc[i : i + batch].tolist()
                try:
                    texts += [first_text(x) for x in _in_time(generate, part, seconds)]
                except Exception:  # noqa: BLE001
                    texts += [one(p) for p in part]
            yield pd.Series(texts, index=asked.index, dtype=object).reindex(s.index).where(s.notna(), None)

    return df.withColumn(out, run(F.col(prompt)))


#: How a draft is asked for again: with the draft, afresh, and along a skeleton.
REPAIRS = ["Mend this draft so that it has numbered steps, marked calculations and a final line.\nDRAFT:\n{draft}", "Write it afresh: numbered steps, marked calculations, a final line.", "Fill in: 1. ... [[calc: ...]] -> ...\n#### ..."]
#: Faults for which a draft is asked for again.
MENDED = [TRACE_SAID[k] for k in ("empty", "steps", "calc", "final")]


def _drafted(x: DataFrame, final: str, make: Callable, tried: str) -> DataFrame:
    """Rows with a prompt `_p` and the state (_t text, _passed, _reasons): a draft is generated, normalized and judged. An
    empty reply leaves text and verdict as they are and is noted as `tried`; of a first draft, it is the text."""
    x = written(generated(x, "_p", "_raw", make), "drafts")
    raw = F.col("_raw") if tried else F.coalesce(F.col("_raw"), F.lit(""))
    whole = ensure_marker(normalized_reasoning(raw, F.col(final))["text"], F.col(final))
    judged = lambda t: F.struct(t.alias("text"), reasoner_quality(t).alias("q"))
    missed = F.struct(F.col("_t").alias("text"), F.struct(F.col("_passed").alias("passed"), F.array_append("_reasons", F.lit(f"{tried} failed: empty reply")).alias("reasons")).alias("q"))
    none = F.coalesce(raw, F.lit("")) == ""
    got = F.when(none, missed).otherwise(once(whole, judged)) if tried else once(whole, judged)
    x = x.withColumn("_s", got).withColumns({"_t": F.col("_s.text"), "_passed": F.col("_s.q.passed"), "_reasons": F.col("_s.q.reasons")})
    return written(x.drop("_s", "_raw", "_p"), "judged")


def reasoned(df: DataFrame, question: str, plan: str, final: str, make: Callable, verify: bool = False) -> DataFrame:
    """UDF-5: adds reasoner_output, final_answer and qc(passed, reasons). A draft is normalized and given a marker; if it
    has a fault that is mended, up to three further drafts are asked for until one passes. The first draft alone decides
    whether. Each round is a written table of the rows that still fail; rows that are done are set aside and asked for
    nothing more.
    """
    asked = role_prompt("reasoner", F.col(question), plan=F.col(plan))
    state = {"_t": F.lit(None).cast("string"), "_passed": F.lit(False), "_reasons": F.array().cast("array<string>")}
    x = _drafted(df.withColumns({"_p": asked, **state}), final, make, "")
    mend = F.arrays_overlap("_reasons", F.array(*[F.lit(m) for m in MENDED]))
    done, todo = [x.where(~mend | F.col("_passed"))], x.where(mend & ~F.col("_passed"))
    for i, ask in enumerate(REPAIRS):
        draft = F.when(F.coalesce(F.col("_t"), F.lit("")) == "", "(empty)").otherwise(F.col("_t"))
        again = F.concat(asked, F.lit("\n"), F.replace(F.lit(ask), F.lit("{draft}"), draft))
        x = _drafted(todo.withColumn("_p", again), final, make, f"repair{i + 1 if i else ''}")
        done.append(x.where("_passed"))
        todo = x.where("NOT _passed")
        if todo.limit(1).count() == 0:
            break
    else:
        done.append(todo)
    x = done[0]
    for more in done[1:]:
        x = x.unionByName(more)
    reasons = F.col("_reasons")
    if verify:
        x = written(x.withColumn("_c", check_lines(F.col("_t"))), "checked")
        x = x.withColumn("_t", F.col("_c.text"))
        reasons = F.concat("_reasons", F.transform("_c.notes", lambda n: F.concat(F.lit("[calc] "), n)))
    answer = first_filled(final_last_line_anywhere(F.col("_t")), F.col(final), F.lit(""))
    qc = F.struct(F.col("_passed").alias("passed"), reasons.alias("reasons"))
    return x.select(*df.columns, F.col("_t").alias("reasoner_output"), F.coalesce(answer, F.lit("")).alias("final_answer"), qc.alias("qc"))


#: The chain of rows whose selector calls nothing, if it is to be replaced.
DEFAULT_CHAIN = ["planner", "reasoner", "verifier", "normalizer"]
#: What each role of a chain is shown, how its text is cleaned, and whose calculations are checked.
CHAIN = {"planner": {}, "reasoner": {"plan": "planner_output"}, "verifier": {"candidate": "reasoner_output", "gold": "gold_answer"}, "normalizer": {"candidate": "reasoner_output"}}
CLEANED = {"selector": sanitize_selector, "planner": sanitize_planner, "reasoner": sanitize_reasoner, "verifier": sanitize_verifier, "normalizer": sanitize_reasoner}
CALCULATED = ["reasoner", "normalizer"]


def _spoken(x: DataFrame, role: str, prompt: Column, make: Callable) -> DataFrame:
    """A stage: the rows' texts of a role, cleaned; written, so that nothing is generated or cleaned twice."""
    raw = generated(x.withColumn("_p", prompt), "_p", "_raw", make)
    return written(raw.withColumn(f"{role}_output", F.coalesce(CLEANED[role](F.col("_raw")), F.lit(""))).drop("_p", "_raw"), role)


def role_chain(df: DataFrame, makes: dict[str, Callable], enforce_halt: bool = False, selector: bool = True, fallback: bool = False, verify: bool = False, repair: bool = False) -> DataFrame:
    """LBL-4: selector, planner, reasoner, verifier, normalizer, each generated for the rows only that call it, and empty for
    the others. The calculator is a stage of its own after reasoner and normalizer: it checks (verify) or mends (repair) the
    calculations of the rows that have some, and cleans and clips their texts again. Adds calls, halt_after, each role's
    output, and calc_checked, calc_mismatches, calc_repaired, calc_failed over both roles. Without a selector every row runs
    the default chain; so do rows that call nothing, with `fallback`.
    """
    q, order = F.col("question"), list(CHAIN)
    default = F.array(*[F.lit(r) for r in DEFAULT_CHAIN])
    if selector:
        x = _spoken(df, "selector", role_prompt("selector", q, strict=True), makes["selector"])
        x = with_computed(x, _s=parse_selector(F.col("selector_output")))
        x = x.withColumns({"calls": F.col("_s.calls"), "halt_after": F.coalesce("_s.halt", F.lit(""))}).drop("_s")
        if fallback:
            none = F.size("calls") == 0
            x = x.withColumns({"halt_after": F.when(none, "normalizer").otherwise(F.col("halt_after")), "calls": F.when(none, default).otherwise(F.col("calls"))})
    else:
        x = df.withColumns({"selector_output": F.lit(""), "calls": default, "halt_after": F.lit("normalizer")})
    counters = ["checked", "mismatches", "repaired", "failed"]
    x = x.withColumns({f"calc_{n}": F.lit(0) for n in counters})
    for role, parts in CHAIN.items():
        out, called = f"{role}_output", F.array_contains("calls", role)
        if enforce_halt:
            halt = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("halt_after"))
            called = called & ((halt == 0) | (halt >= order.index(role) + 1))
        text = role_prompt(role, q, strict=True, **{k: F.col(v) for k, v in parts.items()})
        said = _spoken(x.where(called), role, text, makes[role])
        if role in CALCULATED and (verify or repair):
            marked = F.col(out).contains("[[calc:")
            found = with_computed(said.where(marked), _c=evaluated_lines(F.col(out), repair))
            clean = clip_after_final(CLEANED[role](F.col("_c.text")))
            found = found.withColumns({out: clean, **{f"calc_{n}": F.col(f"calc_{n}") + F.col(f"_c.{n}") for n in counters}}).drop("_c")
            said = written(found, f"{role}-calculator").unionByName(said.where(~marked))
        x = said.unionByName(x.where(~called).withColumn(out, F.lit("")))
    return x


def predictions(chain: DataFrame) -> DataFrame:
    """ANS-6, ANS-7: finals, verdicts and predictions of a chain's rows (with gold_answer), and whether they are right.

    The normalizer's final counts where it spoke, else the reasoner's; a fixed answer of an INCORRECT verdict overrides it.
    """
    said = lambda role: F.nullif(F.col(f"{role}_output"), F.lit(""))
    final = lambda role: F.nullif(strip(F.regexp_extract(said(role), r"####\s*(.+)\s*$", 1)), F.lit(""))
    none, gold = F.lit(""), F.col("gold_answer")
    x = chain.withColumns({"reasoner_final": final("reasoner"), "normalizer_final": final("normalizer"), "verdict": F.coalesce(verdict(said("verifier")), none), "fixed_answer": F.coalesce(fixed_answer(said("verifier")), none)})
    x = x.withColumn("pred_before_verify", F.coalesce(F.when(said("normalizer").isNotNull(), F.col("normalizer_final")).otherwise(F.col("reasoner_final")), none))
    fixed = (F.col("verdict") == "INCORRECT") & (F.col("fixed_answer") != "")
    x = x.withColumns({"pred_after_verify": F.when(fixed, F.col("fixed_answer")).otherwise(F.col("pred_before_verify")), "pred_final": F.coalesce(predicted_answer(said("verifier"), said("reasoner"), said("normalizer")), none)})
    right = lambda c: F.coalesce(answers_match(c, gold), F.lit(False))
    return x.withColumns({"reasoner_ok": F.col("reasoner_final").isNotNull() & right(F.col("reasoner_final")), "final_ok": right(F.col("pred_after_verify"))})
