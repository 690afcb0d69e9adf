"""Calculation markers `[[calc: expression]] -> value`: extraction (native), checks and repairs (Arrow batches)."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.evaluator import SIGNS, SPACINGS, arrow_values, plain_math, safe_calc, shown
from tracemill.functions.text import LINE_END, cleanup_markers, enforce_final, filled_lines, lines, numbers, once, strip, with_computed

#: The formats of markers and of their claims; LINE_CLAIM is what a line is checked by.
MARKER = r"\[\[\s*calc\s*:\s*([^\]]*?)\s*\]\]"
CLAIM = MARKER + r"\s*->\s*(-?\d[\d,]*(?:\.\d+)?)"
LINE_CLAIM = r"\[\[calc:\s*(.*?)\s*\]\]\s*->\s*([+-]?\d+(?:\.\d+)?)"
#: LINE_CLAIM with names, for lines that are cut already; white space in a line is space or tab.
NAMED_CLAIM = r"(?s)\[\[calc:[ \t]*(?P<expr>.*?)[ \t]*\]\][ \t]*->[ \t]*(?P<claimed>[+-]?\d+(?:\.\d+)?)"
#: Currency signs and unit words that expressions lose; numbers with commas at each thousand.
CURRENCY = "[$£€¥]"
UNIT_WORDS = r"(?i)\b(?:kg|g|lbs?|pounds?|mile?s?|km|m|cm|mm|ft|feet|inch(?:es)?|hrs?|hours?|mins?|minutes?|days?|years?|deg(?:rees)?|°|percent)\b"
THOUSANDS = r"(?<!\d)\d{1,3}(?:,\d{3})+(?!\d)"
#: The marker with an arrow that recomputation sees; a marker with whatever stands behind its arrow.
RECOMPUTED = r"(?i)\[\[\s*calc\s*:\s*(.*?)\s*\]\]\s*->\s*(\S+)"
ARROWED = r"\[\[calc:\s*(.*?)\s*\]\]\s*->\s*([^\r\n]+)"
#: How inline mathematics, without currency, units and thousands, becomes an expression, in this order; {1} and
#: {2} are what a pattern has caught.
INLINE_MATHS = [
    (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "({1})/({2})"),
    (r"\\cdot|\\times|·|×", "*"),
    (r"\\left|\\right", ""),
    (r"√\s*(\d+(?:\.\d+)?)", "sqrt({1})"),
    (r"\\sqrt", "sqrt"),
    (r"\{", "("),
    (r"\}", ")"),
    (r"(?<=\d)\s*\^\s*(\d+)", "**{1}"),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"[\[\]]", ""),
    (r"(^|\s)(\d+)\)\s*\*\*", "{1}({2})**"),
]
TOLERANCE = 1e-6


def calc_exprs(text: Column) -> Column:
    """CALC-5: the expressions of all markers."""
    return F.regexp_extract_all(text, F.lit(MARKER), 1)


def claims(text: Column) -> Column:
    """Markers with a numeric arrow, as an array of (expr, claimed)."""
    # One pass over the text; the few claims are taken apart after it.
    one = lambda m: F.struct(F.regexp_extract(m, CLAIM, 1).alias("expr"), F.replace(F.regexp_extract(m, CLAIM, 2), F.lit(","), F.lit("")).try_cast("double").alias("claimed"))
    return F.transform(F.regexp_extract_all(text, F.lit(CLAIM), 0), one)


def marker_claims(text: Column) -> Column:
    """CALC-5, CALC-14: all markers as an array of (expr, claimed): the first number behind the arrow, which takes the rest of
    its line; null without one."""
    marker = r"(?s)\[\[calc:\s*(.*?)\s*\]\](?:\s*->\s*([^\n]+))?"
    one = lambda m: F.struct(F.regexp_extract(m, marker, 1).alias("expr"), F.nullif(F.regexp_extract(F.regexp_extract(m, marker, 2), r"[+-]?\d+(?:\.\d+)?", 0), F.lit("")).cast("double").alias("claimed"))
    return F.transform(F.regexp_extract_all(text, F.lit(marker), 0), one)


def is_symbolic(expr: Column, allowed: tuple[str, ...] = ("pi", "e")) -> Column:
    """CALC-4: whether names other than the allowed ones occur."""
    return F.size(F.array_except(F.regexp_extract_all(expr, F.lit("[A-Za-z]+"), 0), F.array(*[F.lit(a) for a in allowed]))) > 0


def is_trivial(expr: Column) -> Column:
    return (F.trim(expr) == "") | expr.rlike(r"^\s*-?\d+(\.\d+)?\s*$") | ~expr.rlike(r"[-+*/^]")


def plain_numeric(text: Column) -> Column:
    """CALC-3: fractions, signs and powers in ASCII, natively."""
    x = F.regexp_replace(text, r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "($1)/($2)")
    for a, b in SIGNS:
        x = F.replace(x, F.lit(a), F.lit(b))
    for pattern in SPACINGS:
        x = F.regexp_replace(x, pattern, "")
    return strip(F.regexp_replace(F.replace(x, F.lit("^"), F.lit("**")), r"\s+", " "))


def clean_expr(expr: Column) -> Column:
    """CALC-16: currency, unit words and thousands commas go, LaTeX and signs in ASCII, braces as parentheses, balanced."""
    x = F.regexp_replace(F.regexp_replace(expr, CURRENCY, ""), UNIT_WORDS, "")
    # The commas of a number with at most ten groups of digits.
    x = F.regexp_replace(x, r"(?<=(?<!\d)\d{1,3}(?:,\d{3}){0,9}),(?=\d{3}(?:,\d{3})*(?!\d))", "")
    for pattern, by in INLINE_MATHS:
        x = F.regexp_replace(x, pattern, by.replace("{", "$").replace("}", ""))
    return once(x, balance_parens)


def final_expr(answer: Column) -> Column:
    """CALC-9: a final answer in LaTeX as an expression: roots, fractions, pi, degrees, implied products."""
    x = F.regexp_replace(plain_numeric(F.regexp_replace(answer, r"\$", "")), r"\\sqrt\{([^{}]+)\}", "sqrt($1)")
    x = F.translate(F.regexp_replace(x, r"\\pi|π", "pi"), "{}", "()")
    return F.regexp_replace(x, r"(\d)\s*(sqrt|pi|\()", "$1*$2")


def numbers_outside(line: Column) -> Column:
    """CALC-17: numbers outside of markers; arrow values count."""
    return F.transform(numbers(F.regexp_replace(line, MARKER, "")), lambda x: x.cast("double"))


MINED = r"((?:\d|\()[\d\s.+\-*/()]*[-+*/][\d\s.+\-*/()]*[\d)])\s*(?:->|=)\s*(-?\d[\d,]*(?:\.\d+)?)"


def mined_marker(line: Column) -> Column:
    """The marker of an `expression -> value` or `expression = value` in a line, null if there is none."""

    def mined(x: Column) -> Column:
        found = x.rlike(MINED) & ~x.rlike(r"^[A-Za-z]\w*\s*=")
        return F.when(found, F.concat(F.lit("[[calc: "), strip(F.regexp_extract(x, MINED, 1)), F.lit("]] -> "), F.regexp_extract(x, MINED, 2)))

    return once(F.regexp_replace(plain_numeric(line), r"^\s*\d+\.\s+", ""), mined)


def inject_markers(text: Column) -> Column:
    """CALC-7: numbered lines without a marker get the one that their numbers give."""
    plain = lambda x: x.rlike(r"^\s*\d+\.\s+") & ~x.contains("[[calc")
    marked = lambda x: F.concat_ws(" ", x, mined_marker(x))
    return F.array_join(F.transform(lines(text), lambda x: F.when(plain(x), marked(x)).otherwise(x)), "\n")


def ensure_marker(text: Column, final: Column) -> Column:
    """CALC-8: a text without any marker gets a computation step before its final line, from its first minable line or its final."""
    last = lambda x: x.rlike(r"^\s*####")

    def ensured(x: Column) -> Column:
        rows, value = x["rows"], F.coalesce(F.nullif(strip(x["final"]), F.lit("")), F.try_element_at(numbers(x["text"]), F.lit(-1)))
        mined = F.try_element_at(F.filter(F.transform(rows, mined_marker), lambda m: m.isNotNull()), F.lit(1))
        marker = F.coalesce(mined, once(value, lambda v: F.concat(F.lit("[[calc: "), final_expr(v), F.lit("]] -> "), v)))
        body = F.filter(rows, lambda r: ~last(r))
        step = F.concat((F.size(F.filter(body, lambda r: r.rlike(r"^\s*\d+\.\s+"))) + 1).cast("string"), F.lit(". Computation: "))
        put = lambda m: F.array_join(F.concat(body, F.array(F.concat(step, m)), F.filter(rows, last)), "\n")
        return once(marker, lambda m: F.when(m.isNull(), x["text"]).otherwise(put(m)))

    whole = lambda t: F.when(t.rlike(MARKER), t).otherwise(once(F.struct(t.alias("text"), lines(t).alias("rows"), final.alias("final")), ensured))
    return once(text, whole)


def normalized_reasoning(raw: Column, fallback: Column) -> Column:
    """TXT-6: struct(text, final) of the BEGIN block, cleaned, with one final line and markers."""
    block = F.when(raw.contains("<<<BEGIN>>>"), F.regexp_extract(raw, r"(?s)<<<BEGIN>>>(.*?)(?:<<<END>>>|$)", 1)).otherwise(raw)
    marked = lambda done: F.struct(inject_markers(done["text"]).alias("text"), done["final"].alias("final"))
    return once(cleanup_markers(block), lambda c: once(enforce_final(c, fallback), marked))


def balance_parens(expr: Column) -> Column:
    """CALC-16: appends missing closing parentheses, or cuts surplus ones at the end."""
    gap = F.length(F.regexp_replace(expr, "[^(]", "")) - F.length(F.regexp_replace(expr, "[^)]", ""))
    trailing = F.length(F.regexp_extract(expr, r"\)+$", 0))
    return F.when(gap > 0, F.concat(expr, F.repeat(F.lit(")"), gap))).when(gap < 0, F.substring(expr, F.lit(1), F.length(expr) - F.least(-gap, trailing))).otherwise(expr)


#: What recomputation and the reasoner's check note.
RECOMPUTE_NOTES = {"symbolic": "removed symbolic calc '{expr}'", "failed": "calc parse failed '{expr}'; removed", "fixed": "fixed '{expr}' from {said} to {value}"}
REASONER_NOTES = {"symbolic": "skip symbolic: '{expr}' -> '{said}'", "failed": "eval error: {expr}", "text": "skip non-numeric rhs: '{said}'", "wrong": "mismatch: {expr} -> {said} (calc={value})"}


def recompute_report(text: str) -> tuple[str, list[str]]:
    """CALC-6: (text, notes): symbolic or failing markers go, the others get their value; runs of spaces become one."""
    notes: list[str] = []

    def fix(m: re.Match) -> str:
        expr, said = m[1].strip(), m[2]
        if re.search(r"[A-Za-z]", re.sub(r"\b(?:pi|e)\b", "", expr)):
            notes.append(RECOMPUTE_NOTES["symbolic"].format(expr=expr))
            return ""
        v = safe_calc(expr, "normalizer")
        if v is None:
            notes.append(RECOMPUTE_NOTES["failed"].format(expr=expr))
            return ""
        value = str(round(v)) if abs(v - round(v)) < 1e-9 else f"{v:.10g}"
        if value != said:
            notes.append(RECOMPUTE_NOTES["fixed"].format(expr=expr, said=said, value=value))
        return f"[[calc: {expr}]] -> {value}"

    return re.sub(r"\s{2,}", " ", re.sub(RECOMPUTED, fix, text)).rstrip(), notes


def recomputed(text: str) -> str:
    """CALC-6 for one line."""
    return recompute_report(text)[0]


def steps_report(text: str) -> tuple[str, list[str]]:
    """TXT-18: (text, notes): the steps before the first #### line, without bullet or number, recomputed and numbered."""
    found = [recompute_report(re.sub(r"^\s*(\d+\.|-\s+|\*\s+|[>\u2022]\s+)", "", x)) for x in text.split("\n####", 1)[0].splitlines() if x.strip()]
    steps = [t.strip() for t, _ in found if t.strip()]
    return "\n".join(f"{i}. {t}" for i, t in enumerate(steps, 1)), [n for _, notes in found for n in notes]


def patched(text: str) -> str:
    """CALC-12: on a line whose first marker's arrow is wrong, every arrow gets the marker's value."""
    out = []
    for line in text.split("\n"):
        m = re.search(CLAIM, line)
        v = safe_calc(m[1], "repair") if m else None
        if v is not None and abs(v - float(m[2].replace(",", ""))) > TOLERANCE:
            line = re.sub(r"->\s*-?\d+(?:\.\d+)?", lambda _, v=v: f"-> {v}", line)
        out.append(line)
    return "\n".join(out)


def inferred(numbers: list[float], target: float, last_first: bool = False) -> str | None:
    """CALC-18: an operation on two of the last six numbers that gives the target; pairs are tried in order, or the last one first."""
    last = numbers[-6:]
    pairs = [(a, b) for i, a in enumerate(last) for b in last[i + 1 :]]
    for a, b in pairs[-1:] * last_first + pairs:
        tried = [(a, b, "+", a + b), (a, b, "-", a - b), (b, a, "-", b - a), (a, b, "*", a * b)]
        tried += [(p, q, "/", p / q) for p, q in ((a, b), (b, a)) if abs(q) > TOLERANCE]
        for p, q, op, v in tried:
            if abs(v - target) <= TOLERANCE:
                return f"{p}{op}{q}"
    return None


#: What repairs note. Of two notes the first stands where an expression was inferred, the second where none was.
REPAIR_NOTES = {
    "symbolic": "removed symbolic calc marker: {expr}",
    "strict": "strict mode: dropped calc in symbolic context",
    "arrow": "fixed arrow: {clean} = {value} (was {said})",
    "blank": ("filled blank calc -> {guess} = {said}", "dropped blank calc (kept arrow value)"),
    "bare": ("replaced numeric-only calc {clean} -> {guess}", "dropped non-evaluable numeric-only calc {clean}"),
    "odd": ("repaired malformed calc '{expr}' -> {guess}", "left malformed calc unchanged: {expr}"),
}


def tidy(expr: str) -> str:
    """CALC-16 for one expression of a repair."""
    x = re.sub(UNIT_WORDS, "", re.sub(CURRENCY, "", expr))
    x = re.sub(THOUSANDS, lambda m: m[0].replace(",", ""), x)
    for pattern, by in INLINE_MATHS:
        x = re.sub(pattern, lambda m, by=by: by.replace("{1}", m[1] or "" if m.re.groups else "").replace("{2}", m[2] if m.re.groups > 1 else ""), x)
    gap = x.count("(") - x.count(")")
    return x + ")" * gap if gap >= 0 else re.sub(r"\){1,%d}$" % -gap, "", x)


def repair_report(text: str, strict: bool = False) -> tuple[str, list[str]]:
    """CALC-19: (text, notes). Markers with a numeric arrow are repaired: symbolic ones go; blank, bare and failing ones are
    inferred from the numbers of their line, if they can be; wrong arrows get the value. Strict ones are kept if they have a
    value and go otherwise."""
    out, notes = [], []
    for line in text.split("\n"):
        numbers = [float(x) for x in re.findall(r"[+-]?\d+(?:\.\d+)?", re.sub(r"\[\[calc:.*?\]\]", "", line))]

        def fix(m: re.Match, numbers=numbers) -> str:
            expr, said = m[1].strip(), m[2]
            clean = tidy(expr)
            value, marker = safe_calc(clean, "repair") if clean else None, lambda e: f"[[calc: {e}]] -> {said}"
            note = lambda n, guess=None: notes.append(n.format(expr=expr, clean=clean, value=value, said=said, guess=guess))
            if set(re.findall(r"[A-Za-z_]\w*", clean)) - {"sqrt", "pi", "e"}:
                note(REPAIR_NOTES["symbolic"])
                return ""
            if strict:
                if value is None:
                    note(REPAIR_NOTES["strict"])
                return "" if value is None else marker(clean)
            kind = "blank" if not clean else "bare" if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", clean) else "odd"
            if kind == "odd" and value is not None:
                if abs(value - float(said)) <= TOLERANCE:
                    return marker(clean)
                note(REPAIR_NOTES["arrow"])
                return f"[[calc: {clean}]] -> {value}"
            guess = inferred(numbers, float(said))
            if guess and safe_calc(tidy(guess), "repair") is not None:
                note(REPAIR_NOTES[kind][0], tidy(guess))
                return marker(tidy(guess))
            if kind == "bare" and value is not None:
                return marker(clean)
            note(REPAIR_NOTES[kind][1])
            return marker(expr) if kind == "odd" else f"-> {said}"

        out.append(re.sub(LINE_CLAIM, fix, line))
    return "\n".join(out), notes


def repaired(text: str) -> str:
    """CALC-19, then CALC-12."""
    return patched(repair_report(text)[0])


def reasoner_report(text: str | None) -> tuple[bool, list[str], str]:
    """CALC-11: (ok, messages, text): a line's first marker is skipped if it or its value is symbolic; values may be rationals
    and are compared relatively; a wrong one is replaced to the line's end."""
    ok, notes, out = True, [], []
    for line in (text or "").splitlines():
        m = re.search(ARROWED, line)
        if m:
            expr, said = m[1].strip(), m[2].strip()
            plain, value = plain_math(expr), plain_math(said)
            if re.search(r"[A-Za-z_√π]", plain) or re.search(r"[A-Za-z√π]", value):
                notes.append(REASONER_NOTES["symbolic"].format(expr=expr, said=said))
            elif (got := safe_calc(plain, "reasoner")) is None:
                ok = False
                notes.append(REASONER_NOTES["failed"].format(expr=expr))
            elif (claimed := rational(value)) is None:
                notes.append(REASONER_NOTES["text"].format(said=said))
            elif abs(got - claimed) > TOLERANCE * max(1.0, abs(got), abs(claimed)):
                ok = False
                notes.append(REASONER_NOTES["wrong"].format(expr=expr, said=said, value=shown(got)))
                line = line[: m.start(2)] + shown(got) + line[m.end(2) :]
        out.append(line)
    return ok, notes, "\n".join(out)


def rational(text: str) -> float | None:
    """CALC-15: a number, with commas or as a fraction."""
    x = text.replace(",", "").strip()
    m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*/\s*([+-]?\d+(?:\.\d+)?)", x)
    try:
        v = float(m[1]) / float(m[2]) if m else float(x)
    except (ValueError, ZeroDivisionError):
        return None
    return v if math.isfinite(v) else None


def evaluation_report(text: str | None, repair: bool) -> tuple[int, int, int, int, str]:
    """CALC-13: (checked, mismatches, repaired, failed, text): a line's first marker counts; only values that are wholly
    numeric up to the line's end are compared. A repair replaces every marker of the line by the first one's."""
    checked = wrong = mended = failed = 0
    out = []
    for line in (text or "").splitlines():
        m = re.search(ARROWED, line)
        if m:
            checked += 1
            expr, got = m[1].strip(), safe_calc(m[1].strip(), "eval")
            try:
                claimed = float(m[2].strip().replace(",", ""))
            except ValueError:
                claimed = None
            if got is None:
                failed += 1
            elif claimed is not None and abs(got - claimed) > TOLERANCE:
                wrong += 1
                if repair:
                    mended += 1
                    line = re.sub(ARROWED, lambda _, e=expr, v=got: f"[[calc: {e}]] -> {v}", line)
        out.append(line)
    return checked, wrong, mended, failed, "\n".join(out)


def _reported(text: Column, f, fields: str, blank: Column) -> Column:
    """f over the texts that hold a marker, each different text of a batch once; `blank` is what the others get."""

    @F.pandas_udf(fields)
    def run(s: pd.Series) -> pd.DataFrame:
        known = {x: f(x or "") for x in s.unique()}
        return pd.DataFrame([known[x] for x in s], columns=[c.split()[0] for c in fields.split(", ")])

    marked = text.contains("[[")
    return F.when(marked, run(F.when(marked, text))).otherwise(blank)


def check_lines(text: Column) -> Column:
    """CALC-11 as a column: struct(ok, notes, text)."""
    blank = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("notes"), text.alias("text"))
    return _reported(text, reasoner_report, "ok boolean, notes array<string>, text string", blank)


def evaluated_lines(text: Column, repair: bool = True) -> Column:
    """CALC-13 as a column: struct(checked, mismatches, repaired, failed, text)."""
    none = [F.lit(0).alias(n) for n in ("checked", "mismatches", "repaired", "failed")]
    return _reported(text, lambda x: evaluation_report(x, repair), "checked int, mismatches int, repaired int, failed int, text string", F.struct(*none, text.alias("text")))


def normalized_steps(text: Column) -> Column:
    """TXT-18 as a column: struct(text, notes). Texts without a marker are renumbered natively."""
    body = F.split_part(text, F.lit("\n####"), F.lit(1))
    bare = F.transform(filled_lines(body), lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s*(\d+\.|-\s+|\*\s+|[>\u2022]\s+)", ""), r"\s{2,}", " "), r"\s+$", "")))
    steps = F.transform(F.filter(bare, lambda x: x != ""), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    plain = F.struct(F.array_join(steps, "\n").alias("text"), F.array().cast("array<string>").alias("notes"))
    return F.when(text.isNotNull(), _reported(text, steps_report, "text string, notes array<string>", plain))


def _text_function(f):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def with_markers(text: Column, column) -> Column:
    """Python sees only the texts that hold a marker."""
    return F.when(text.contains("[["), column(F.when(text.contains("[["), text))).otherwise(text)


def recompute_markers(text: Column) -> Column:
    """CALC-6, line by line."""
    return with_markers(text, _text_function(lambda t: "\n".join(recomputed(x) for x in t.split("\n"))))


def patch_arrows(text: Column) -> Column:
    return with_markers(text, _text_function(patched))


def repair_markers(text: Column) -> Column:
    return with_markers(text, _text_function(repaired))


def repair_rows(df, text: str = "reasoner_output", qc: str = "qc", strict: bool = False):
    """CALC-20: the text repaired (CALC-19, then CALC-12); each note is appended to qc.reasons as `[repair] note`.

    Whether a row passed stays; a row without a qc has passed. Python sees only the texts that hold a marker.
    """

    @F.pandas_udf("text string, notes array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        # A text that repeats in a batch is repaired once.
        reports = {x: repair_report(x or "", strict) for x in s.unique()}
        done = {x: (patched(t), notes) for x, (t, notes) in reports.items()}
        return pd.DataFrame([done[x] for x in s], columns=["text", "notes"])

    marked, c = F.col(text).contains("[[calc:"), F.col(text)
    plain = F.struct(c.alias("text"), F.array().cast("array<string>").alias("notes"))
    if qc not in df.columns:
        df = df.withColumn(qc, F.lit(None).cast("struct<passed:boolean,reasons:array<string>>"))
    x = df.withColumn("_r", F.when(marked, run(F.when(marked, c))).otherwise(plain))
    noted = F.transform("_r.notes", lambda n: F.concat(F.lit("[repair] "), n))
    reasons = F.concat(F.coalesce(F.col(qc)["reasons"], F.array().cast("array<string>")), noted)
    return x.withColumn(qc, F.struct(F.when(F.col(qc).isNull(), True).otherwise(F.col(qc)["passed"]).alias("passed"), reasons.alias("reasons"))).withColumn(text, F.col("_r.text")).drop("_r")


REPORT = "ok boolean, checked long, failed long, mismatches array<struct<expr:string,claimed:double,got:double>>"


def claimed_numbers(words: pa.Array) -> pa.Array:
    try:
        return pc.ascii_ltrim(words, "+").cast("double")
    except pa.ArrowInvalid:  # beyond the largest double
        return pa.array([float(w) for w in words.to_pylist()], "double")


def arrow_report(texts: pa.Array, tolerance: float = TOLERANCE, dialect: str = "verifier") -> pa.Array:
    """CALC-10, CALC-14 over an Arrow array of texts: their reports, with no step per text."""
    cut = pc.split_pattern_regex(pc.fill_null(texts, ""), f"[{LINE_END}]")
    rows, rest = pc.list_parent_indices(cut), pc.list_flatten(cut)
    marked = pc.match_substring(rest, "[[calc:")
    rows, found = rows.filter(marked), pc.extract_regex(rest.filter(marked), NAMED_CLAIM)
    rows, found = rows.filter(found.is_valid()), found.filter(found.is_valid())
    exprs, claimed = pc.ascii_trim(found.field("expr"), " "), claimed_numbers(found.field("claimed"))
    got = arrow_values(exprs, dialect)
    wrong = pc.fill_null(pc.greater(pc.abs(pc.subtract(got, claimed)), tolerance), False)
    count = lambda at: np.bincount(at.to_numpy(zero_copy_only=False), minlength=len(texts)).astype("int64")
    checked, failed, mismatched = count(rows), count(rows.filter(got.is_null())), count(rows.filter(wrong))
    named = pa.StructArray.from_arrays([c.filter(wrong) for c in (exprs, claimed, got)], ["expr", "claimed", "got"])
    mismatches = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], mismatched.cumsum()]), "int32"), named)
    return pa.StructArray.from_arrays([pa.array(failed + mismatched == 0), pa.array(checked), pa.array(failed), mismatches], ["ok", "checked", "failed", "mismatches"])


def with_claim_report(df, text: Column, out: str, tolerance: float = TOLERANCE, dialect: str = "verifier"):
    """CALC-10, CALC-14: adds `out`, struct(ok, checked, failed, mismatches (expr, claimed, got)) of a text, folded over its
    lines. A line's first claim counts; one that can't be evaluated fails; a text without claims passes. Computed once per
    row; a batch of texts is judged in one go."""

    @F.arrow_udf(REPORT)
    def report(texts: pa.Array) -> pa.Array:
        return arrow_report(texts, tolerance, dialect)

    return with_computed(df, **{out: report(F.make_valid_utf8(text))})


def verify_claims(df, text: str, key: list[str], tolerance: float = TOLERANCE, dialect: str = "verifier"):
    """CALC-10, CALC-14, AGG-8: for each row its key and n_checked, n_failed, n_mismatch, ok, mismatches of its report."""
    r = with_claim_report(df.select(*key, F.col(text).alias("_text")), F.col("_text"), "_r", tolerance, dialect)
    return r.select(*key, F.col("_r.checked").alias("n_checked"), F.col("_r.failed").alias("n_failed"), F.size("_r.mismatches").cast("long").alias("n_mismatch"), "_r.ok", "_r.mismatches")
