"""Answers: canonical forms and comparison (ANS-1 to ANS-8), natively but for expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.evaluator import safe_calc
from tracemill.functions.text import blank_to_null, final_last_line_anywhere, final_or_text, once, put_in, strip

BRACES = str.maketrans("{}", "()")

#: Unit words that may follow a number, with no word boundary before them.
UNITS = "hours?|hrs?|minutes?|mins?|meters?|m|kg|g|dollars?|usd"


def numeric(text: str) -> float | None:
    """ANS-1: the value of an answer that is an expression; fractions, roots and degrees may be LaTeX, letters never count."""
    x = text.strip()
    if len(x) > 1 and x[0] == x[-1] == "$":
        x = x[1:-1]
    x = re.sub(r"\\degree|°", "", x)
    x = re.sub(r"\\sqrt\{([^}]+)\}", r"sqrt(\1)", re.sub(r"\\frac\{([^}]+)\}\{([^}]+)\}", r"(\1)/(\2)", x))
    x = re.sub(r"\\[A-Za-z]+", "", x).translate(BRACES)
    return None if re.search("[A-Za-z]", x) else safe_calc(x.strip(), "verifier")


def answer_values(text: str) -> list[float] | None:
    """ANS-2: the sorted values of an answer or of its comma list, null unless all are numeric."""
    core = text.strip().strip(".").strip()
    if len(core) > 1 and core[0] == core[-1] == "$":
        core = core[1:-1].strip()
    found = [numeric(p) for p in re.split(r"\s*,\s*", core)]
    return None if None in found else sorted(found)


def numeric_set(c: Column) -> Column:
    """ANS-2 as a column: lists of plain numbers natively, other answers that hold a digit in Arrow batches."""

    @F.pandas_udf("array<double>")
    def slow(s: pd.Series) -> pd.Series:
        known = {x: answer_values(x) for x in s.dropna().unique()}
        return s.map(known.get).astype(object) if known else pd.Series([None] * len(s), dtype=object)

    core = lambda x: F.btrim(strip(x), F.lit("."))
    number = r"[+-]?(?:0+|[1-9]\d*|\d+\.\d*|\.\d+)"
    plain = lambda x: x.rlike(rf"^{number}(?:\s*,\s*{number})*$")
    values = lambda x: F.array_sort(F.transform(F.split(x, ","), lambda p: strip(p).cast("double")))
    native = once(core(c), lambda x: F.when(plain(x), values(x)))
    return F.coalesce(native, slow(F.when(~plain(core(c)) & c.rlike(r"\d"), c)))


def answer_class(c: Column) -> Column:
    """ANS-2: NUMERIC_SET or TEXT, null for null. A single number is a set of one, and degree signs go before an answer is
    evaluated, so no answer is left for classes of its own."""
    return F.when(c.isNull(), F.lit(None)).when(numeric_set(c).isNotNull(), "NUMERIC_SET").otherwise("TEXT")


def decimal_text(v: Column) -> Column:
    """A double as text: whole ones below 1e16 end in .0."""
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e16), F.concat(v.cast("long").cast("string"), F.lit(".0"))).otherwise(v.cast("string"))


#: Why answers are equal or not.
COMPARED = {
    "gold": "missing gold",
    "pred": "missing pred",
    "numbers": "numeric match",
    "sizes": "set size mismatch %d vs %d",
    "values": "value mismatch %s vs %s",
    "texts": "literal match",
    "differ": "literal mismatch '%s' vs '%s'",
}


def answer_comparison(pred: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    """ANS-3: struct(equal, why). Sets of numbers are equal within the tolerance, in any order; else texts are equal without
    the dots at their ends; missing ones never match."""
    text = lambda c: F.btrim(strip(c), F.lit("."))
    both = F.struct(numeric_set(pred).alias("a"), numeric_set(gold).alias("b"), text(pred).alias("p"), text(gold).alias("g"))
    none = lambda c: F.coalesce(c, F.lit("")) == ""

    def compared(x: Column) -> Column:
        n, m = F.size(x["a"]), F.size(x["b"])
        apart = F.filter(F.zip_with(x["a"], x["b"], lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda t: ~(F.abs(t["p"] - t["q"]) <= tolerance))
        first = F.try_element_at(apart, F.lit(1))
        sizes = put_in(COMPARED["sizes"], n, m)
        values = once(first, lambda f: put_in(COMPARED["values"], decimal_text(f["p"]), decimal_text(f["q"])))
        numbers = F.when(n != m, sizes).when(first.isNotNull(), values).otherwise(COMPARED["numbers"])
        literal = F.when((strip(x["p"]) != "") & (strip(x["p"]) == strip(x["g"])), COMPARED["texts"]).otherwise(put_in(COMPARED["differ"], x["p"], x["g"]))
        why = F.when(none(gold), COMPARED["gold"]).when(none(pred), COMPARED["pred"]).when(x["a"].isNotNull() & x["b"].isNotNull(), numbers).otherwise(literal)
        return once(why, lambda w: F.struct(w.endswith(" match").alias("equal"), w.alias("why")))

    return once(both, compared)


def answers_equal(pred: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    """ANS-3: whether answer_comparison finds them equal."""
    text = lambda c: strip(F.btrim(strip(c), F.lit(".")))
    both = F.struct(numeric_set(pred).alias("a"), numeric_set(gold).alias("b"), text(pred).alias("p"), text(gold).alias("g"))

    def same(x: Column) -> Column:
        near = F.forall(F.zip_with(x["a"], x["b"], lambda p, q: F.abs(p - q) <= tolerance), lambda t: F.coalesce(t, F.lit(False)))
        literal = F.coalesce((x["p"] != "") & (x["p"] == x["g"]), F.lit(False))
        return F.when(x["a"].isNotNull() & x["b"].isNotNull(), (F.size(x["a"]) == F.size(x["b"])) & near).otherwise(literal)

    return once(both, same)


def strip_answer(c: Column) -> Column:
    """ANS-4: no spaces, no dots at the end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \n]", ""), r"\.+$", "")


def answers_match(pred: Column, gold: Column) -> Column:
    return strip_answer(pred) == strip_answer(gold)


def numeric_text(c: Column) -> Column:
    """ANS-5: no dollar signs, commas, closing unit word or dot."""
    x = strip(F.regexp_replace(c, r"[$,]", ""))
    x = strip(F.regexp_replace(x, rf"(?i)[,\s]*({UNITS})$", ""))
    return blank_to_null(F.regexp_replace(x, r"\.$", ""))


def fixed_answer(verifier: Column) -> Column:
    """The FIXED_ANSWER of a verifier block; empty if blank, null if there is no tag."""
    p = r"(?is)<<\s*FIXED(?:_ANSWER)?\s*:\s*(.*?)\s*>>"
    return once(verifier, lambda v: F.when(v.rlike(p), strip(F.regexp_extract(v, p, 1))))


def verdict(verifier: Column) -> Column:
    return blank_to_null(F.upper(F.regexp_extract(verifier, r"(?i)<<\s*VERDICT\s*:\s*(CORRECT|INCORRECT)", 1)))


def predicted_answer(verifier: Column, reasoner: Column, normalizer: Column) -> Column:
    """ANS-6: normalizer, then reasoner final, then the fixed answer."""
    return F.coalesce(numeric_text(final_or_text(normalizer)), numeric_text(final_or_text(reasoner)), numeric_text(fixed_answer(verifier)))


def scored_answer(verifier: Column, reasoner: Column, normalizer: Column) -> Column:
    """ANS-7: what accuracy looks at; a fixed answer of an INCORRECT verdict overrides."""
    own = F.when(normalizer.isNotNull(), final_or_text(normalizer)).otherwise(F.coalesce(final_or_text(reasoner), F.lit("")))
    fixed = blank_to_null(fixed_answer(verifier))
    return F.when((verdict(verifier) == "INCORRECT") & fixed.isNotNull(), fixed).otherwise(own)


def normal_answer(reasoner: Column, verifier: Column, gold: Column) -> Column:
    """ANS-8: struct(final, source). A blank FIXED tag of an INCORRECT verdict still wins."""
    wrong, fixed, last = verdict(verifier).eqNullSafe("INCORRECT"), fixed_answer(verifier), final_last_line_anywhere(reasoner)
    has_gold = F.coalesce(strip(gold), F.lit("")) != ""
    value = F.when(wrong & fixed.isNotNull(), fixed).when(has_gold, strip(gold)).otherwise(F.coalesce(last, F.lit("")))
    source = F.when(wrong & fixed.isNotNull(), "verifier_fix").when(has_gold, "gold").when(last.isNotNull(), "reasoner").otherwise("none")
    return F.struct(value.alias("final"), source.alias("source"))
