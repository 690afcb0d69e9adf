"""A bounded evaluator of arithmetic expressions (CALC-1), in six dialects, and the plan language (CALC-2).

Integers stay exact until the end; magnitudes and exponents are bounded, so no expression hangs. Any failure is null.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import once

TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z]\w*)|(\*\*|//|[-+*/%(),]))")
#: Digits of the largest whole number, length of the longest expression, depth of the deepest.
MOST_DIGITS, LONGEST, DEEPEST = 400, 400, 60
COMMON: dict[str, Callable] = {"sqrt": math.sqrt, "abs": abs, "round": round}
MORE = COMMON | {"sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "ln": math.log, "log10": math.log10, "exp": math.exp}
#: Dialects: functions, and whether // is known.
DIALECTS = {"verifier": (COMMON, True), "router": (COMMON, False), "normalizer": (MORE, True), "reasoner": (COMMON, False), "repair": (COMMON, False), "eval": (COMMON, False)}


class Unfit(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Unfit
        at = m.end()
        kind = "num" if m[1] else "name" if m[2] else "op"
        out.append((kind, m[1] or m[2] or m[3]))
    return out


def number(word: str) -> int | float:
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", word):
        return int(word, 16)
    if word.endswith("_") or "__" in word or (word.replace("_", "").isdigit() and len(word) > 1 and word[0] == "0" and int(word.replace("_", ""))):
        raise Unfit
    plain = word.replace("_", "")
    return int(plain) if plain.isdigit() else float(plain)


def power(a, b):
    if isinstance(a, int) and isinstance(b, int):
        if b >= 0 and abs(b) * max(1, abs(a).bit_length()) > 3.33 * MOST_DIGITS:
            raise Unfit
        return a**b
    v = float(a) ** float(b)
    if isinstance(v, complex):
        raise Unfit
    return v


class Parser:
    """Precedence climbing over tokens."""

    def __init__(self, words: list[tuple[str, str]], functions: dict[str, Callable], floor: bool):
        self.words, self.at, self.functions, self.floor, self.depth = words, 0, functions, floor, 0

    def next(self, *ops: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] == "op" and self.words[self.at][1] in ops:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def sum(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unfit
        a = self.product()
        while op := self.next("+", "-"):
            b = self.product()
            a = a + b if op == "+" else a - b
        self.depth -= 1
        return a

    def product(self):
        a = self.signed()
        while op := self.next("*", "/", "%", "//"):
            b = self.signed()
            if op == "//" and not self.floor:
                raise Unfit
            a = {"*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "//": lambda: a // b}[op]()
            if isinstance(a, int) and a.bit_length() > 3.33 * MOST_DIGITS:
                raise Unfit
        return a

    def signed(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unfit
        sign = self.next("+", "-")
        a = (-self.signed() if sign == "-" else +self.signed()) if sign else self.raised()
        self.depth -= 1
        return a

    def raised(self):
        a = self.atom()
        return power(a, self.signed()) if self.next("**") else a

    def atom(self):
        if self.next("("):
            a = self.sum()
            if not self.next(")"):
                raise Unfit
            return a
        if self.at >= len(self.words) or self.words[self.at][0] == "op":
            raise Unfit
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "num":
            return number(word)
        if word in ("pi", "e"):
            return getattr(math, word)
        if word not in self.functions or not self.next("("):
            raise Unfit
        args = [self.sum()]
        while self.next(","):
            args.append(self.sum())
        if not self.next(")"):
            raise Unfit
        return self.functions[word](*args)


def safe_calc(expr: str | None, dialect: str = "verifier") -> float | None:
    if not expr or len(expr) > LONGEST:
        return None
    if dialect == "reasoner":
        expr = plain_math(expr)
    functions, floor = DIALECTS[dialect]
    try:
        p = Parser(tokens(expr), functions, floor)
        v = p.sum()
        if p.at != len(p.words):
            return None
        v = float(v)
    except (Unfit, ValueError, ArithmeticError, TypeError, RecursionError):
        return None
    return v if math.isfinite(v) else None


#: Signs and spacings that are replaced before evaluation, in this order; a caret becomes a power last.
SIGNS = [("×", "*"), ("·", "*"), ("⋅", "*"), ("\\cdot", "*"), ("−", "-"), ("—", "-"), ("÷", "/")]
SPACINGS = [r"\^\s*\\?circ", "°", r"\\,|\\!|\\;|\\:"]


def plain_math(text: str) -> str:
    """CALC-3: fractions, signs and powers in ASCII."""
    text = re.sub(r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"(\1)/(\2)", text)
    for a, b in SIGNS:
        text = text.replace(a, b)
    for pattern in SPACINGS:
        text = re.sub(pattern, "", text)
    return re.sub(r"\s+", " ", text.replace("^", "**")).strip()


def shown(v: float) -> str:
    """CALC-15: whole if near enough, else at most ten decimals."""
    return str(round(v)) if abs(v - round(v)) < 1e-9 else f"{v:.10f}".rstrip("0").rstrip(".")


def evaluate_plan(plan: str | None) -> tuple[list[float | None], list[dict]]:
    """CALC-2: values of `n. expression # note` lines, where _k is the k-th value so far (0 out of range), up to <stop>."""
    values: list[float | None] = []
    logs: list[dict] = []
    for text in (plan or "").splitlines():
        text = text.strip()
        if text == "<stop>":
            break
        if not text:
            continue
        m = re.match(r"(\d+)\.\s*(.+)$", text.split("#")[0].strip())
        if not m:
            logs.append({"line": text, "error": "line_parse", "value": None})
            continue

        def earlier(k: re.Match) -> str:
            i = int(k[1])
            return ("None" if values[i - 1] is None else f"({values[i - 1]!r})") if 1 <= i <= len(values) else "0"

        expr = re.sub(r"_(\d+)", earlier, m[2])
        v = safe_calc(expr, "verifier") if re.fullmatch(r"[0-9eE()+\-*/\s._]+", expr) else None
        values.append(v)
        logs.append({"line": text, "error": None if v is not None else "eval", "value": v})
    return values, logs


#: What is evaluated natively: two plain numbers and a sign.
PLAIN = r"^\s*((?!0\d)\d{1,15}(?:\.\d{1,6})?)\s*([-+*/])\s*((?!0\d)\d{1,15}(?:\.\d{1,6})?)\s*$"

#: The same for Arrow's expressions, which know no lookahead.
PLAIN_PARTS = r"^[@]*(?P<a>N)[@]*(?P<op>[-+*/])[@]*(?P<b>N)[@]*$".replace("@", " \\t\\n\\v\\f\\r").replace("N", r"(?:0|[1-9]\d{0,14})(?:\.\d{1,6})?")


def _plain(expr: Column) -> Column:
    return expr.rlike(PLAIN)


def _native(expr: Column) -> Column:
    a, op, b = (F.regexp_extract(expr, PLAIN, i) for i in (1, 2, 3))
    parts = F.struct(a.try_cast("double").alias("a"), op.alias("op"), b.try_cast("double").alias("b"))
    valued = lambda x: F.when(x["op"] == "+", x["a"] + x["b"]).when(x["op"] == "-", x["a"] - x["b"]).when(x["op"] == "*", x["a"] * x["b"]).when(x["op"] == "/", F.try_divide(x["a"], x["b"]))
    return once(parts, valued)


def calc(expr: Column, dialect: str = "verifier") -> Column:
    """CALC-1 as a column: the native path for `a op b`, Arrow batches for the rest."""

    @F.pandas_udf("double")
    def slow(s: pd.Series) -> pd.Series:
        known = {x: safe_calc(x, dialect) for x in s.dropna().unique()}
        if not known:
            return pd.Series([None] * len(s), dtype=object)
        found = s.map(known)  # values are finite, so what is no number is null
        return found.astype(object).where(found.notna(), None)

    return F.when(_plain(expr), _native(expr)).otherwise(slow(F.when(_plain(expr), F.lit(None)).otherwise(expr)))


def calc_each(exprs: Column, dialect: str = "verifier") -> Column:
    """CALC-1 over an array of expressions: values in their order, null where there is none. Arrays of `a op b` only are
    evaluated natively; of the others a batch evaluates each different expression once."""

    @F.pandas_udf("array<double>")
    def slow(s: pd.Series) -> pd.Series:
        # Arrays come as JSON: Spark measures an Arrow batch after each row, and a list column at the cost of all rows before.
        known: dict = {}
        found: list = []
        for text in s:
            each = None if text is None else json.loads(text)
            found.append(None if each is None else [known[e] if e in known else known.setdefault(e, safe_calc(e, dialect)) for e in each])
        return pd.Series(found, index=s.index, dtype=object)

    plain = lambda x: F.forall(x, lambda e: F.coalesce(_plain(e), F.lit(True)))
    return F.coalesce(once(exprs, lambda x: F.when(plain(x), F.transform(x, _native))), slow(once(exprs, lambda x: F.when(~plain(x), F.to_json(x)))))


def arrow_values(exprs: pa.Array, dialect: str = "verifier") -> pa.Array:
    """CALC-1 over an Arrow array: `a op b` in one go, of the others each different one once."""
    parts = pc.extract_regex(exprs, PLAIN_PARTS)
    a, op, b = (pc.struct_field(parts, n) for n in ("a", "op", "b"))
    a, b = a.cast("double"), b.cast("double")
    ratio = pc.divide(a, pc.if_else(pc.not_equal(b, 0.0), b, pa.scalar(None, "double")))
    is_op = pc.make_struct(*[pc.fill_null(pc.equal(op, o), False) for o in "+-*/"], field_names=list("+-*/"))
    values = pc.case_when(is_op, pc.add(a, b), pc.subtract(a, b), pc.multiply(a, b), ratio)
    rest = pc.and_(pc.is_valid(exprs), pc.is_null(op))
    if not pc.any(rest).as_py():
        return values
    others = exprs.filter(rest).dictionary_encode()
    known = pa.array([safe_calc(e, dialect) for e in others.dictionary.to_pylist()], "double")
    return pc.replace_with_mask(values, rest, known.take(others.indices))


def expression_values(df: DataFrame, exprs: str, dialect: str = "verifier", out: str = "values") -> DataFrame:
    """CALC-1 with a dictionary: adds the values of an array of expressions, each different expression of the whole table
    evaluated once. For expressions that repeat much and cost much; the dictionary is two shuffles.

    Expressions meet by a 64-bit hash with the text as check; rows get their values back by the hash of their array. Rows
    without expressions, or with a null array, take no part in either.
    """
    key = F.xxhash64(exprs)
    arrays = df.select(F.col(exprs).alias("_e")).where(F.size("_e") > 0).distinct()
    each = arrays.select(F.xxhash64("_e").alias("_h"), "_e", F.posexplode("_e").alias("_i", "_x")).withColumn("_k", F.xxhash64("_x"))
    known = each.select("_k", "_x").distinct().withColumn("_v", calc(F.col("_x"), dialect))
    valued = each.alias("e").join(known.alias("d"), (F.col("e._k") == F.col("d._k")) & F.col("e._x").eqNullSafe(F.col("d._x"))).select("e._h", "e._e", "e._i", "d._v")
    back = valued.groupBy("_h", "_e").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("_values"))
    x = df.withColumn("_key", F.when(F.size(exprs) > 0, key))
    x = x.join(back, (F.col("_key") == F.col("_h")) & (F.col(exprs) == F.col("_e")), "left")
    empty = F.when(F.col(exprs).isNotNull(), F.array().cast("array<double>"))
    return x.withColumn(out, F.coalesce("_values", empty)).drop("_key", "_h", "_e", "_values")


PLAN_RESULT = "values array<double>, logs array<struct<line:string,error:string,value:double>>"


def plan_values(plan: Column) -> Column:
    @F.pandas_udf(PLAN_RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        found = [evaluate_plan(x) for x in s]
        return pd.DataFrame({"values": [v for v, _ in found], "logs": [g for _, g in found]})

    return run(plan)
