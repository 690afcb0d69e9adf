"""Column functions over reasoning-trace text: whitespace, chevron plans, final answers, markers, line arrays."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends, the texts at which generated text is cut, cue words of multi-step questions, role order, plans that stand in for none.
LINE_END = "\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029"
LINE_ENDS = f"\r\n|[{LINE_END}]"
STOP_TOKENS = ["\n<role:", "\n<<", "<<<END>>>", "<<END>>"]
MULTISTEP_CUES = ["then", "after", "each day", "per day", "per week", "first", "second", "next", "total", "sum of", "difference of"]
ROLE_ORDER = ["planner", "reasoner", "calculator", "verifier", "normalizer"]
EMPTY_PLAN = "<<\n1. Read problem carefully.\n2. Compute needed quantities.\n>>"
DEFAULT_PLAN = "<<\n1. Identify required quantities.\n2. Compute and present final answer.\n>>"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trims white space of any kind; trim() alone takes spaces only."""
    return F.btrim(c, F.lit(" \t\r\n\x0b\x0c"))


def first_filled(*cs: Column) -> Column:
    """PRJ-2: the first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def normalize_ws(c: Column) -> Column:
    """TXT-1: runs of white space become one space; trimmed."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f mentions it."""
    return F.transform(F.array(c), f)[0]


def put_in(template: str, *values: Column) -> Column:
    """format_string for %s and %d of strings and whole numbers, without a formatter for each row; null is put in as null."""
    pieces = re.split("%[sd]", template)
    filled = [x for v, piece in zip(values, pieces[1:], strict=True) for x in (F.coalesce(v.cast("string"), F.lit("null")), F.lit(piece))]
    return F.concat(F.lit(pieces[0]), *filled)


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row and never copied into what follows.

    Spark merges a projection into the Python UDFs above it as often as they mention it, however dear it is, unless it isn't
    deterministic; the row number, never below 0, makes it so and changes no value.
    """
    return df.withColumns({n: F.when(F.monotonically_increasing_id() >= 0, c) for n, c in columns.items()})


def lines(c: Column) -> Column:
    """Lines of a text; one empty part after a final line end is dropped, an empty text has none."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(once(F.split(c, LINE_ENDS), cut))


def filled_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: strip(x) != "")


def chevron_blocks(c: Column) -> Column:
    """TXT-2: the contents of all << >> segments."""
    return F.regexp_extract_all(c, F.lit("(?s)<<(.*?)>>"), 1)


def without_chevrons(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?s)<<.*?>>", ""))


def plan_text(c: Column) -> Column:
    """TXT-3: a plan as it is if it opens with <<, wrapped otherwise, the default if blank."""
    wrapped = F.concat(F.lit("<<\n"), F.array_join(F.transform(filled_lines(c), lambda x: strip(x)), "\n"), F.lit("\n>>"))
    return F.when(c.isNull() | (strip(c) == ""), EMPTY_PLAN).when(strip(c).startswith("<<"), strip(c)).otherwise(wrapped)


def cleanup_markers(c: Column) -> Column:
    """TXT-4: drops BEGIN/END artefacts and lone > lines."""
    x = F.regexp_replace(F.replace(c, F.lit("<<<BEGIN>>>"), F.lit("")), "<<<END>>>>+", "")
    return strip(F.regexp_replace(x, r"(?m)^\s*>\s*\n", ""))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[+-]?\d+(?:\.\d+)?"), 0)


def final_last_line_anywhere(c: Column) -> Column:
    """TXT-7: the payload of the last line that opens with ####."""
    found = F.filter(lines(c), lambda x: x.rlike(r"^\s*####\s*[^\n#]+"))
    return blank_to_null(strip(F.regexp_extract(F.try_element_at(found, F.lit(-1)), r"^\s*####\s*([^\n#]+)", 1)))


def final_on_last_line(c: Column) -> Column:
    """TXT-7: the payload of #### on the last line that isn't blank, else null."""
    payload = lambda x: F.when(x.startswith("####"), blank_to_null(strip(F.regexp_replace(x, r"^\s*####\s*", ""))))
    return once(strip(F.try_element_at(filled_lines(c), F.lit(-1))), payload)


def final_or_text(c: Column) -> Column:
    """TXT-7: the first #### payload, else the whole text."""
    return F.coalesce(blank_to_null(strip(F.regexp_extract(c, r"####[ \t]*([^\n]+)", 1))), strip(c))


def enforce_final(c: Column, fallback: Column) -> Column:
    """TXT-5: struct(text, final) with exactly one closing #### line."""
    own = final_last_line_anywhere(c)

    def through_last(rows: Column) -> Column:
        """What follows the last #### line goes."""
        upto = F.array_max(F.transform(rows, lambda x, i: F.when(strip(x).startswith("####"), i + 1)))
        return once(upto, lambda n: F.when(n.isNull(), rows).otherwise(F.slice(rows, F.lit(1), n)))

    def closed(rows: Column) -> Column:
        value = F.coalesce(own, blank_to_null(strip(fallback)), F.try_element_at(numbers(F.array_join(rows, "\n")), F.lit(-1)))
        body = F.array_join(F.filter(rows, lambda x: (strip(x) != "") & ~strip(x).startswith("####")), "\n")
        text = lambda x: F.when(x["v"].isNull(), x["b"]).otherwise(F.concat_ws("\n", blank_to_null(x["b"]), F.concat(F.lit("#### "), x["v"])))
        return once(F.struct(value.alias("v"), body.alias("b")), lambda x: F.struct(text(x).alias("text"), x["v"].alias("final")))

    return once(once(lines(c), through_last), closed)


def ensure_final_suffix(c: Column, final: Column) -> Column:
    """TXT-8: appends #### final unless a #### line is there or there is no final."""
    return F.when(c.rlike(r"(?m)^\s*####") | final.isNull() | (strip(final) == ""), c).otherwise(F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit("\n#### "), strip(final)))


def clamp(c: Column) -> Column:
    """TXT-9: the text before the earliest stop token."""
    first = F.least(*[F.nullif(F.locate(t, c), F.lit(0)) for t in STOP_TOKENS])
    return strip(F.when(first.isNull(), c).otherwise(F.substring(c, F.lit(1), first - 1)))


def sanitize_planner(c: Column) -> Column:
    """TXT-10: the first << block up to >> or the end, wrapped again; else the text up to >>; else clamped."""
    inner = strip(F.regexp_extract(c, r"(?s)<<(.*?)(?:>>|$)", 1))
    return F.when(c.contains("<<"), F.concat(F.lit("<<\n"), inner, F.lit("\n>>"))).when(c.contains(">>"), strip(F.regexp_extract(c, "(?s)^(.*?)>>", 1))).otherwise(clamp(c))


def collapse_repeats(arr: Column) -> Column:
    """WIN-2: of consecutive lines that are equal when trimmed, the first."""
    return once(arr, lambda a: F.filter(a, lambda x, i: (i == 0) | (strip(x) != strip(F.get(a, i - 1)))))


def sanitize_reasoner(c: Column) -> Column:
    """TXT-11: tags and chevron tokens go, the text ends with its first #### line, repeated lines collapse."""
    x = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "(?i)</?assistant>", "")
    x = F.regexp_replace(F.regexp_replace(x, "<role:[^>]+>", ""), "<<<?[^>]+>>>?", "")
    return strip(F.array_join(collapse_repeats(once(once(x, lines), lambda rows: _through(rows, r"^####\s"))), "\n"))


def _through(rows: Column, pattern: str) -> Column:
    """Lines through the first one that has the pattern; all without one."""
    at = F.array_position(F.transform(rows, lambda r: r.rlike(pattern)), True)
    return once(at, lambda n: F.when(n > 0, F.slice(rows, F.lit(1), n.cast("int"))).otherwise(rows))


def clip_lines(arr: Column) -> Column:
    """Lines through the first #### line."""
    return once(arr, lambda rows: _through(rows, r"^\s*####\s*\S"))


def clip_after_final(c: Column) -> Column:
    """TXT-15."""
    return F.array_join(clip_lines(once(c, lines)), "\n")


def sanitize_verifier(c: Column) -> Column:
    """TXT-12: the first whole VERDICT/EVIDENCE/FIXED triple in canonical form, else the text before the first header."""
    p = r"(?is)<<\s*VERDICT\s*:\s*(CORRECT|INCORRECT)\s*>>.*?<<\s*EVIDENCE\s*:\s*(.*?)>>.*?<<\s*FIXED(?:_ANSWER)?\s*:\s*(.*?)>>"
    part = lambda i: strip(F.regexp_extract(c, p, i))
    whole = F.concat(F.lit("<<VERDICT: "), F.upper(part(1)), F.lit(">>\n<<EVIDENCE: "), part(2), F.lit(">>\n<<FIXED_ANSWER: "), part(3), F.lit(">>"))
    return F.when(c.rlike(p), whole).otherwise(strip(F.regexp_extract(c, r"(?is)^(.*?)(?:<<\s*VERDICT|$)", 1)))


def selector_roles(c: Column) -> Column:
    """TXT-13: roles of a calls: list, else those that the text names, in canonical order."""
    low = F.lower(F.regexp_replace(F.regexp_replace(strip(c), "(?s)`{3}.*?`{3}", " "), "<<|>>", " "))
    named = lambda t: F.transform(F.split(F.regexp_extract(t, r"calls\s*:\s*([^\n;><]+)", 1), ","), strip)
    listed = lambda t: t.rlike(r"calls\s*:\s*[^\n;><]+")
    said = once(low, lambda t: F.struct(t.alias("low"), named(t).alias("named"), listed(t).alias("listed")))
    order = F.array(*[F.lit(r) for r in ROLE_ORDER])
    return once(said, lambda x: F.filter(order, lambda r: F.when(x["listed"], F.array_contains(x["named"], r)).otherwise(F.contains(x["low"], r))))


def sanitize_selector(c: Column) -> Column:
    """TXT-13: `CALLS: a,b; HALT_AFTER: x`."""
    said = F.regexp_extract(F.lower(c), r"halt[_\-\s]*after\s*:\s*([a-z_]+)", 1)

    def put(x: Column) -> Column:
        roles, said = x["roles"], x["said"]
        halt = F.when(said.isin(*ROLE_ORDER), said).when(F.array_contains(roles, "normalizer"), F.lit("normalizer")).otherwise(F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("normalizer")))
        calls = F.when(F.size(roles) > 0, F.concat(F.lit("CALLS: "), F.array_join(roles, ",")))
        return F.concat_ws("; ", calls, F.concat(F.lit("HALT_AFTER: "), halt))

    return F.when(c.isNull() | (c == ""), "").otherwise(once(F.struct(selector_roles(c).alias("roles"), said.alias("said")), put))


def parse_selector(c: Column) -> Column:
    """TXT-14: struct(calls, halt), matched independently."""
    calls = F.filter(F.transform(F.split(F.regexp_extract(c, r"(?i)CALLS\s*:\s*([^;\n]*)", 1), ","), lambda x: F.lower(strip(x))), lambda x: x != "")
    return F.struct(calls.alias("calls"), blank_to_null(F.lower(strip(F.regexp_extract(c, r"(?i)HALT_AFTER\s*:\s*([A-Za-z_]+)", 1)))).alias("halt"))


def count_steps(c: Column) -> Column:
    """TXT-16: numbered steps inside the outermost << >>, else lines that aren't blank."""
    inner = F.when(c.rlike(r"(?s)<<.*>>"), F.regexp_extract(c, r"(?s)<<(.*)>>", 1)).otherwise(c)
    n = F.size(F.regexp_extract_all(inner, F.lit(r"(?m)^\s*\d+\.\s+"), 0))
    return F.when(n > 0, n).otherwise(F.size(filled_lines(inner)))


def looks_multistep(c: Column, words: int = 28) -> Column:
    """TXT-17: any cue as a substring, or many words."""
    return F.lower(c).rlike("|".join(MULTISTEP_CUES)) | (F.size(F.split(strip(c), r"\s+")) >= words)


def numbered_lines(c: Column) -> Column:
    """WIN-1: the lines between line feeds that aren't just spaces, as they are but for spaces around them, numbered from 1."""
    kept = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def renumber(c: Column) -> Column:
    """WIN-1: lines that aren't blank, without their bullet or number, numbered from 1."""
    body = F.transform(filled_lines(c), lambda x: strip(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*])\s*", "")))
    kept = F.filter(body, lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
