"""Field resolution over loosely typed records (PRJ-1 to PRJ-18, FLT-1, FLT-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import blank_to_null, first_filled, normalize_ws, once, strip


def nested(raw: Column, path: str, kind: str = "string") -> Column:
    """PRJ-1: a value of a VARIANT by path, null if a step is missing or no object."""
    return F.try_variant_get(raw, f"$.{path}", kind)


def searched(raw: Column, name: str, places: tuple[str, ...] = ("", "orig.", "meta.", "meta.orig.")) -> Column:
    """The first filled value of a field among the places of a record."""
    return first_filled(*[nested(raw, p + name) for p in places])


def looks_step_by_step(c: Column) -> Column:
    return c.contains("<<") | (F.size(F.split(strip(c), "\n")) >= 2)


def detected_fields(raw: Column) -> Column:
    """PRJ-3, PRJ-4: struct(question, solution, final, subject, level); answers fill the solution or the final, in order."""
    question, solution, final = searched(raw, "question"), searched(raw, "solution"), first_filled(searched(raw, "final_answer"), searched(raw, "final_ans"))
    question = first_filled(question, searched(raw, "problem"))

    def filled(s: Column, a: Column) -> Column:
        fills = s["solution"].isNull() & looks_step_by_step(a)
        short = ~fills & s["final"].isNull() & ~a.contains("\n") & (F.length(a) <= 64)
        mined = blank_to_null(strip(F.regexp_extract(a, r"####\s*([^\n]+)", 1)))
        return F.struct(F.when(fills, a).otherwise(s["solution"]).alias("solution"), F.when(fills & s["final"].isNull(), mined).when(short, strip(a)).otherwise(s["final"]).alias("final"))

    answers = F.array(*[blank_to_null(nested(raw, place + "answer")) for place in ("", "orig.", "meta.", "meta.orig.")])
    found = F.aggregate(answers, F.struct(solution.alias("solution"), final.alias("final")), filled)
    unique = F.regexp_replace(F.split_part(searched(raw, "unique_id"), F.lit("/"), F.lit(2)), "_", " ")
    subject = first_filled(searched(raw, "subject"), F.concat(F.upper(F.substring(unique, 1, 1)), F.substring(unique, F.lit(2), F.length(unique))))
    level = first_filled(searched(raw, "level"), searched(raw, "difficulty"))
    return once(found, lambda x: F.struct(normalize_ws(question).alias("question"), x["solution"].alias("solution"), x["final"].alias("final"), subject.alias("subject"), level.alias("level")))


def inferred_dataset(record_id: Column, hub_name: Column) -> Column:
    """PRJ-5: gsm8k before math before multiarith."""
    i, h = F.coalesce(record_id, F.lit("")), F.coalesce(hub_name, F.lit(""))
    low = F.lower(i)
    return F.when(low.startswith("gsm8k_") | (F.lower(h) == "gsm8k"), "gsm8k").when(i.startswith("MATH_") | F.lower(h).contains("math"), "math").when(low.startswith("multiarith_") | F.lower(h).contains("multiarith"), "multiarith")


def clean_final(c: Column) -> Column:
    """PRJ-7: unwraps \\boxed{..} around the whole and strips dollar signs; applied twice."""
    for _ in range(2):
        boxed = F.regexp_extract(strip(c), r"^\\boxed\{(.*)\}$", 1)
        c = strip(F.regexp_replace(F.when(boxed != "", boxed).otherwise(strip(c)), r"^\$+|\$+$", ""))
    return c


def gold_answer(answer: Column) -> Column:
    """PRJ-7: struct(gold, rationale) of an answer text, cut at the last ####."""
    cut = answer.contains("####")
    gold = F.when(cut, strip(F.regexp_extract(answer, r"(?s)^.*####\s*([^\n]*)", 1))).otherwise(answer)
    rationale = F.when(cut, blank_to_null(strip(F.regexp_extract(answer, "(?s)^(.*)####", 1))))
    return F.struct(clean_final(gold).alias("gold"), rationale.alias("rationale"))


def unified(df: DataFrame, raw: str, split: str) -> DataFrame:
    """PRJ-6, PRJ-8, PRJ-9: id, dataset, split, question, gold_answer, subject, level, rationale_gold and `fits`."""
    v = F.col(raw)
    answer = first_filled(nested(v, "answer"), nested(v, "orig.answer"), nested(v, "meta.orig.answer"), nested(v, "orig.final_ans"))
    x = df.withColumn("_g", gold_answer(answer)).withColumn("question", first_filled(nested(v, "question"), nested(v, "meta.orig.problem"), nested(v, "meta.orig.question")))
    subject, level = (first_filled(nested(v, f"orig.{n}"), nested(v, f"meta.{n}"), nested(v, n)) for n in ("subject", "level"))
    x = x.select(*df.columns, nested(v, "id").alias("id"), inferred_dataset(nested(v, "id"), nested(v, "meta.hf_name")).alias("dataset"), F.lit(split).alias("split"), "question", F.col("_g.gold").alias("gold_answer"), subject.alias("subject"), level.alias("level"), F.col("_g.rationale").alias("rationale_gold"))
    return x.withColumn("fits", F.col("dataset").isNotNull() & F.col("question").isNotNull() & F.col("gold_answer").isNotNull())


def picked_field(named: list[Column], strings: list[Column]) -> Column:
    """PRJ-10: the first value of the named ones, else the first string with a question mark, else empty."""
    asking = F.filter(F.array(*strings), lambda s: F.contains(s, F.lit("?")))
    return F.coalesce(*named, F.try_element_at(asking, F.lit(1)), F.lit(""))


def enveloped(df: DataFrame, key: str, position: str, question: Column, answer: Column) -> DataFrame:
    """PRJ-11: id, question, answer and the whole record."""
    return df.select(F.concat(F.lit(f"{key}_"), F.col(position).cast("string")).alias("id"), question.alias("question"), answer.alias("answer"), F.to_json(F.struct(*df.columns)).alias("orig"))


#: The keys that a row keeps as its source, and those that tell where it comes from.
SOURCE_KEYS = ["id", "dataset", "split", "input_question", "plan", "reasoner_output", "final_answer", "rationale_gold", "subject", "level"]
ORIGIN_KEYS = ["unique_id", "hf_name", "hf_config", "original_index"]


def part(raw: Column, path: str) -> Column:
    """A part of a VARIANT as JSON, null if it isn't there; a JSON null is `null`."""
    return F.to_json(F.try_variant_get(raw, f"$.{path}", "variant"))


def object_of(members: list[tuple[str, Column]]) -> Column:
    """A JSON object of the members (name, JSON) that aren't null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), c) for name, c in members]), F.lit("}"))


def slim_provenance(raw: Column) -> Column:
    """PRJ-12: struct(id, hf_name, hf_config, original_index, unique_id); what is missing is empty, an index null."""
    own = lambda path: F.coalesce(nested(raw, path), F.lit(""))
    found = first_filled(nested(raw, "id"), nested(raw, "idx"), nested(raw, "meta.orig.unique_id"), F.lit(""))
    return F.struct(F.coalesce(found, F.lit("")).alias("id"), own("meta.hf_name").alias("hf_name"), own("meta.hf_config").alias("hf_config"), nested(raw, "meta.original_index", "long").alias("original_index"), own("meta.orig.unique_id").alias("unique_id"))


def kept_source(raw: Column) -> Column:
    """PRJ-13: those of the ten kept keys that a record has, as JSON; a null stays one."""
    return object_of([(k, part(raw, k)) for k in SOURCE_KEYS])


def origin(raw: Column) -> Column:
    """PRJ-14: the id, and in `prov` what is known of the origin, as JSON; an origin of which nothing is known is left out.

    The origin lies in the source (else the meta) of the record, there under source, else orig, else at its top.
    """
    empty = ["null", "{}", "[]", '""', "0", "false"]
    at = lambda place: F.coalesce(~part(raw, place).isin(*empty), F.lit(False))
    known = lambda place, k: F.nullif(part(raw, f"{place}.{k}"), F.lit("null"))

    def members(carrier: str) -> Column:
        places = [f"{carrier}.source", f"{carrier}.orig"]
        of = lambda place: object_of([(k, known(place, k)) for k in ORIGIN_KEYS])
        return F.when(at(places[0]), of(places[0])).when(at(places[1]), of(places[1])).otherwise(of(carrier))

    prov = F.when(at("source"), members("source")).when(at("meta"), members("meta"))
    return object_of([("id", F.coalesce(part(raw, "id"), F.lit("null"))), ("prov", F.nullif(prov, F.lit("{}")))])


def provenance(raw: Column, mode: str = "minimal", minimal=origin) -> Column:
    """PRJ-15: the meta of a row as JSON: nothing, the whole record, or its source as `minimal` has it (PRJ-13, PRJ-14)."""
    if mode == "none":
        return F.lit("{}")
    return object_of([("source", F.to_json(raw) if mode == "raw" else minimal(raw))])


def with_fallback(raw: Column, name: str) -> Column:
    """PRJ-16: a field or the first filled one of the places where provenance keeps it, else unknown."""
    return F.coalesce(searched(raw, name, ("", "meta.", "meta.source.", "meta.source_reasoner.", "meta.source_verifier.", "meta.prov.")), F.lit("unknown"))


def stratum(raw: Column, names: list[str]) -> Column:
    """PRJ-17: a text of the fields, __NA__ for missing ones, __ALL__ without fields."""
    return F.concat_ws("|", *[F.coalesce(nested(raw, n), F.lit("__NA__")) for n in names]) if names else F.lit("__ALL__")


def row_id(raw: Column, dataset: str, split: str, position: Column) -> Column:
    """PRJ-18: id, else idx, else a numbered name."""
    return F.coalesce(first_filled(nested(raw, "id"), nested(raw, "idx")), F.concat(F.lit(f"{dataset}_{split}_"), (position + 1).cast("string")))


def members(df: DataFrame, **allowed: list[str] | None) -> DataFrame:
    """FLT-1, FLT-4: rows whose columns are in the given lists; an empty list is no filter."""
    for name, values in allowed.items():
        if values:
            df = df.where(F.col(name).isin(*values))
    return df


def parse_list(text: str | None) -> list[str] | None:
    """FLT-2: a,b,c."""
    found = [x.strip() for x in (text or "").split(",") if x.strip()]
    return found or None


def parse_caps(text: str | None, sign: str = "=") -> dict[str, int]:
    """FLT-2: k=v,k=v; parts that don't parse are skipped."""
    pairs = (x.partition(sign) for x in parse_list(text) or [])
    return {k.strip(): int(v) for k, _, v in pairs if k.strip() and v.strip().lstrip("-").isdigit()}


def parse_pair_caps(text: str | None) -> dict[tuple[str, str], int]:
    """FLT-2: dataset:role=v."""
    return {(d.strip(), r.strip()): n for k, n in parse_caps(text).items() for d, _, r in [k.partition(":")] if d and r}
