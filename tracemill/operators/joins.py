"""Keyed joins of role tables (JOIN-1 to JOIN-8) and set operations (SET-1 to SET-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import DEFAULT_PLAN, first_filled


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """JOIN-6: of rows with one key the last; null and empty keys go. A maximum per key, so it aggregates map-side."""
    columns = [c for c in df.columns if c != key]
    kept = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return kept.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(position)).alias("_row")).select(key, "_row.*")


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JOIN-3, SET-4: rows whose key isn't in the output yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def with_plan(raw: DataFrame, plans: DataFrame, key: str = "id", plan: str = "plan", position: str = "pos") -> DataFrame:
    """JOIN-1: each row's plan, the default one where there is none."""
    return raw.join(last_wins(plans, key, position).select(key, plan), key, "left").withColumn(plan, first_filled(F.col(plan), F.lit(DEFAULT_PLAN)))


def with_companions(spine: DataFrame, companions: dict[str, DataFrame], key: str = "id", position: str = "pos") -> DataFrame:
    """JOIN-2, JOIN-4, JOIN-5: the spine with each companion's row as a struct of its name, null where there is none."""
    for name, df in companions.items():
        row = last_wins(df, key, position)
        spine = spine.join(row.select(key, F.struct(*[c for c in row.columns if c not in (key, position)]).alias(name)), key, "left")
    return spine


def union_roles(df: DataFrame, roles: dict[str, dict[str, Column]], keep: list[str]) -> DataFrame:
    """SET-1: one row per role in a single pass; a role whose `when` is false or whose payload is blank gives none (FLT-3)."""
    items = []
    for name, parts in roles.items():
        row = F.struct(F.lit(name).alias("role"), parts["prompt"].alias("prompt"), parts["response"].alias("response"))
        items.append(F.when(parts.get("when", F.lit(True)) & (F.trim(F.coalesce(parts["response"], F.lit(""))) != ""), row))
    return df.select(*keep, F.explode(F.array_compact(F.array(*items))).alias("_r")).select(*keep, "_r.*")


def distinct_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """SET-2: of rows that are equal in the keys, the first."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(position)).alias("_row")).select(*keys, "_row.*")


def concat(frames: list[DataFrame]) -> DataFrame:
    """SET-3: all rows of all frames, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def kept_and_rejected(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """SET-5: rows that pass and the others; a null test rejects."""
    ok = F.coalesce(keep, F.lit(False))
    return df.where(ok), df.where(~ok)


def _comparable(df: DataFrame, name: str) -> Column:
    """A column by which values can be hashed and compared; maps and variants as JSON. -0.0 is 0.0."""
    kind = df.schema[name].dataType.simpleString()
    if "map<" in kind or "variant" in kind:
        return F.to_json(F.struct(F.col(name)))
    return F.col(name) + F.lit(0.0) if kind in ("float", "double") else F.col(name)


def not_chosen(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """JOIN-7: the rows of the pool that equal no chosen one in all columns of the pool; nulls are equal. A row that repeats
    a chosen one goes with it. Rows meet by a hash of their content and are compared in full then."""
    columns = pool.columns
    mine = [_comparable(pool, c).alias(f"_p{i}") for i, c in enumerate(columns)]
    theirs = [_comparable(chosen, c).alias(f"_c{i}") for i, c in enumerate(columns)]
    taken = chosen.select(*theirs).distinct()
    taken = taken.withColumn("_ch", F.xxhash64(*taken.columns))
    x = pool.select("*", *mine).withColumn("_ph", F.xxhash64(*[f"_p{i}" for i in range(len(columns))]))
    same = F.col("_ph") == F.col("_ch")
    for i in range(len(columns)):
        same = same & F.col(f"_p{i}").eqNullSafe(F.col(f"_c{i}"))
    return x.join(taken, same, "left_anti").select(*columns)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Explicit positions from 0 in groups."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
