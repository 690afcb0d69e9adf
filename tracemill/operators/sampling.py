"""Limits, splits, caps and stratified samples (SMP-1 to SMP-11): order by hash, so reruns agree.

Groups are strata or (dataset, role) pairs. Where a cap makes most rows superfluous, ranks come from a window, and Spark's
window group limit keeps only the first of each task before the shuffle; other ranks are counted by `drawn_ranks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int, *ids: str) -> Column:
    """A pseudorandom string for each row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def share_key(seed: int, *ids: str) -> Column:
    """A pseudorandom number from 0 to 1."""
    return F.conv(F.substring(draw_key(seed, *ids), 1, 15), 16, 10).cast("double") / F.lit(float(16**15))


def first_rows(df: DataFrame, n: int | None, position: str) -> DataFrame:
    """SMP-1: rows at places below n; all, if n is None or negative."""
    return df if n is None or n < 0 else df.where(F.col(position) < n)


def drawn_ranks(df: DataFrame, group: list[str], seed: int, key: str) -> DataFrame:
    """Adds _r, the place from 1 in drawn order within a group, and _n, the size of the group.

    A group is cut by the first three digits of the draw key, so that no group is a single task; only the counts of these
    cuts, at most 4096 of a group, meet in a window. Null groups are groups.
    """
    x = df.withColumn("_k", draw_key(seed, key)).withColumn("_cut", F.substring("_k", 1, 3))
    names = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    counts = x.groupBy(*names, F.col("_cut").alias("_c")).agg(F.count("*").alias("_rows"))
    own = Window.partitionBy(*[f"_g{i}" for i in range(len(group))])
    before = F.sum("_rows").over(own.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_n": F.sum("_rows").over(own)}).drop("_rows")
    on = F.col("_cut") == F.col("_c")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    place = F.row_number().over(Window.partitionBy(*group, "_cut").orderBy("_k", key))
    return x.withColumn("_own", place).join(counts, on).withColumn("_r", F.col("_before") + F.col("_own")).drop("_k", "_cut", "_c", "_own", "_before", *[f"_g{i}" for i in range(len(group))])


def train_val_split(df: DataFrame, ratio: float, seed: int, key: str, group: list[str] = ()) -> DataFrame:
    """SMP-2: the first floor(n * ratio) of a group in drawn order are `val`, the rest `train`."""
    ranked = drawn_ranks(df, list(group), seed, key)
    return ranked.withColumn("split", F.when(F.col("_r") <= F.floor(F.col("_n") * ratio), "val").otherwise("train")).drop("_n", "_r")


def capped(df: DataFrame, group: list[str], cap: int | Column, seed: int, key: str) -> DataFrame:
    """SMP-3, SMP-7: at most `cap` rows of each group, in drawn order; all, if it is null or not above 0.

    A cap in a column is one for its whole group. Then rows are counted by the first digits of their draw key; a group keeps
    all cells below the one in which its cap is reached, and only that cell's rows are ranked.
    """
    if isinstance(cap, int):
        if cap <= 0:
            return df
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(draw_key(seed, key), key)))
        return ranked.where(F.col("_r") <= cap).drop("_r")
    x = df.withColumns({"_k": draw_key(seed, key), "_cap": cap}).withColumn("_cell", F.substring("_k", 1, 3))
    names = [f"_g{i}" for i in range(len(group))]
    cells = x.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("_cell").alias("_c")).agg(F.count("*").alias("_n"), F.max("_cap").alias("_most")).where("_most > 0")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*names).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", before).where("_before < _most")
    edges = cells.groupBy(*names).agg(F.max(F.struct("_c", (F.col("_most") - F.col("_before")).alias("left"))).alias("_edge"))
    same = F.lit(True)
    for g, n in zip(group, names, strict=True):
        same = same & x[g].eqNullSafe(edges[n])
    near = x.join(edges, same, "left").where(F.col("_edge").isNull() | (F.col("_cell") <= F.col("_edge._c")))
    at_edge = F.coalesce(F.col("_cell") == F.col("_edge._c"), F.lit(False))
    # Rows that stay in any case are partitions of their own, so no group meets in a task.
    place = F.row_number().over(Window.partitionBy(*group, "_cell", F.when(~at_edge, F.col("_k"))).orderBy("_k", key))
    return near.withColumn("_r", place).where(~at_edge | (F.col("_r") <= F.col("_edge.left"))).select(*df.columns)


def capped_by(df: DataFrame, role_caps: dict[str, int], pair_caps: dict[tuple[str, str], int], seed: int, key: str, dataset: str = "dataset", role: str = "role") -> DataFrame:
    """SMP-8: caps per role, overridden by caps per (dataset, role)."""
    chosen = F.lit(None).cast("int")
    for r, n in role_caps.items():
        chosen = F.when(F.col(role) == r, n).otherwise(chosen)
    for (d, r), n in pair_caps.items():
        chosen = F.when((F.col(dataset) == d) & (F.col(role) == r), n).otherwise(chosen)
    return capped(df, [dataset, role], chosen, seed, key)


def balanced(df: DataFrame, cap: int, share: float, positive: Column, seed: int, key: str) -> DataFrame:
    """SMP-4: cap rows of which half-even round(cap * share) are positive; whichever kind lacks rows is topped up from the other."""
    want = int(round(cap * min(1.0, max(0.0, share))))
    kind = F.coalesce(positive, F.lit(False))
    first = Window.partitionBy("_k").orderBy(draw_key(seed, key), key)
    x = df.withColumn("_k", kind).withColumn("_r", F.row_number().over(first))
    x = x.withColumn("_first", F.when(F.col("_k"), F.col("_r") <= want).otherwise(F.col("_r") <= cap - want))
    # No row beyond the cap of its kind can be chosen, so few rows meet in the last ranking.
    x = x.where(F.col("_r") <= cap)
    x = x.withColumn("_o", F.row_number().over(Window.orderBy(F.desc("_first"), draw_key(seed + 1, key), key)))
    return x.where(F.col("_o") <= cap).drop("_k", "_r", "_first", "_o")


def round_robin(df: DataFrame, strata: list[str], k: int, seed: int, key: str) -> DataFrame:
    """SMP-5: one row of each stratum per round, strata in order, until there are k."""
    x = df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(draw_key(seed, key), key))).where(F.col("_r") <= k)
    return x.orderBy("_r", *strata).limit(k).drop("_r")


def largest_remainder(df: DataFrame, stratum: str, k: int, seed: int, key: str) -> DataFrame:
    """SMP-6: quotas in proportion to the strata, remainders to the largest, ties to the larger name; then a draw within each."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    x = counts.withColumn("_t", total).withColumn("_q", F.expr(f"n * {k} div _t")).withColumn("_rest", F.expr(f"n * {k} % _t"))
    left = F.lit(k) - F.sum("_q").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc(stratum)))
    quota = x.withColumn("_left", left).withColumn("_o", order).select(F.col(stratum).alias("_s"), F.when(F.col("_t") <= k, F.col("n")).otherwise(F.col("_q") + F.when(F.col("_o") <= F.col("_left"), 1).otherwise(0)).alias("_quota"))
    ranked = drawn_ranks(df, [stratum], seed, key).drop("_n")
    return ranked.join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("_r") <= F.col("_quota")).drop("_s", "_quota", "_r")


def weighted_rows(df: DataFrame, weights: dict[str, int], role: str = "role") -> DataFrame:
    """SMP-9: rows repeated by the weight of their role; once without one."""
    times = F.lit(1)
    for r, n in weights.items():
        times = F.when(F.col(role) == r, max(1, n)).otherwise(times)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def eval_carve_out(df: DataFrame, ratio: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """SMP-10: (train, eval): max(1, floor(n * ratio)) rows in drawn order are held out, before any weighting, so that no
    row is in both. Where that would be all rows, all are trained on and one is evaluated as well."""
    x = drawn_ranks(df, [], seed, key).withColumn("_e", F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)))
    held = F.when(F.col("_e") < F.col("_n"), F.col("_r") > F.col("_n") - F.col("_e"))
    train, evaluated = x.where(~F.coalesce(held, F.lit(False))), x.where(F.coalesce(held, F.col("_r") == 1))
    return train.drop("_r", "_n", "_e"), evaluated.drop("_r", "_n", "_e")
