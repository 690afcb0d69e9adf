"""Evaluation metrics (AGG-1 to AGG-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), digits)


def confusion(expected: Column, said: Column) -> list[Column]:
    """AGG-5: tp, tn, fp, fn of CORRECT verdicts; verdicts that can't be parsed count in none."""
    yes, no = said == "CORRECT", said == "INCORRECT"
    return [F.count_if(expected & yes).alias("tp"), F.count_if(~expected & no).alias("tn"), F.count_if(~expected & yes).alias("fp"), F.count_if(expected & no).alias("fn"), F.count("*").alias("verifier_total")]


def summary(df: DataFrame) -> DataFrame:
    """AGG-6: accuracy, precision, recall and f1 of confusion counts."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    return df.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)})


def by_grouping_sets(df: DataFrame, dataset: str, subject: str, aggregates: list[Column]) -> DataFrame:
    """AGG-3, AGG-4: overall, by dataset and by subject in one pass; blank subjects are no group of their own."""
    x = df.withColumn("_s", F.nullif(F.trim(F.col(subject)), F.lit("")))
    sets = x.groupingSets([[], [dataset], ["_s"]], dataset, "_s").agg(F.grouping_id().alias("_g"), *aggregates)
    level = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "dataset").otherwise("subject")
    named = sets.withColumn("level", level).where((F.col("level") != "subject") | F.col("_s").isNotNull())
    value = F.when(F.col("level") == "dataset", F.col(dataset)).when(F.col("level") == "subject", F.col("_s"))
    return named.withColumn("value", value).drop("_g", "_s", dataset)


def chain_histogram(df: DataFrame, group: list[str], calls: str, halt: str) -> DataFrame:
    """AGG-7: rows per chain `a,b;halt=x`; a missing halt shows as None."""
    chain = F.concat(F.array_join(calls, ","), F.lit(";halt="), F.coalesce(F.col(halt), F.lit("None")))
    return df.groupBy(*group, chain.alias("chain")).agg(F.count("*").alias("n"))


def chain_map(histogram: DataFrame, group: list[str]) -> DataFrame:
    """The histogram as one map per group; there are few chains."""
    return histogram.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chain", "n")))).alias("chains"))


def changed_counts(df: DataFrame, group: list[str], old: str, new: str) -> DataFrame:
    """AGG-9: rows that a repair changed."""
    return df.groupBy(*group).agg(F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed"), F.count("*").alias("total"))


def kept_counts(df: DataFrame, dataset: str, kept: Column) -> DataFrame:
    """AGG-1: rows in, kept and rejected of each dataset."""
    return df.groupBy(dataset).agg(F.count("*").alias("n_in"), F.count_if(kept).alias("n_kept"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("n_rejected"))


def count_report(df: DataFrame, fields: list[str], missing: str = "unknown") -> DataFrame:
    """AGG-2: rows by the strata of some fields, in their order; null fields are named `missing`."""
    strata = [F.coalesce(F.col(f).cast("string"), F.lit(missing)).alias(f) for f in fields]
    return df.groupBy(*strata).agg(F.count("*").alias("n")).orderBy(*fields)


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    """AGG-11."""
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))
