"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Between
stages the rows are a Parquet table in the shared folder, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import few, read, written
from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.jaccard import jaccard_components
from tracemill.llm.mixing import mix, whole_documents
from tracemill.llm.queries import MIX_WEIGHTS, SHARD_DIMS, learnable
from tracemill.llm.sharding import shard_rows
from tracemill.llm.toxicity import score_toxicity


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose (id, text) isn't in gone (doc_id, h); null ids and null texts are compared as values."""
    gone = few(gone.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; what it learns from are the labels of documents that are there."""
    return without(docs, score_toxicity(docs, learnable(read(spark, sf_dir, "labels"), "toxic"), threshold=0.5).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays: the one with the smallest id, and of several rows with that id
    the one with the smallest text hash, once. Documents without words link with nothing and stay."""
    found = written(jaccard_components(docs, length=5, percent=80), "near-copies")
    return without_copies(docs, found)


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs less the rows that aren't the first of their component; found has doc_id, h, n_shingles and component."""
    linked = found.where("n_shingles > 0").withColumn("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    first = linked.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    several = first.where("rows > 1")
    gone = linked.join(few(several), "component").where("row <> first")
    left = without(docs, gone)
    # Rows that repeat both id and text of a first row can't be told apart: of these one stays.
    again = linked.join(few(several), "component").where("row = first").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h")
    again = written(again, "repeated-rows")
    if again.limit(1).count() == 0:
        return left
    once = again.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"))
    same = docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__h"))
    kept = docs.join(few(once), same).groupBy("__d", "__h").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return without(left, again).unionByName(kept)


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without(docs, decontaminate(docs, read(spark, sf_dir, "benchmark"), length=10).where("n_hit > 0"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated in whole as the mix has it: every one as often as its source gives whole passes, and once
    more those of the pass that ends at the target, so a source's words meet its target to within one document."""
    times = whole_documents(mix(docs, MIX_WEIGHTS, share=1.5, most=2.0)[0]).groupBy(F.col("doc_id").alias("__d"), F.col("_text").alias("__h")).agg(F.avg("times").alias("__n"))
    # Most documents are taken, so the join is shuffled at every size.
    repeated = docs.join(times.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__h")))
    # Rows that agree in id and text share what they are given, to the nearest whole number.
    return repeated.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round("__n").cast("int"))))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 24."""
    return shard_rows(docs, SHARD_DIMS, shards=24)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_contamination", benchmark_contamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Scores and draws aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
