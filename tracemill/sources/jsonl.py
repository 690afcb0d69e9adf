"""JSON-lines sources and sinks (SRC-1 to SRC-12, SNK-1 to SNK-6). Paths are only ever opened by Spark."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources.ledger import exists
from tracemill.sources.lines import as_rows, as_variant, positioned, scan

#: Source keys and their (name, configuration) candidates in the order in which they are tried; all are local paths here.
CATALOG = {
    "gsm8k": [("gsm8k", "main"), ("gsm8k", "socratic")],
    "asdiv": [("EleutherAI/asdiv", None), ("asdiv", None)],
    "multiarith": [("ChilleD/MultiArith", None)],
    "addsub": [("allenai/lila", "addsub")],
    "MATH": [("nlile/hendrycks-MATH-benchmark", None), ("MATH", None)],
    "MathBench": [("opencompass/MathBench", None)],
    "Omni-MATH": [("KbsdJames/Omni-MATH", None)],
}


def read_strict(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """SRC-1: any malformed line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_strictest(spark: SparkSession, path: str | list[str], schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """SRC-2: a blank line fails the read as well, and so does a record that lacks a required key, unless its value is null."""
    value = F.col("value")
    there = F.json_object_keys(value)
    bad = F.when(F.trim(value) == "", "blank line")
    for k in required:
        bad = F.coalesce(bad, F.when(~F.coalesce(F.array_contains(there, k), F.lit(False)), f"no key {k}"))
    checked = F.coalesce(F.when(bad.isNotNull(), F.raise_error(bad).cast("string")), value)
    rows = spark.read.text(path).select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("_j"))
    return rows.select("_j.*")


def read_permissive(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SRC-3, SRC-4: (good rows, rejects with text, file and line number). Blank lines are neither."""
    found = scan(spark, path, as_rows(schema))
    return found.records().select("record.*"), found.rejects()


def read_silent(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """SRC-5: malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_variant(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-6: (records as VARIANT with their text and position, rejects with text, file and line). Positions run over all
    files, arguments in their order."""
    found = scan(spark, path, as_variant)
    return positioned(found.records()).select(F.col("record").alias("value"), F.parse_json("record").alias("raw"), "position"), found.rejects()


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: by ending; an unknown one is JSON."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith(".tsv"):
        return spark.read.option("header", True).option("sep", "\t").csv(path)
    return spark.read.json(path)


def read_catalog(spark: SparkSession, root: str, key: str, split: str) -> DataFrame:
    """SRC-8, SRC-9: the first candidate that can be read."""
    places = [f"{root}/{repo}{'/' + config if config else ''}/{split}.jsonl" for repo, config in CATALOG[key]]
    return spark.read.json(first_existing(spark, [*places, f"{root}/{key}/{split}.jsonl", f"{root}/{key}_{split}.jsonl"]))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """SRC-9: through Hadoop, so that any store will do."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-12: rows to be joined by key, with `pos`, their place; none, if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("pos", T.LongType())]))
    return positioned(scan(spark, path, as_rows(schema)).records(), "pos").select("record.*", "pos")


def read_tests(spark: SparkSession, schema: T.StructType, unified: str | None = None, root: str = "", datasets: tuple[str, ...] = (), splits: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """SRC-11: (rows, missing files): a unified file as it is; else the files root/dataset/split.jsonl that are there, whose
    rows lose their position in this order to a missing id: `dataset_split_position`, counted over all files."""
    if unified:
        return read_strict(spark, unified, schema), []
    wanted = [(d, s, f"{root}/{d}/{s}.jsonl") for d in datasets for s in splits]
    there = [w for w in wanted if exists(spark, w[2])]
    missing = [w[2] for w in wanted if w not in there]
    if not there:
        return spark.createDataFrame([], T.StructType([*[f for f in schema.fields if f.name not in ("dataset", "split")], T.StructField("dataset", T.StringType()), T.StructField("split", T.StringType())])), missing
    rows = positioned(scan(spark, [w[2] for w in there], as_rows(schema)).records())
    name = lambda i: F.element_at(F.array(*[F.lit(w[i]) for w in there]), F.col("_arg") + 1)
    own = [F.col(f"record.{f}").alias(f) for f in schema.fieldNames() if f not in ("dataset", "split")]
    x = rows.select(*own, name(0).alias("dataset"), name(1).alias("split"), "position")
    return x.withColumn("id", F.coalesce("id", F.concat_ws("_", "dataset", "split", F.col("position").cast("string")))).drop("position"), missing


def read_tree(spark: SparkSession, root: str, pattern: str = "*_reasoner.jsonl*") -> DataFrame:
    """SRC-10: all files below a root whose names fit."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK-1: overwritten; fields that are null are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """SNK-2: rows are appended whatever is there; ledger.append_new leaves out the keys that are."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_counted(df: DataFrame, path: str | None, **counts: Column) -> dict:
    """SNK-6, AGG-10: df is written as JSON lines, or nowhere if there is no path (a report); the counts, aggregates of its
    columns, are gathered in passing by the same job."""
    seen = Observation()
    x = df.observe(seen, *[c.alias(n) for n, c in counts.items()])
    write_jsonl(x, path) if path else x.write.format("noop").mode("overwrite").save()
    return dict(seen.get)


def replace_with_backup(df: DataFrame, path: str) -> None:
    """SNK-3: written beside, then renamed; the first original stays as .bak."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = f"{path}.new-{uuid.uuid4().hex}"
    write_jsonl(df, new)
    at, bak, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.bak", new))
    fs = at.getFileSystem(conf)
    if fs.exists(at):
        fs.delete(at, True) if fs.exists(bak) else fs.rename(at, bak)
    fs.rename(fresh, at)


def write_with_rejects(good: DataFrame, bad: DataFrame, path: str, keep_invalid: bool) -> None:
    """SNK-4."""
    write_jsonl(good, path)
    if keep_invalid:
        bad.write.mode("overwrite").text(f"{path}.rejects")


def write_evaluation(predictions: DataFrame, summary: DataFrame, path: str) -> None:
    """SNK-5: predictions as JSON lines, and the summary, of a few rows, as one indented JSON text in one file."""
    write_jsonl(predictions, f"{path}/predictions")
    rows = [json.loads(r) for r in summary.toJSON().collect()]
    at = summary.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/summary.json")
    out = at.getFileSystem(summary.sparkSession._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(rows, indent=2, ensure_ascii=False).encode()))
    out.close()
