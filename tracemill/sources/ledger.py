"""An append ledger of JSON lines, one row per key (SNK-2, STR-2).

Rows lie in `bucket=<hash of the key>/batch=<label>`. A batch reads the keys of its own buckets only, so with buckets in
proportion to the rows the reads of all batches together grow with what is appended. A batch is marked as begun before it
writes and as done after it: a batch that is done is not written again, rows of one that failed half way are not read and go
when it is run again.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.scratch import written

BUCKETS = 256


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at)


def _names(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _mark(spark: SparkSession, path: str, there: bool) -> None:
    at, fs = _hadoop(spark, path)
    fs.mkdirs(at) if there else fs.delete(at, True)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The rows of all batches that are done; only some buckets, if they are named."""
    wide = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())])
    paths = [path] if buckets is None else [p for b in buckets if exists(spark, p := f"{path}/bucket={b}")]
    if not paths or (buckets is None and not any(n.startswith("bucket=") for n in _names(spark, path))):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", path).schema(wide).json(paths)
    # Batches that are under way, or died; mostly none.
    open_ = _names(spark, f"{path}/_begun")
    return (rows.where(~F.col("batch").isin(open_)) if open_ else rows).select(*schema.fieldNames())


def _counted(seen: Observation) -> int:
    """0 if the side that was observed turned out to be empty and was left out of the plan while it ran."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


def append_batch(df: DataFrame, path: str, key: str, batch: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Appends the rows whose key isn't there yet, as the batch of that label: the numbers of keys read and rows written.

    Rows with a null key can't be known again; each is appended. All batches of a ledger need the same number of buckets.
    """
    spark = df.sparkSession
    if exists(spark, f"{path}/_done/{batch}"):
        return {"read": 0, "written": 0}
    at, fs = _hadoop(spark, f"{path}/bucket=*/batch={batch}")
    for left in fs.globStatus(at) or []:
        fs.delete(left.getPath(), True)
    _mark(spark, f"{path}/_begun/{batch}", True)
    rows = written(df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
    # At most as many numbers as there are buckets.
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    there = [b for b in touched if exists(spark, f"{path}/bucket={b}")]
    seen, stored, new = Observation(), Observation(), rows
    if there:
        keys = read_ledger(spark, path, T.StructType([df.schema[key]]), there).observe(seen, F.count("*").alias("n"))
        new = rows.join(keys, key, "left_anti")
    if touched:
        new = new.observe(stored, F.count("*").alias("n")).withColumn("batch", F.lit(batch))
        new.repartition("bucket").write.mode("append").partitionBy("bucket", "batch").option("ignoreNullFields", "false").json(path)
    _mark(spark, f"{path}/_done/{batch}", True)
    _mark(spark, f"{path}/_begun/{batch}", False)
    return {"read": _counted(seen) if there else 0, "written": _counted(stored) if touched else 0}


def append_new(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> dict[str, int]:
    """SNK-2: a batch without a name of its own: run again, it finds its keys there and adds nothing."""
    return append_batch(df, path, key, uuid.uuid4().hex, buckets)
