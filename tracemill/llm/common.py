"""What the operators share: scratch tables, bounded broadcasts, prefix sums and word expressions."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames of at most this many rows may be broadcast after a count.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tracemill-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows (counted), else df for a shuffled join.

    Rows with arrays count by `weight`, the number of their elements.
    """
    if weight is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    return F.broadcast(df) if (df.agg(F.sum(weight + 1)).first()[0] or 0) <= most else df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the Python worker gives back what it freed: workers idle on beside the JVM, in the same container."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: 64-bit words of the largest sieve (8 MB).
SIEVE_WORDS = 1 << 20


def sieve(wanted: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that all keys of `wanted` pass and about one in sixty others: a bitmap of bounded size with two bits a key.

    Beyond the bound more others pass, so an exact join has to follow in any case.
    """
    words = min(SIEVE_WORDS, 1 << max(4, (wanted.count() // 4).bit_length()))
    cells = lambda c: [F.pmod(F.xxhash64(F.lit(i), c), F.lit(words * 64)) for i in range(2)]
    bit = lambda cell: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int"))
    place = lambda cell: F.shiftright(cell, 6).cast("int")
    packed = wanted.select(F.explode(F.array(*cells(F.col(key)))).alias("cell")).groupBy(place(F.col("cell")).alias("i")).agg(F.bit_or(bit(F.col("cell"))).alias("b"))
    whole = wanted.sparkSession.range(words).join(packed, F.col("id") == F.col("i"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    map_of = written(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("map")), "sieve").scalar()

    def passes(c: Column) -> Column:
        first, second = (F.get(map_of, place(x)).bitwiseAND(bit(x)) != 0 for x in cells(c))
        return first & second

    return passes


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small local relation of numbers; columns is a DDL string."""
    names = [c.split()[0] for c in columns.split(",")]
    kinds = [c.split()[1] for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(f"CAST({'NULL' if v is None else v} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS v({', '.join(names)})")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty. lower() is faster, and the same for ASCII texts."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of a separator class, as an array without empty strings."""
    parts = F.split(text, f"[{separators}]+")
    # Only the first and the last part can be empty.
    begin = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.when((F.size(parts) >= begin) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, begin, F.greatest(F.size(parts) - last - begin + 1, F.lit(0)))


def prefix_index(df: DataFrame, group: list[str], by: str, order: list[str], weight: str | None, out: str, buckets: int, bucket: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `weight` (rows, if None) over the rows of the group before this one, gapless and in parallel.

    Rows of a group are ordered by (`bucket`, a number from 0 to buckets - 1, or else the hash bucket of `by`, order). A group is dealt over `buckets` tasks, so a group that
    holds a third of all rows is no single task; only (group, bucket) totals meet in the window over buckets.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    df = df.withColumn("_bucket", (F.pmod(F.xxhash64(by), F.lit(buckets)) if bucket is None else bucket).cast("int"))
    totals = df.groupBy(*group, "_bucket").agg(F.sum(w).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_own", F.coalesce(F.sum(w).over(within), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket") == F.col("_b")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return own.join(totals, on).withColumn(out, (F.col("_before") + F.col("_own")).cast("long")).drop("_b", "_before", "_own", "_bucket", *[f"_g{i}" for i in range(len(group))])
