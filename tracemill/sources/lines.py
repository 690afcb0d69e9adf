"""Scans of JSON lines that know where each line stands (SRC-3, SRC-4, SRC-6, PRJ-11, PRJ-18).

Text is read and parsed once: a scan is a written table of records, rejects and blank lines, each with its argument, file,
block and place, so later steps neither parse again nor depend on how a second scan would be cut into tasks. Line numbers and
running positions are sums of counts per block, file and argument, never a window over all lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.scratch import scratch

#: Where a line stands: argument, file, start of its block, and a number that grows within the block.
PLACE = ["_arg", "_file", "_block", "_at"]
BLOCK = PLACE[:3]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    each = [spark.read.text(p).select("value", F.lit(i).alias("_arg"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")) for i, p in enumerate(paths)]
    return reduce(DataFrame.union, each).withColumn("_at", F.monotonically_increasing_id())


def as_rows(schema: T.StructType) -> Callable[[Column], Column]:
    """A parser to rows of a schema, null for what is no such JSON."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])

    def parse(value: Column) -> Column:
        found = F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        kept = F.struct(*[found[f.name].alias(f.name) for f in schema.fields])
        return F.when(found.isNotNull() & found["_corrupt_record"].isNull(), kept)

    return parse


def as_variant(value: Column) -> Column:
    """A parser to records of any form: the text itself where it is JSON."""
    return F.when(F.try_parse_json(value).isNotNull(), value)


@dataclass
class Scan:
    """table: `record` (null for rejects and blank lines), `value` (the text of rejects) and PLACE; counts of kept, rejected
    and blank lines, gathered while the table was written."""

    table: DataFrame
    counts: dict[str, int]

    def records(self) -> DataFrame:
        """`record` and PLACE of the lines that parsed."""
        return self.table.where("record IS NOT NULL").select("record", *PLACE)

    def rejects(self) -> DataFrame:
        """SRC-4: text, file and line number, from 1 with blank lines counted, of the lines that didn't."""
        bad = self.table.where("record IS NULL AND value IS NOT NULL")
        blocks = self.table.groupBy(*BLOCK).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_arg", "_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
        # Within a block lines are numbered without gaps.
        return bad.join(blocks, BLOCK).select("value", F.col("_file").alias("file"), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"))


def scan(spark: SparkSession, paths: str | list[str], parse: Callable[[Column], Column]) -> Scan:
    """Reads the files of all arguments once. A parser gives null for what it rejects; blank lines are neither."""
    lines = _lines(spark, [paths] if isinstance(paths, str) else paths)
    blank = F.trim(F.regexp_replace("value", r"[\t\r\x0b\x0c]", " ")) == ""
    found = lines.withColumn("record", F.when(~blank, parse(F.col("value"))))
    found = found.withColumn("value", F.when(F.col("record").isNull() & ~blank, F.col("value")))
    seen, path = Observation(), scratch(spark, "lines")
    n = F.count_if
    counted = found.observe(seen, n(F.col("record").isNotNull()).alias("kept"), n(F.col("value").isNotNull()).alias("rejected"), n(F.col("record").isNull() & F.col("value").isNull()).alias("blank"))
    counted.write.parquet(path)
    return Scan(spark.read.schema(found.schema).parquet(path), dict(seen.get))


def positioned(rows: DataFrame, out: str = "position") -> DataFrame:
    """PRJ-11, PRJ-18, SRC-11: adds the place of each row, from 0 without gaps, among all rows: arguments in their order, the
    files of one by name, lines as they stand. Rows (with PLACE) are ranked within their blocks only; blocks, files and
    arguments add what comes before."""
    before = lambda *group: Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda df, by, n, of: df.groupBy(*by).agg(F.sum(of).alias(n))
    blocks = rows.groupBy(*BLOCK).agg(F.count("*").alias("_n"))
    files, args = total(blocks, ["_arg", "_file"], "_nf", "_n"), total(blocks, ["_arg"], "_na", "_n")
    blocks = blocks.withColumn("_b", F.sum("_n").over(before("_arg", "_file").orderBy("_block")))
    files = files.withColumn("_f", F.sum("_nf").over(before("_arg").orderBy("_file")))
    # One row per argument.
    args = args.withColumn("_a", F.sum("_na").over(before().orderBy("_arg")))
    starts = blocks.join(files, ["_arg", "_file"]).join(F.broadcast(args), "_arg")
    first = reduce(Column.__add__, [F.coalesce(c, F.lit(0)) for c in ("_a", "_f", "_b")])
    own = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("_at")) - 1
    ranked = rows.withColumn("_own", own)
    return ranked.join(starts.select(*BLOCK, first.alias("_first")), BLOCK).withColumn(out, (F.col("_first") + F.col("_own")).cast("long")).drop("_own", "_first")
