"""Queries of sources, sinks and the stream: tables written as text or JSON lines and read again."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators import fields, joins, metrics
from tracemill.plans.registered import query
from tracemill.scratch import scratch
from tracemill.session import table
from tracemill.sources import jsonl, ledger
from tracemill.sources.lines import as_rows, as_variant, positioned, scan
from tracemill.streaming.resume import ingest

#: Files that the orders' lines are dealt to.
FILES = 64
ORDER = T.StructType([T.StructField("k", T.LongType()), T.StructField("p", T.StringType())])


def order_lines(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Orders as JSON lines in order of their key, in 64 folders with a file each; every fifth is cut short, and every
    seventh of the others blank."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    text = F.to_json(F.struct("k", "p"))
    line = F.when(F.col("k") % 5 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).when(F.col("k") % 7 == 0, " ").otherwise(text)
    at = scratch(spark, name)
    folder = F.lpad(F.pmod("k", F.lit(FILES)).cast("string"), 2, "0")
    o.select(line.alias("value"), folder.alias("part"), "k").repartition(FILES, "part").sortWithinPartitions("part", "k").select("value", "part").write.partitionBy("part").text(at)
    return at


LINES = f"SELECT o_orderkey AS k, o_orderpriority AS p, lpad(CAST(o_orderkey % {FILES} AS VARCHAR), 2, '0') AS part, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' WHEN o_orderkey % 7 = 0 THEN 'blank' ELSE 'kept' END AS kind FROM orders"


@query(f"SELECT part, line, value FROM (SELECT part, kind, row_number() OVER (PARTITION BY part ORDER BY k) AS line, '{{\"k\":' || k || ',\"p\":\"' || p || '\"' AS value FROM ({LINES})) WHERE kind = 'bad'")
def q_reject_lines(spark, sf_dir):
    """SRC-3, SRC-4: rejects with their file and line number, blank lines counted."""
    bad = jsonl.read_permissive(spark, order_lines(spark, sf_dir, "rejects"), ORDER)[1]
    return bad.select(F.regexp_extract("file", r"part=(\d+)", 1).alias("part"), "line", "value")


@query(f"SELECT k, 'orders_' || (row_number() OVER (ORDER BY part < '30', part, k) - 1) AS id FROM ({LINES}) WHERE kind = 'kept'")
def q_running_ids(spark, sf_dir):
    """PRJ-11, PRJ-18, SRC-6: ids by position over all files, arguments in their order, later folders first."""
    at = order_lines(spark, sf_dir, "running")
    found = scan(spark, [f"{at}/part=[3-6]*", f"{at}/part=[0-2]*"], as_variant)
    x = positioned(found.records()).select(F.get_json_object("record", "$.k").cast("long").alias("k"), "position")
    ids = fields.enveloped(x, "orders", "position", F.lit(""), F.lit(""))
    return ids.select(F.get_json_object("orig", "$.k").cast("long").alias("k"), "id")


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE kind WHEN 'bad' THEN 'rejected' ELSE kind END AS kind FROM ({LINES})) GROUP BY kind UNION ALL SELECT 'status ' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
def q_counts_in_passing(spark, sf_dir):
    """AGG-1, AGG-10, SNK-6: counts that a scan and a report gather while they run, without a job of their own."""
    counts = scan(spark, order_lines(spark, sf_dir, "counted"), as_rows(ORDER)).counts
    o = table(spark, sf_dir, "orders")
    status = ["F", "O", "P"]
    report = jsonl.write_counted(o, None, **{f"status {s}": F.count_if(F.col("o_orderstatus") == s) for s in status})
    return spark.createDataFrame([(k, n) for k, n in {**counts, **report}.items() if n], "kind string, n long")


@query(f"SELECT k, p, 'silent' AS how FROM ({LINES}) WHERE kind = 'kept' UNION ALL SELECT k, p, 'tree' FROM ({LINES}) WHERE kind = 'kept' UNION ALL SELECT o_custkey, o_orderstatus, 'tsv' FROM orders UNION ALL SELECT o_custkey, o_orderstatus, 'strictest' FROM orders")
def q_readers(spark, sf_dir):
    """SRC-2, SRC-5, SRC-7, SRC-10: lines that don't parse left out; all files below a root; by ending; nothing missing."""
    at = order_lines(spark, sf_dir, "silent")
    silent = jsonl.read_silent(spark, at, ORDER).where("k IS NOT NULL")
    tree = scratch(spark, "tree")
    kept = silent.withColumn("part", F.pmod("k", F.lit(8)))
    kept.write.partitionBy("part").json(f"{tree}/below")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("p"))
    tsv, strict = f"{scratch(spark, 'ending')}/t.tsv", f"{scratch(spark, 'strict')}/s"
    rows.write.option("header", True).option("sep", "\t").csv(tsv)
    jsonl.write_jsonl(rows, strict)
    parts = {"silent": silent, "tree": jsonl.read_tree(spark, tree, "*.json"), "tsv": jsonl.read_any(spark, tsv), "strictest": jsonl.read_strictest(spark, strict, ORDER, ("k", "p"))}
    return joins.concat([df.select(F.col("k").cast("long").alias("k"), "p", F.lit(how).alias("how")) for how, df in parts.items()])


@query("SELECT o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, 'first' FROM orders")
def q_catalogue(spark, sf_dir):
    """SRC-8, SRC-9, SRC-11, SRC-12: the first place of a key that is there; files over datasets and splits, those that are
    missing left out; a missing file has no rows."""
    root = scratch(spark, "catalogue")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    for split, left in (("train", 0), ("val", 1)):
        jsonl.write_jsonl(o.where(F.col("k") % 2 == left), f"{root}/gsm8k/{split}.jsonl")
    jsonl.write_jsonl(o, f"{root}/gsm8k/socratic/train.jsonl")
    first = jsonl.read_catalog(spark, root, "gsm8k", "train").withColumn("split", F.lit("first"))
    ids = T.StructType([T.StructField("id", T.StringType()), *ORDER.fields])
    tests, missing = jsonl.read_tests(spark, ids, None, root, ("gsm8k", "math"), ("train", "val"))
    none = jsonl.read_keyed(spark, missing[0], ORDER).select("k", "p", F.lit("none").alias("split"))
    return joins.concat([df.select("k", "p", "split") for df in (first, tests, none)])


@query("SELECT item_id % 4 = 0 AS rejected, count(*) AS n FROM benchmark GROUP BY ALL")
def q_rejects(spark, sf_dir):
    """SRC-6, SET-5, SNK-4: lines that are no JSON, and records that a test fails, are rejects; both are written and read."""
    at, out = scratch(spark, "lines"), scratch(spark, "kept")
    i = F.col("item_id")
    table(spark, sf_dir, "benchmark").select(F.when(i % 8 == 0, "{bad").otherwise(F.to_json(F.struct("item_id"))).alias("value")).write.text(at)
    read, bad = jsonl.read_variant(spark, at)
    good, failed = joins.kept_and_rejected(read, F.variant_get("raw", "$.item_id", "long") % 4 != 0)
    jsonl.write_with_rejects(good.select("position"), bad.select("value").unionByName(failed.select("value")), out, keep_invalid=True)
    parts = {False: spark.read.json(out), True: spark.read.text(f"{out}.rejects")}
    return joins.concat([df.select(F.lit(k).alias("rejected")) for k, df in parts.items()]).groupBy("rejected").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM documents UNION ALL SELECT NULL, 'appended', CAST(count(*) AS VARCHAR) FROM documents")
def q_jsonl_round_trip(spark, sf_dir):
    """SRC-1, SNK-1, SNK-2: rows written and read again, nulls kept; rows that are appended as they are, twice."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    at, twice = scratch(spark, "jsonl"), scratch(spark, "twice")
    jsonl.write_jsonl(d, at)
    for half in (0, 1):
        jsonl.append_rows(d.where(F.coalesce(F.col("doc_id") % 2, F.lit(0)) == half), twice)
    n = jsonl.read_strict(spark, twice, d.schema).agg(F.count("*").cast("string").alias("source"))
    return jsonl.read_strict(spark, at, d.schema).unionByName(n.select(F.lit(None).cast("long").alias("doc_id"), F.lit("appended").alias("lang"), "source"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE 'all' END AS said FROM documents")
def q_ledger(spark, sf_dir):
    """SNK-2, STR-2: batches appended by key; keys that are there, and a batch that is done, aren't written again."""
    d, at = table(spark, sf_dir, "documents").select("doc_id", "lang"), scratch(spark, "ledger")
    ledger.append_batch(d.where("doc_id % 3 = 0").withColumn("said", F.lit("third")), at, "doc_id", "0", buckets=16)
    for _ in range(2):
        ledger.append_batch(d.withColumn("said", F.lit("all")), at, "doc_id", "1", buckets=16)
    return ledger.read_ledger(spark, at, T.StructType([*d.schema.fields, T.StructField("said", T.StringType())]))


@query("SELECT DISTINCT event_id, user_id FROM events")
def q_stream_resume(spark, sf_dir):
    """STR-1, STR-2: events streamed to a ledger in micro-batches, twice, one row per id."""
    at = scratch(spark, "stream")
    events = table(spark, sf_dir, "events")
    events.repartition(8).write.parquet(f"{at}/in")
    for mark in ("a", "b"):
        ingest(spark, f"{at}/in", events.schema, lambda b: b.select("event_id", "user_id"), f"{at}/out", f"{at}/{mark}", key="event_id", kind="parquet", files_per_trigger=4, buckets=8).awaitTermination()
    return ledger.read_ledger(spark, f"{at}/out", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())]))


@query("SELECT o_orderkey AS k, o_orderpriority || '!' AS p, 'new' AS version FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, 'bak' FROM orders UNION ALL SELECT o_custkey, o_orderstatus, 'prediction' FROM orders UNION ALL SELECT count(*), o_orderstatus, 'summary' FROM orders GROUP BY o_orderstatus")
def q_sinks(spark, sf_dir):
    """SNK-3, SNK-5, SET-3: a table replaced with its first original kept; predictions with their summary."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    at, out = scratch(spark, "replaced"), scratch(spark, "evaluation")
    jsonl.write_jsonl(rows, at)
    for more in ("?", "!"):
        jsonl.replace_with_backup(rows.withColumn("p", F.concat("p", F.lit(more))), at)
    said = o.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("p"))
    jsonl.write_evaluation(said, said.groupBy("p").agg(F.count("*").alias("k")), out)
    parts = {"new": spark.read.schema(ORDER).json(at), "bak": spark.read.schema(ORDER).json(f"{at}.bak"), "prediction": spark.read.schema(ORDER).json(f"{out}/predictions"), "summary": spark.read.option("multiLine", True).schema(ORDER).json(f"{out}/summary.json")}
    return joins.concat([df.withColumn("version", F.lit(v)) for v, df in parts.items()])


@query("SELECT coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY ALL")
def q_count_report(spark, sf_dir):
    """AGG-2: documents by strata."""
    return metrics.count_report(table(spark, sf_dir, "documents"), ["lang", "source"])
