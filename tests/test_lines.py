"""Line numbers, running positions and the append ledger against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources import jsonl, ledger
from tracemill.sources.lines import as_rows, as_variant, positioned, scan
from tracemill.streaming.resume import ingest

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def many(seed, n):
    rng = random.Random(seed)
    kinds = [lambda i: json.dumps({"id": f"é{seed}-{i}", "v": i}), lambda i: "", lambda i: "  \t", lambda i: f"{{bad {i}", lambda i: json.dumps({"v": "x" * rng.randint(0, 90)})]
    return [rng.choices(kinds, [6, 1, 1, 2, 1])[0](i) for i in range(n)]


def test_line_numbers_over_splits(spark, small_splits, tmp_path):
    texts = {"b/x": many(1, 90), "b/a": many(2, 70), "a": many(3, 50)}
    for name, rows in texts.items():
        at = tmp_path / f"{name}.jsonl"
        at.parent.mkdir(exist_ok=True)
        at.write_text("\n".join(rows) + "\n")
    found = scan(spark, [str(tmp_path / "b"), str(tmp_path / "a.jsonl")], as_rows(SCHEMA))
    assert found.table.select("_file", "_block").distinct().count() > 8
    bad = {n: [(i + 1, x) for i, x in enumerate(rows) if x.strip() and (x[0] == "{" and ("bad" in x or '"x' in x or '"v": ""' in x))] for n, rows in texts.items()}
    got = sorted((r.file.split(str(tmp_path) + "/")[1][:-6], r.line, r.value) for r in found.rejects().collect())
    assert got == sorted((n, i, x) for n, rows in bad.items() for i, x in rows)
    assert found.counts["rejected"] == len(got)
    assert found.counts["blank"] == sum(not x.strip() for rows in texts.values() for x in rows)
    # Files of an argument by name, arguments in their order.
    order = [json.loads(x)["id"] for n in ("b/a", "b/x", "a") for x in texts[n] if '"id"' in x]
    rows = positioned(found.records()).select("record.id", "position").collect()
    assert found.counts["kept"] == len(rows)
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == order and sorted(r.position for r in rows) == list(range(len(order)))
    kept = positioned(found.records().where("record.v % 2 = 0")).select("record.v", "position").collect()
    assert sorted(r.position for r in kept) == list(range(len(kept)))


def test_scan_of_nothing(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    found = scan(spark, str(tmp_path / "e.jsonl"), as_variant)
    assert found.counts == {"kept": 0, "rejected": 0, "blank": 0}
    assert positioned(found.records()).count() == 0 and found.rejects().count() == 0


def test_variant_keeps_text_and_position(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"a": 1}\n\n[2]\n{no\n3\n')
    good, bad = jsonl.read_variant(spark, str(tmp_path / "v.jsonl"))
    assert [(r.value, r.position) for r in good.orderBy("position").collect()] == [('{"a": 1}', 0), ("[2]", 1), ("3", 2)]
    assert [(r.value, r.line) for r in bad.collect()] == [("{no", 4)]


def test_strictest(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert jsonl.read_strictest(spark, put("a", '{"id":"a","v":null}\n'), SCHEMA, ("id", "v")).count() == 1
    for name, text in (("b", '{"id":"a","v":1}\n\n{"id":"b","v":1}\n'), ("c", '{"id":"a"}\n'), ("d", "{bad\n")):
        with pytest.raises(Exception):
            jsonl.read_strictest(spark, put(name, text), SCHEMA, ("id", "v")).collect()


def test_missing_files(spark, tmp_path):
    assert jsonl.read_keyed(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    (tmp_path / "gsm8k").mkdir()
    (tmp_path / "gsm8k/val.jsonl").write_text('{"id":"z","v":1}\n{"v":2}\n')
    (tmp_path / "gsm8k/test.jsonl").write_text('{"v":3}\n')
    rows, missing = jsonl.read_tests(spark, SCHEMA, None, str(tmp_path), ("gsm8k", "math"), ("val", "test"))
    assert sorted((r.id, r.v, r.dataset, r.split) for r in rows.collect()) == [("gsm8k_test_2", 3, "gsm8k", "test"), ("gsm8k_val_1", 2, "gsm8k", "val"), ("z", 1, "gsm8k", "val")]
    assert len(missing) == 2


def test_counts_in_passing(spark, tmp_path):
    df = spark.range(10)
    assert jsonl.write_counted(df, str(tmp_path / "o"), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0)) == {"n": 10, "even": 5}
    assert jsonl.write_counted(df, None, n=F.count("*")) == {"n": 10}
    assert spark.read.json(str(tmp_path / "o")).count() == 10


def rows_of(spark, path):
    return sorted((r.id, r.v) for r in ledger.read_ledger(spark, path, SCHEMA).collect())


def test_ledger_reads_its_buckets_only(spark, tmp_path):
    path, told = str(tmp_path / "led"), []
    for i in range(12):
        new = spark.createDataFrame([(f"k{j}", i) for j in range(i * 8, i * 8 + 10)], SCHEMA)
        told.append(ledger.append_batch(new, path, "id", f"b{i}", buckets=512))
    # Two keys of each batch were in the batch before.
    assert [t["written"] for t in told] == [10] + [8] * 11
    assert len(rows_of(spark, path)) == 98
    # Without pruning, the twelve batches would read 10 + 18 + ... keys, over 600.
    assert sum(t["read"] for t in told) < 80


def test_ledger_replaces_what_died(spark, tmp_path):
    path = str(tmp_path / "led")
    df = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    ledger.append_batch(df, path, "id", "0", buckets=4)
    # A batch that wrote some of its rows and died: begun, never done.
    ledger._mark(spark, f"{path}/_begun/1", True)
    died = spark.createDataFrame([("c", 8), ("old", 9)], SCHEMA).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")).withColumn("batch", F.lit("1"))
    died.write.mode("append").partitionBy("bucket", "batch").json(path)
    assert rows_of(spark, path) == [("a", 1), ("b", 2)]
    again = spark.createDataFrame([("b", 7), ("c", 3), ("d", None)], SCHEMA)
    assert ledger.append_batch(again, path, "id", "1", buckets=4)["written"] == 2
    assert ledger.append_batch(again, path, "id", "1", buckets=4) == {"read": 0, "written": 0}
    assert rows_of(spark, path)[:3] == [("a", 1), ("b", 2), ("c", 3)] and len(rows_of(spark, path)) == 4
    # Rows without a key are appended, once for each batch.
    null = spark.createDataFrame([(None, 1)], SCHEMA)
    assert [ledger.append_batch(null, path, "id", b, buckets=4)["written"] for b in ("2", "2", "3")] == [1, 0, 1]


def test_stream_that_died_goes_on(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    for i in range(4):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"id": f"{j}", "v": i}) for j in range(i, i + 5)) + "\n")
    fails = [True]

    def transform(batch):
        if fails and batch.where("v = 2").limit(1).count():
            fails.pop()
            raise RuntimeError("died")
        return batch

    run = lambda m: ingest(spark, str(src), SCHEMA, transform, out, m, files_per_trigger=1).awaitTermination()
    with pytest.raises(Exception):
        run(mark)
    run(mark)
    assert [r[0] for r in rows_of(spark, out)] == [str(i) for i in range(8)]
    # A new checkpoint reads all again.
    run(str(tmp_path / "mark2"))
    assert len(rows_of(spark, out)) == 8
