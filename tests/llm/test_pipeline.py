"""The pipeline's stages against brute force on the smallest tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components
from tracemill.llm import queries
from tracemill.llm.mixing import mix

SF_DIR = "/root/testdata/sf0.001"
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_contamination", "source_mix", "shards"]
    columns = set(steps[0][0].asDict())
    assert all(set(rows[0].asDict()) == columns for rows in steps[1:5])


def test_toxicity_keeps_what_it_does_not_reject(spark, steps):
    rejected = {r.doc_id for r in queries.op9_toxicity(spark, SF_DIR).where("predicted = 1").collect()}
    assert ids(steps[1]) == [i for i in ids(steps[0]) if i not in rejected]


def test_first_of_each_group_stays(steps):
    rows = sorted(steps[1], key=lambda r: r.doc_id)
    comps = brute_components([r.text for r in rows])
    assert ids(steps[2]) == [r.doc_id for i, r in enumerate(rows) if comps[i][1] == i]


def test_contaminated_documents_go(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        q = re.findall(PATTERN, lower(r.text))
        windows |= {tuple(q[k : k + 10]) for k in range(max(1, len(q) - 9))} if q else set()
    assert {len(w) for w in windows} == {10}

    def clean(t):
        w = re.findall(PATTERN, lower(t))
        return not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))

    assert ids(steps[3]) == sorted(r.doc_id for r in steps[2] if clean(r.text))


def test_mix_meets_its_targets_in_whole_documents(spark, steps):
    before = spark.createDataFrame(steps[3], spark.read.parquet(f"{SF_DIR}/documents.parquet").schema)
    rows = mix(before, queries.MIX_WEIGHTS)[0].collect()
    size, source = {r.doc_id: r["size"] for r in rows}, {r.doc_id: r.source for r in rows}
    target, total = {r.source: r.target for r in rows}, {r.source: r.source_size for r in rows}
    got, words = Counter(ids(steps[4])), Counter()
    for i, n in got.items():
        words[source[i]] += n * size[i]
        whole = target[source[i]] // total[source[i]] if total[source[i]] else 1
        assert n in (whole, whole + 1)
    for s in target:
        assert abs(words[s] - target[s]) <= max(n for i, n in size.items() if source[i] == s) / 2 + 1


def test_shards_hold_every_row(steps):
    assert ids(steps[5]) == ids(steps[4])
    assert {r.shard for r in steps[5]} <= set(range(24))


def test_rows_are_told_apart_by_id_and_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    twin = " ".join(f"w{i}" for i in range(40))
    rows = [(None, twin, "en", "a", 1), (1, twin, "en", "a", 1), (1, "a text of its own that stays here", "en", "a", 1), (1, twin, "en", "a", 1), (2, None, "en", None, 0), (2, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "a text of its own that stays here"), (1, twin), (2, ""), (2, "")]
    bad = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("text IS NOT NULL").first().text
    docs = spark.createDataFrame([(None, bad, "en", "a", 1), (None, "clean", "en", "a", 1), (3, bad, "en", "a", 1), (3, "clean", "en", "a", 1)], schema)
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.benchmark_contamination(spark, docs, SF_DIR).collect()) == [(0, "clean"), (3, "clean")]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name
