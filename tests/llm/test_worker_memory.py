"""What Python workers hold, as they stay beside the JVM after their tasks."""

import gc

import numpy as np
import pyarrow as pa

from tests.llm.test_operators import docs_of, words
from tracemill.llm import jaccard, toxicity


def test_workers_drop_the_language_model(spark):
    docs = docs_of(spark, [f"{words(30, i)} you vile id1ot" if i % 2 else words(30, i) for i in range(60)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    assert toxicity.score_toxicity(docs, labels).count() == 60

    def models(batches):
        for _ in batches:
            pass
        gc.collect()
        yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ == "Characters" for x in gc.get_objects())]})

    held = spark.range(0, 64, 1, 16).mapInArrow(models, "n long").collect()
    assert [r.n for r in held] == [0] * 16


def test_tasks_hand_on_few_hashes_at_once(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: ran.append(run))
    docs = docs_of(spark, ["a"])
    jaccard.prefix_keys(docs, 5, 80, np.empty(0, np.uint64))
    jaccard.shingle_sets(docs, 5)
    texts = [words(900, i) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"text": [t.encode() for t in texts]})
    size = [len(jaccard.Shingler(5)(t.encode())) for t in texts]
    keys, sets = (list(run(iter([batch]))) for run in ran)
    assert len(keys) > 1 and max(b.num_rows for b in keys) <= 200_000 + max(size)
    assert len(sets) > 1 and max(len(b["s"].flatten()) for b in sets) <= 200_000 + max(size)
    assert sum(b.num_rows for b in keys) == sum(n - -(-80 * n // 100) + 1 + (n - -(-80 * n // 100)) // 4 for n in size)
    assert [len(s) for b in sets for s in b["s"].to_pylist()] == size


def test_evidence_in_parts_is_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(f"{words(20, i)} vile id1ot number{i}", 1) if i % 2 else (words(20, i), 0) for i in range(80)], "text string, y int").coalesce(1)
    model = spark.sparkContext.broadcast(toxicity.Characters({}))
    whole = toxicity.term_evidence(rows, model)
    assert "vile" in whole[0]

    def few_kept(batches, run):
        toxicity.KEPT, toxicity.DECODED, kept = 5, 3, (toxicity.KEPT, toxicity.DECODED)
        yield from run(batch.iloc[i : i + 1] for batch in batches for i in range(len(batch)))
        toxicity.KEPT, toxicity.DECODED = kept

    monkeypatch.setattr(toxicity, "tidy", lambda run: lambda batches: few_kept(batches, run))
    assert toxicity.term_evidence(rows, model) == whole
