"""What toxicity counts in arrays, a slice of texts at a time, against the plain way, text by text."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_operators import docs_of, words
from tracemill.llm import toxicity

ODD = [
    None, "", " \n\t ", "  a  ", "you vile idiot. idiot, idiots!", "i d i o t", "so i d 1 o t! he said", " i\x1fd\x1fi\x1fo\x1ft \"a.s.s\" a b",
    "1d10t iiidiot 1-d-i-o-t v.i.l.e viiile   $tupid stuuupid stup1d!", "Émile ÉÉMILE ça Straße İstanbul ΣΑΣ 漢字漢 ͅx", "... --- 12:30 $45.00 _ __ a_b",
    "a$$ a$$$ ass!! asss, (ass) mor0n. m o r o n", "x" * 300, "i  d  i  o  t - y o u - m 0 r 0 n", "vile! vile? v!le |diot clown c1own c.l.o.w.n",
]
TERMS = {"idiot": 3.0, "idio*": 2.6, "ass": 2.7, "stup*": 3.1, "vile": 2.9, "moro*": 2.8, "clown*": 3.3, "illeg*": 2.55, "straße": 2.6, "sti*": 2.7}


@pytest.fixture
def model(spark):
    counts = toxicity.character_counts(docs_of(spark, ["you are a vile idiot and an ass, stupid moron, clown"] * 50 + [words(200, 3)]))
    return spark.sparkContext.broadcast(toxicity.Characters(counts))


def found(text, model):
    tokens, apart = toxicity.tokens_of(text or "")
    return tokens, [{w for w in toxicity.token_words(x, model)} for x in tokens], {w for x in apart for w in toxicity.token_words(x, model)}


def scorer(monkeypatch, model, weights):
    with monkeypatch.context() as m:
        m.setattr(toxicity.F, "pandas_udf", lambda kind: lambda run: lambda text: run)
        run = toxicity.evidence("text", model, weights)
    return lambda texts: [x for out in run(iter([pd.Series(texts, dtype=object)])) for x in out]


def test_only_what_may_hold_a_term_is_decoded(spark, monkeypatch, model):
    calls, restore = Counter(), toxicity.restore
    monkeypatch.setattr(toxicity, "restore", lambda token, *more: calls.update(["n"]) or restore(token, *more))
    texts = [f"n0thing {chr(97 + i % 26)}{chr(97 + i // 26)}-qu3r{chr(97 + i % 26)} c o u r t {chr(97 + i % 26)}" for i in range(500)] + ["1d1ot"]
    got = scorer(monkeypatch, model, {"idiot": 3.0, "idio*": 2.6})(texts)
    assert got == [0.0] * 500 + [3.0]
    assert 0 < calls["n"] < 10


@pytest.mark.parametrize("size", [1, 90, 10_000])
def test_evidence_is_that_of_each_text(spark, monkeypatch, model, size):
    monkeypatch.setattr(toxicity, "SLICE", size)
    texts = ODD + [words(60, i) for i in range(20)]

    def best(w):
        return max(TERMS.get(t, 0.0) for t in toxicity.word_terms(w))

    want = []
    for t in texts:
        _, of_tokens, spelt = found(t, model.value)
        want.append(math.fsum(max(map(best, ws), default=0.0) for ws in of_tokens) + math.fsum(map(best, spelt)))
    assert scorer(monkeypatch, model, TERMS)(texts) == want
    assert sum(x > 0 for x in want) >= 8


@pytest.mark.parametrize("size", [1, 90, 10_000])
def test_term_counts_are_those_of_each_text(spark, model, monkeypatch, size):
    monkeypatch.setattr(toxicity, "SLICE", size)
    texts = pd.Series(ODD + [f"vile number{i} {words(5, i)}" for i in range(20)], dtype=object)
    y = np.array([i % 3 > 0 for i in range(len(texts))], "int64")
    n, signs = (Counter(), Counter()), defaultdict(set)
    for t, label in zip(texts, y.tolist(), strict=True):
        tokens, of_tokens, spelt = found(t, model.value)
        terms = {x for w in set().union(spelt, *of_tokens) for x in toxicity.word_terms(w)}
        n[label].update(terms)
        for x in terms if label else ():
            signs[x].add(min(zlib.crc32(w.encode()) for w in tokens))
    got, kept = (Counter(), Counter()), defaultdict(set)
    for part in toxicity.slices(texts):
        for r in toxicity.term_counts(texts.iloc[part].tolist(), y[part], model.value, {}).itertuples():
            got[0][r.w] += r.n0
            got[1][r.w] += r.n1
            kept[r.w].update(() if r.s is None else r.s.tolist())
    assert (+got[0], +got[1]) == n
    for term, wanted in signs.items():
        assert kept[term] == wanted if size == 10_000 and len(wanted) < toxicity.SIGNATURES else len(kept[term]) >= min(len(wanted), toxicity.SIGNATURES)
        assert kept[term] <= wanted


def test_trigrams_are_those_of_each_word(spark):
    texts = ODD + [words(60, i) for i in range(20)]
    want = Counter()
    for w in " ".join(t or "" for t in texts).lower().split():
        if w.isalpha():
            w = toxicity.BEGIN * 2 + w + toxicity.END
            want.update(w[i : i + 3] for i in range(len(w) - 2))
    assert toxicity.character_counts(docs_of(spark, texts)) == want
