"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate as D
from tracemill.llm import common, neighbours, perspectives, pii, quality, registry, token_count, toxicity
from tracemill.llm.components import connected_components
from tracemill.llm.jaccard import jaccard_components, tile_links
from tracemill.llm.mixing import mix, shard_ends, taken_words
from tracemill.llm.sharding import assign_shards, shard_rows, with_slots

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def words(n, seed=0):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, 500, n))


TEXTS = [None, "", " \n", "one", words(300), words(300), words(40, 1), "a b c d e f g h i j k l", words(3000, 2), "One TWO\tthree", "é É 🙂 " * 9] + [words(30, s) for s in range(3, 20)]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def test_shards(spark):
    n = len(TEXTS)
    df = docs_of(spark, TEXTS * 3, [None if i % 3 else "hot" for i in range(n * 3)])
    got = with_slots(assign_shards(df, ["source", "lang", "n_chars"], shards=4)).collect()
    assert len(got) == n * 3
    assert all(r["size"] == len((TEXTS[r.doc_id % n] or "").encode()) + 8 for r in got)
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id % n] or "").encode()) for r in got)
    by = {s: [r for r in got if r.shard == s] for s in {r.shard for r in got}}
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert set(by) == {0, 1, 2, 3}
    texts = {}
    for r in got:
        texts.setdefault(TEXTS[r.doc_id % n], set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    group = Counter()
    for r in got:
        group[TEXTS[r.doc_id % n]] += r["size"]
    # The long text's copies are a shard's bytes by themselves; the other shards differ by two groups at most.
    total, (top, most) = sum(group.values()), group.most_common(1)[0]
    assert most >= total / 4
    alone = texts[top].pop()
    assert {r.doc_id % n for r in by[alone]} == {TEXTS.index(top)}
    sizes = [sum(r["size"] for r in rows) for s, rows in by.items() if s != alone]
    assert max(sizes) - min(sizes) <= 2 * max(v for t, v in group.items() if t != top)
    assert assign_shards(df.limit(0), ["source"], shards=4).count() == 0
    again = df.union(df.limit(2))
    assert shard_rows(again, ["source"], target_bytes=20_000).count() == n * 3 + 2
    with pytest.raises(ValueError):
        shard_rows(df.withColumn("shard", F.lit(1)), ["source"], shards=2)


def test_cuts_halve_the_bytes(spark):
    df = docs_of(spark, [words(20 + 7 * i, i) for i in range(200)], [f"s{i % 5}" for i in range(200)])
    rows = assign_shards(df, ["source", "n_chars"], shards=2).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    # The cut is at the text where the bytes reach a half, or right after it.
    assert abs(sizes[0] - sizes[1]) <= max(r["size"] for r in rows)


def bench_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontaminate(spark):
    long = TEXTS[4].split()
    items = [(1, " ".join(long[20:45])), (2, "a, B! c"), (3, None), (4, ""), (5, "nowhere at all to be found in any of these texts"), (10, " ".join(long[30:41])), (6, "one")]
    texts = [*TEXTS, "x a b c a b c y", " ".join(["q"] * 5 + long[20:31]), TEXTS[4] + " " + TEXTS[4]]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = re.findall(pattern, lower(t)), set(), set()
        for item, text in items:
            q = re.findall(pattern, lower(text))
            for k in range(max(1, len(q) - 9)) if q else ():
                part = q[k : k + 10]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        found.add(str(item))
        want[i] = (len(w), len(hit), sorted(found))
    got = D.decontaminate(docs_of(spark, texts), bench_of(spark, items), 10)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got.collect()} == want
    assert D.decontaminate(docs_of(spark, texts), bench_of(spark, []), 10).where("n_hit > 0").count() == 0
    assert D.decontaminate(docs_of(spark, texts).limit(0), bench_of(spark, items), 10).count() == 0


def test_proximity(spark):
    docs = docs_of(spark, ["red green blue", "red big green blue", "green far far far far far red"])
    windows, _ = D.item_windows(bench_of(spark, [(1, "red green")]), 10)
    postings = D.store_postings(docs, windows.select(F.explode("window").alias("term")).distinct())
    ranked = D.ranked_terms(windows, postings)
    near = {n: sorted(r.doc_id for r in D.find_near(postings, ranked, n).select("doc_id").distinct().collect()) for n in (0, 1, 8)}
    assert near == {0: [0], 1: [0, 1], 8: [0, 1, 2]}


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_copies(n, seed):
    r, base, out = np.random.default_rng(seed), words(120, seed).split(), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.integers(0, 5)):
            w[r.integers(0, len(w))] = f"z{r.integers(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark):
    shared = words(70, 99)
    texts = [*TEXTS, *near_copies(60, 5), *near_copies(12, 6), *[f"{words(40, 200 + i)} {shared}" for i in range(20)], *["same text again and again"] * 5, "SAME text again and again"]
    got = jaccard_components(docs_of(spark, texts), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)
    assert jaccard_components(docs_of(spark, texts).limit(0), 5, 80).count() == 0


def test_tile_links():
    sets = [np.array(sorted({zlib.crc32(" ".join(s).encode()) for s in shingles(t)}), np.uint64) for t in [*near_copies(30, 7), *[words(130, s) for s in range(8)]]]
    parent = list(range(len(sets)))
    for a, b in tile_links(sets, 80):
        parent = [parent[a] if p == parent[b] else p for p in parent]
    for i, j in combinations(range(len(sets)), 2):
        x = len(np.intersect1d(sets[i], sets[j]))
        if 100 * x >= 80 * (len(sets[i]) + len(sets[j]) - x):
            assert parent[i] == parent[j]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 50, 50: 50, 70: 50}


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS, "▁a ▁▁b", "a  b\n\n c", "<s> </s> <0x0A>", "x" * 5000, " lead", "trail ", "\x00", "数学 数学"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs_of(spark, texts), path, 100).collect()}
    assert got == {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in enumerate(texts)}


TURNS = "conv_id long, turn long, role string, text string"


def test_rotation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, None, None, "x"), (3, 0, "system", "only")] + [(9, t, "cat", str(t)) for t in range(130)]
    got = perspectives.rotate(spark.createDataFrame(rows, TURNS)).collect()
    mine = {(r.conv_id, r.perspective, r.segment): r for r in got}
    assert len(got) == 2 + 1 + 3
    r = mine[1, "ann", 0]
    assert r.rendered == "<|system|>\ns\n<|assistant|>\nhi\n<|user name=bob|>\n\n<|assistant|>\nbye\n"
    assert [r.rendered[s.start : s.end] for s in r.mask] == ["hi", "bye"]
    assert sum(len(x.messages) for x in got if x.conv_id == 9) == 130


def test_rotation_keeps_order_in_crowded_conversations(spark):
    rows = [(None, t % 8, "system" if t == 0 else f"r{t % 3}", f"m{t}") for t in range(400)] + [(None, 3, "r0", "same")] * 90
    got = perspectives.rotate(spark.createDataFrame(rows, TURNS)).collect()
    want = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    for who in ("r0", "r1", "r2"):
        parts = sorted((r.segment, r.messages) for r in got if r.perspective == who)
        assert [k for k, _ in parts] == list(range(8))
        assert [m.content for k, part in parts for m in (part[1:] if k else part)] == [r[3] for r in want]
        assert all(part[0].role == "system" and part[0].content == "m0" for k, part in parts if k)
    assert perspectives.rotate(spark.createDataFrame([], TURNS)).count() == 0


def assert_dealt(spark):
    """Slots over shards: sums are kept, counts are as spread as a multinomial draw's, reruns agree."""
    sizes = {"a": 6400, "b": 64 * 300_000, "c": 1, None: 0}
    sources = spark.createDataFrame(list(sizes.items()), "source string, n_slots long")
    ends = {r.source: r.ends for r in shard_ends(sources, 64, 5).collect()}
    assert ends == {r.source: r.ends for r in shard_ends(sources, 64, 5).collect()}
    for s, n in sizes.items():
        counts = np.diff([0, *ends[s]])
        assert len(counts) == 64 and counts.min() >= 0 and counts.sum() == n
        if n > 1000:
            chi = ((counts - n / 64) ** 2 / (n / 64)).sum()
            assert 30 < chi < 110  # 63 degrees of freedom


def test_slots_are_runs_of_their_shards(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (i * 7 % 400)), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    placed, drawn = mix(df, [5.0, 2.0, 1.0])
    slots = drawn.select("source", "slot", "output_shard").distinct().orderBy("source", "slot").collect()
    for s in {r.source for r in slots}:
        of = [(r.slot, r.output_shard) for r in slots if r.source == s]
        # Without gaps, and in runs.
        assert [x for x, _ in of] == list(range(len(of)))
        assert [y for _, y in of] == sorted(y for _, y in of)
    found = taken_words(placed, drawn).collect()
    assert all((r.n_shards > 0) == (r.taken > 0) for r in found)


def test_mix(spark):
    texts = TEXTS * 4
    sources = [["a", "b", "c", "d", None][i % 5] for i in range(len(texts))]
    df = docs_of(spark, texts, sources)
    run = lambda: sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in taken_words(*mix(df, [5.0, 2.0, 1.0], block_words=16)).collect())
    got = run()
    assert got == run()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert {r[0]: r[1] for r in got} == size
    sums = Counter()
    for i, s in enumerate(sources):
        sums[s] += size[i]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight, target = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}, {}
    left, open_ = 1.5 * sum(sums.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sums[s]}
        for s in over or open_:
            target[s] = 2.0 * sums[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = Counter()
    for i, n, total, goal, t in got:
        assert total == sums[sources[i]]
        assert abs(goal - target[sources[i]]) < 1e-6
        assert t <= 2 * n
        taken[sources[i]] += t
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert_dealt(spark)
    assert taken_words(*mix(df.limit(0), [1.0])).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def fits(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = lambda: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(), "phone": lambda: 10 <= len(d) <= 15}[k]()

    return sorted((m.start(), i, m.end()) for i, k in enumerate(BASE) for m in re.finditer(BASE[k], t or "") if fits(k, m.group()))


def test_pii(spark):
    texts = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.400 00001.0002.3.255", "+1 (234) 567-8901) +12", "9" * 5000 + " 4111-1111 1111 1111", "x" * 50000 + "@", "éé a@b.co 🙂 +49 123 456 7890", "4111 1111 1111 1111-5", "+1234567890+1234567890"]
    texts += [f"the patient zorblax wrote from zed@mail.org on day {i}" for i in range(4)] + [f"the day is fine and so on {i}" for i in range(40)]
    got = {r.doc_id: r for r in pii.find_spans(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i].base] == base_spans(t)
        assert set(got[i].base) <= set(got[i].spans)
    revealed = {texts[10][s.start : s.end] for s in got[10].spans if s.kind == 4}
    assert "zorblax" in revealed
    assert "the" not in revealed
    clean = {r.doc_id: r.text for r in pii.sanitise_documents(docs_of(spark, texts)).collect()}
    assert "zorblax" not in clean[10]
    assert "[EMAIL]" in clean[10]
    assert clean[0] is None
    assert pii.find_spans(docs_of(spark, texts).limit(0)).count() == 0


def wilson(k, n, z=1.645):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def test_pii_terms(spark, monkeypatch):
    far = " ".join(["some", "words", "that", "stand", "between"] * 60)
    texts = [f"quorlin {far} wrote from one@mail.org", "quorlin again from one@mail.org or solitary", "quorlin alone without any address", *["same text of plumbus one two@mail.org"] * 9, "three@mail.org and plumbus"]
    texts += [f"some words that stand between wrote alone without any address from text of the same and so on {i}" for i in range(2000)]
    got = {r.doc_id: r for r in pii.find_spans(docs_of(spark, texts)).collect()}
    size, total = {i: set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(BASE["email"], " ", lower(t)))) for i, t in enumerate(texts)}, 2005
    once = {t: i for i, t in enumerate(texts)}.values()
    assert len(once) == total
    n_t = Counter(w for i in once for w in size[i])
    reveal = set()
    for e in ("one@", "two@", "three@"):
        inside = [i for i in once if e in texts[i]]
        n_et, p = Counter(w for i in inside for w in size[i]), len(inside) / total
        reveal |= {w for w, n in n_et.items() if len(w) >= 3 and not w.isdigit() and wilson(n, n_t[w]) >= max(0.25, p**0.2)}
    for i, t in enumerate(texts):
        taken = [(s, e) for s, _, e in base_spans(t)]
        want = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m.group().lower() in reveal and not any(m.start() < e and s < m.end() for s, e in taken)]
        assert [(s.start, s.end) for s in got[i].spans if s.kind == 4] == want, i
    assert "quorlin" in reveal
    # A word that stood once beside an address reveals it only if it stands nowhere else.
    assert "solitary" in reveal and not {"some", "plumbus"} & reveal
    several = {r.doc_id: r for r in pii.find_spans(docs_of(spark, texts), support=2).collect()}
    assert any(s.kind == 4 for s in several[0].spans) and "solitary" not in {texts[1][s.start : s.end] for s in several[1].spans}
    monkeypatch.setattr(pii, "PATTERN_TERMS", 0)  # words are looked up one by one
    assert {r.doc_id: r.spans for r in pii.find_spans(docs_of(spark, texts)).collect()} == {i: r.spans for i, r in got.items()}


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = (r.normal(size=(20, 16))[r.integers(0, 20, 5000)] + 0.3 * r.normal(size=(5000, 16))).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] + [1.0] * 15, 0), (9060, [1.0, None] + [1.0] * 14, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {}
    for g in neighbours.search(df, df.where("vec_id % 20 = 0"), 20, 0.97).collect():
        found.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert set(found) == set(range(0, 5000, 20))
    hits, y = 0, x.astype(float)
    for q, near in found.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, 21))
        assert [(-z, v) for _, v, z in near] == sorted((-z, v) for _, v, z in near)
        assert all(abs(s[v] - z) < 1e-9 for _, v, z in near)
        hits += len({v for _, v, _ in near} & set(best))
    assert hits / (20 * len(found)) >= 0.9
    small = neighbours.search(df.limit(3), df.where("vec_id = 0"), 20).collect()
    assert len(small) == 2
    assert neighbours.search(df.limit(0), df, 20).count() == 0


def labelled(spark, train, marks, texts, label):
    """Documents (the texts first, then the ones to learn from) and labels."""
    docs = docs_of(spark, texts + train)
    return docs, spark.createDataFrame([(len(texts) + i, m) for i, m in enumerate(marks)], f"doc_id long, {label} int")


def test_neighbours_where_norms_differ():
    """The largest inner products, with norms of a lognormal spread: found in few parts if directions have structure."""
    r = np.random.default_rng(3)
    directions = neighbours.unit(neighbours.unit(r.normal(size=(40, 32)))[r.integers(0, 40, 6000)] + 0.08 * r.normal(size=(6000, 32)))
    for sigma, most in ((0.0, 4), (1.0, 12)):
        x = directions * np.exp(r.normal(0, sigma, (6000, 1)))
        largest = np.linalg.norm(x, axis=1).max()
        place, route, probes = neighbours.learned(x[:4096], largest, 16, 20, 0.97)
        part = neighbours.likelihood(neighbours.lifted(x, largest), place).argmax(1)
        asked = x[4096::10]
        s = asked @ x.T
        s[np.arange(len(asked)), np.arange(4096, 6000, 10)] = -np.inf
        near = np.argsort(-s, axis=1)[:, :20]
        sent = np.argsort(-neighbours.likelihood(neighbours.unit(asked), route), axis=1)[:, :probes]
        assert probes <= most, (sigma, probes)
        assert (part[near][:, :, None] == sent[:, None, :]).any(2).mean() >= 0.9
        assert np.bincount(part, minlength=16).max() < 3 * 6000 / 16


def test_toxicity(spark):
    bad = [f"{words(20, s)} you vilewort {words(9, s + 50)}" for s in range(40)]
    good = [words(30, s + 500) for s in range(60)]
    texts = [*bad[30:], *good[40:], "you v1lew0rt", "v i l e w o r t", "you viiiiilewort", None, "", "x" * 9000]
    docs, marks = labelled(spark, bad[:30] + good[:40], [1] * 30 + [0] * 40, texts, "toxic")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    assert all(got[i].predicted == 1 for i in range(10))
    assert all(got[i].predicted == 0 for i in range(10, 30))
    assert [got[i].predicted for i in range(30, 36)] == [1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0


def exhaustive(token, model, apart=False):
    """The best score of all ways to read a token."""
    def ways(i, a, b):
        if i == len(token):
            yield 0.0, model(a, b, toxicity.END)
            return
        ch = token[i]
        if ch in toxicity.MARKS:
            yield from ((toxicity.SEPARATOR + s, e) for s, e in ways(i + 1, a, b))
        for c, cost in [(ch, toxicity.AS_IS), *((x, toxicity.ALIKE) for x in toxicity.LOOKS_LIKE.get(ch, ""))]:
            if c == b:
                yield from ((toxicity.REPEAT + s, e) for s, e in ways(i + 1, a, b))
            yield from ((cost + model(a, b, c) + s, e) for s, e in ways(i + 1, b, c))

    return max(s + e for s, e in ways(0, toxicity.BEGIN, toxicity.BEGIN))


def way_score(token, word, model):
    """The best score of the ways to read a token that give the word."""
    def ways(i, j, a, b):
        if i == len(token):
            return model(a, b, toxicity.END) if j == len(word) else float("-inf")
        ch, best = token[i], float("-inf")
        if ch in toxicity.MARKS:
            best = max(best, toxicity.SEPARATOR + ways(i + 1, j, a, b))
        for c, cost in [(ch, toxicity.AS_IS), *((x, toxicity.ALIKE) for x in toxicity.LOOKS_LIKE.get(ch, ""))]:
            if c == b:
                best = max(best, toxicity.REPEAT + ways(i + 1, j, a, b))
            if j < len(word) and word[j] == c:
                best = max(best, cost + model(a, b, c) + ways(i + 1, j + 1, b, c))
        return best

    return ways(0, 0, toxicity.BEGIN, toxicity.BEGIN)


def test_viterbi_against_all_ways():
    counts = Counter()
    for w in ["idiot", "vile", "letter", "too", "ass", "all", "toll", "silly"] * 3:
        w = toxicity.BEGIN * 2 + w + toxicity.END
        counts.update(w[i : i + 3] for i in range(len(w) - 2))
    model = toxicity.Characters(counts)
    for token in ["idiot", "1d10t", "iddiot", "i-d-iot", "viiile", "t0ll", "leetteer", "a$$", "s!lly", "aall"]:
        word = toxicity.restore(token, model)
        assert abs(way_score(token, word, model) - exhaustive(token, model)) < 1e-9, token
    for token in ["iddiioott", "viiiile", "aaass", "lletttter", "tooo", "sillyy"]:
        assert toxicity.unrepeated(token, model) == toxicity.restore(token, model)


def test_toxicity_disguises(spark):
    counts = toxicity.character_counts(docs_of(spark, ["you are a vile idiot and an ass with a vigewort"] * 50 + [" ".join(chr(0x4E00 + i) + chr(0x4E00 + 7 * i % 2900) for i in range(2900))]))
    model = toxicity.Characters(counts)
    assert sum(counts.values()) == 50 * (3 + 3 + 1 + 4 + 5 + 3 + 2 + 3 + 4 + 1 + 8 + 11) + 2900 * 3
    assert len({c for g in counts for c in g}) <= toxicity.ALPHABET + 3

    def found(text):
        tokens, apart = toxicity.tokens_of(text)
        return {w for x in (*tokens, *apart) for w in toxicity.token_words(x, model)}

    for text in ["so i d i o t! he said", "i d 1 o t", "i-d-1-o-t.", "iddiioott", "id-iot", "1d!ot!", "y o u a r e a n i d i o t " * 9, "i d i o t", "(i  d  i  o  t)", "y0u-1d10t"]:
        assert "idiot" in found(text), text
    assert "vigewort" in found("a vi9ewort")
    assert "vile" in found("v i l e")
    assert "ass" in found("a$$")
    assert found("2013-05-06 $45.00") == {"2013", "05", "06", "45", "00"}


def test_quality(spark):
    good = [words(60, s).capitalize() + "." for s in range(60)]
    junk = ["!! ".join(words(40, s).upper().split()) for s in range(60)]
    texts = [*good[40:], *junk[40:], None, "", "y" * 9000]
    docs, marks = labelled(spark, good[:40] + junk[:40], [1] * 40 + [0] * 40, texts, "quality")
    got = {r.doc_id: r for r in quality.score_quality(docs, marks).collect()}
    assert all(got[i].predicted == 1 for i in range(20))
    assert all(got[i].predicted == 0 for i in range(20, 40))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert quality.score_quality(docs, marks.limit(0)).first().score == 0.5
    assert quality.score_quality(docs.limit(0), marks).count() == 0


def test_votes_against_brute_force():
    r = np.random.default_rng(4)
    vectors, labels, stands = r.integers(-2, 3, (90, 3)).astype(float), r.random(90), r.random(90) + 0.5
    queries = r.integers(-2, 3, (40, 3)).astype(float)
    cosine = quality.unit(queries) @ quality.unit(vectors).T
    got = quality.votes(cosine.astype(np.float32), labels, stands)
    for i in range(len(queries)):
        order = sorted(range(90), key=lambda j: -cosine[i, j])
        near = [j for j in range(90) if cosine[i, j] >= cosine[i, order[quality.NEIGHBOURS - 1]] - 1e-6]
        assert len(near) >= quality.NEIGHBOURS
        weight = [(max(cosine[i, j], 0) ** 8 + 1e-9) * stands[j] for j in near]
        assert abs(got[i] - sum(w * labels[j] for w, j in zip(weight, near, strict=True)) / sum(weight)) < 1e-4


def test_latent_space_is_a_truncated_svd():
    x = np.random.default_rng(5).normal(size=(200, 30)) @ np.diag(np.linspace(4, 0.1, 30)) @ np.random.default_rng(6).normal(size=(30, 120))
    want = np.linalg.svd(x, full_matrices=False)[2][: quality.DIMENSIONS]
    p = quality.latent_space(x)
    assert np.allclose(np.linalg.norm(x @ p), np.linalg.norm(x @ want.T), rtol=1e-6)


def test_null_ids_link(spark):
    base = words(60, 77)
    rows = [(None, base, None, None, 0, ""), (5, base + " more", "en", "s", 0, ""), (9, base, "en", "s", 0, ""), (None, "alone", "en", "s", 0, ""), (9, base, "en", "s", 0, "")]
    got = jaccard_components(spark.createDataFrame(rows, COLUMNS), 5, 80).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(False, 5, 57, 5), (False, 9, 56, 5), (False, 9, 56, 5)]
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(1, None), (56, 5)]


def test_repeated_vectors_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), *[(3, [0.9, 0.1])] * 4, (20, [0.0, 1.0]), (7, [0.5, 0.5])]
    found = neighbours.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<float>"), df.where("vec_id % 20 = 0"), 5).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 0] == [3, 3, 3, 3, 7]


CLASHING = ["h", "n_words", "score", "predicted", "size", "target", "taken", "_bucket", "slot", "vec_id", "part", "x", "words", "spans", "base", "n_tokens", "_h", "_d", "segment", "messages", "rank", "times", "y"]


def test_clashing_columns(spark):
    """Columns that are named as operators name theirs change no result."""
    texts = [*TEXTS[:8], "write to me@mail.org at once", words(60, 3), words(60, 3)]
    plain = docs_of(spark, texts, ["a", "b", None, *["a"] * 8])
    odd = plain.select("*", *[F.lit(f"q{i}").alias(c) for i, c in enumerate(CLASHING)])
    bench = bench_of(spark, [(1, words(60, 3))])
    marks = spark.createDataFrame([(4, 1, "t"), (7, 0, "t")], "doc_id long, toxic int, score string")
    runs = {
        "shards": lambda d: assign_shards(d, ["source", "n_chars"], shards=2),
        "rows": lambda d: shard_rows(d, ["source"], shards=2).select("doc_id", "shard"),
        "phrases": lambda d: D.decontaminate(d, bench),
        "mix": lambda d: taken_words(*mix(d, [5.0, 2.0])),
        "copies": lambda d: jaccard_components(d),
        "pii": lambda d: pii.find_spans(d),
        "clean": lambda d: pii.sanitise_documents(d).select("doc_id", "text"),
        "toxicity": lambda d: toxicity.score_toxicity(d, marks),
        "quality": lambda d: quality.score_quality(d, marks.withColumnRenamed("toxic", "quality")),
    }
    for name, run in runs.items():
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(plain).collect())), name
    assert set(pii.sanitise_documents(odd).columns) == set(odd.columns)
    turns = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", "ho"), (1, 1, "bob", "ho")], TURNS)
    assert sorted(map(str, perspectives.rotate(turns.select("*", *[F.lit(1).alias(c) for c in ("segment", "rank", "part", "times", "who", "said")])).collect())) == sorted(map(str, perspectives.rotate(turns).collect()))


def test_sieve(spark):
    wanted = spark.range(0, 5000, 5).select(F.concat(F.lit("w"), "id").alias("term"))
    rows = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("term"), "id")
    passed = {r.id for r in rows.where(common.sieve(wanted, "term")(F.col("term"))).collect()}
    assert set(range(0, 5000, 5)) <= passed
    assert len(passed) < 1150


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_registered_queries_agree_with_their_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF_DIR}/{f}'")
    df, want = registry.QUERIES[name](spark, SF_DIR), con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
