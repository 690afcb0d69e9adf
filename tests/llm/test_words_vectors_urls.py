"""Spelling variants, exact k-means and URL rules against brute force: nulls, ties, repeated rows, empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import link_trust, spelling, yinyang

DOCS = "doc_id long, text string, word string, key string"


def edits(w, alphabet):
    """Words one edit from w."""
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in alphabet} | {a + c + b for a, b in cuts for c in alphabet}
    return out - {w}


def brute_words(rows, shortest=5, least=3, misspell=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspell and h % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= least}


def brute_forms(n):
    alphabet = {c for w in n for c in w}
    out = {}
    for w in n:
        near = edits(w, alphabet) & n.keys()
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 2 * n[w] else None, None, n[w], len(near), n[best] if best and n[best] >= 2 * n[w] else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(5, 9))) for _ in range(800)})
    a = spelling.Automaton(words)
    assert [a.ends(a.begin, 0, w, 0) for w in words] == list(range(len(words)))
    assert a.ends(a.begin, 0, "zzzzz", 0) == a.ends(a.begin, 0, words[0][:2], 0) == -1
    # No two states have the same right language.
    assert len({(f, tuple((c, t) for c, (t, _) in e.items())) for f, e in zip(a.final, a.edges, strict=True)}) == len(a.edges)
    for w in words[::9]:
        for exact in (0, len(w) // 2):
            want = {v for v in edits(w, "abc") & set(words) if len(v) >= len(w) and v[:exact] == w[:exact]}
            assert {words[k] for k in a.near(w, exact)} == want


@pytest.mark.parametrize("most", [8192, 3])
def test_near_pairs(spark, most):
    rng = random.Random(2)
    words = {"".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(150)} | {"".join(rng.choices("abcdefgé", k=rng.randint(5, 30))) for _ in range(200)} | {"x" * 300, "x" * 299, "y" + "x" * 299}
    df = spark.createDataFrame([(w, 3 + len(w)) for w in words], "word string, n long")
    got = [(r.u, r.nu, r.v, r.nv) for r in spelling.near_pairs(df, most).collect()]
    alphabet = {c for w in words for c in w}
    want = {(w, v) if (len(w), w) < (len(v), v) else (v, w) for w in words for v in edits(w, alphabet) & words}
    assert len(got) == len(set(got)) and {(u, v) for u, _, v, _ in got} == want
    assert all((nu, nv) == (3 + len(u), 3 + len(v)) for u, nu, v, nv in got)


def spelt_rows():
    rng = random.Random(4)
    base = ["Colour", "color", "colours", "receive", "recieve", "ÉCOLE", "école", "naïves", "straße", "strasse", "grÖße", "abcd", "abc×d÷e"]
    base += ["".join(rng.choices("aeiourst", k=6)) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(base, k=40)) + ", " + "'".join(rng.choices(base, k=3)) + "9x") for i in range(60)]
    rows += [(200 + i, "planet planet planet planex" + " plaxex" * (i % 3 == 0)) for i in range(30)]
    return rows + [(7, rows[7][1])] * 3 + [(None, "colour receive colour"), (100, None), (101, ""), (102, "Q" * 3000 + " " + "q" * 3000 + "2" + "q" * 3000), (103, " 12 ..")]


def test_spelling_variants(spark):
    rows = spelt_rows()
    got = spelling.spelling_variants(spark.createDataFrame([(*r, "w", "k") for r in rows], DOCS)).collect()
    want = brute_forms(brute_words(rows))
    assert len(got) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(r.form for r in got) and any(r.form and r.root != r.form for r in got)
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0


def test_word_counts_without_misspelling(spark):
    rows = spelt_rows()
    df = spark.createDataFrame([(*r, "w", "k") for r in rows], DOCS)
    assert {r.word: r.n for r in spelling.word_counts(df, 4, 1, None).collect()} == brute_words(rows, 4, 1, None)


def brute_kmeans(ids, v, k, rounds, seed=1):
    import hashlib

    order = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), v[i].tolist()))
    c = [v[i].tolist() for i in order[:k]]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(x.tolist(), y, strict=True)) for y in c] for x in v]
        own = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if r < rounds:
            for j in range(len(c)):
                mine = [v[i].tolist() for i in range(len(v)) if own[i] == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return own, [row[j] for row, j in zip(d, own, strict=True)], c


def test_yinyang(spark):
    import hashlib

    r = np.random.default_rng(5)
    x = (r.normal(size=(9, 8))[r.integers(0, 9, 400)] + 0.4 * r.normal(size=(400, 8))).round(2)
    x[40] = x[41] = x[42]
    x[50:60] = np.round(x[50:60])  # ties
    rows = [(i, [float(c) for c in v], "c") for i, v in enumerate(x)] + [(5, [float(c) for c in x[5]], "c"), (None, [0.5] * 8, "c")]
    odd = [(900, None, "c"), (901, [1.0] * 7, "c"), (902, [float("nan")] + [0.0] * 7, "c"), (903, [None] + [0.0] * 7, "c"), (904, [float("inf")] + [0.0] * 7, "c"), (905, [1e300] + [0.0] * 7, "c"), (906, [], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster string").repartition(5)
    for rounds, groups in ((3, 4), (6, 1), (4, 16)):
        got = yinyang.cluster(df, k=10, rounds=rounds, scale=64, dims=8, groups=groups).collect()
        v = np.floor(np.array([e for _, e, _ in rows]) * 64).astype(np.int64)
        own, d, c = brute_kmeans([i for i, _, _ in rows], v, 10, rounds)
        sums = Counter()
        for j, e in zip(own, d, strict=True):
            sums[j] += e
        sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
        want = Counter((rows[i][0], own[i], d[i], sums[own[i]], sum(d), sha[own[i]]) for i in range(len(rows)))
        assert Counter(tuple(g) for g in got) == want, (rounds, groups)
    few = yinyang.cluster(df.where("vec_id < 3"), k=10, rounds=2, dims=8).collect()
    assert len(few) == 3 and all(g.distance == 0 for g in few)
    assert yinyang.cluster(df.limit(0), dims=8).count() == 0


def test_yinyang_skips_distances():
    """Bounds hold, and most distances are never computed once clusters are apart."""
    r = np.random.default_rng(6)
    x = ((r.normal(size=(16, 8))[r.integers(0, 16, 3000)] * 8 + 0.1 * r.normal(size=(3000, 8))) * 64).astype(np.int64)
    c = x[r.permutation(3000)[:16]].copy()
    group = yinyang.grouped(c, 4)
    assert set(group) <= set(range(4)) and len(set(group)) > 1
    own, upper, lower = yinyang.first_state(x, c, group)
    counted = []
    plain = yinyang.squared
    yinyang.squared = lambda a, b: counted.append(len(np.atleast_2d(a))) or plain(a, b)
    try:
        for _ in range(4):
            new = np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(16)])
            moved, c = np.sqrt(plain(new, c)) * (1 + yinyang.SLACK), new
            counted.clear()
            own, upper, lower = yinyang.next_state(x, own, upper, lower, c, moved, group)
            d = np.stack([plain(x, y) for y in c], axis=1)
            assert (own == d.argmin(1)).all()
            assert (upper * (1 + 1e-9) >= np.sqrt(d[np.arange(3000), own])).all()
            for g in range(lower.shape[1]):
                others = np.where((group[None, :] == g) & (np.arange(16)[None, :] != own[:, None]), np.sqrt(d), np.inf).min(1)
                assert (lower[:, g] <= others + 1e-6).all()
        assert sum(counted) < 3000 * 16 / 4
    finally:
        yinyang.squared = plain


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("http://a.com/x?y#z", "a.com", "/x", "com/"), ("https://COM/x", "com", "/x", "com/"), ("http://a.com", "a.com", "", None), ("http://xcom/", "xcom", "/", None), ("http://m.Example.com/en/1", "m.example.com", "/en/1", "example.com/en/"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("http://a.www.example.com/en/?q=/", "a.www.example.com", "/en/", "www.example.com/en/"), ("http://example.com/EN/", "example.com", "/EN/", "com/"),
    ("http://x.net/es", "x.net", "/es", None), ("http://x.net/es/1", "x.net", "/es/1", "net/es/"), ("x.com/y", "", "", None), (None, "", "", None), ("://h.com/p", "h.com", "/p", "com/"), ("a://b.com?u=c://d.net/es/", "b.com", "", None), ("", "", "", None), ("http://u:p@a.com:80/é\n/x#", "u:p@a.com:80", "/é\n/x", None), ("http:///x", "", "/x", None),
])
def test_url_parts(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "u string").select(link_trust.host_of(F.col("u")).alias("h"), link_trust.path_of(F.col("u")).alias("p"))
    r = df.select("h", "p", link_trust.rule_of(F.col("h"), F.col("p"), RULES).alias("r")).first()
    assert (r.h, r.p, r.r and r.r.rule) == (host, path, rule)


def brute_levels(pages, damping=0.85, rest=1e-6):
    seeds = {"allow": Counter(), "block": Counter()}
    n, edges = Counter(), Counter()
    for host, verdict, links in pages:
        if host:
            n[host] += 1
            if verdict:
                seeds[verdict][host] += 1
            for to in links:
                if to.lower() != host:
                    edges[host, to.lower()] += 1
    levels = {}
    for kind in seeds:
        walk = {h: c / n[h] for h, c in seeds[kind].items()}
        total, left = Counter(walk), 1.0
        out = Counter()
        for (a, b), c in edges.items():
            out[a if kind == "allow" else b] += c
        while walk and left > rest:
            step = defaultdict(float)
            for (a, b), c in edges.items():
                at, to = (a, b) if kind == "allow" else (b, a)
                if at in walk:
                    step[to] += damping * walk[at] * c / out[at]
            walk = step
            total.update(walk)
            left *= damping
        levels[kind] = total
    return levels


def test_link_trust(spark):
    rng = random.Random(7)
    hosts = [f"h{i}.org" for i in range(12)] + ["good.com", "bad.net", "hub.org", "spam.org", "alone.org"]
    pages = []
    for i in range(150):
        h = rng.choice(hosts[:12] + ["hub.org"])
        links = [rng.choice(["hub.org", "good.com", *hosts[:4]]) for _ in range(rng.randint(0, 4))]
        pages.append((f"http://{h}/p{i}", links))
    pages += [("http://good.com/a", ["hub.org", "h1.org", "H2.org"])] * 4 + [("http://bad.net/es/1", ["h3.org"])] * 3 + [("http://bad.net/en/1", [])] + [("http://spam.org/x", ["bad.net", "bad.net"])] * 5
    pages += [("http://alone.org/", []), (None, ["good.com"]), ("nothing", ["bad.net"]), ("http://bad.net", [])]
    kinds = ["<A class=x HREF='https://{}/p?q'>", '<a href="//{}">', "<a\nhref=http://{}/x >", '<a id=1 href = "HTTP://{}#a">']
    html = lambda links: "<p><a href='/own'>" + "".join(kinds[k % 4].format(to) for k, to in enumerate(links)) + "<img src='http://no.com/'>"
    df = spark.createDataFrame([(i, u, html(ls) if i % 17 else (html(ls) or None), "x") for i, (u, ls) in enumerate(pages)] + [(999, "http://h1.org/", None, "x")], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in link_trust.judge_urls(df, RULES).collect()}
    assert len(got) == len(pages) + 1
    rule = lambda r: None if r.rule is None else {k: v for v, k in RULES}[r.rule]
    levels = brute_levels([(got[i].host, rule(got[i]), ls) for i, (_, ls) in enumerate(pages)] + [("h1.org", None, [])])
    for r in got.values():
        t, d = levels["allow"][r.host], levels["block"][r.host]
        assert abs(r.trust - t) < 1e-9 and abs(r.distrust - d) < 1e-9
        assert r.verdict == (rule(r) or ("block" if d >= 0.5 and d > t else "allow"))
    by = {r.host: r for r in got.values() if r.rule is None}
    assert by["spam.org"].verdict == by["bad.net"].verdict == "block" and by["alone.org"].verdict == by[""].verdict == "allow"
    assert link_trust.judge_urls(df.limit(0), RULES).count() == 0
