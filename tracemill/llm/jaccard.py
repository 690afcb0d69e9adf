"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, sorted-array intersection, components.

A document is the set of its word shingles as sorted 64-bit hashes; equal sets are one class. Two classes link when
100 * |x & y| >= percent * |x | y|. The join finds the components of the links without writing all links out:

1. A pass over the texts gives the size and the class of each document, and counts shingles per task. Shingles of more
   than a fixed share of the documents are frequent; by that share there are boundedly many of them.
2. Two linked classes share `l` of the first (n - needed + l) shingles in one global order (rare before frequent, then
   by hash). A second pass writes these prefixes; keys that one class alone has go at once.
3. Classes that still share a key get their sets. Those with an equal minimum hash are dealt in tiles of bounded size,
   sorted by set size: a tile compares bitmaps (hash modulo a power of two), whose bit counts bound the overlap from
   above, and intersects sorted arrays only where the bound leaves a link possible and the two are in different
   components so far. A crowd of several tiles is compared tile against tile.
4. Classes that never met in a tile are joined on the prefix keys, only between different components and within the size
   band, and must share `l` keys; bitmaps of fixed width bound the overlap of these pairs, and what is left is
   intersected exactly. So no link between different components is lost, and rows per class grow with the tiles of its
   crowd, not with its members.

Nulls and texts without words have empty sets and link with nothing; texts of fewer words than a shingle are one
shingle. Repeated rows are members of one class. A null id is a document like others; it is no component's smallest id
unless the component has none else. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tracemill.llm.common import few, tidy, written
from tracemill.llm.components import connected_components

#: A shingle in more than one of so many documents (and of at least FREQUENT_LEAST) comes last in the order of prefixes.
FREQUENT_SHARE, FREQUENT_LEAST = 2000, 48
#: Classes in a tile, and minimum hashes by which classes meet in tiles.
TILE, MEETINGS = 1024, 3
#: Hashes that a task hands on at once, besides those of one text, and prefix keys in one task that looks for shared ones.
HANDED, KEYS_IN_TASK = 200_000, 250_000
#: 64-bit words of the bitmaps that bound pairs outside of tiles.
BITMAP_WORDS = 16

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(int(ODD[salt % 8]) * salt % 2**64)
    x = (x ^ (x >> np.uint64(31))) * ODD[1]
    x = (x ^ (x >> np.uint64(29))) * ODD[2]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Text bytes to the sorted hashes of its shingles: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, length: int):
        self.length = length

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        n = len(words)
        k = min(self.length, n)
        if not k:
            return np.empty(0, np.uint64)
        ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
        out = np.full(n - k + 1, k, np.uint64)
        for j in range(k):  # words have random hashes, so their sum with odd factors tells orders apart
            out += ids[j : j + n - k + 1] * ODD[j % 8]
        return np.unique(mixed(out))


def class_of(s: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    for t in batch.column(0):
        yield t.as_py()


def profiles(docs: DataFrame, length: int) -> DataFrame:
    """kind 0: a document's id, text hash h, set size n and class x; kind 1: a shingle x that n different sets of a task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, held, n_held, n_sets = Shingler(length), set(), [], 0, 0

        def counted() -> pa.RecordBatch:
            x, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, int))
            keep = c >= max(3, n_sets / (4 * FREQUENT_SHARE))
            none = pa.nulls(int(keep.sum()), pa.int64())
            return batch_of(none, none, c[keep], x[keep].astype(np.int64), 1)

        def batch_of(ids, h, n, x, kind) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, h, pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(np.full(len(n), kind), pa.int32())], ["doc_id", "h", "n", "x", "kind"])

        for batch in batches:
            n, x = [], []
            for t in texts(batch):
                s = shingles(t)
                c = class_of(s)
                n.append(len(s)), x.append(c)
                if c not in seen:
                    seen.add(c)
                    held.append(s)
                    n_held += len(s)
                    n_sets += 1
                if n_held > 4_000_000:
                    yield counted()
                    held, n_held, n_sets = [], 0, 0
            yield batch_of(batch.column(1), batch.column(2), n, x, 0)
        yield counted()

    return docs.select("text", "doc_id", "h").mapInArrow(tidy(run), "doc_id long, h long, n long, x long, kind int")


def prefix_keys(docs: DataFrame, length: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """key, x (class), n and l of every prefix shingle, each class once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(length), set()
        keys, xs, ns, ls, held = [], [], [], [], 0

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(xs), pa.int64()), pa.array(np.concatenate(ns), pa.int32()), pa.array(np.concatenate(ls), pa.int32())], ["key", "x", "n", "l"])
            for part in (keys, xs, ns, ls):
                part.clear()
            return out

        for batch in batches:
            for t in texts(batch):
                s = shingles(t)
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                spare = len(s) - -(-percent * len(s) // 100)
                l = 1 + spare // 4
                if len(frequent):
                    at = np.searchsorted(frequent, s)
                    often = frequent[np.minimum(at, len(frequent) - 1)] == s
                    s = np.concatenate([s[~often], s[often]])
                p = s[: spare + l]
                keys.append(p), xs.append(np.full(len(p), c)), ns.append(np.full(len(p), len(s))), ls.append(np.full(len(p), l))
                held += len(p)
                if held >= HANDED:
                    yield handed()
                    held = 0
        if keys:
            yield handed()

    return docs.select("text").mapInArrow(tidy(run), "key long, x long, n int, l int")


def shingle_sets(docs: DataFrame, length: int) -> DataFrame:
    """x (class), s (its sorted shingles), meet (its minimum hashes) and bits (its bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(length)
        seen, found, held = set(), [], 0

        def handed() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, found)])
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
            meet = pa.array([[int(mixed(s, 3 + r).min().astype(np.int64)) for r in range(MEETINGS)] for s in found], pa.list_(pa.int64()))
            bits = pa.array([bitmap(s).view(np.int64).tolist() for s in found], pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), sets, meet, bits], ["x", "s", "meet", "bits"])
            found.clear()
            return out

        for batch in batches:
            for t in texts(batch):
                s = shingles(t)
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                found.append(s)
                held += len(s)
                if held >= HANDED:
                    yield handed()
                    held = 0
        if found:
            yield handed()

    return docs.select("text").mapInArrow(tidy(run), "x long, s array<long>, meet array<long>, bits array<long>")


def bitmap(s: np.ndarray) -> np.ndarray:
    """BITMAP_WORDS words with the bit of each shingle's hash."""
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[(s % np.uint64(64 * BITMAP_WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def tile_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of a tile, as pairs of places."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    group, links, begin = np.arange(len(order)), [], 0
    while begin < len(order):
        # A band: sizes that may link with its smallest and largest; bitmaps are as wide as the band's largest set.
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] * 100 / percent, "right")))
        last = max(end, int(np.searchsorted(sizes, sizes[end - 1] * 100 / percent, "right")))
        width = 1 << max(6, int(sizes[last - 1] - 1).bit_length() + 2)
        maps = np.zeros((last - begin, width // 8), np.uint8)
        for i in range(begin, last):
            bits = (sets[order[i]] % np.uint64(width)).astype(np.int64)
            np.bitwise_or.at(maps[i - begin], bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        for i in range(begin, end):
            upto = int(np.searchsorted(sizes, sizes[i] * 100 / percent, "right"))
            rest = np.arange(i + 1, upto)
            rest = rest[group[rest] != group[i]]
            if not len(rest):
                continue
            mine = maps[i - begin]
            # Bits that only one of the two has stand for shingles that the other lacks.
            bound = np.minimum(sizes[i] - np.bitwise_count(mine & ~maps[rest - begin]).sum(1), sizes[rest] - np.bitwise_count(~mine & maps[rest - begin]).sum(1))
            possible = 100 * bound >= percent * (sizes[i] + sizes[rest] - bound)
            for j in rest[possible][np.argsort(-bound[possible], kind="stable")]:
                if group[i] != group[j] and linked(sets[order[i]], sets[order[j]], percent):
                    links.append((order[i], order[j]))
                    group[group == group[j]] = group[i]
        begin = end
    return links


def tiles(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in tiles; sets has g, tile, x and s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, xs, held = None, [], []

        def done() -> pa.RecordBatch:
            found = tile_links(held, percent)
            return pa.RecordBatch.from_arrays([pa.array([xs[i] for i, _ in found], pa.int64()), pa.array([xs[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            values, ends = batch.column(3).flatten().to_numpy().astype(np.uint64), batch.column(3).offsets.to_numpy()
            ends = ends - ends[0]
            for i, (g, tile, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if (g, tile) != now:
                    if len(xs) > 1:
                        yield done()
                    now, xs, held = (g, tile), [], []
                xs.append(x)
                held.append(values[ends[i] : ends[i + 1]].copy())
        if len(xs) > 1:
            yield done()

    dealt = sets.repartition("g", "tile").sortWithinPartitions("g", "tile", "x")
    return dealt.select("g", "tile", "x", "s").mapInArrow(tidy(run), "a long, b long")


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.array(p.as_py(), np.int64), np.array(q.as_py(), np.int64), percent) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Each bit that only one of the two has is a shingle that the other lacks, which bounds the overlap from above.
    maps = [sets.select(F.col("x").alias(n), F.size("s").alias(f"n{n}"), F.col("bits").alias(f"bits_{n}")).dropDuplicates([n]) for n in "ab"]
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    bound = F.expr("(na + nb - apart) div 2")
    pairs = pairs.join(maps[0], "a").join(maps[1], "b").withColumn("apart", apart).where(100 * bound >= percent * (F.col("na") + F.col("nb") - bound)).select("a", "b")
    sets = sets.select("x", "s").dropDuplicates(["x"])
    left = sets.select(F.col("x").alias("a"), F.col("s").alias("p"))
    right = sets.select(F.col("x").alias("b"), F.col("s").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(tidy(run), "a long, b long")


def jaccard_components(docs: DataFrame, length: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, h (hash of the text), n_shingles, component (a number), component_id (smallest doc_id reachable by links)."""
    texts_of = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    found = written(profiles(texts_of, length), "profiles")
    members = found.where("kind = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), "x")
    # Of a set of n, spare + l shingles are prefix keys.
    spare = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100)
    n_docs, n_keys = members.agg(F.count("*"), F.coalesce(F.sum(spare + 1 + F.floor(spare / 4)), F.lit(0))).first()
    often = max(FREQUENT_LEAST, n_docs / FREQUENT_SHARE)
    # Bounded by the mean size of a set times FREQUENT_SHARE, however many documents there are.
    frequent = found.where("kind = 1").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= often).select("x")
    frequent = np.unique(np.array([r[0] for r in frequent.toLocalIterator()], np.int64).astype(np.uint64))

    # So many tasks that what one sorts doesn't grow with the table.
    n_tasks = max(docs.sparkSession.sparkContext.defaultParallelism, 1 + int(n_keys) // KEYS_IN_TASK)
    keys = prefix_keys(texts_of, length, percent, frequent).repartition(n_tasks, "key").groupBy("key", "x", "n", "l").agg(F.lit(1).alias("_"))
    shared = F.count("*").over(Window.partitionBy("key"))
    buckets = written(keys.withColumn("m", shared).where("m > 1").select("key", "x", "n", "l"), "buckets")
    # A class that links with another shares at least as many keys as the smallest that it may link with must.
    smallest = F.ceil(F.col("n") * percent / 100)
    needed = 1 + F.floor((smallest - F.ceil(smallest * percent / 100)) / 4)
    for _ in range(2):
        enough = buckets.groupBy("x", "n").agg(F.count("*").alias("_keys")).where(F.col("_keys") >= needed).select("x")
        live = buckets.join(few(enough), "x", "left_semi")
        several = live.groupBy("key").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")).where("_lo < _hi").select("key")
        buckets = written(live.join(few(several), "key", "left_semi"), "buckets")

    # One document of each class that still shares a key.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    candidates = members.groupBy("x").agg(F.min(row).alias("row")).join(few(buckets.select("x").distinct()), "x", "left_semi")
    candidates = candidates.select(F.col("row.doc_id").alias("_id"), F.col("row.h").alias("_h"))
    chosen = texts_of.join(few(candidates), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    sets = written(shingle_sets(chosen, length), "shingle-sets")

    meeting = sets.select("x", "s", F.explode("meet").alias("g"))
    crowds = meeting.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    # A crowd of several tiles is compared tile against tile, so that all classes with an equal minimum hash have met.
    n_tiles = F.ceil(F.col("m") / TILE)
    own = F.pmod(F.xxhash64("x", "g"), n_tiles)
    dealt = meeting.join(crowds, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1)))
    dealt = dealt.withColumn("tile", F.least("own", "other") * n_tiles + F.greatest("own", "other"))
    first = written(tiles(dealt, percent).distinct(), "links")
    comps = written(connected_components(first), "components")

    # Between different components, classes that share enough prefix keys; the largest component of a key stands on one side only.
    of = buckets.join(comps.withColumnRenamed("node", "x"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    per_key = of.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("most"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("key", "most")
    of = of.join(few(written(per_key, "keys-apart")), "key").withColumn("main", F.col("comp") == F.col("most"))
    of = of.join(sets.select("x", "meet").dropDuplicates(["x"]), "x")
    of = written(of.select("key", "x", "n", "l", "comp", "main", "meet"), "apart")
    p, q = of.where("NOT main").alias("p"), of.alias("q")
    unmet = ~F.exists(F.zip_with("p.meet", "q.meet", lambda a, b: a == b), lambda same: same)
    near = unmet & (F.col("p.comp") != F.col("q.comp")) & (F.col("q.main") | (F.col("p.x") < F.col("q.x"))) & (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n"))
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & near)
    pairs = pairs.groupBy(F.least("p.x", "q.x").alias("a"), F.greatest("p.x", "q.x").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("p.l", "q.l")).alias("l")).where("shared >= l").select("a", "b")
    second = exact_links(pairs, sets, percent)
    name = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    joined = second.join(name, "a", "left").join(name.withColumnsRenamed({"a": "b", "ca": "cb"}), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = connected_components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    final = comps.select(F.col("node").alias("x"), "comp").join(over, "comp", "left").select("x", F.coalesce("top", "comp").alias("top"))
    alone = over.select(F.col("comp").alias("x"), "top").join(final.select("x"), "x", "left_anti")
    final = final.unionByName(alone)

    classes = members.groupBy("x").agg(F.min("doc_id").alias("first"))
    named = classes.join(final, "x", "left").withColumn("top", F.coalesce("top", "x"))
    # A null id is a document all the same; it stands for itself where a component has no other.
    smallest = named.groupBy("top").agg(F.min("first").alias("component_id"))
    ids = written(named.join(smallest, "top").select(F.col("x").alias("_x"), F.col("top").alias("component"), "component_id"), "class-ids")
    out = members.join(few(ids), F.col("x") == F.col("_x"))
    filled = F.col("n_shingles") > 0
    return out.select("doc_id", "h", "n_shingles", "component", F.when(filled, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
