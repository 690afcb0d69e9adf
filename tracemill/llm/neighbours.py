"""Approximate nearest neighbours, by inner product, by learned partitions.

On a bounded sample (SAMPLE vectors by hash) the graph of largest inner products is cut into balanced parts by recursive
bisection: a split at the median of the leading direction, then swaps of the nodes with the most neighbours on the other
side. A small network (one hidden layer) learns a vector's part; vectors are lifted for it, each by the coordinate that it
lacks to the largest norm of the table, so that long and short ones of a direction are told apart. A second network learns,
for a query's direction, in which parts the vectors with the largest products lie. Every vector of the table goes to its
likeliest part; a query goes to its `probes` likeliest parts, where exact inner products rank all vectors. There are
LEAST_PARTS parts at least and one for PART_ROWS vectors, as long as the sample has SAMPLED_ROWS vectors for each; beyond
that parts hold more vectors. `probes` is the least number that reaches `recall` for the eighth of the sample that the second
network hasn't seen; their neighbours in the sample lie farther apart than those of the whole table.

Vectors of a part are dealt in blocks of about BLOCK_ROWS, its queries in blocks of about QUERY_ROWS, so a crowded part is
many tasks. A query that found fewer than k is searched again in all parts. Model and sample are the only data on the
driver; the sample is drawn by a hash bound, so no task sends it more than its share.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Rows that
repeat a vec_id are candidates each, but never of a query with the same id; of queries that repeat an id the least vector
asks. Ties go to the smaller vec_id. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import values, written

SAMPLE, GRAPH_NEIGHBOURS, HIDDEN = 8192, 12, 128
LEAST_PARTS, PART_ROWS, SAMPLED_ROWS = 16, 1600, 8
BLOCK_ROWS, QUERY_ROWS = 4096, 8192


def graph_of(x: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k rows with the largest inner product, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[i : i + 1024] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size (give or take one) that cut few edges of the graph."""
    part, stack = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while stack:
        rows, first, n = stack.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        lead = np.linalg.svd(centred[:: max(1, len(rows) // 2048)], full_matrices=False)[2][0]
        cut = len(rows) * (n // 2) // n
        right = np.ones(len(x), np.int8)
        right[rows] = 1
        right[rows[np.argsort(centred @ lead, kind="stable")[:cut]]] = 0
        inside = np.zeros(len(x), bool)
        inside[rows] = True
        for _ in range(12):
            held = inside[graph[rows]]
            other = (held & (right[graph[rows]] != right[rows][:, None])).sum(1) - (held & (right[graph[rows]] == right[rows][:, None])).sum(1)
            a, b = (rows[right[rows] == s][np.argsort(-other[right[rows] == s], kind="stable")] for s in (0, 1))
            ga, gb = (np.sort(other[right[rows] == s])[::-1] for s in (0, 1))
            m = min(len(a), len(b))
            swaps = int((ga[:m] + gb[:m] > 0).sum()) // 2
            if not swaps:
                break
            right[a[:swaps]], right[b[:swaps]] = 1, 0
        stack += [(rows[right[rows] == 0], first, n // 2), (rows[right[rows] == 1], first + n // 2, n - n // 2)]
    return part


def trained(x: np.ndarray, goal: np.ndarray, parts: int, rounds: int = 40) -> list[np.ndarray]:
    """Weights of a network from vectors to parts (goal: numbers) or to shares of parts (goal: a row of shares for each
    vector), by Adam on shuffled batches of fixed seed."""
    goal = np.eye(parts)[goal] if goal.ndim == 1 else goal
    r = np.random.default_rng(7)
    w = [r.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(rounds):
        order = r.permutation(len(x))
        for i in range(0, len(x), 256):
            rows = order[i : i + 256]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p = (p - goal[rows]) / len(rows)
            back = (p @ w[2].T) * (h > 0)
            grads = [x[rows].T @ back, back.sum(0), h.T @ p, p.sum(0)]
            t += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                w[j] = w[j] - 0.005 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return w


def likelihood(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    """Scores of the parts, larger for likelier ones."""
    return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors over the largest norm, with the coordinate that makes them unit vectors."""
    y = x / largest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))])


def learned(x: np.ndarray, largest: float, parts: int, k: int, recall: float) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """(network of lifted vectors, network of queries, probes) of a sample."""
    y = lifted(x, largest)
    if parts == 1:
        return trained(y, np.zeros(len(x), np.int64), 1, 0), trained(x, np.zeros(len(x), np.int64), 1, 0), 1
    graph = graph_of(x / largest, min(max(k, GRAPH_NEIGHBOURS), len(x) - 1))
    place = trained(y, balanced_parts(y, graph[:, :GRAPH_NEIGHBOURS], parts), parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x))[:, None], likelihood(y, place).argmax(1)[graph]), 1 / graph.shape[1])
    held = np.arange(len(x)) % 8 == 0
    route = trained(unit(x[~held]), goal[~held], parts)
    # The share of a query's neighbours that its likeliest parts hold, by their number.
    order = np.argsort(-likelihood(unit(x[held]), route), axis=1, kind="stable")
    found = np.take_along_axis(goal[held], order, 1).mean(0).cumsum()
    return place, route, min(parts, int(np.searchsorted(found, recall - 1e-9)) + 1)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    return table.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def search(table: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product) of the k nearest found. queries holds the same columns."""
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, size = length["count"], length["n"]
    rows, asked = rows.where(F.size("v") == size), valid_vectors(queries, id_col, vector_col).where(F.size("v") == size)
    bound = int(min(1.0, 1.2 * SAMPLE / total) * 2**32)
    mark = F.xxhash64("vec_id", "v")
    drawn = rows.where(F.pmod(mark, F.lit(2**32)) <= bound).orderBy(mark, "vec_id", "v").limit(SAMPLE).select("v").collect()
    x = np.array([r["v"] for r in drawn], np.float64)
    largest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()[0]
    parts = max(1, min(max(LEAST_PARTS, total // PART_ROWS), len(x) // SAMPLED_ROWS))
    place, route, probes = learned(x, largest, parts, k, recall)
    model = spark.sparkContext.broadcast((place, route))

    def dealt(n: int, asking: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                v = np.stack(b["v"].to_numpy())
                s = likelihood(unit(v) if asking else lifted(v, largest), model.value[asking])
                near = np.argsort(-s, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"part": near.ravel().astype("int32"), "vec_id": np.repeat(b["vec_id"].to_numpy(), near.shape[1]), "v": [v for v in b["v"] for _ in range(near.shape[1])]})

        return run

    schema = "part int, vec_id long, v array<double>"
    placed = written(rows.mapInPandas(dealt(1, False), schema), "placed")
    # One row per part comes to the driver.
    blocks = {r["part"]: max(1, -(-r["count"] // BLOCK_ROWS)) for r in placed.groupBy("part").count().collect()}

    def ranked(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        c = c.sort_values("vec_id", kind="stable")
        ids, v = c["vec_id"].to_numpy(), np.stack(c["v"].to_numpy())
        out = []
        for i in range(0, len(q), 256):
            names, x = q["vec_id"].to_numpy()[i : i + 256], np.stack(q["v"].to_numpy()[i : i + 256])
            s = x @ v.T
            s[names[:, None] == ids[None, :]] = -np.inf
            least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            at, col = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & np.isfinite(s))
            # Products again, row by row, so that equal vectors have equal scores in every block.
            exact = np.concatenate([(x[at[j : j + 8192]] * v[col[j : j + 8192]]).sum(1) for j in range(0, len(at), 8192)]) if len(at) else np.empty(0)
            order = np.lexsort((ids[col], -exact, at))
            first = np.searchsorted(at[order], at[order], "left")
            keep = order[np.arange(len(order)) - first < k]
            out.append(pd.DataFrame({"query_id": names[at[keep]], "vec_id": ids[col[keep]], "score": exact[keep]}))
        return pd.concat(out)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def found(asked: DataFrame, n: int) -> DataFrame:
        sent = written(asked.mapInPandas(dealt(n, True), schema), "sent-queries")
        crowds = {r["part"]: max(1, -(-r["count"] // QUERY_ROWS)) for r in sent.groupBy("part").count().collect()}
        tiles = [(p, blocks[p], m) for p, m in crowds.items() if p in blocks]
        if not tiles:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        sizes = F.broadcast(values(spark, "_p INT, _n INT, _m INT", tiles))
        own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = sent.join(sizes, F.col("part") == F.col("_p")).withColumn("crowd", own("_m")).withColumn("block", every("_n")).select("part", "block", "crowd", "vec_id", "v")
        c = placed.join(sizes, F.col("part") == F.col("_p")).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("_n")).cast("int")).withColumn("crowd", every("_m")).select("part", "block", "crowd", "vec_id", "v")
        near = q.groupBy("part", "block", "crowd").cogroup(c.groupBy("part", "block", "crowd")).applyInPandas(ranked, "query_id long, vec_id long, score double")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    result = written(found(asked, probes), "neighbours")
    if probes == parts:
        return result
    full = result.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
    short = written(asked.join(full, "vec_id", "left_anti"), "short-queries")
    if short.limit(1).count() == 0:
        return result
    return result.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(found(short, parts))
