"""Exact k-means by Yinyang grouping, in integers.

Centroids are put into groups once. Each vector keeps its cluster, an upper bound of the distance to its centroid and, for
each group, a lower bound of the distance to the group's other centroids. After centroids move, bounds are corrected by how
far they moved; a vector whose upper bound is below all lower ones keeps its cluster unseen, else only groups whose bound
isn't above are scanned, exactly. Squared distances are integers, so ties are true ties and go to the smaller number.

Vectors of another length, with null or non-finite components, or with a scaled component beyond LARGEST (a long) take no
part, as if they weren't there. Components beyond EASY are squared and summed in whole numbers of any length; a distance
or inertia that no long holds is null. Repeated rows are vectors each; a null id is hashed as an empty one. Of
an empty table the result is empty; with fewer vectors than k there are as many centroids as vectors. Further columns of the
table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import written

#: The largest scaled component, and up to which squares and their sum are safe in a long.
LARGEST, EASY = 1 << 62, 1 << 27
LONGEST = (1 << 63) - 1
#: How much bounds are widened against rounding, relative and absolute.
SLACK = 1e-9


def scaled_vectors(table: DataFrame, scale: int = 64, dims: int = 64, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component, of the vectors that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    # NaN is above all numbers.
    odd = F.exists(x, lambda c: c.isNull() | (F.abs(c * scale) > LARGEST))
    kept = table.where((F.size(vector) == dims) & ~odd)
    return kept.select(F.col(id_).alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest sha256 of `<seed>:<id>`, in that order; k rows come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > EASY:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


def grouped(centroids: np.ndarray, n: int) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means among the centroids themselves, in their order."""
    n = min(n, len(centroids))
    middles = centroids[:n].astype(float)
    for _ in range(5):
        of = np.array([np.argmin(squared(middles, c)) for c in centroids])
        middles = np.array([centroids[of == g].mean(axis=0) if (of == g).any() else middles[g] for g in range(n)])
    return of


def _below(d: np.ndarray) -> np.ndarray:
    """A safe lower bound; infinite where a group has no other centroid."""
    return np.where(np.isinf(d), d, d - SLACK * (1 + np.abs(np.where(np.isinf(d), 0, d))))


def first_state(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by group, of vectors that are compared with all centroids."""
    d = np.stack([squared(x, y) for y in c], axis=1)
    own = d.argmin(axis=1)  # the first of equals
    d = root(d)
    upper = d[np.arange(len(x)), own]
    d[np.arange(len(x)), own] = np.inf
    lower = np.stack([d[:, group == g].min(axis=1) if (group == g).any() else np.full(len(x), np.inf) for g in range(group.max() + 1)], axis=1)
    return own, upper, _below(lower)


def next_state(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, moved: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids have moved to c, each as far as `moved` says."""
    own = own.copy()
    upper = upper + moved[own]
    lower = _below(lower - np.array([moved[group == g].max(initial=0) for g in range(lower.shape[1])]))
    # Globally: who can have another centroid as near as its own, first by the old bound, then by the true distance.
    near = lambda at: at[lower[at].min(axis=1) <= upper[at] * (1 + SLACK)]
    at = near(np.arange(len(x)))
    best = squared(x[at], c[own[at]])
    upper[at] = root(best)
    still = np.isin(at, near(at), assume_unique=True)
    at, best = at[still], best[still]
    was, was_d = own[at], upper[at]
    now = was.copy()
    for g in range(lower.shape[1]):
        # By group: those whose bound is not above.
        there = np.flatnonzero(lower[at, g] <= was_d * (1 + SLACK))
        lower[at[there], g] = np.inf
        for j in np.flatnonzero(group == g):
            i = there[was[there] != j]
            d = squared(x[at[i]], c[j])
            wins = (d < best[i]) | ((d == best[i]) & (j < now[i]))
            # Of each two centroids the farther one counts as another one, in its own group.
            far = np.where(wins, root(best[i]), root(d))
            side = np.where(wins, group[now[i]], g)
            lower[at[i], side] = np.minimum(lower[at[i], side], _below(far))
            best[i], now[i] = np.where(wins, d, best[i]), np.where(wins, j, now[i])
    # The centroid that was left is another one now; a scan of its group after another one had won has passed it over.
    left = now != was
    side = group[was[left]]
    lower[at[left], side] = np.minimum(lower[at[left], side], _below(was_d[left]))
    own[at], upper[at] = now, root(best)
    return own, upper, lower


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, groups: int = 4) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector that takes part.

    Each round assigns all vectors and moves each centroid to the floor of its vectors' mean; then all are assigned once
    more. The state of a round is a written table; k centroids and k sums are all that comes to the driver.
    """
    spark = table.sparkSession
    state = written(scaled_vectors(table, scale, dims), "vectors")
    c = first_centroids(state, k)
    if not len(c):
        return state.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    group, moved = grouped(c, groups), None
    easy = state.where(F.exists("v", lambda x: F.abs(x) > EASY)).limit(1).count() == 0
    part = (lambda x: x) if easy else (lambda x: x.cast("decimal(20,0)"))
    id_type = state.schema["vec_id"].dataType.simpleString()
    for last in [False] * rounds + [True]:

        def assigned(batches: Iterator[pd.DataFrame], c=c, moved=moved, last=last) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy()).astype(np.int64)
                if moved is None:
                    own, upper, lower = first_state(x, c, group)
                else:
                    own, upper, lower = next_state(x, b["cluster"].to_numpy(), b["upper"].to_numpy(), np.stack(b["lower"].to_numpy()), c, moved, group)
                if last:
                    yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": own, "distance": [d if d <= LONGEST else None for d in squared(x, c[own]).tolist()]}).astype({"distance": object})
                else:
                    yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "cluster": own, "upper": upper, "lower": list(lower)})

        columns = f"vec_id {id_type}, cluster int, distance long" if last else f"vec_id {id_type}, v array<long>, cluster int, upper double, lower array<double>"
        state = written(state.mapInPandas(assigned, columns), "assigned")
        if not last:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(part(F.col("v")[i])) for i in range(dims)]).alias("s")).collect()
            before, c = c, c.copy()
            for r in sums:
                c[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
            moved = root(squared(c, before)) * (1 + SLACK)
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    held = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(whole.alias("s")).collect()}
    fits = lambda n: int(n) if n is not None and n <= LONGEST else None
    total = fits(None if None in held.values() else sum(held.values()))
    named = [(j, fits(held[j]), total, hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(held)]
    each = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # As many rows as centroids.
    return state.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
