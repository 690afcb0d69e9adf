"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

The tree is built over distinct texts: rows with equal texts are one point with their sum of sizes and the metadata of one
of them, so no cut divides them. Points are placed on a grid of metadata dimensions (categories by a hash, numbers by
their logarithm). A node that has to hold k shards is cut at the byte weighted quantile floor(k/2) / k along the dimension
whose points spread widest in it; a side gets as many of the k shards as its bytes come to. Ties on the dimension are
ordered by a hash of the text, so a value that holds a third of all rows is cut as finely as any other. A group of equal
texts that is as large as a shard is a shard by itself, before the tree is built over the others.

Cuts are found by narrowing histograms: a pass sums bytes per (node, cell) with map-side aggregation, a window over the
cells of a node picks the cell that the quantile falls into, and only one row per node comes to the driver. Passes read a
compact table (id, size, keys, node) in the shared folder, written once a level, never the texts.

Nulls: a null text has no bytes (its size is the overhead per row) and is equal to other null texts, a null dimension
sorts first, a null id is an id. Repeated rows are rows each. An empty table gives no rows. `shard_rows` keeps further
columns of the input; a column named `shard` raises a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import few, prefix_index, values, written

#: Bits of a key: dimension, hash of the text.
DIM_BITS, TEXT_BITS = 21, 42
CELLS = 1024
ROW_OVERHEAD = 8


def position(kind: T.DataType, c: Column) -> Column:
    """A value's place on its dimension, from 0 to 2**DIM_BITS - 1; null is 0."""
    top = 2**DIM_BITS - 1
    if isinstance(kind, T.NumericType):
        x = F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.least((F.log2(x + 1) * 2 ** (DIM_BITS - 6)).cast("long"), F.lit(top))
    return F.coalesce(F.shiftrightunsigned(F.crc32(c.cast("string").cast("binary")), 32 - DIM_BITS), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    """What tells texts apart; a null text has one of its own."""
    return F.coalesce(F.xxhash64(text, F.octet_length(text)), F.lit(0))


def points(docs: DataFrame, dims: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32, h (hash of the text) and keys _k0.. of every row; rows with equal texts have equal keys."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_OVERHEAD).cast("long")
    place = F.struct(*[position(kinds[d], F.col(d)).alias(f"d{i}") for i, d in enumerate(dims)])
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    base = written(docs.select(F.col(id_col), size.alias("size"), crc.alias("text_crc32"), text_hash(F.col(text_col)).alias("h"), place.alias("place")), "shard-rows")
    # Only groups whose rows differ in metadata need the place of one of them.
    differ = base.groupBy("h").agg(F.min("place").alias("_place"), F.max("place").alias("_top")).where("_place <> _top").select(F.col("h").alias("_h"), "_place")
    base = base.join(few(written(differ, "shard-groups")), F.col("h") == F.col("_h"), "left").withColumn("place", F.coalesce("_place", "place"))
    tie = F.col("h").bitwiseAND(2**TEXT_BITS - 1)
    keys = [F.shiftleft(F.col(f"place.d{i}"), TEXT_BITS).bitwiseOR(tie).alias(f"_k{i}") for i in range(len(dims))]
    return base.select(id_col, "size", "text_crc32", "h", *keys)


def large_groups(base: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hashes of the texts whose rows fill a shard each, largest first, and the bytes of all rows. At most `shards` rows come here."""
    total = base.agg(F.sum("size")).first()[0] or 0
    left, found = total, []
    sums = base.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * shards >= total)
    # A group smaller than a shard's share of everything can still be a share of what larger groups leave, so look again.
    while len(found) < shards - 1:
        more = sums.where(~F.col("h").isin(found)).orderBy(F.desc("bytes"), "h").limit(shards).collect() if found else sums.orderBy(F.desc("bytes"), "h").limit(shards).collect()
        took = 0
        for r in more:
            if len(found) < shards - 1 and r["bytes"] * (shards - len(found)) >= left:
                found.append(r["h"])
                left -= r["bytes"]
                took += 1
        if not took:
            break
        sums = base.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (shards - len(found)) >= left)
    return found, total


def assign_shards(docs: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0005) -> DataFrame:
    """id, size, text_crc32, h and shard for every row, from a tree of `shards` leaves or of leaves of about `target_bytes`."""
    spark = docs.sparkSession
    base = written(points(docs, dims, id_col, text_col).withColumn("_node", F.lit(0)), "shard-keys")
    total = base.agg(F.sum("size")).first()[0]
    if total is None:
        return base.select(id_col, "size", "text_crc32", "h", F.lit(0).alias("shard"))
    leaves = shards or max(1, round(total / target_bytes))
    alone, _ = large_groups(base, leaves)
    # Groups that fill a shard have nodes of their own, -1, -2 and so on.
    own = F.coalesce(*[F.when(F.col("h") == F.lit(h), -1 - i) for i, h in enumerate(alone)], F.col("_node"))
    current = written(base.withColumn("_node", own), "shard-nodes") if alone else base

    low = TEXT_BITS
    spread = [F.struct(F.min(f"_k{i}").alias("lo"), F.max(f"_k{i}").alias("hi")).alias(f"_k{i}") for i in range(len(dims))]
    nodes = {0: leaves - len(alone)}  # node to the number of its leaves
    order = {0: (0,)}  # node to its way from the root, which orders the leaves
    root = None
    while True:
        # One row for each node that is cut further, of which there are fewer than leaves.
        waiting = [n for n, k in nodes.items() if k > 1]
        if not waiting:
            break
        found = {r["_node"]: r for r in current.where(F.col("_node").isin(waiting)).groupBy("_node").agg(F.sum("size").alias("bytes"), *spread).collect()}
        root = root or found.get(0)
        cuts = {}  # node to (dimension, lo, hi, bytes below lo, bytes wanted below the cut)
        for n in waiting:
            # A node without rows (fewer texts than shards) or with one text can't be cut.
            if n not in found or found[n]["_k0"]["lo"] == found[n]["_k0"]["hi"]:
                nodes[n] = 1
                continue
            wide = [((found[n][f"_k{i}"]["hi"] >> low) - (found[n][f"_k{i}"]["lo"] >> low)) / max(1, (root[f"_k{i}"]["hi"] >> low) - (root[f"_k{i}"]["lo"] >> low)) for i in range(len(dims))]
            d = max(range(len(dims)), key=lambda i: (wide[i], -i))
            cuts[n] = (d, found[n][f"_k{d}"]["lo"], found[n][f"_k{d}"]["hi"], 0, found[n]["bytes"] * (nodes[n] // 2) / nodes[n])
        if not cuts:
            break
        at = weighted_cuts(current, dict(cuts), tolerance * total / leaves)
        side = values(spark, "_n INT, _d INT, _at LONG", [(n, cuts[n][0], key) for n, (key, _) in at.items()])
        key = F.coalesce(*[F.when(F.col("_d") == i, F.col(f"_k{i}")) for i in range(len(dims))])
        split = current.join(F.broadcast(side), F.col("_node") == F.col("_n"), "left").withColumn("_node", F.when(F.col("_n").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + F.when(key < F.col("_at"), 1).otherwise(2)))
        current = written(split.select(*current.columns), "shard-nodes")
        for n, (_, below) in at.items():
            k = nodes.pop(n)
            left = min(k - 1, max(1, round(k * below / found[n]["bytes"])))
            nodes[2 * n + 1], nodes[2 * n + 2] = left, k - left
            order[2 * n + 1], order[2 * n + 2] = (*order[n], 0), (*order[n], 1)
    # Leaves are numbered from left to right, shards of one group last.
    numbers = [(n, i) for i, n in enumerate(sorted(nodes, key=order.get))] + [(-1 - i, len(nodes) + i) for i in range(len(alone))]
    leaf = values(spark, "_n INT, shard INT", numbers)
    return current.join(F.broadcast(leaf), F.col("_node") == F.col("_n")).select(id_col, "size", "text_crc32", "h", "shard")


def weighted_cuts(current: DataFrame, cuts: dict[int, tuple], tolerance: float) -> dict[int, tuple[int, int]]:
    """Of each node the key at which the rows below it weigh as wanted, to within `tolerance` bytes or one text, and their bytes."""
    spark, done, n_dims = current.sparkSession, {}, sum(c.startswith("_k") for c in current.columns)
    top = {n: c[2] for n, c in cuts.items()}
    while cuts:
        spec = values(spark, "_n INT, _d INT, _lo LONG, _hi LONG, _w LONG, _base DOUBLE, _want DOUBLE", [(n, d, lo, hi, (hi - lo) // CELLS + 1, below, want) for n, (d, lo, hi, below, want) in cuts.items()])
        key = F.coalesce(*[F.when(F.col("_d") == i, F.col(f"_k{i}")) for i in range(n_dims)])
        cells = (
            current.join(F.broadcast(spec), F.col("_node") == F.col("_n"))
            .withColumn("_key", key)
            .where(F.col("_key").between(F.col("_lo"), F.col("_hi")))
            .groupBy("_n", "_base", "_want", F.expr("(_key - _lo) div _w").alias("_cell"))
            .agg(F.sum("size").alias("_bytes"), F.min("_key").alias("_min"), F.max("_key").alias("_max"))
        )
        upto = F.sum("_bytes").over(Window.partitionBy("_n").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        last = F.max("_cell").over(Window.partitionBy("_n"))
        picked = cells.withColumn("_upto", F.col("_base") + upto).withColumn("_last", last).where((F.col("_upto") >= F.col("_want")) | (F.col("_cell") == F.col("_last")))
        for r in picked.groupBy("_n").agg(F.min_by(F.struct("_upto", "_bytes", "_min", "_max"), "_cell").alias("c")).select("_n", "c.*").collect():
            d, lo, hi, _, want = cuts.pop(r["_n"])
            below = r["_upto"] - r["_bytes"]
            # No side may stay empty: there is something below the cut, and the last text isn't.
            begins, ends = below == 0, r["_max"] == top[r["_n"]]
            if r["_min"] == r["_max"] or (r["_bytes"] <= tolerance and not begins and not ends):
                first = ends or (not begins and want - below <= r["_upto"] - want)
                done[r["_n"]] = (r["_min"], below) if first else (r["_max"] + 1, r["_upto"])
            else:
                cuts[r["_n"]] = (d, r["_min"], r["_max"], below, want)
    return done


def with_slots(assigned: DataFrame, id_col: str = "doc_id", rows_per_task: int = 4096) -> DataFrame:
    """Adds `slot`: a gapless number from 0 in each shard."""
    shards, rows = assigned.agg(F.countDistinct("shard"), F.count("*")).first()
    return prefix_index(assigned, ["shard"], id_col, [id_col, "h"], None, "slot", max(4, -(-rows // (max(1, shards) * rows_per_task))))


def shard_rows(docs: DataFrame, dims: list[str], id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """docs with `shard`, ready for a write partitioned by it."""
    if "shard" in docs.columns:
        raise ValueError("the column shard is there already")
    found = assign_shards(docs, dims, id_col=id_col, text_col=text_col, **tree).groupBy(F.col("h").alias("__h")).agg(F.min("shard").alias("__shard"))
    # One row for each different text: the join is shuffled at every size.
    return docs.join(found.hint("merge"), text_hash(F.col(text_col)) == F.col("__h")).select(*[F.col(c) for c in docs.columns], F.col("__shard").alias("shard"))
