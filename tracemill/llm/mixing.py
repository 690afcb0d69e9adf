"""Mixing sources to target weights with fixed-length blocks and pseudorandom index permutations.

The words of a source, document after document in hashed order, are packed into blocks of a fixed number of words. A
source that shall give T words gives whole passes over its blocks and then a part of a further pass; every pass has its
own pseudorandom permutation of the block indexes (swap-or-not rounds over a hash). Over the output shards a source's slots
are dealt in multinomial counts, their sum fixed at the target: the slots of a group of shards are halved again and again by
as many hashed bits as there are slots. Each shard gets its run of slots, which the permutation has mapped to random blocks.
Slots find their blocks by a join on (source, block index); the last slot is cut to the words still wanted.

Only integer and hash functions of Spark are used, so reruns agree. Offsets are summed in parallel within a source, so
a source with a third of all rows is no single task. Targets need one row per source.

Nulls: a null source is a source of its own, last in order; a null text has no words, is in no block and is never taken.
Empty tables give no rows. Further columns are not carried, so none can clash; rows that repeat an id, or id and text,
are mixed each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import few, prefix_index, split_words, written

SPACES = r"\x20\x09-\x0D"
#: Rounds of a permutation, and slots that one task makes.
ROUNDS, TASK_SLOTS = 12, 200_000


def count_words(text: Column) -> Column:
    return F.size(split_words(F.coalesce(text, F.lit("")), SPACES)).cast("long")


def target_words(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with `target`: `share` of all words by weight, at most `most` times the source's size.

    Sources are few enough for a window over all of them (one row each). What a capped source can't give is dealt again
    by weight: the sources below the cap get weight * level, where the level solves the sum, so it is found from the
    running sums in the order in which sources reach the cap.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rank = F.row_number().over(by_code) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    x = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_capped", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))).withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    # If the sources before this one are capped and the rest share what is left, this would be the level.
    x = x.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    level = F.min(F.when(fits, F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("l")))).over(everything).getField("l")
    return x.withColumn("_l", level).withColumn("target", F.when(F.col("_l").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_l")))).select("source", "source_size", "target")


def permuted(index: Column, blocks: Column, source: Column, turn: Column, seed: int) -> Column:
    """The place of a block index in the pass `turn`, a pseudorandom permutation of 0 to blocks - 1.

    Swap-or-not: each round pairs x with (key - x) mod blocks and swaps the two or not by a hash of the pair, which is a
    bijection for any number of blocks.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), source, turn, r), blocks) - x, blocks)
        return F.when(F.pmod(F.xxhash64(F.lit(seed + 1), source, turn, r, F.greatest(x, other)), F.lit(2)) == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


#: Words of 64 bits that one row counts.
WORDS = 4096


def shard_ends(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, ends): of each source's n_slots, dealt over the shards (a power of two) in multinomial counts, the number of
    slots up to the end of each shard. A row of counts for each source and shard is all that is moved."""
    nodes = sources.select("source", F.lit(1).alias("node"), F.col("n_slots").alias("n"))
    k = shards
    while k > 1:
        chunks = nodes.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / (64 * WORDS)))))
        words = F.least(F.lit(WORDS), F.ceil(F.col("n") / 64) - F.col("c") * WORDS)

        def ones(a: Column, i: Column) -> Column:
            word = F.col("c") * WORDS + i
            left = F.least(F.lit(64), F.col("n") - word * 64).cast("int")
            # The last word has fewer bits.
            mask = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - left)
            return a + F.bit_count(F.xxhash64(F.lit(seed), "source", "node", word).bitwiseAND(mask))

        bits = F.when(F.col("n") > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), words - 1), F.lit(0).cast("long"), lambda a, i: a + ones(F.lit(0).cast("long"), i)))
        half = chunks.groupBy("source", "node", "n").agg(F.coalesce(F.sum(bits), F.lit(0)).alias("l"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("l")).alias("n")))
        nodes = half.select("source", F.explode(sides).alias("s")).select("source", "s.*")
        k //= 2
    counts = F.transform(F.array_sort(F.collect_list(F.struct("node", "n"))), lambda x: x["n"])
    upto = F.aggregate("counts", F.array().cast("array<long>"), lambda a, n: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n))
    return nodes.groupBy("source").agg(counts.alias("counts")).select("source", upto.alias("ends"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, block_words: int = 128, output_shards: int = 64, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, drawn): the documents with size, source_size and target; the pieces drawn.

    drawn: output_shard, source, slot, turn, block, doc_id, _from (the document's first word within its source, which tells
    rows with the same id apart), first_word (in the document), words. There are 64 output shards at most, a power of two.
    """
    if output_shards not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("output_shards has to be a power of two, 64 at most")
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_text")), "mix-sizes")
    # Sources are categories: targets are computed over one row each.
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = written(target_words(per_source, weights, share, most).join(few(per_source.select(F.col("source").alias("_s"), "_rows")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-targets")
    largest = sources.agg(F.max("_rows")).first()[0] or 0
    placed = prefix_index(sized, ["source"], "doc_id", ["doc_id", "size", "_text"], "size", "_from", min(20_000, max(4, -(-largest // 512))))
    placed = placed.join(few(sources.select(F.col("source").alias("_s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    length = F.lit(block_words).cast("long")
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"_from div {block_words}"), F.expr(f"(_from + size - 1) div {block_words}"))))
        .withColumn("_begin", F.greatest(F.col("_from"), F.col("block") * length))
        .withColumn("_end", F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * length))
        .select("source", "block", "doc_id", (F.col("_begin") - F.col("_from")).alias("first_word"), (F.col("_begin") - F.col("block") * length).alias("_at"), (F.col("_end") - F.col("_begin")).alias("words"), "_from")
    )
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    wanted = sources.where("source_size > 0").withColumn("blocks", blocks).withColumn("_whole", F.expr("cast(round(target) AS LONG) div source_size")).withColumn("_rest", F.expr("cast(round(target) AS LONG) % source_size"))
    # Of the last pass the places before `_rest`: blocks of full length, but for the tail, wherever the permutation puts it.
    tail_at, short = permuted(F.col("blocks") - 1, F.col("blocks"), F.col("source"), F.col("_whole").cast("int"), seed), F.col("blocks") * length - F.col("source_size")
    full = F.ceil(F.col("_rest") / block_words)
    last = F.when(full <= tail_at + 1, full).otherwise(F.ceil((F.col("_rest") + short) / block_words))
    dealt = written(wanted.select("source", (F.col("_whole") * F.col("blocks") + last).cast("long").alias("n_slots")), "mix-slots")
    ends = written(shard_ends(dealt, output_shards, seed + 2), "mix-shards").select(F.col("source").alias("_s"), "ends")
    wanted = wanted.join(few(ends), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    n_slots = wanted.agg(F.sum(F.col("blocks") * (F.col("_whole") + 1))).first()[0] or 0
    slots = (
        wanted.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(int(most)))))
        .where(F.col("turn") <= F.col("_whole"))
        .withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(4096).cast("long"))))  # two steps, so that a large source is no single task
        .repartition(max(1, -(-n_slots // TASK_SLOTS)), "source", "turn", "_first")
        .withColumn("_i", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + 4095, F.col("blocks") - 1))))
        .withColumn("_place", permuted(F.col("_i"), F.col("blocks"), F.col("source"), F.col("turn"), seed))
        .withColumn("_tail_place", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("source"), F.col("turn"), seed))
        .withColumn("_tail", F.col("source_size") - (F.col("blocks") - 1) * length)
        .withColumn("_length", F.when(F.col("_i") == F.col("blocks") - 1, F.col("_tail")).otherwise(length))
        .withColumn("_before", F.col("_place") * length - F.when(F.col("_tail_place") < F.col("_place"), length - F.col("_tail")).otherwise(0))
        .withColumn("_take", F.when(F.col("turn") < F.col("_whole"), F.col("_length")).otherwise(F.least(F.col("_length"), F.col("_rest") - F.col("_before"))))
        .where("_take > 0")
        .select(F.col("source").alias("_s"), F.col("_i").alias("_b"), "turn", (F.col("turn") * F.col("blocks") + F.col("_place")).alias("slot"), "_take", "ends")
        .withColumn("output_shard", F.size(F.filter("ends", lambda e: e <= F.col("slot"))))
        .drop("ends")
    )
    # Slots grow with the data, though Spark takes the table of sources that they come from for their size: no broadcast.
    drawn = pieces.hint("merge").join(slots, pieces["source"].eqNullSafe(slots["_s"]) & (pieces["block"] == slots["_b"]) & (pieces["_at"] < slots["_take"]))
    drawn = drawn.select("output_shard", "source", "slot", "turn", "block", "doc_id", "_from", "first_word", F.least(F.col("words"), F.col("_take") - F.col("_at")).alias("words"))
    return placed, drawn


def taken_words(placed: DataFrame, drawn: DataFrame) -> DataFrame:
    """Of every document the words that the mix takes, repeats counted (0 if none), and the number of output shards that they
    are in."""
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("output_shard")))
    sums = drawn.groupBy(F.col("source").alias("_s"), F.col("_from").alias("_f"), F.col("doc_id").alias("_d")).agg(F.sum("words").alias("taken"), F.bit_count(mask).alias("n_shards"))
    # Documents with words have places of their own; those without take nothing.
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_from") == F.col("_f")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") > 0)
    return placed.join(sums, on, "left").select("doc_id", "source", "_text", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


def whole_documents(placed: DataFrame, block_words: int = 128, seed: int = 17) -> DataFrame:
    """The mix in whole documents: `times`, how often each is taken.

    Every document of a source is in each of its whole passes. The pass that ends at the target draws its slots in the order
    of the permutation; a document is drawn with the block that holds its middle word, and documents are taken in that order
    as long as their middle lies before the pass's end, so the words of a source meet its target to within half of the
    document at the end. Documents without words are taken once.
    """
    x = placed.withColumn("_whole", F.expr("cast(round(target) AS LONG) div nullif(source_size, 0)")).withColumn("_rest", F.expr("cast(round(target) AS LONG) % nullif(source_size, 0)"))
    x = x.withColumn("_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    x = x.withColumn("_drawn", permuted(F.expr(f"(_from + size div 2) div {block_words}"), F.col("_blocks"), F.col("source"), F.col("_whole").cast("int"), seed))
    largest = x.agg(F.max("_blocks")).first()[0] or 0
    buckets = min(20_000, max(4, -(-largest // 512)))
    worded = x.where("size > 0")
    at = F.least(F.lit(buckets - 1), F.floor(F.col("_drawn") * buckets / F.col("_blocks")))
    worded = prefix_index(worded, ["source"], "doc_id", ["_drawn", "_from"], "size", "_before_", buckets, at)
    inside = 2 * F.col("_before_") + F.col("size") <= 2 * F.col("_rest")
    taken = worded.withColumn("times", (F.col("_whole") + F.when(inside, 1).otherwise(0)).cast("int")).where("times > 0")
    empty = x.where("size = 0").withColumn("times", F.lit(1))
    return taken.select(*placed.columns, "times").unionByName(empty.select(*placed.columns, "times"))
