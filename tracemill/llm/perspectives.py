"""Multi-party perspective rotation, with DataFrame functions only.

Each participant of a conversation gets the dialogue rendered with itself as the assistant and the others as named
users; context roles stay what they are. Spans of the assistant's messages are the training mask.

Messages of a conversation are ranked by (turn, role, text) and rendered in segments of SEGMENT consecutive ones, so a
very long conversation is many rows and no single task; one of up to SEGMENT messages is one row per participant. Every
later segment begins with the conversation's first message of each context role. Ranks come from a range partitioning of
all messages and the sums of its partitions, so a conversation that holds a third of all rows is ranked by many tasks.

Nulls: a null role is the participant `unknown`, a null text is empty, a null turn comes first, a null conv_id is a
conversation of its own. Ties of a turn go by role, then text; repeated rows are rendered each. Without participants
(context roles only) a conversation has no rows. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import written

SEGMENT = 64
#: Messages of one task, and segments of a conversation that meet its participants in one task.
TASK_ROWS, TASK_SEGMENTS = 100_000, 64


def header(role: Column, name: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("|>\n"))


def ranked(said: DataFrame) -> DataFrame:
    """said (conv_id, turn, role, text) with `rank`, gapless from 0 in each conversation."""
    # Equal messages are one row with a count, so that any number of them are ranked at once.
    order = ["conv_id", "turn", "role", "text"]
    distinct = said.groupBy(*order).agg(F.count("*").alias("times"))
    dealt = distinct.repartitionByRange(max(1, -(-said.count() // TASK_ROWS)), *order)
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "dealt-messages")
    sums = dealt.groupBy("conv_id", "part").agg(F.sum("times").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each conversation and partition that it reaches into.
    before = sums.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("times").over(within), F.lit(0)))
    joined = own.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    # Each of the equal messages takes a rank.
    return joined.withColumn("rank", F.explode(F.sequence(F.col("_before") + F.col("_own"), F.col("_before") + F.col("_own") + F.col("times") - 1))).select(*order, "rank")


def rotate(conversations: DataFrame, context_roles: tuple[str, ...] = ("system",), segment: int = SEGMENT) -> DataFrame:
    """conv_id, perspective, segment, messages (role, name, content, train), rendered, mask ((start, end) in characters)."""
    said = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = written(ranked(said), "ranked-messages")
    context = F.col("role").isin(*context_roles)
    lines = F.array_sort(F.collect_list(F.struct("rank", "role", "text")))
    segments = said.withColumn("segment", F.expr(f"rank div {segment}")).groupBy("conv_id", "segment").agg(lines.alias("said"))
    # Participants, and the first message of each context role; both are aggregated before they are shuffled.
    first = said.groupBy("conv_id", "role").agg(F.min(F.struct("rank", "role", "text")).alias("first"), F.max("rank").alias("last"))
    carried = F.array_sort(F.collect_list(F.when(context, F.col("first"))))
    who = first.groupBy(F.col("conv_id").alias("_c")).agg(F.collect_set(F.when(~context, F.col("role"))).alias("who"), carried.alias("carried"), (F.max("last") / (segment * TASK_SEGMENTS)).cast("int").alias("_most"))
    who = who.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_most")))).drop("_most")
    salt = F.expr(f"cast(segment div {TASK_SEGMENTS} AS INT)")
    views = segments.withColumn("_s", salt).join(who, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_s") == F.col("_salt"))).drop("_c", "_s", "_salt")
    earlier = F.filter("carried", lambda m: m["rank"] < F.col("segment") * segment)
    views = views.select("conv_id", "segment", F.concat(earlier, F.col("said")).alias("said"), F.explode("who").alias("perspective"))

    def message(m: Column) -> Column:
        own, context = m["role"] == F.col("perspective"), m["role"].isin(*context_roles)
        role = F.when(own, F.lit("assistant")).when(context, m["role"]).otherwise(F.lit("user"))
        return F.struct(role.alias("role"), F.when(~own & ~context, m["role"]).alias("name"), m["text"].alias("content"), own.alias("train"))

    def step(a: Column, m: Column) -> Column:
        head = header(m["role"], m["name"])
        begin = F.length(a["text"]) + F.length(head)
        span = F.struct(begin.alias("start"), (begin + F.length(m["content"])).alias("end"))
        return F.struct(F.concat(a["text"], head, m["content"], F.lit("\n")).alias("text"), F.when(m["train"], F.concat(a["mask"], F.array(span))).otherwise(a["mask"]).alias("mask"))

    none = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    views = views.withColumn("messages", F.transform("said", message)).withColumn("_r", F.aggregate("messages", none, step))
    return views.select("conv_id", "perspective", "segment", "messages", F.col("_r.text").alias("rendered"), F.col("_r.mask").alias("mask"))
