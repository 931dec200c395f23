"""Multi-party perspective rotation of dialogues (operator 8, DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that speaker as
``assistant`` and everyone else as a named user; speakers in ``system`` stay system. The
character ranges of the assistant's own texts are the loss mask.

A dialogue is rendered in parts of ``turns_per_part`` turn numbers, so that a conversation
of any length is many rows of bounded size: each part is gathered once, the participants
(one small row per conversation and part) join it on the same keys, and every
perspective is rendered from that row. Texts are shuffled once, whatever the number of
participants. ``part`` orders the parts; mask offsets count from the part's start.

Context. The system turns of a dialogue's first part stand again, masked, before the turns of
every later part (``carried`` of them), so that no part is trained without its
instructions. ``text_offset`` is the place of a part's own turns in the whole dialogue: without
the carried turns the parts join to the whole rendering.

Defined results: a null text renders empty and a null speaker as the user ``unknown``, who is
not a participant; turns with the same number are ordered by speaker and text, and
repeated rows are repeated turns; null turn numbers come first, in part -1; a
conversation whose only speakers are system or null has no perspectives; a null
conversation id is a conversation of its own; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rendering.
OPEN, NAME, BODY, CLOSE = "<|", " name=", "|>\n", "\n<|end|>\n"


def rotate(turns: DataFrame, system: tuple = ("system",), turns_per_part: int = 64, conv_col: str = "conv_id",
           turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_trained, carried, text_offset, text, mask): mask is an
    array of [start, end) character ranges of ``text`` that the model is trained on."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.floor(F.col(turn_col) / turns_per_part), F.lit(-1)).cast("bigint").alias("part"),
        F.struct(F.col(turn_col).alias("turn"), F.col(speaker_col).alias("who"), F.coalesce(F.col(text_col), F.lit("")).alias("said")).alias("t"),
        F.col(speaker_col).alias("who"))
    speakers = rows.where(F.col("who").isNotNull() & ~F.col("who").isin(*system)).select("conv_id", "part", "who").distinct()
    people = speakers.groupBy("conv_id").agg(F.sort_array(F.collect_set("who")).alias("people"))
    places = rows.select("conv_id", "part").distinct().join(
        people.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # the first part's system turns (part -1 holds turns without a number), for the parts after it
    opening = own.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"),
                         F.filter("ts", lambda t: F.coalesce(t["who"].isin(*system), F.lit(False))).alias("lead"))
    opening = opening.groupBy("_conv").agg(F.min_by("lead", "_part").alias("lead"), F.min("_part").alias("first"))
    parts = own.join(opening, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "part", F.when(F.col("part") > F.col("first"), F.concat("lead", "ts")).otherwise(F.col("ts")).alias("ts"),
        F.when(F.col("part") > F.col("first"), F.size("lead")).otherwise(F.lit(0)).alias("carried"))
    # null ids meet under an id of their own, so that the join keeps the keys the parts are dealt by
    seen = parts.join(places.withColumnsRenamed({"conv_id": "_conv", "part": "_part"}),
                      F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")
    me = seen.select("conv_id", "part", "ts", "carried", F.explode("people").alias("perspective"))

    def head(t):
        other = F.concat(F.lit("user"), F.lit(NAME), F.coalesce(t["who"], F.lit("unknown")))
        return F.concat(F.lit(OPEN), F.when(t["who"] == F.col("perspective"), F.lit("assistant")).when(
            t["who"].isin(*system), F.lit("system")).otherwise(other), F.lit(BODY))
    cells = F.transform("ts", lambda t: F.struct(head(t).alias("head"), t["said"].alias("said"),
                                                 t["who"].eqNullSafe(F.col("perspective")).alias("mine")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def walk(a, c):
        start = a["at"] + F.length(c["head"])
        end = start + F.length(c["said"])
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + len(CLOSE)).cast("int").alias("at"),
                        F.when(c["mine"], F.concat(a["mask"], span)).otherwise(a["mask"]).alias("mask"))
    own_size = F.aggregate(F.slice("cells", F.col("carried") + 1, F.greatest(F.size("cells"), F.lit(1))), F.lit(0).cast("bigint"),
                           lambda a, c: a + F.length(c["head"]) + F.length(c["said"]) + len(CLOSE))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # a row a part
    return me.withColumn("cells", cells).withColumn("text_offset", F.coalesce(F.sum(own_size).over(before), F.lit(0))).select(
        "conv_id", "perspective", "part", F.size("cells").alias("n_turns"),
        F.size(F.filter("cells", lambda c: c["mine"])).alias("n_trained"), "carried", "text_offset",
        F.array_join(F.transform("cells", lambda c: F.concat(c["head"], c["said"], F.lit(CLOSE))), "").alias("text"),
        F.aggregate("cells", zero, walk, lambda a: a["mask"]).alias("mask"))
