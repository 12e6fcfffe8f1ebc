"""Chat formatting by multi-party perspective rotation.

Every dialogue is rendered once for each of its participants: that speaker is the assistant, whose
words are the targets of training, the others are named users, and context roles stay what they
are.  The rendering is a table of segments, one row per turn and perspective with its place in the
rendered dialogue, so a dialogue with very many turns is many rows, never one value.

Places come from running sums over blocks: turns are range-sorted by dialogue and turn, lengths are
summed inside each range, and the sums of a dialogue's earlier ranges are added.  Only ids and
lengths pass through the windows; texts are attached at the end.

Defined results: a null text counts as empty; a null role speaks as ``unknown``; null turns come
first, equal turns go by role and text; rows without a dialogue id form one dialogue; repeated rows
are turns of their own; a dialogue without participants (context only) has no rendering; further
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.llm.common import partitions, pick
from starledger.session import cut_lineage

CONTEXT_ROLES = ("system",)
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEAD = 32       # leading characters of a text that deal equal turns to ranges


def header(speaker: Column, perspective: Column, context: tuple[str, ...] = CONTEXT_ROLES) -> Column:
    """What stands before a turn: the assistant, a context role, or a named user."""
    role = (F.when(speaker == perspective, F.lit("assistant"))
            .when(speaker.isin(*context), speaker)
            .otherwise(F.concat(F.lit("user name="), speaker)))
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE))


def perspectives(turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role",
                 text: str = "text", context: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """One row per turn and participant.

    (dialogue, perspective, position, speaker, segment, segment_start, mask_start, mask_end):
    positions count turns from 0; places count characters of the rendered dialogue; the mask covers
    the words and the end mark of the participant's own turns and is null elsewhere.
    """
    n = partitions(turns.sparkSession)
    order = [F.col("d"), F.col("t").asc_nulls_first(), F.col("speaker"), F.substring("text", 1, LEAD)]
    placed = cut_lineage(
        pick(turns, d=dialogue, t=turn, speaker=speaker, text=text)
        .select("d", "t", F.coalesce(F.col("speaker").cast("string"), F.lit("unknown")).alias("speaker"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(n, *order)
        .sortWithinPartitions("d", F.col("t").asc_nulls_first(), "speaker", "text")
        .withColumn("at", F.monotonically_increasing_id()), "turns")
    speakers = (placed.filter(~F.col("speaker").isin(*context))
                .select(F.col("d").alias("p_d"), F.col("speaker").alias("perspective")).distinct())
    sized = (placed.select("d", "speaker", "at", F.length("text").alias("chars"))
             .join(speakers, F.col("d").eqNullSafe(F.col("p_d")))
             .select("d", "perspective", "at", F.shiftright("at", 33).alias("block"),
                     (F.length(header(F.col("speaker"), F.col("perspective"), context)) + F.col("chars")
                      + len(END)).cast("bigint").alias("size")))
    inside = Window.partitionBy("d", "perspective", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = sized.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("start"),
                       F.count("*").over(inside).alias("position"))
    # One row per dialogue, participant and range.
    earlier = Window.partitionBy("d", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (sized.groupBy("d", "perspective", "block").agg(F.sum("size").alias("size"), F.count("*").alias("turns"))
              .select(F.col("d").alias("b_d"), F.col("perspective").alias("b_perspective"), F.col("block").alias("b_block"),
                      F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
                      F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before")))
    placed_runs = (run.join(blocks, F.col("d").eqNullSafe(F.col("b_d")) & (F.col("perspective") == F.col("b_perspective"))
                            & (F.col("block") == F.col("b_block")))
                   .select("at", "perspective", (F.col("position") + F.col("turns_before")).alias("position"),
                           (F.col("start") + F.col("before")).alias("segment_start")))
    head = header(F.col("speaker"), F.col("perspective"), context)
    own = F.col("speaker") == F.col("perspective")
    words = F.col("segment_start") + F.length(head)
    return (placed.join(placed_runs, "at")
            .select(F.col("d").alias(dialogue), "perspective", "position", "speaker",
                    F.concat(head, F.col("text"), F.lit(END)).alias("segment"), "segment_start",
                    F.when(own, words).alias("mask_start"),
                    F.when(own, words + F.length("text") + len(END)).alias("mask_end")))
