"""Chat formatting by perspective rotation, in DataFrame functions only.

Each dialogue is rendered once per participant: that speaker's turns as the assistant's, the others'
as users named after them, system turns as they are.  The loss mask covers the assistant's text and
its end mark.  Output is one row per perspective and turn with its place in the rendered dialogue,
so a dialogue of any length is never gathered in one task: the turns are range-partitioned and
summed per partition and dialogue, and the totals (a row per dialogue and partition) carry over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccat.llm.common import materialize

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _segment(header: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), header, F.lit("\n"), text, F.lit(END))


def rotate_perspectives(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
                        text_col: str = "text", system: str = SYSTEM) -> DataFrame:
    """``conv_id, perspective, turn, turn_no, speaker, role, segment, start, end, mask_start, mask_end``.

    ``start`` and ``end`` are code points in the dialogue as rendered for ``perspective`` (the
    concatenation of its segments by ``turn_no``); the mask columns are null on turns that take no
    loss.  Turns are ordered by turn, speaker, text; null turns come first; repeated rows are
    separate turns.  Null texts count as empty; a null speaker is the user 'unknown', a participant
    like others; a dialogue of system turns alone has no participant and gives no rows; a null id
    is a dialogue of its own kind, kept.  Only the four named columns are read.
    """
    lean = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "speaker", "text"]
    lean = lean.withColumn("m", F.monotonically_increasing_id())
    placed = lean.repartitionByRange(*order, "m").sortWithinPartitions(*order, "m")
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "turns")
    is_system = F.col("speaker") == system
    other = F.when(is_system, F.lit(system)).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    sized = placed.withColumns({
        "as_other": F.length(_segment(other, F.col("text"))).cast("long"),
        "as_self": F.length(_segment(F.lit("assistant"), F.col("text"))).cast("long")})
    local = Window.partitionBy("part", "conv_id").orderBy("turn", "speaker", "text", "m").rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.withColumns({"b": F.coalesce(F.sum("as_other").over(local), F.lit(0)), "n": F.count(F.lit(1)).over(local)})
    # Per dialogue and partition: rows of all its partitions before.  One row each.
    carried = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sized.groupBy("conv_id", "part").agg(F.sum("as_other").alias("z"), F.count(F.lit(1)).alias("c")).select(
        F.col("conv_id").alias("kc"), F.col("part").alias("kp"),
        F.coalesce(F.sum("z").over(carried), F.lit(0)).alias("cb"), F.coalesce(F.sum("c").over(carried), F.lit(0)).alias("cn"))
    spoken = sized.filter(~is_system).groupBy("conv_id", "speaker").agg(F.lit(1).alias("one")).select(
        F.col("conv_id").alias("pc"), F.col("speaker").alias("perspective"))
    rows = summed.join(carry, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("part") == F.col("kp"))).drop("kc", "kp")
    wide = rows.join(spoken, F.col("conv_id").eqNullSafe(F.col("pc"))).drop("pc")
    diff = F.when(F.col("speaker") == F.col("perspective"), F.col("as_self") - F.col("as_other")).otherwise(F.lit(0))
    local_view = Window.partitionBy("part", "conv_id", "perspective").orderBy("turn", "speaker", "text", "m").rowsBetween(Window.unboundedPreceding, -1)
    carried_view = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # What a speaker's own turns differ by, per partition; every partition of the dialogue gets a row.
    view = sized.filter(~is_system).groupBy("conv_id", "speaker", "part").agg(F.sum(F.col("as_self") - F.col("as_other")).alias("d"))
    parts = sized.select("conv_id", "part").distinct()
    grid = parts.join(spoken, F.col("conv_id").eqNullSafe(F.col("pc"))).drop("pc")
    shift = grid.join(view.select(F.col("conv_id").alias("vc"), F.col("speaker").alias("vs"), F.col("part").alias("vp"), "d"),
                      F.col("conv_id").eqNullSafe(F.col("vc")) & (F.col("perspective") == F.col("vs")) & (F.col("part") == F.col("vp")), "left").select(
        F.col("conv_id").alias("sc"), F.col("perspective").alias("sp"), F.col("part").alias("spart"),
        F.coalesce(F.sum(F.coalesce("d", F.lit(0))).over(carried_view), F.lit(0)).alias("cd"))
    full = wide.withColumn("diff", F.coalesce(F.sum(diff).over(local_view), F.lit(0))).join(
        shift, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("perspective") == F.col("sp")) & (F.col("part") == F.col("spart")))
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(mine, F.lit("assistant")).otherwise(other)
    start = F.col("b") + F.col("cb") + F.col("diff") + F.col("cd")
    size = F.when(mine, F.col("as_self")).otherwise(F.col("as_other"))
    head = len(BEGIN) + len("assistant") + 1
    return full.select("conv_id", "perspective", "turn", (F.col("n") + F.col("cn")).alias("turn_no"), "speaker", role.alias("role"),
                       _segment(role, F.col("text")).alias("segment"), start.alias("start"), (start + size).alias("end"),
                       F.when(mine, start + head).alias("mask_start"), F.when(mine, start + size - 1).alias("mask_end"))
