"""Multi-party perspective rotation, in DataFrame operations only.

Every participant of a conversation is the assistant once: the dialogue is rendered with that speaker's turns as the
assistant's and all others as named users, and the loss mask covers the assistant's turns. The result has one row per
conversation, perspective and turn with its place in the rendered dialogue, so a conversation of any length is rendered
in parallel; the dialogue is the segments in order of `position`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadframe.llm.common import null_safe, ordered, written

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = ("system",)


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
                        text_col: str = "text", system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, chat_role, segment, start, end, mask_start, mask_end.

    Positions and offsets are code points from 0, ends exclusive; the mask (assistant text and its end mark) is
    empty, at the segment's end, for other turns. Speakers in `system` keep the system role and have no perspective; a conversation of such turns
    alone gives no rows. A null speaker is called "unknown", a null text is empty, null conversation ids form one
    conversation and null turns come first. Equal turns are ordered by speaker and a hash of the text; repeated rows are
    rendered each. Template marks inside a text or a name are broken up by spaces, line breaks in a name become spaces;
    `speaker` and `perspective` keep the name as it is. Other columns are ignored, so their names cannot clash.
    """
    mark = r"<\|(im_start|im_end)\|>"
    name = F.regexp_replace(F.regexp_replace("speaker", mark, "< |$1| >"), r"[\n\r]", " ")
    t = written(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                             F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
                             F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), mark, "< |$1| >").alias("_text"),
                             F.monotonically_increasing_id().alias("_row")))
    # places are found without the texts, which join at the end
    slim = t.select("_row", "conv_id", "turn", "speaker", F.length("_text").alias("_chars"), F.xxhash64("_text").alias("_mark"))
    is_system = F.col("speaker").isin(*system)
    people = slim.filter(~is_system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    role = F.when(is_system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(START), "chat_role", F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    size = F.length(head) + F.col("_chars") + len(END) + 1
    views = null_safe(slim, people, ["conv_id"]).withColumn("chat_role", role).withColumn("_size", size.cast("bigint")).drop("_chars")
    placed = ordered(views, ["conv_id", "perspective"], ["turn", "speaker", "_mark", "_row"], "position", {"start": "_size"}).drop("speaker", "turn", "conv_id")
    full = placed.join(t, "_row").withColumn("_head", head)
    masked = F.col("chat_role") == "assistant"
    return full.select("conv_id", "perspective", "position", "turn", "speaker", "chat_role", F.concat("_head", "_text", F.lit(END + "\n")).alias("segment"), "start",
                       (F.col("start") + F.col("_size")).alias("end"),
                       (F.col("start") + F.when(masked, F.length("_head")).otherwise(F.col("_size"))).alias("mask_start"),
                       (F.col("start") + F.col("_size") - F.when(masked, 1).otherwise(0)).alias("mask_end"))
