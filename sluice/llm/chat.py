"""Chat formatting: a dialogue from every participant's perspective.

For each participant of a conversation the dialogue is rendered with that
speaker as ``assistant`` and every other one as a named user; the mask holds
the character spans to train on: the speaker's own words and their end mark.
``system`` turns stay system turns for everybody and are nobody's view.

A conversation is rendered in parts of ``PART_TURNS`` turn numbers, so most
are one row per speaker; the parts of a long one, put together in order of
``part``, are its text. Neither a conversation with a third of all turns nor
one turn number shared by very many rows meets in one task: a part with more
than ``PART_ROWS`` rows is cut further, by turn and hash. Counts and names
are partial aggregates; texts move once.

Defined cases: turns are ordered by turn number, then by the MD5 of role and
text; a null turn number comes last; a row repeated in all of conversation,
turn, role and text is one turn; a null or empty role is the participant
``unknown``; a null text is empty; a null conversation id is a conversation;
marks inside texts and names are defused (``<|im_`` becomes ``< |im_``) and
line breaks in names become spaces; conversations with only system turns give
no rows; an empty table gives an empty result; only the named columns are
read, so further ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

PART_TURNS = 256
PART_ROWS = 4096
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
#: Part number base of turns without a number: after every numbered part.
_LAST = 1 << 40


def _defused(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, F.lit(f"{START}assistant\n")) \
        .when(role == SYSTEM, F.lit(f"{START}system\n")) \
        .otherwise(F.concat(F.lit(f"{START}user name="), role, F.lit("\n")))


def perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """conversation, speaker, part, n_turns, text and mask (array of
    struct<start, end>: code points of this part's text)."""
    name = F.translate(_defused(F.coalesce(quoted(role).cast("string"), F.lit(""))), "\r\n", "  ")
    rows = turns.select(quoted(conversation).alias("conv"), quoted(turn).cast("long").alias("turn"),
                        F.when(name == "", F.lit("unknown")).otherwise(name).alias("role"),
                        _defused(F.coalesce(quoted(text), F.lit(""))).alias("text"))
    speakers = rows.filter(F.col("role") != SYSTEM).select(F.col("conv").alias("c2"), F.col("role").alias("speaker")).distinct()
    rows = rows.withColumn("tie", F.md5(F.concat(F.length("role").cast("string"), F.lit("|"), "role", F.lit("|"), "text"))).dropDuplicates(["conv", "turn", "tie"])
    bucket = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(_LAST))
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy(F.col("conv").alias("c3"), F.col("bucket").alias("b3")).agg(F.count(F.lit(1)).alias("rows")) \
        .filter(F.col("rows") > PART_ROWS).select("c3", "b3")
    place = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(PART_TURNS)) * 4096 + F.conv(F.substring("tie", 1, 3), 16, 10).cast("long")
    parts = rows.join(sizes, F.col("conv").eqNullSafe(F.col("c3")) & (F.col("bucket") == F.col("b3")), "left") \
        .withColumn("part", F.col("bucket") * (PART_TURNS * 4096) + F.when(F.col("b3").isNotNull(), place).otherwise(F.lit(0)))
    turn_first = F.struct(F.col("turn").isNull().alias("late"), "turn", "tie", "role", "text")
    gathered = parts.groupBy("conv", "part").agg(F.sort_array(F.collect_list(turn_first)).alias("turns"))
    views = gathered.join(speakers, F.col("conv").eqNullSafe(F.col("c2")))
    speaker = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct(
        _head(t["role"], speaker).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
        (t["role"] == speaker).alias("own")))
    views = views.withColumn("pieces", pieces)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], F.array(span)))
                        .otherwise(acc["mask"]).alias("mask"))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    mask = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("mask")), step, lambda acc: acc["mask"])
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return views.select(F.col("conv").alias(conversation), "speaker", "part", F.size("turns").alias("n_turns"),
                        body.alias("text"), mask.alias("mask"))
