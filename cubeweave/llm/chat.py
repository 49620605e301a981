"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns are the assistant's and are trained on,
the others are users with names. A rendering is cut into parts of PART turns, so that no dialogue, however
long, has to fit one row; the parts in order make up the whole rendering.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeweave.ranking import rank_in_groups

PART = 64
END = "<|end|>\n"


def escaped_text(c: Column) -> Column:
    r"""Text in which no marker can stand: `<|` becomes `<\|` and `<\` becomes `<\\`; original_text() undoes it."""
    return F.replace(F.replace(c, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(c: Column) -> Column:
    r"""A role on one line and without bars: `\`, `|` and line feed become `\\`, `\p` and `\n`."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


def original_text(text: str) -> str:
    """What escaped_text() was given."""
    return re.sub(r"<\\([\\|])", r"<\1", text)


def render(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, speaker, part, n_turns, n_trained, text, masks for every participant of every conversation.

    Turns are ordered by turn number, then role, then text; rows that agree in all are interchangeable. A turn is
    rendered as `<|assistant|>\\n` or `<|user name=ROLE|>\\n`, its text and `<|end|>\\n`. masks are the
    (start, end) code points of the part's text that are trained on: the speaker's texts with their end marks.
    Null turn numbers sort first, null texts are empty, null roles are the participant `unknown`, null conv_ids
    one conversation. Roles and texts that hold markers are escaped, so no turn can be forged; texts and dialogues of
    any length are rendered whole. An empty table gives no rows; extra columns are ignored.
    """
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("__rid"),
    )
    ranked = rank_in_groups(turns, ["conv_id"], ["turn", "role", "text", "__rid"], name="pos")
    # parts lie by these keys, and each part's speakers come to them, so texts are not shuffled again
    keyed = ranked.select(F.coalesce("conv_id", F.lit(0).cast("long")).alias("__c"), F.col("conv_id").isNull().alias("__n"), F.expr(f"pos div {PART}").alias("part"), "pos", "role", "text")
    parts = keyed.groupBy("__c", "__n", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    speakers = keyed.select("__c", "__n", F.col("role").alias("speaker")).distinct().join(keyed.select("__c", "__n", "part").distinct(), ["__c", "__n"])
    views = parts.join(speakers, ["__c", "__n", "part"]).withColumn("conv_id", F.when(~F.col("__n"), F.col("__c")))
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped_role(t["role"]), F.lit("|>\n")))
    body = lambda t: F.concat(escaped_text(t["text"]), F.lit(END))
    cut = views.select("conv_id", "speaker", "part", F.transform("turns", lambda t: F.struct(own(t).alias("own"), head(t).alias("head"), body(t).alias("body"))).alias("cut"))
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    masks = F.aggregate(
        "cut", F.struct(F.lit(0).cast("long").alias("at"), F.array(span).alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(t["own"], F.array_append(s["spans"], F.struct((s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))).otherwise(s["spans"]).alias("spans"),
        ), lambda s: F.slice(s["spans"], F.lit(2), F.size(s["spans"])),
    )
    text = F.array_join(F.transform("cut", lambda t: F.concat(t["head"], t["body"])), "")
    return cut.select("conv_id", "speaker", "part", F.size("cut").cast("long").alias("n_turns"), F.size(F.filter("cut", lambda t: t["own"])).cast("long").alias("n_trained"), text.alias("text"), masks.alias("masks"))
