"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and adjacent turns of one role are merged. The text form of a
merged turn is::

    ### role:
    first text</part>second text</turn>

A control string inside a role or a text is broken by one backslash ("##\\# ", "<\\/turn>", "<\\/part>"; a control string that
already holds backslashes gets one more), so `parse` gives back every role and text exactly.

Long conversations are collected in two steps: first runs inside slices of `SLICE` turn numbers, then the runs. The final
row of a conversation holds all of it, as that row is the result asked for.

Defined cases: null role or text counts as empty; null turn numbers come first; rows of equal turn number are ordered by
role and text; repeated rows stay; a null conv_id is a conversation of its own; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NAMED, PART, CLOSE = "### ", ":\n", "</part>", "</turn>\n"
SLICE = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"##(\\*)# ", r"##$1\\# "), r"<(\\*)/(turn|part)>", r"<$1\\/$2>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)/(turn|part)>", r"<$1/$2>"), r"##\\(\\*)# ", r"##$1# ")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r":(\\*)\n", ":$1\\\\\n")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r":\\(\\*)\n", ":$1\n"))


def _starts(items: Column) -> Column:
    """Positions (from 1) at which a run of one role begins."""
    return F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: (i == 1) | (F.get(items, i - 1)["role"] != F.get(items, i - 2)["role"]))


def _runs(items: Column, starts: Column) -> Column:
    """Adjacent items (role, parts) of one role become one."""
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(items) + 1)
    return F.transform(starts, lambda i, k: F.struct(
        F.get(items, i - 1)["role"].alias("role"), F.flatten(F.transform(F.slice(items, i, end(k) - i), lambda x: x["parts"])).alias("parts")))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, parts), adjacent turns of one role merged."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array(F.coalesce("text", F.lit(""))).alias("parts"))
    sliced = (rows.groupBy("conv_id", F.floor(F.col("turn") / SLICE).alias("part"))
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("items"))
              .withColumn("starts", _starts(F.col("items")))
              .select("conv_id", "part", _runs(F.col("items"), F.col("starts")).alias("runs")))
    whole = (sliced.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "runs"))), lambda x: x["runs"])).alias("items"))
             .withColumn("starts", _starts(F.col("items"))))
    return whole.select("conv_id", _runs(F.col("items"), F.col("starts")).alias("turns"))


def format_chats(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, segments (text, loss) and formatted, which is all segments joined. Loss is true on the texts of role `learn`."""
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def one(turn: Column) -> Column:
        parts = F.transform(turn["parts"], lambda p, i: F.array(segment(F.when(i > 0, PART).otherwise(""), no), segment(escape(p), turn["role"] == learn)))
        return F.concat(F.array(segment(F.concat(F.lit(OPEN), escape_role(turn["role"]), F.lit(NAMED)), no)), F.flatten(parts), F.array(segment(F.lit(CLOSE), no)))

    made = turns(conversations).select("conv_id", F.flatten(F.transform("turns", one)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """Array of (role, parts) of a formatted conversation."""
    pieces = F.split(formatted, CLOSE, -1)

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, NAMED, 1)
        body = piece.substr(F.length(role) + len(NAMED) + 1, F.length(piece))
        return F.struct(unescape_role(role.substr(F.lit(len(OPEN) + 1), F.length(role))).alias("role"), F.transform(F.split(body, PART, -1), unescape).alias("parts"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)
