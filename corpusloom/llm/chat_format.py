"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant and
the others as named users; what the assistant says, with its end mark, is what a loss counts. A dialogue
comes as one row for each turn: its segment, where the segment stands in the dialogue, and the span to
learn from. So a conversation of any length is spread over tasks: places are sums over blocks of turns
first, then within a block. dialogues() joins the segments up.

No text or name can forge a turn: what would be a control token in a text gets a backslash, and names have
their line breaks and backslashes written out. Both can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import parts, read

BEGIN, END, SYSTEM, NOBODY = "<|im_start|>", "<|im_end|>\n", "system", "unknown"
ASSISTANT, NAMED = "assistant", "user name="
#: Turn numbers of a block.
TURNS = 64


def escaped(text: Column) -> Column:
    """A text without control tokens: one more backslash between each `<`, its backslashes if any, and `|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """A name on one line, without control tokens: backslashes doubled, line breaks as \\n and \\r, `<|` as `<\\|`."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("<|", "<\\|")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, perspective, seq, turn, role, segment, start, length, mask_start, mask_length.

    One row for each turn and participant of its conversation; `system` speaks but is no participant, so
    a conversation of system turns alone gives none. Turns go by number, nulls first, equal ones by
    speaker and text. start counts characters of the dialogue before the segment; the mask is the part of
    the segment, by its place in the dialogue, that the assistant wrote (length 0 in others' turns). A
    null speaker is `unknown`, a null text empty; a row of a null conversation is a dialogue by itself;
    repeated rows are turns each. Control tokens in texts and names are escaped. Turns of one number in one
    conversation are one task's. Other columns are not read.
    """
    n = parts(df)
    role = F.coalesce(F.col(role_col), F.lit(NOBODY))
    turns = df.select(F.col(conv_col).alias("_conv"), F.col(conv_col).cast("string").alias("_key"), F.col(turn_col).alias("turn"), role.alias("role"), escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), escaped_name(role).alias("_name"))
    alone = turns.where(F.col("_key").isNull() & (F.col("role") != SYSTEM))
    alone = _rendered(alone.withColumns({"perspective": F.col("role"), "_head": F.lit(f"{BEGIN}{ASSISTANT}\n"), "seq": F.lit(0).cast("bigint"), "start": F.lit(0).cast("bigint")}), conv_col)
    # a turn's length if another speaks for the assistant; the assistant's name makes it longer or shorter
    named = F.when(F.col("role") == SYSTEM, F.col("role")).otherwise(F.concat(F.lit(NAMED), F.col("_name")))
    size = (F.length(named) + F.length("_text") + len(BEGIN) + 1 + len(END)).cast("bigint")
    block = F.floor(F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**62))) / TURNS)
    turns = turns.where(F.col("_key").isNotNull()).withColumns({"_block": block, "_size": size})

    # what stands before a block: characters and turns, and turns of each participant
    sums = turns.groupBy("_key", "_block", "role").agg(F.sum("_size").alias("chars"), F.count("*").alias("turns"))
    before = lambda *by: Window.partitionBy("_key", *by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("_key", "_block").agg(F.sum("chars").alias("chars"), F.sum("turns").alias("turns"))
    blocks = blocks.select("_key", "_block", F.coalesce(F.sum("chars").over(before()), F.lit(0)).alias("_chars"), F.coalesce(F.sum("turns").over(before()), F.lit(0)).alias("_turns"))
    who = sums.where(F.col("role") != SYSTEM).select("_key", F.col("role").alias("perspective")).distinct()
    own = sums.select("_key", "_block", F.col("role").alias("perspective"), "turns")
    places = blocks.join(who, "_key").join(own, ["_key", "_block", "perspective"], "left")
    places = places.withColumn("_own", F.coalesce(F.sum("turns").over(before("perspective")), F.lit(0))).drop("turns")

    # texts are shuffled once; the windows and the join find them dealt by block
    inside = Window.partitionBy("_key", "_block").orderBy(F.col("turn").asc_nulls_first(), "role", "_text")
    rows = turns.repartition(n, "_key", "_block").withColumn("_seq", F.row_number().over(inside) - 1)
    rows = rows.withColumn("_start", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    rows = rows.join(places, ["_key", "_block"])
    mine = F.col("role") == F.col("perspective")
    earlier = F.sum(mine.cast("bigint")).over(Window.partitionBy("_key", "_block", "perspective").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)) - mine.cast("bigint")
    change = F.lit(len(ASSISTANT) - len(NAMED)) - F.length(escaped_name(F.col("perspective")))
    start = F.col("_chars") + F.col("_start") + (F.col("_own") + earlier) * change
    speaker = F.when(F.col("role") == SYSTEM, F.lit(SYSTEM)).when(mine, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(NAMED), F.col("_name")))
    rows = rows.withColumns({"start": start, "_head": F.concat(F.lit(BEGIN), speaker, F.lit("\n")), "seq": F.col("_turns") + F.col("_seq")})
    return _rendered(rows, conv_col).unionByName(alone)


def _rendered(rows: DataFrame, conv_col: str) -> DataFrame:
    """The result's columns of rows with perspective, seq, turn, role, start, _head and _text."""
    mine = F.col("role") == F.col("perspective")
    head = F.length("_head").cast("bigint")
    length = head + F.length("_text") + len(END)
    return rows.select(
        F.col("_conv").alias(conv_col),
        "perspective",
        "seq",
        "turn",
        "role",
        F.concat("_head", "_text", F.lit(END)).alias("segment"),
        "start",
        length.alias("length"),
        F.when(mine, F.col("start") + head).otherwise(F.col("start")).alias("mask_start"),
        F.when(mine, length - head).otherwise(F.lit(0)).cast("bigint").alias("mask_length"),
    )


def dialogues(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv, perspective, text, masks (of start and length) of each dialogue, from perspectives(): for conversations that fit a row."""
    mask = F.struct(F.col("mask_start").alias("start"), F.col("mask_length").alias("length"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment", mask.alias("mask"))))
    joined = segments.groupBy(conv_col, "perspective").agg(parts.alias("parts"))
    masks = F.filter(F.transform("parts", lambda x: x["mask"]), lambda m: m["length"] > 0)
    return joined.select(conv_col, "perspective", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("text"), masks.alias("masks"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(read(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text, coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS k FROM conversations),
p AS (SELECT DISTINCT k, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
h AS (SELECT *, '{BEGIN}' || CASE WHEN role = '{SYSTEM}' THEN role WHEN role = perspective THEN 'assistant'
  ELSE 'user name=' || replace(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<|', '<\|') END || chr(10) AS head FROM t JOIN p USING (k)),
s AS (SELECT *, head || text || '{END.strip()}' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS seq, length(segment) AS n, coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s
  WINDOW w AS (PARTITION BY k, perspective ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, seq::BIGINT AS seq, turn, role, segment, start::BIGINT AS start, n::BIGINT AS length,
  (start + CASE WHEN role = perspective THEN length(head) ELSE 0 END)::BIGINT AS mask_start, (CASE WHEN role = perspective THEN n - length(head) ELSE 0 END)::BIGINT AS mask_length
FROM o"""

QUERIES = {"op6_chat_format": op6_chat_format}
ORACLES = {"op6_chat_format": ORACLE}
