"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``[INST]role[/INST]text</s>`` and a conversation as ``<s>`` and its turns.
Every assistant turn becomes an example of its own: all turns before it as context, that reply
as the only trainable part.  Turns after the last reply belong to one more example in which
nothing is trainable, so the examples of a conversation always show all its turns.

Control strings inside texts and roles are escaped by one more backslash after their first
character than they already have there; reading back takes one away.  No control string ends
in the start of another, so none can arise where a text meets the template.

Defined results: turns follow `turn`, then role, then text, nulls first; a null role or text is
empty; rows repeated in full are turns of their own; null conversation ids are one conversation;
an empty table gives no rows; other columns are ignored.

A conversation's text is one value, as its digest requires.  Its examples are not: each is made
from that text and an end when its row is written, so they are never held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellkin.llm import corpus

#: The template's control strings.
START, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
_TAIL = r"(/?(?:s>|INST\]))"
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _TAIL, r"([<\[])\\(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _placed(rows: DataFrame) -> DataFrame:
    """conv_id, place, piece, end (code points up to and with the piece), body (of its text), reply, last."""
    written = rows.select("conv_id", "turn", "role", "text", escape(F.col("text")).alias("body")).select(
        "*",
        F.concat(
            F.lit(HEAD), escape(F.col("role")), F.lit(BODY), F.col("body"), F.lit(CLOSE)
        ).alias("piece"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return written.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        "piece",
        (upto + len(START)).alias("end"),
        F.length("body").alias("body"),
        (F.coalesce(F.col("role"), F.lit("")) == TRAINED).alias("reply"),
        F.lead(F.lit(False), 1, True).over(order).alias("last"),
    )


def examples(rows: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, last, text, loss_start, loss_chars of every example.

    The trainable part is `loss_chars` code points from the zero-based `loss_start`; an example
    of the turns after the last reply has null `loss_start` and no `loss_chars`.
    """
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))
    marks = F.collect_list(
        F.when(F.col("reply") | F.col("last"), F.struct("place", "end", "body", "reply", "last"))
    )
    whole = (
        _placed(rows)
        .groupBy("conv_id")
        .agg(pieces.alias("pieces"), marks.alias("marks"))
        .select(
            "conv_id",
            F.concat(F.lit(START), F.array_join("pieces.piece", "")).alias("whole"),
            F.explode("marks").alias("mark"),
        )
    )
    start = F.when(F.col("mark.reply"), F.col("mark.end") - len(CLOSE) - F.col("mark.body"))
    return whole.select(
        "conv_id",
        F.col("mark.place").alias("example"),
        F.col("mark.place").cast("long").alias("n_turns"),
        F.col("mark.last").alias("last"),
        F.substring("whole", F.lit(1), F.col("mark.end").cast("int")).alias("text"),
        start.alias("loss_start"),
        F.when(F.col("mark.reply"), F.col("mark.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def turns(text: Column) -> Column:
    """array<struct<role, text>> of the turns that a formatted example holds."""
    parts = F.split(F.substring(text, len(START) + 1, 2**31 - 1), CLOSE)

    def parsed(part: Column) -> Column:
        head = F.substring_index(part, BODY, 1)
        return F.struct(
            unescape(F.substring(head, len(HEAD) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(part, F.length(head) + len(BODY) + 1, F.length(part))).alias("text"),
        )

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), parsed)


def read_back(made: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation."""
    reply = unescape(
        F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    )
    read = made.select(
        "conv_id",
        "example",
        F.length("text").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), reply).alias("reply"),
        # One example shows all turns; the others are read for their reply alone.
        F.when(F.col("last"), F.col("text")).alias("all"),
    )
    said = F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply"))))
    one = read.groupBy("conv_id").agg(
        F.max("all").alias("all"), said.alias("said"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join("said.reply", "")
    seen = one.select("conv_id", turns(F.col("all")).alias("turns"), loss.alias("loss"), "formatted_chars")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return seen.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_PLANTED = """
SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""


def op11_chat_prefixes(spark, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(examples(rows.unionByName(spark.sql(_PLANTED))))


_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
      + length(regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
      + length('[INST][/INST]</s>') AS chars
  FROM rows),
placed AS (
  SELECT *, length('<s>') + sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM numbered)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""

ORACLE = {"op11_chat_prefixes": _SQL}
