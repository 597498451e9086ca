r"""Chat formatting by prefix-target expansion.

Each assistant turn becomes one example: all turns before it are context and only the reply is trainable.  The turns
after the last reply (or a conversation without replies) give one example with nothing trainable, so no turn is lost.

A turn is rendered as ``### role:`` newline, text, ``</turn>`` newline.  Inside texts ``&``, ``#`` and ``<`` become
``&amp;``, ``&num;`` and ``&lt;`` (inside roles also ``:`` becomes ``&colon;``), so no text can contain a control string,
and replacing them back, ``&amp;`` last, restores the text exactly.

Every example of a conversation is a prefix of that conversation's rendering, up to the end of its turn.
``prefix_targets`` keeps the rendering once and each example as its number of turns; ``examples`` explodes them into rows
with their own text and mask, and ``read_back`` reads everything from those rows.

Only DataFrame functions are used.  A conversation is the unit of work, gathered in one shuffle by conv_id; its examples
are made and read where it lies, one row at a time.
Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first; repeated rows
are repeated turns; a null conv_id is a conversation of its own; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ":\n", "</turn>\n"
ASSISTANT = "assistant"


#: Control characters and what stands for them, ``&`` first.
MARKS = [("&", "&amp;"), ("#", "&num;"), ("<", "&lt;")]
ROLE_MARKS = [*MARKS, (":", "&colon;")]


def escape(text: Column, marks: list[tuple[str, str]] = MARKS) -> Column:
    for sign, name in marks:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def unescape(text: Column, marks: list[tuple[str, str]] = ROLE_MARKS) -> Column:
    for sign, name in [*marks[1:], marks[0]]:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def prefix_targets(turns: DataFrame) -> DataFrame:
    """conv_id, text (the whole rendering), examples: array of (turns, trainable, reply_chars), in turn order.

    turns: how many the example has; reply_chars: the code points of its last one's text, as rendered.
    """
    by_conv = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said")).alias("t")
    )
    rows = by_conv.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == ASSISTANT).alias("trainable"),
                F.concat(F.lit(HEAD), escape(t["role"], ROLE_MARKS), F.lit(COLON)).alias("head"),
                escape(t["said"]).alias("body"),
            ),
        ).alias("parts"),
    )
    numbered = F.transform("parts", lambda p, k: F.struct((k + 1).alias("turns"), p["trainable"].alias("trainable"), F.length(p["body"]).alias("reply_chars")))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.filter(numbered, lambda e: e["trainable"] | (e["turns"] == F.size("parts"))).alias("examples"),
    )


def examples(targets: DataFrame) -> DataFrame:
    """One row per example: conv_id, example_no, is_last, text, loss_start (0-based) and loss_chars.

    The reply is trainable, its ``</turn>`` is not.
    """
    text = F.concat(F.call_function("substring_index", F.col("whole"), F.lit(END), F.col("e.turns")), F.lit(END))
    rows = targets.select("conv_id", F.col("text").alias("whole"), F.size("examples").alias("n"), F.posexplode("examples").alias("example_no", "e"))
    rows = rows.select("conv_id", "example_no", (F.col("example_no") + 1 == F.col("n")).alias("is_last"), text.alias("text"), "e")
    end = F.length("text")
    return rows.select(
        "conv_id",
        "example_no",
        "is_last",
        "text",
        F.when(F.col("e.trainable"), end - len(END) - F.col("e.reply_chars")).otherwise(end).cast("long").alias("loss_start"),
        F.when(F.col("e.trainable"), F.col("e.reply_chars")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) parsed back from a rendering."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")
    pattern = r"(?s)^### ([^:]*):\n(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")),
    )


def read_back(shown: DataFrame) -> DataFrame:
    """Digests per conversation, from the rows of ``examples``: the turns from the last one's text, the losses from each
    one's mask.

    formatted_chars is the number of code points of all examples' texts together.
    """
    turns = F.when(F.col("is_last"), read_turns(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    rows = shown.select("conv_id", "example_no", turns.alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    read = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("turns").isNotNull(), F.size("turns"))).cast("long").alias("n_turns"),
        F.max(F.when(F.col("turns").isNotNull(), F.sha2(said, 256))).alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return read.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )


PLANTED = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string"
    )
    return read_back(examples(prefix_targets(turns.unionByName(extra))))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(text) + 14
      + 4 * length(regexp_replace(role || text, '[^&#]', '', 'g')) + 3 * length(regexp_replace(role || text, '[^<]', '', 'g'))
      + 6 * length(regexp_replace(role, '[^:]', '', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
run AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM run GROUP BY conv_id
"""
