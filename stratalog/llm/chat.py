"""Chat formatting over typed content parts, in DataFrame functions only.

A message holds a role and parts of type text, image, audio or document. A visitor goes through the parts
of a conversation in order: text is escaped and copied, every other part becomes a placeholder that is
numbered within the conversation, its reference is recorded and the number of tokens that it expands to
is counted. Turns are framed by control strings::

    <|turn|>ROLE<|says|>BODY<|end|>

Every control string begins with ``<|``. Inside texts a backslash is put before the bar of any ``<``,
backslashes, ``|``, so a text never holds a control string, and taking one backslash away again gives the
text back exactly. The loss mask covers the bodies of assistant turns, as ranges of code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Types of parts besides text; a part of any other is drawn as "other", as its name could hold a control string.
ATTACHED = ("image", "audio", "document")
#: Tokens of an image patch grid, of a second of audio and of a page of a document.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A message of plain text as its single part."""
    empty = "cast(null as {})".format
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            F.expr(empty("string")).alias("ref"),
            F.expr(empty("int")).alias("width"),
            F.expr(empty("int")).alias("height"),
            F.expr(empty("double")).alias("seconds"),
            F.expr(empty("int")).alias("pages"),
        )
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _expanded(part: Column) -> Column:
    """Tokens that an attachment takes in the model's input; unknown measures count as one unit."""
    cells = lambda x: F.greatest(F.lit(1), F.ceil(F.coalesce(x, F.lit(1)) / PATCH))
    return (
        F.when(part["type"] == "image", cells(part["width"]) * cells(part["height"]))
        .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * TOKENS_PER_SECOND)))
        .when(part["type"] == "document", F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(1))) * TOKENS_PER_PAGE)
        .otherwise(1)
        .cast("long")
    )


def _visited(parts: Column, before: Column) -> Column:
    """The body of a message; attachments are numbered on from ``before``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("out"))

    def visit(state: Column, part: Column) -> Column:
        number = state["n"] + F.when(_is_text(part), 0).otherwise(1)
        drawn = F.when(part["type"].isin(*ATTACHED), part["type"]).otherwise("other")
        placeholder = F.concat(F.lit("<|"), drawn, F.lit(":"), (before + number).cast("string"), F.lit("|>"))
        piece = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)
        return F.struct(number.cast("long").alias("n"), F.array_append(state["out"], piece).alias("out"))

    return F.aggregate(parts, start, visit, lambda s: F.array_join(s["out"], ""))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation from messages (conv_id, turn, role, parts).

    Returns conv_id, n_turns, formatted, loss_spans (array of start, length in code points), attachments
    (array of number, type, ref, tokens, turn) and expanded_tokens. Messages are ordered by turn, a null
    turn first; rows that repeat a turn are all kept, ordered by role and content. A null role, text or
    list of parts is empty, parts without a type are text, and part types other than text, image, audio
    and document are drawn as "other", a placeholder of one token, and keep their name in the record. A null conv_id is a conversation of its own.
    Other columns are ignored; an empty table gives an empty result.
    """
    parts = F.coalesce(F.filter(F.col("parts").cast(f"array<{PART}>"), lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>"))
    rows = messages.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts")
    )
    attached = F.filter("parts", lambda p: ~_is_text(p))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("rn", F.row_number().over(order)).withColumn(
        "att_before", F.coalesce(F.sum(F.size(attached)).over(earlier), F.lit(0)).cast("long")
    )
    drawn = counted.withColumn("body", _visited(F.col("parts"), F.col("att_before"))).withColumn(
        "head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    )
    piece = drawn.withColumn("piece", F.concat("head", "body", F.lit(END)))
    located = piece.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(earlier), F.lit(0)).cast("long"))
    mask = F.struct((F.col("at") + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length"))
    records = F.transform(
        attached,
        lambda p, i: F.struct(
            (F.col("att_before") + i + 1).alias("number"),
            p["type"].alias("type"),
            p["ref"].alias("ref"),
            _expanded(p).alias("tokens"),
            F.col("turn").alias("turn"),
        ),
    )
    turn = F.struct(
        "rn", "piece", F.when(F.col("role") == "assistant", mask).alias("mask"), records.alias("records")
    )
    grouped = located.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return grouped.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["mask"]), lambda m: m.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["records"])).alias("attachments"),
    ).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), with texts unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, SAYS, 1)).alias("role"),
            unescape(F.regexp_replace(F.regexp_replace(p, r"(?s)^.*?<\|says\|>", ""), r"<\|end\|>$", "")).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    cut = lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))
    return F.array_join(F.transform(loss_spans, cut), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the output holds, read back from it."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "loss", masked_text(F.col("formatted"), F.col("loss_spans"))
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: Both turns of the conversation that is added to the table.
HOSTILE = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(HOSTILE).alias("text"))
    messages = rows.unionByName(added).withColumn("parts", text_parts(F.col("text")))
    return digest(format_conversations(messages))


#: The contract's columns from the table alone; the length counts what the template adds.
ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(length(role) + length(text) + 23 + len(regexp_extract_all(role || ' ' || text, '<\\*\|'))) AS chars
  FROM m GROUP BY conv_id)
SELECT conv_id, cast(n_turns AS bigint) AS n_turns, sha256(said) AS turns_sha256, cast(length(loss) AS bigint) AS loss_chars,
       sha256(loss) AS loss_sha256, cast(chars AS bigint) AS formatted_chars
FROM g
"""
