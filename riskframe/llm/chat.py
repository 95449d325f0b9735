"""Chat formatting with typed content parts, by DataFrame functions only.

A turn's content is a list of parts ``struct<type, text, ref, tokens>``. A
visitor (one ``transform`` over the list) flattens text, image, audio and
document parts: text is escaped, any other part becomes a placeholder
``<|type|>`` in its place, and its reference, position and expanded token
count are recorded. The template is

    <|turn|>ROLE<|body|>CONTENT<|end|>

Control strings inside roles and texts get a backslash after their first
character and backslashes are doubled, so that the text can be read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"

#: Strings that templates use to steer a model; ``<|`` starts
#: every marker of this template.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

#: Part types that become placeholders.
ATTACHMENTS = ("image", "audio", "document")

PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROL, out)


def unescape(text: Column) -> Column:
    out = reduce(lambda c, s: F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s)), CONTROL, text)
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _kind(part: Column) -> Column:
    return F.lower(F.coalesce(part["type"], F.lit("text")))


def _visit(part: Column) -> Column:
    """A part as it stands in the formatted text. Unknown types are text."""
    return F.when(_kind(part).isin(*ATTACHMENTS), F.concat(F.lit("<|"), _kind(part), F.lit("|>"))) \
        .otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def format_chats(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns`` (conv_id, turn, role, content: array of parts) to one row per
    conversation: ``conv_id``, ``n_turns``, ``formatted``, ``loss_mask`` (per
    turn under the loss: its number from 0, where the turn starts, where the
    masked text starts, its length; code points of ``formatted``),
    ``attachments`` (type, ref, tokens, turn, place in the turn),
    ``expanded_tokens``.

    Rows come by turn; equal turns by role, then content. NULL role, content
    and text are empty; a NULL conv_id is a conversation of its own; repeated
    rows are turns of their own; an empty table gives no row. Other columns
    are not read. A conversation is one output row, so its rows meet in one
    task, as text; nothing wider is grouped."""
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
                     F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>").alias("content"))
    t = t.withColumn("body", F.array_join(F.transform("content", _visit), "")) \
        .withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))) \
        .withColumn("att", F.filter(F.transform("content", lambda p, i: F.struct(
            _kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"),
            i.alias("place"))), lambda a: a["type"].isin(*ATTACHMENTS))).drop("content")
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    run = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("no", (F.row_number().over(by_turn) - 1).cast("long")) \
        .withColumn("from", F.sum(F.length("piece")).over(run) - F.length("piece"))
    masked = F.when(F.col("role").isin(*loss_roles), F.struct(
        F.col("no"), F.col("from").alias("turn_start"),
        (F.col("from") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    by_no = lambda c: F.array_sort(F.collect_list(c))  # noqa: E731  structs sort by their first field, no
    g = t.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        by_no(F.struct("no", "piece")).alias("pieces"),
        by_no(masked).alias("loss_mask"),
        by_no(F.struct("no", "att")).alias("att"))
    return g.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        "loss_mask",
        F.flatten(F.transform("att", lambda a: F.transform(a["att"], lambda x: F.struct(
            x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens"),
            a["no"].alias("turn"), x["place"].alias("place"))))).alias("attachments")) \
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"),
                                                   lambda s, x: s + x["tokens"]))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read ``format_chats`` rows back: adds ``turns`` (array of role, text) and
    ``loss_texts`` (what lies under the mask), both unescaped."""
    parts = F.split(F.col("formatted"), r"<\|turn\|>")       # its first element is empty
    marked = F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: F.struct(
        unescape(F.substring_index(p, BODY, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text")))
    under = F.transform("loss_mask", lambda m: unescape(F.substring(
        F.concat(F.lit(TURN), F.element_at("parts", (m["no"] + 2).cast("int"))),
        (m["start"] - m["turn_start"] + 1).cast("int"), m["length"].cast("int"))))
    return formatted.withColumn("parts", parts).withColumn("turns", marked) \
        .withColumn("loss_texts", under).drop("parts")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Contract columns of the formatted conversations (conv_id, turn, role,
    text), read back from the formatted text."""
    turns = conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("content"))
    back = read_chats(format_chats(turns))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts hold control strings."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").unionByName(probe)


_ESC = "replace({0}, '\\', '\\\\')"
for _s in CONTROL:
    _ESC = f"replace({_ESC}, '{_s}', '{_s[0]}\\{_s[1:]}')"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS listed,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(TURN + BODY + END)} + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM g"""
