"""Chat formatting of reply trees.

Messages point to the message they reply to. Iterative self-joins that double their
reach give every message the score and length of its way from the root, rank the
leaves of a conversation, and list the messages of the chosen ways; rounds grow as the
logarithm of the deepest reply. Each chosen root-to-leaf path is formatted as one
conversation with spans of the text that a loss is taken of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: First characters of strings that a text may not show in a formatted conversation: marks of this template and of common others.
CONTROL = r"<(?=\|)|\|(?=>)|<(?=/?s>)|\[(?=/?INST\])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """conv_id, leaf, pos (0: root), node_id for the `best` root-to-leaf paths of each conversation.

    messages(conv_id, node_id, parent_id, score): a message whose parent is null, itself
    or absent is a root. Paths are ranked by the sum of their scores (null: 0), then by
    length, then by the smaller leaf. Messages in a circle of replies have no root and are
    on no path. node_id is to be unique in its conversation: rows that repeat one multiply the ways
    through it. Null conversations and ids are left out; other columns aren't looked at; an empty table gives no rows.
    """
    nodes = messages.select("conv_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    parents = nodes.select("conv_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    state = nodes.join(parents, ["conv_id", "parent_id"], "left").select("conv_id", "node_id", F.when(F.col("there") & (F.col("parent_id") != F.col("node_id")), F.col("parent_id")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("n"))
    state = stored(state, "replies")
    first, jumps = state, []
    most = state.groupBy("conv_id").count().agg(F.max("count").alias("m")).first()["m"] or 0
    for _ in range(max(1, int(most).bit_length() + 1)):
        if state.where("up is not null").isEmpty():
            break
        active = state.where("up is not null")  # the others have reached their root
        jumps.append(active.select("conv_id", "node_id", "up"))
        far = state.select("conv_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("n2"))
        longer = active.join(far, ["conv_id", "up"]).select("conv_id", "node_id", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n"))
        state = stored(state.where("up is null").unionByName(longer), "replies")
    inner = first.select("conv_id", F.col("up").alias("node_id")).where("node_id is not null").distinct()
    leaves = state.where("up is null").join(inner, ["conv_id", "node_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("sum").desc(), F.col("n").desc(), "node_id"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= best)
    paths = chosen.select("conv_id", F.col("node_id").alias("leaf"), "node_id", "n", F.lit(0).cast("long").alias("back"))
    for i, jump in enumerate(jumps):
        more = paths.join(jump.where("up is not null"), ["conv_id", "node_id"]).select("conv_id", "leaf", F.col("up").alias("node_id"), "n", (F.col("back") + (1 << i)).alias("back"))
        paths = stored(paths.unionByName(more), "paths")
    return paths.select("conv_id", "leaf", (F.col("n") - 1 - F.col("back")).alias("pos"), "node_id")


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """conv_id, leaf, formatted, spans (start and end code points of learned text) of the best paths.

    messages(conv_id, node_id, parent_id, role, text, score); null roles and texts count
    as empty; roles are percent-encoded.
    """
    body = messages.select("conv_id", "node_id", F.url_encode(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    turns = best_paths(messages, best).join(body, ["conv_id", "node_id"])
    # One conversation is one row by its nature; its turns are gathered, nothing more.
    listed = turns.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("t"))
    piece = lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE + "\n"))
    start = lambda s, x: s["at"] + len(OPEN) + 1 + F.length(x["role"])
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    span = lambda s, x: F.struct(start(s, x).alias("start"), (start(s, x) + F.length(x["text"])).alias("end"))
    step = lambda s, x: F.struct((start(s, x) + F.length(x["text"]) + len(CLOSE) + 1).alias("at"), F.when(x["role"] == LEARNED, F.concat(s["spans"], F.array(span(s, x)))).otherwise(s["spans"]).alias("spans")).cast(kind)
    return listed.select("conv_id", "leaf", F.concat_ws("", F.transform("t", piece)).alias("formatted"), F.aggregate("t", zero.cast(kind), step)["spans"].alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, leaf, turns (role, text), learned (the text under the spans), formatted_chars of format_paths()'s rows."""
    pattern = r"<\|im_start\|>([^\n]*)\n((?s:.*?))<\|im_end\|>\n"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(pattern), F.lit(i)) for i in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(F.url_decode(r).alias("role"), unescape(t).alias("text")))
    learned = F.concat_ws("", F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))))
    return formatted.select("conv_id", "leaf", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """One row per formatted conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def chains(conversations: DataFrame) -> DataFrame:
    """Reply trees of plain conversations(conv_id, turn, role, text): each row replies to the one before.

    Rows of one turn follow each other by role and text; null turns come first. A null
    conv_id is no conversation and is left out.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumn("node_id", order.cast("long"))
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def own_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


CHAT_SQL = r"""WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<\|')) + len(regexp_extract_all(text, '\|>'))
    + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '\[/?INST\]'))) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id"""
