"""Chat formatting: event-sourced reconstruction of conversations, then rendering, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The template, and the characters that open a control string in this or another common template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
OPENERS = r"[<\[]"
MARK = "\\"


def escape(text: Column) -> Column:
    """Put a backslash after each character that could open a control string: none is left whole in the text."""
    return F.regexp_replace(text, f"({OPENERS})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})\\", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages: (conv_id, message, role, text).

    ``events`` has (conv_id, message, seq, kind, role, text). In order of seq, a ``delta`` adds its text
    to its message, an ``edit`` puts its text in the place of what the message had, a ``regenerate``
    empties the message, whose later deltas then build it anew. The fold needs no state: events before
    a message's last edit or regeneration cannot count, so a window drops them, and what is left is
    joined in order. The role is that of the latest event that has one.

    Null texts add nothing, unknown kinds are ignored, a null seq comes first; equal seqs go by kind and
    text. Repeated events count as often as they come. Other columns are ignored. An empty log has no
    messages.
    """
    # hash-partitioned by conversation once; the window, the fold and the rendering all reuse it
    by_message = Window.partitionBy("conv_id", "message")
    in_order = by_message.orderBy("seq", "kind", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resets = F.col("kind").isin("edit", "regenerate").cast("int")
    live = (
        events.select("conv_id", "message", "seq", "kind", "role", "text")
        .filter(F.col("kind").isin("delta", "edit", "regenerate"))
        .withColumn("epoch", F.sum(resets).over(in_order))
        .withColumn("role", F.last("role", ignorenulls=True).over(by_message.orderBy("seq", "kind", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("last_epoch", F.max("epoch").over(by_message))
        .filter("epoch = last_epoch")
    )
    # the reset event stands first in its epoch
    piece = F.struct(F.col("seq"), (~F.col("kind").isin("edit", "regenerate")).alias("later"), F.col("kind"), F.coalesce(F.when(F.col("kind") != "regenerate", F.col("text")), F.lit("")).alias("text"))
    return live.groupBy("conv_id", "message").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, train_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, n_turns.

    Each turn is a start mark, the escaped role, a line feed, the escaped text and an end mark. A span
    (turn, within, start, length) is the place of a trained text in code points: ``within`` counts from
    the turn's start mark, ``start`` from the conversation's start. A conversation's text is one string,
    as whoever formats it wants; a null role counts as empty.
    """
    in_order = Window.partitionBy("conv_id").orderBy("message", "role", "text")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(TURN_START), escape(role), F.lit("\n")), escape(text)
    # running sums over rows, so that the work of a conversation grows with its length only
    blocks = (
        messages.select("conv_id", "message", role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(TURN_END)).alias("block"), F.length(head).alias("within"), F.length(body).alias("length"))
        .withColumn("turn", F.row_number().over(in_order) - 1)
        .withColumn("at", F.coalesce(F.sum(F.length("block").cast("long")).over(before), F.lit(0).cast("long")))
    )
    span = F.struct("turn", "within", (F.col("at") + F.col("within")).alias("start"), "length")
    return blocks.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == train_role, span))).alias("loss_spans"),
        F.count(F.lit(1)).alias("n_turns"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns and trained text from ``formatted`` and ``loss_spans`` alone: conv_id, turns, trained, formatted."""
    blocks = F.split(F.col("formatted"), r"<\|im_start\|>")  # no escaped text holds the mark
    body = F.transform(F.slice(blocks, 2, F.size(blocks) - 1), lambda b: F.substring_index(b, TURN_END, 1))
    turns = F.transform(
        body,
        lambda b: F.struct(
            unescape(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text"),
        ),
    )
    trained = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring(F.concat(F.lit(TURN_START), F.get(F.col("pieces"), s["turn"] + 1)), s["within"] + 1, s["length"])),
        ),
        "",
    )
    return rendered.withColumn("pieces", blocks).select("conv_id", turns.alias("turns"), trained.alias("trained"), "formatted")


def message_log(rows: DataFrame, chunk: int = 200) -> DataFrame:
    """An event log of stored messages (conv_id, turn, role, text), as a chat server would have written it.

    A message arrives in deltas of ``chunk`` characters. Of each seven messages one was first answered
    otherwise and regenerated, and one was edited after its first version: their first texts must not
    survive. Turns come in order, nulls first; rows of one turn go by role, then text.
    """
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn(
        "message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    deltas = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / chunk).cast("int")),
        lambda i: F.struct((i + 10).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.substring(text, i * chunk + 1, F.lit(chunk)).alias("text")),
    )
    event = lambda seq, kind, body: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), body.alias("text"))
    draft = event(1, "delta", F.substring(text, 1, 40))
    case = F.pmod(F.xxhash64("conv_id", "message"), F.lit(7))
    log = (
        F.when(case == 0, F.concat(F.array(draft, event(2, "regenerate", F.lit(None).cast("string"))), deltas))
        .when(case == 1, F.array(draft, event(3, "edit", text)))
        .otherwise(deltas)
    )
    return numbered.withColumn("event", F.explode(log)).select("conv_id", "message", "event.seq", "event.kind", "role", "event.text")


def op4_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    # every input file also plans the two rows of conversation -7; only one row of ids is exploded
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("r"),
    ).select("conv_id", "r.turn", "r.role", F.lit(hard).alias("text"))
    rendered = render(reconstruct(message_log(table.unionByName(extra))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(rendered).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH rows AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(text) + length('<|im_end|>') + 1
           + length(role || text) - length(regexp_replace(role || text, '[<\[]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
