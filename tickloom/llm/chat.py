"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation's log is a set of events in order of ``seq``:

    message     opens the turn with a role and a text (or replaces it whole)
    delta       appends text to its turn (streamed output)
    edit        replaces the text of its turn
    regenerate  replaces the text of its turn (null: empty, deltas follow) and
                discards everything that later turns got before it

``fold_events`` reduces a log to final messages; ``render`` writes each
conversation in one string with the loss mask of the assistant's texts;
``parse`` reads such a string back.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed for each turn. In roles and
texts ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and, in roles, ``>`` becomes
``\\g``, so no text holds a control string, and every text can be had back.

Defined results: null text is empty, null role is the empty role, null
conv_id is a conversation of its own, null turns come first, and an event of
unknown kind counts as a message. Events of one turn with equal seq are taken in
order of kind and text. Other columns are ignored. An empty log gives no rows.
A conversation's rows meet in one task only as one string, which the output needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(text: Column) -> Column:
    return _swap(text, [("\\", "\\b"), ("<", "\\l")])


def unescape(text: Column) -> Column:
    return _swap(text, [("\\l", "<"), ("\\b", "\\")])


def escape_role(role: Column) -> Column:
    return _swap(escape(role), [(">", "\\g")])


def unescape_role(role: Column) -> Column:
    return _swap(role, [("\\g", ">"), ("\\l", "<"), ("\\b", "\\")])


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, event, turn, role, text) -> one row per final message: conv_id, turn, role, text."""
    kind = F.coalesce("event", F.lit("message"))
    log = events.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("seq", F.lit(-1)).alias("seq"), F.when(kind.isin("delta", "edit", "regenerate"), kind).otherwise("message").alias("event"))
    # A conversation's rows meet once; the windows and groups below share that partitioning.
    log = log.repartition("conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "turn")
    at = F.struct("seq", "event", "text")
    live = (
        log.withColumn("cut", F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).over(earlier))
        .where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
        .withColumn("begun", F.max(F.when(F.col("event") != "delta", at)).over(own))
        .withColumn("last_role", F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "event", "text", "role"))).over(own))
        .where(F.col("begun").isNull() | (at == F.col("begun")) | ((F.col("event") == "delta") & (F.col("seq") >= F.col("begun.seq"))))
    )
    parts = F.sort_array(F.collect_list(F.struct("seq", (F.col("event") == "delta").alias("more"), "text")))
    folded = live.groupBy("conv_id", "turn").agg(parts.alias("parts"), F.max("last_role.role").alias("role"), F.max(F.col("begun").isNotNull().cast("int")).alias("whole"))
    # Equal events (repeated rows of one message) are one message; each delta counts.
    first = F.element_at(F.filter("parts", lambda x: ~x["more"]), 1)["text"]
    deltas = F.transform(F.filter("parts", lambda x: x["more"]), lambda x: x["text"])
    return folded.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.when(F.col("whole") == 1, first).otherwise(""), F.array_join(deltas, "")).alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in code points of the escaped texts)."""
    head = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">"))
    whole = messages.select("conv_id", F.struct("turn", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("loss")).alias("m"))
    conv = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    formatted = F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["head"])
        size = F.length(m["body"])
        spans = F.when(m["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(acc["spans"])
        return F.struct((start + size + len(END)).alias("at"), spans.alias("spans"))

    return conv.select("conv_id", formatted.alias("formatted"), F.aggregate("ms", step, add)["spans"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns that a formatted string holds: array of (role, text)."""
    pieces = F.split(formatted, F.lit(END), -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(pieces, lambda t: F.struct(unescape_role(F.substring_index(F.substr(t, F.lit(7)), ">", 1)).alias("role"), unescape(F.substr(t, F.instr(t, F.lit(">")) + 1)).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row is a message of its own, in order of turn, role and text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(w).cast("long")
    return conversations.select("conv_id", "role", "text", n.alias("turn")).select("conv_id", "turn", "role", "text", F.col("turn").alias("seq"), F.lit("message").alias("event"))


def op3(conversations: DataFrame) -> DataFrame:
    """The formatting query: the table and conversation -7, folded, rendered, and read back from the output."""
    said = "\\### Assistant: </turn> ok"
    own = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    out = render(fold_events(as_events(rows)))
    turns, loss = parse(F.col("formatted")), under_mask(F.col("formatted"), F.col("loss_spans"))
    out = out.withColumns({"turns": turns, "loss": loss})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS esc,
         length(role) + 3 * length(role) - length(replace(role, '\', '')) - length(replace(role, '<', '')) - length(replace(role, '>', '')) AS esc_role
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(esc_role + esc + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
