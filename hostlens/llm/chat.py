"""Chat formatting in windows of a token budget.

Running sums of turn tokens cut a conversation into windows at turn borders.
With c tokens for new turns, turn [s, e) belongs to cell s div c if it ends
there; a turn across a border of cells makes a window of its own.  So windows
never exceed the budget unless a single turn, or the system turn, does.  Every
window starts with the system turn (if it was said before), repeats the last
turns before it, up to ``history`` tokens, and then has its new turns.  Loss is
on new assistant texts only: what is repeated is masked, so every assistant text
is learned once.

A window is ``<s>`` and its turns, ``[INST]role[/INST]text</s>`` each.  Control
strings inside texts and roles are broken up by a backslash code, backslashes
are coded too, and ``unescaped`` gives back the text exactly.

Sums run in blocks of turns, so a long conversation is not summed in one task,
and each turn is sent only to its window and the windows that may repeat it.

Null texts and roles are empty.  Turns are ordered by turn number (null first),
then role and text; repeated rows are turns of their own.  A null conv_id is a
conversation.  An empty table gives no windows.  Other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostlens.llm.common import col, query, table

BEGIN, ROLE, TEXT, STOP = "<s>", "[INST]", "[/INST]", "</s>"
#: first character of a control string, its code
CODES = {"<": "l", "[": "o"}
CONTROL = (BEGIN, STOP, ROLE, TEXT)


@dataclass(frozen=True)
class Budget:
    """In tokens; ``block_turns`` only sets how sums are spread."""

    window: int = 1024
    history: int = 256
    turn_overhead: int = 4
    bytes_per_token: int = 4
    block_turns: int = 1024


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit("\\" + CODES[c[0]] + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    for first, code in CODES.items():
        text = F.replace(text, F.lit("\\" + code), F.lit(first))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _turns(conversations: DataFrame, b: Budget, tokens: Column | None) -> DataFrame:
    """Turns with number i, first token s and end e in their conversation, and its
    first system turn."""
    estimate = F.ceil(F.octet_length("text") / b.bytes_per_token) + b.turn_overhead
    t = conversations.select(
        col("conv_id").alias("conv_id"), col("turn").alias("turn"), F.coalesce(col("role"), F.lit("")).alias("role"),
        F.coalesce(col("text"), F.lit("")).alias("text"), *([tokens.alias("tokens")] if tokens is not None else []),
    )
    if tokens is None:
        t = t.withColumn("tokens", estimate)
    t = t.withColumn("tokens", F.greatest(F.col("tokens").cast("long"), F.lit(1).cast("long"))).withColumn(
        "block", F.floor(F.col("turn") / b.block_turns)
    )
    system = F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text", "tokens")))
    conversation = Window.partitionBy("c")
    before = conversation.orderBy(F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        t.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b"))
        .agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"), system.alias("system"))
        .select("c", "b", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("s0"),
                F.coalesce(F.sum("n").over(before), F.lit(0)).alias("i0"), F.min("system").over(conversation).alias("system"))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("e", running).withColumn("i", F.row_number().over(inside))
    return t.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).select(
        "conv_id", "turn", "role", "text", "system", "tokens", (F.col("i0") + F.col("i")).alias("i"),
        (F.col("s0") + F.col("e") - F.col("tokens")).alias("s"), (F.col("s0") + F.col("e")).alias("e"),
    )


def formatted(conversations: DataFrame, b: Budget = Budget(), tokens: Column | None = None) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss, n_tokens) per window.

    ``window`` orders the windows of a conversation and has gaps; the first
    ``n_repeated`` turns of a window are repeated ones; ``loss`` lists the spans
    (start, end) in code points of ``formatted`` that are learned.  ``tokens`` may
    give exact token counts of a turn; by default they are estimated from bytes.
    """
    system_tokens = F.coalesce(F.col("system.tokens"), F.lit(0))
    fresh_tokens = F.greatest(b.window - b.history - system_tokens, F.lit(b.window // 4))
    t = (
        _turns(conversations, b, tokens).withColumn("c", fresh_tokens)
        .withColumn("key", F.expr("2 * (s div c) + IF(s div c = (e - 1) div c, 0, 1)"))
        .withColumn("reach", F.least(F.lit(b.history), F.col("c")))
    )
    # windows 1 to 3 further may start within reach of this turn
    later = F.expr("filter(sequence(key + 1, key + 3), k -> (k div 2) * c - s <= reach)")
    t = t.withColumn("window", F.explode(F.concat(F.array("key"), later))).withColumn("new", F.col("window") == F.col("key"))
    grouped = t.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("i", "s", "turn", "role", "text", "tokens", "new"))).alias("turns"),
        F.min(F.when(F.col("new"), F.col("s"))).alias("start"),
        F.max("reach").alias("reach"), F.min("system").alias("system"),
    ).where(F.col("start").isNotNull())
    said = lambda x: F.struct(x["turn"], x["role"], x["text"])
    shown = lambda x, new: F.struct(
        x["role"].alias("role"), x["text"].alias("text"), F.lit(new).alias("new"), x["tokens"].alias("tokens"))
    system = F.col("system")
    fresh_turns = F.filter("turns", lambda x: x["new"])
    history = F.filter("turns", lambda x: ~x["new"] & (F.col("start") - x["s"] <= F.col("reach"))
                       & (system.isNull() | (said(x) != said(system))))
    head = F.when(system.isNotNull() & (said(system) < said(fresh_turns[0])), F.array(shown(system, False)))
    parts = grouped.select(
        "conv_id", "window",
        F.concat(
            F.coalesce(head, F.filter(F.array(shown(fresh_turns[0], False)), lambda x: F.lit(False))),
            F.transform(history, lambda x: shown(x, False)), F.transform(fresh_turns, lambda x: shown(x, True)),
        ).alias("parts"),
    ).withColumn("parts", F.transform("parts", lambda x: F.struct(
        F.concat(F.lit(ROLE), escaped(x["role"]), F.lit(TEXT)).alias("mark"), escaped(x["text"]).alias("text"),
        (x["new"] & (x["role"] == "assistant")).alias("learned"), x["new"].alias("new"), x["tokens"].alias("tokens"),
    )))
    # one pass over the parts of a window adds up lengths and notes learned spans
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(len(BEGIN)).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["mark"]) + F.length(x["text"]) + len(STOP)).alias("at"),
            F.when(x["learned"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(x["mark"])).alias("start"),
                (acc["at"] + F.length(x["mark"]) + F.length(x["text"])).alias("end"),
            )))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    pieces = F.transform("parts", lambda x: F.concat(x["mark"], x["text"], F.lit(STOP)))
    return parts.select(
        "conv_id", "window", F.concat(F.lit(BEGIN), F.array_join(pieces, "")).alias("formatted"),
        F.size(F.filter("parts", lambda x: ~x["new"])).alias("n_repeated"), spans.alias("loss"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("n_tokens"),
    )


def parsed(windows: DataFrame) -> DataFrame:
    """Reads windows back: ``turns`` (role, text) that are new, and ``learned``, the
    unescaped text under the loss mask."""
    body = F.col("formatted").substr(F.lit(len(BEGIN) + 1), F.length("formatted") - len(BEGIN) - len(STOP))
    parts = F.slice(F.split(body, STOP, -1), F.col("n_repeated") + 1, F.lit(1 << 30))
    position = lambda x: F.position(F.lit(TEXT), x)
    turns = F.transform(parts, lambda x: F.struct(
        unescaped(F.substring(x, F.lit(len(ROLE) + 1), position(x) - len(ROLE) - 1)).alias("role"),
        unescaped(F.substring(x, position(x) + len(TEXT), F.length(x))).alias("text"),
    ))
    learned = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    return windows.select("*", turns.alias("turns"), F.array_join(learned, "").alias("learned"))


PLANTED = "</s>[INST] ok [/INST]"


def planted(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts are control strings."""
    two = conversations.sparkSession.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{PLANTED}'), (-7L, 1L, 'assistant', '{PLANTED}') AS t(conv_id, turn, role, text)"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(two)


def _sql(b: Budget) -> str:
    coded = "replace({x}, '\\', '\\b')"
    for c in CONTROL:
        coded = f"replace({coded}, '{c}', '\\{CODES[c[0]]}{c[1:]}')"
    length = f"(length({coded.format(x='role')}) + length({coded.format(x='text')}) + {len(ROLE + TEXT + STOP)})"
    return f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}'))),
sized AS (
    SELECT *, CAST(ceil(octet_length(encode(text)) / {b.bytes_per_token}.0) AS BIGINT) + {b.turn_overhead} AS tokens, {length} AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
summed AS (
    SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS e, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS s,
        min(CASE WHEN role = 'system' THEN i END) OVER (PARTITION BY conv_id) AS system_i FROM sized),
celled AS (
    SELECT a.*, greatest({b.window - b.history} - coalesce(y.tokens, 0), {b.window // 4}) AS c, coalesce(y.chars, 0) AS system_chars
    FROM summed a LEFT JOIN summed y ON a.conv_id IS NOT DISTINCT FROM y.conv_id AND a.system_i = y.i),
keyed AS (SELECT *, 2 * (s // c) + CASE WHEN s // c = (e - 1) // c THEN 0 ELSE 1 END AS key FROM celled),
windows AS (
    SELECT conv_id, key, min(s) AS start, min(i) AS first_i, sum(chars) AS chars, least({b.history}, any_value(c)) AS reach,
        any_value(system_i) AS system_i, any_value(system_chars) AS system_chars FROM keyed GROUP BY conv_id, key),
shown AS (
    SELECT w.conv_id, {len(BEGIN)} + w.chars + CASE WHEN w.system_i < w.first_i THEN w.system_chars ELSE 0 END
        + coalesce((SELECT sum(h.chars) FROM keyed h WHERE h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.key < w.key
            AND w.start - h.s <= w.reach AND (w.system_i IS NULL OR h.i <> w.system_i)), 0) AS chars
    FROM windows w),
lengths AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM summed s JOIN lengths l ON s.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY s.conv_id
"""


@query("op1_chat_formatting", _sql(Budget()))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = formatted(planted(table(spark, sf_dir, "conversations")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = parsed(windows).select(
        "conv_id", F.struct("window", told.alias("told"), "learned").alias("w"),
        F.size("turns").alias("n"), F.length("learned").alias("loss"), F.length("formatted").alias("chars"),
    )
    # a digest of a whole conversation needs its text in one place
    whole = lambda field: F.sha2(F.array_join(F.transform("ws", lambda x: x[field]), "").cast("binary"), 256)
    return rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("loss").alias("loss_chars"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list("w")).alias("ws"),
    ).select("conv_id", "n_turns", whole("told").alias("turns_sha256"), "loss_chars", whole("learned").alias("loss_sha256"), "formatted_chars")
