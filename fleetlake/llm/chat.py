"""Chat formatting with Spark expressions only.

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Adjacent turns of one role share a block and are set apart by ``<|im_sep|>``.
In texts and roles ``\\`` becomes ``\\e`` and ``<`` becomes ``\\l`` (in roles
also a line feed ``\\n``), so no control string can occur in them and reading
back gives every turn as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escaped(text: Column, role: bool = False) -> Column:
    for a, b in (("\\", "\\e"), ("<", "\\l"), *([("\n", "\\n")] if role else [])):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for a, b in (*([("\n", "\\n")] if role else []), ("<", "\\l"), ("\\", "\\e")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row for each conv_id, null included.

    Turns are sorted by (turn, role, text), nulls first; repeated rows are turns
    of their own; null roles and texts are empty.  ``loss`` lists the parts of
    ``formatted`` to learn, as (start, length) in UTF-8 bytes: every text of
    ``loss_role``, in order.  An empty table gives no row; other columns are
    not read.  A conversation is one string, so it is built by one task; its
    turns are folded in runs of 1000, as a growing array is copied each time."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written_out = F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))
    part = "array<struct<piece: string, start: int, length: int, learn: boolean>>"
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  (``value`` is worked out once)

    def add(now: Column, t: Column) -> Column:
        """A turn of the open block's role joins it; another ends it and opens its own."""
        before = F.when(now["role"].isNull(), t["head"]).when(now["role"] == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END), t["head"]))
        return bound(before, lambda b: F.struct(
            t["role"].alias("role"), (now["at"] + F.octet_length(b) + F.octet_length(t["body"])).alias("at"),
            F.array_append(now["out"], F.struct(
                F.concat(b, t["body"]).alias("piece"), (now["at"] + F.octet_length(b)).alias("start"),
                F.octet_length(t["body"]).alias("length"), (t["role"] == loss_role).alias("learn"))).alias("out")))

    def add_run(state: Column, r: Column) -> Column:
        run = F.aggregate(F.slice("rows", r * 1000 + 1, 1000), F.struct(
            state["role"].alias("role"), state["at"].alias("at"), F.array().cast(part).alias("out")), add)
        return bound(run, lambda done: F.struct(
            done["role"].alias("role"), done["at"].alias("at"), F.array_append(state["outs"], done["out"]).alias("outs")))

    parts = F.aggregate(
        F.expr("sequence(0, (size(rows) - 1) div 1000)").cast("array<int>"),
        F.struct(F.lit(None).cast("string").alias("role"), F.lit(0).alias("at"), F.array().cast(f"array<{part}>").alias("outs")),
        add_run, lambda state: F.flatten(state["outs"]))
    return whole.select("conv_id", written_out.alias("rows")).select("conv_id", parts.alias("parts")).select(
        "conv_id", F.concat(F.array_join(F.transform("parts", lambda p: p["piece"]), ""), F.lit(END)).alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["start"], p["length"])).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    def block(b: Column) -> Column:
        body = F.substring(b, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(unescaped(role, True).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != ""), block))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    # the one-element array binds the bytes, so that they are made once
    return F.transform(F.array(formatted.cast("binary")), lambda b: F.array_join(
        F.transform(loss, lambda s: unescaped(b.substr(s["start"] + 1, s["length"]).cast("string"))), ""))[0]


def chat_query(turns: DataFrame) -> DataFrame:
    """Digest of all conversations and of one, -1, whose texts look like the
    control strings of another template, read back from the formatted text."""
    probe = turns.sparkSession.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    done = format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(probe))
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS closes
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN opens THEN 13 + length(replace(replace(replace(role, '\', '\e'), '<', '\l'), chr(10), '\n')) ELSE 10 END
           + length(replace(replace(text, '\', '\e'), '<', '\l')) + CASE WHEN closes THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
