r"""Operator 2: chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted by turn; adjacent
rows of one role are merged into one turn by array aggregation; the turns are
concatenated under this template (``<turn>``, ``<part>``, ``</turn>`` are the
control strings)::

    <turn>ROLE\nTEXT<part>TEXT ...</turn>\n

Inside roles and texts ``\`` becomes ``\b`` and the ``<`` of a control string
becomes ``\l`` (in roles a line feed also becomes ``\n``). A backslash of an
escaped text is always followed by one of these letters, so unescaping is two
plain replacements and exact, and a control string never occurs in a text.
``parse`` reads the turns back by splitting at the control strings.

The loss mask has one boolean per text segment (the texts between control
strings, in order): true for assistant texts.

Cases: null text or role is empty; rows with equal turns are ordered by role,
then text, nulls first; repeated rows stay; null conv_id is a conversation of
its own; empty table: no rows; other columns are ignored. A conversation
becomes one string, so its rows meet in one row by nature.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha_hex

OPEN, PART, CLOSE = "<turn>", "<part>", "</turn>\n"


def _escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b"))
    for ctl in ("<turn>", "<part>", "</turn>"):
        c = F.replace(c, F.lit(ctl), F.lit("\\l" + ctl[1:]))
    return c


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(_escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return _unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_chats(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role",
                 text_col="text") -> DataFrame:
    """conv_id, formatted string, loss_mask array<boolean>, n_merged int."""
    d = rows.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # indexes at which a merged turn starts, then the slices between them
    first = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (
        F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]))
    d = d.withColumn("st", first)
    stop = lambda k: F.coalesce(F.get("st", k + 1), F.size("ts") + 1)
    merged = F.transform("st", lambda s, k: F.struct(
        F.element_at("ts", s)["role"].alias("role"),
        F.transform(F.slice("ts", s, stop(k) - s), lambda t: t["text"]).alias("texts")))
    d = d.withColumn("turns", merged)
    block = lambda t: F.concat(
        F.lit(OPEN), escape_role(t["role"]), F.lit("\n"),
        F.array_join(F.transform(t["texts"], _escape), PART), F.lit(CLOSE))
    return d.select(
        "conv_id", F.array_join(F.transform("turns", block), "").alias("formatted"),
        F.transform("ts", lambda t: t["role"] == "assistant").alias("loss_mask"),
        F.size("turns").alias("n_merged"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: one element per original row, in order."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: F.length(b) > 0)

    def turn(b):
        head = F.substring_index(b, "\n", 1)
        role = unescape_role(F.substring(head, len(OPEN) + 1, 2147483647))
        texts = F.split(F.substring(b, F.length(head) + 2, F.lit(2147483647)), PART)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), _unescape(x).alias("text")))
    return F.flatten(F.transform(blocks, turn))


def loss_text(turns: Column, mask: Column) -> Column:
    """The text under the loss mask of parsed turns."""
    kept = F.filter(F.zip_with(turns, mask, lambda t, m: F.struct(t["text"].alias("x"), m.alias("m"))),
                    lambda z: z["m"])
    return F.array_join(F.transform(kept, lambda z: z["x"]), "")


TRAP = "\\### Assistant: </turn> ok"


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"))
                            for i, r in enumerate(("user", "assistant"))])).alias("t"))
    trap = trap.select("conv_id", "t.turn", "t.role", F.lit(TRAP).alias("text"))
    out = format_chats(conv.union(trap))
    out = out.withColumn("turns", parse(F.col("formatted")))
    loss = loss_text(F.col("turns"), F.col("loss_mask"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        sha_hex(F.array_join(lines, "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), sha_hex(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_merged")


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (
  SELECT *, (rn = 1 OR role <> prev) AS head,
    replace(replace(replace(replace(text, '\', '\b'), '<turn>', '\lturn>'), '<part>', '\lpart>'), '</turn>', '\l/turn>') AS esc,
    replace(replace(replace(replace(replace(role, '\', '\b'), '<turn>', '\lturn>'), '<part>', '\lpart>'), '</turn>', '\l/turn>'), chr(10), '\n') AS erole
  FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN head THEN 15 + length(erole) + length(esc) ELSE 6 + length(esc) END)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE head)::INT AS n_merged
FROM e GROUP BY conv_id
"""
