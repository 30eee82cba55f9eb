"""Chat formatting, relational: sort collected turn structs, merge same-role neighbours, concatenate.

Only Spark expressions are used. A conversation becomes one string of blocks

    <|role|>ROLE<|text|>TEXT[<|next|>TEXT...]<|end|>\\n

where adjacent turns of one role share a block, their texts divided by ``<|next|>``. Control strings
inside roles and texts (also those of two other common templates) are escaped reversibly, so that
:func:`read_back` returns exactly the turns that went in.

Defined results: null roles and texts read as empty; turns sort by (turn, role, text) with null turns
first, so ties and repeated rows keep a fixed order; null ``conv_id`` is a conversation of its own;
extra columns are ignored; an empty table gives no rows. One conversation is one output row by
definition, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Control strings and what stands for them inside texts; the escape sign itself comes first.
ESCAPES = (("~", "~0"), ("<|", "~1"), ("<s>", "~2"), ("</s>", "~3"), ("[INST]", "~4"), ("[/INST]", "~5"))


def escape(c: Column) -> Column:
    """Replace each control string; the result holds none."""
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`."""
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted string.

    ``segments`` joined give ``formatted``; ``loss`` marks the segments that count for training, which
    are exactly the escaped texts of ``loss_role``.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segments(x, i):
        first = (i == 0) | (F.get("ts", i - 1)["role"] != x["role"])
        last = F.coalesce(F.get("ts", i + 1)["role"] != x["role"], F.lit(True))
        head = F.when(first, F.concat(F.lit("<|role|>"), escape(x["role"]), F.lit("<|text|>"))).otherwise(F.lit("<|next|>"))
        seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(
            seg(head, F.lit(False)),
            seg(escape(x["text"]), x["role"] == F.lit(loss_role)),
            seg(F.when(last, F.lit("<|end|>\n")).otherwise(F.lit("")), F.lit(False)),
        )

    out = convs.select("conv_id", F.flatten(F.transform("ts", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds ``turns`` array<struct<role, text>> parsed from ``formatted``, and ``loss_text``: the texts of ``loss_role`` found
    there, which must be what the mask of ``segments`` marks."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda b: b != "")

    def parse(b):
        parts = F.split(b, r"<\|text\|>", 2)
        role = unescape(F.substring_index(F.get(parts, F.lit(0)), "<|role|>", -1))
        return F.struct(role.alias("role"), F.split(F.get(parts, F.lit(1)), r"<\|next\|>", -1).alias("texts"))

    # the inner transform sees the block already parsed: a block of many turns is split once
    turns = F.flatten(F.transform(F.transform(blocks, parse), lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    marked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    found = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == F.lit(loss_role)), lambda t: t["text"]), "")
    same = F.when(found == marked, found).otherwise(F.raise_error(F.lit("the loss mask differs from the formatted text")))
    return formatted.withColumn("turns", turns).withColumn("loss_text", same)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every formatted conversation, plus conversation -1, read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = read_back(format_conversations(turns.unionByName(probe)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(c: str) -> str:
    for raw, safe in ESCAPES:
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, CASE WHEN before IS NULL OR before <> role THEN length('<|role|><|text|>') + length({_escaped_sql('role')}) ELSE length('<|next|>') END
    + length({_escaped_sql('text')}) + CASE WHEN after IS NULL OR after <> role THEN length('<|end|>') + 1 ELSE 0 END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
