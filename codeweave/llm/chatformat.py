"""Chat formatting with cumulative-snapshot collapse.

A log may hold one conversation many times, each snapshot a few turns
longer. A turn is (turn, role, text); a conversation is its distinct turns
in order. Every turn gets a rolling hash of the conversation up to it: two
exact sums of 63-bit turn hashes, as running totals over all turns in
(conv_id, turn) order less the total before the conversation, so no task
needs a whole conversation. Conversations with equal final hashes collapse
to the smallest conv_id; an anti-join against the hashes of inner turns
removes those that are a prefix of a longer one. What is left is rendered.

Defined cases: null role or text counts as empty (and equals empty); a null
conv_id is a conversation of its own rows, a null turn sorts first; repeated
rows count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_total, work_dir, written

QUERY = "op10_chat_snapshots"
OPEN, CLOSE = "<|", "|>"
HASH = "decimal(38,0)"


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                          role_col: str = "role", text_col: str = "text",
                          base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, turns): kept = one row per maximal conversation (conv_id,
    n_turns, n_copies); turns = the distinct turns of all conversations."""
    base = base or work_dir(turns.sparkSession, "chat")
    t = written(turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct(), f"{base}/turns")
    h = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), "turn", "role", "text"), 1).cast(HASH)
         for seed in (1, 2)]
    slim = t.select("conv_id", "turn", "role", F.xxhash64("text").alias("tie"),
                    h[0].alias("h1"), h[1].alias("h2"), F.lit(1).cast("long").alias("one"))
    keys = ["conv_id", "turn", "role", "tie"]
    r = running_total(slim, keys, "h1", "b1", f"{base}/run1", HASH)
    r = running_total(r, keys, "h2", "b2", f"{base}/run2", HASH)
    r = written(running_total(r, keys, "one", "b0", f"{base}/run0"), f"{base}/run")
    # Totals grow along a conversation, so its start has the smallest.
    start = written(r.groupBy(F.col("conv_id").alias("c")).agg(
        F.min("b1").alias("s1"), F.min("b2").alias("s2"), F.min("b0").alias("s0"),
        F.count(F.lit(1)).alias("n_turns")), f"{base}/starts")
    p = r.join(start, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "n_turns", (F.col("b0") - F.col("s0") + 1).alias("upto"),
        (F.col("b1") + F.col("h1") - F.col("s1")).cast(HASH).alias("p1"),
        (F.col("b2") + F.col("h2") - F.col("s2")).cast(HASH).alias("p2"))
    p = written(p, f"{base}/prefixes")
    key = ["upto", "p1", "p2"]
    whole = p.filter("upto = n_turns").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = p.filter("upto < n_turns").select(*key).distinct()
    kept = whole.join(inner, key, "left_anti").select(
        "conv_id", F.col("upto").alias("n_turns"), "n_copies")
    return written(kept, f"{base}/kept"), t


def render(kept: DataFrame, turns: DataFrame) -> DataFrame:
    """``kept`` with ``rendered``: the conversation in template form, one
    block a turn. Template marks inside a text are broken up."""
    k = kept.select(F.col("conv_id").alias("k"))
    own = turns.join(k, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")

    def clean(c):
        return F.replace(F.replace(c, F.lit(OPEN), F.lit("< |")), F.lit(CLOSE), F.lit("| >"))
    block = F.concat(F.lit(OPEN), clean(F.col("role")), F.lit(CLOSE), F.lit("\n"),
                     clean(F.col("text")), F.lit(f"{OPEN}end{CLOSE}\n"))
    lines = own.groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role",
        F.xxhash64("text").alias("tie"), block.alias("block")))).alias("blocks"))
    text = lines.select("c", F.array_join(F.col("blocks.block"), "").alias("rendered"))
    return kept.join(text, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")


def chat_documents(turns: DataFrame, **cols) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of every maximal conversation."""
    return render(*maximal_conversations(turns, **cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the maximal conversations, rendered."""
    return chat_documents(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS ts
  FROM t GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, ts FROM c GROUP BY ts),
p AS (SELECT DISTINCT ts[1:k] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM w)),
k AS (SELECT w.* FROM w LEFT JOIN p ON w.ts = p.ts WHERE p.ts IS NULL)
SELECT conv_id, len(ts)::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
  array_to_string(list_transform(ts, lambda x: '<|' || replace(replace(x.role, '<|', '< |'), '|>', '| >') || '|>' || chr(10)
    || replace(replace(x.text, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10)), '') AS rendered
FROM k
"""
