"""Mixing sources to target weights.

Size of a document: number of `[^\\x20\\x09-\\x0D]+` words (null text: 0).
Sources in code-point order, null last, get the weights 5, 2, 1, repeating,
and share ``share_percent`` of all sizes in proportion; a target stops at
``cap`` times its source's size and the excess goes to the others by weight
until none is above. The repetition rate of a source is target / size; each
document is emitted floor(rate) times plus one copy when a hash of (seed,
doc_id, source) falls below the fraction: the draw needs no state, so reruns
and recomputed tasks agree.

The resharing has a closed form: with the sources in ascending order of
cap * size / weight, the first k are capped, where k is the first position
at which the remaining share per weight is no larger than the next ratio.

Defined cases: an empty text or a source of size 0 has target 0 and takes
nothing; null doc_ids draw by the text's hash; repeated rows draw alike; an
empty table gives no rows; source values differing in case or blanks are
different sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_total, work_dir, written

QUERY = "op5_mix_sources"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"
_DRAW = 1 << 32


def source_targets(sizes: DataFrame, base: str, weights=WEIGHTS, share_percent: int = SHARE_PERCENT,
                   cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per
    source, the order statistics by range-partitioned running totals."""
    s = sizes.withColumn("one", F.lit(1)).withColumn("is_null", F.col("source").isNull()) \
        .withColumn("name", F.coalesce("source", F.lit("")))
    ranked = running_total(s, ["is_null", "name"], "one", "rank", f"{base}/rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int"))
    # Ratios compare as exact fractions: size * (all other weights).
    scale = 1
    for x in weights:
        scale *= x
    ranked = (ranked.withColumn("weight", w.cast("long"))
              .withColumn("ratio", F.col("source_size") * (F.lit(scale) / F.col("weight"))
                          .cast("long")))
    ranked = running_total(ranked, ["ratio", "is_null", "name"], "weight", "w_before",
                           f"{base}/weights")
    ranked = running_total(ranked, ["ratio", "is_null", "name"], "source_size", "s_before",
                           f"{base}/sizes")
    tot = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("long").alias("size"),
                     F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight")).first()
    left = F.lit(tot["size"] * (share_percent / 100.0)) - cap * F.col("s_before")
    level = left / (F.lit(tot["weight"]) - F.col("w_before"))
    t = ranked.withColumn("level", level)
    cut = t.filter(F.col("level") * F.col("weight") <= cap * F.col("source_size")).agg(
        F.min_by("level", "w_before").alias("cut")).first()["cut"]
    target = F.least((cap * F.col("source_size")).cast("double"),
                     F.coalesce(F.lit(cut).cast("double") * F.col("weight"),
                                (cap * F.col("source_size")).cast("double")))
    return t.select("source", "source_size", F.when(F.col("source_size") > 0, target)
                    .otherwise(F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, share_percent: int = SHARE_PERCENT,
        cap: int = CAP, seed: str = SEED
        ) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target, copies (how often the mix
    holds the row) and taken (= copies * size), and the new names of columns
    that would clash with these."""
    base = work_dir(docs.sparkSession, "mixing")
    spare = {c: f"__mix_{c}" for c in docs.columns if c in (
        "size", "source_size", "target", "copies", "taken")}
    d = docs.withColumnsRenamed(spare) if spare else docs
    name = {c: spare.get(c, c) for c in (id_col, text_col, source_col)}
    size = F.coalesce(F.regexp_count(F.col(name[text_col]), F.lit(WORD)), F.lit(0)).cast("long")
    d = d.withColumn("size", size).withColumn("__src", F.col(name[source_col]).cast("string"))
    # Sizes once per document (the text is scanned here and nowhere else);
    # sources are pre-aggregated before the shuffle.
    per = d.groupBy(F.col("__src").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(per, base, weights, share_percent, cap), f"{base}/targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")) \
        .otherwise(F.lit(0.0))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(name[id_col]).cast("string"),
                                                   F.md5(F.coalesce(name[text_col], F.lit("")))),
                      F.coalesce("__src", F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(_DRAW))
    t = targets.withColumnRenamed("source", "__tsrc")
    # One row per source: the adaptive planner broadcasts it when measured
    # small; otherwise both sides are plain exchanges and a hot source splits.
    out = d.join(t, F.col("__src").eqNullSafe(F.col("__tsrc")), "left")
    out = out.withColumn("__rate", rate).withColumn(
        "copies", (F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1)
                   .otherwise(0)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(
        "__rate", "__src", "__tsrc"), spare


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The per-document report of the mix."""
    out, _ = mix(docs, **kw)
    return out


def emitted(docs: DataFrame, **kw) -> DataFrame:
    """The mix: every row of ``docs`` repeated ``copies`` times, columns as
    in ``docs``."""
    out, spare = mix(docs, **kw)
    out = out.filter("copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(spare.get(c, c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of each document."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "source")).select(
        F.col("doc_id"), "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
    WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, source_size * (10 // weight) AS ratio FROM r),
b AS (SELECT *, coalesce(sum(weight) OVER w, 0) AS w_before, coalesce(sum(source_size) OVER w, 0) AS s_before,
    sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM o WINDOW w AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_size::DOUBLE * 1.5::DOUBLE - 2 * s_before::DOUBLE) / (all_weight - w_before)::DOUBLE AS level FROM b),
c AS (SELECT arg_min(level, w_before) AS cut FROM l WHERE level * weight <= 2 * source_size),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN
    least((2 * source_size)::DOUBLE, coalesce((SELECT cut FROM c) * weight, (2 * source_size)::DOUBLE)) ELSE 0.0::DOUBLE END AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('{SEED}|' || d.k || '|' || coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / {_DRAW}.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM j)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
"""
