"""Centroid clustering (k-means) in integers, by JVM expressions only.

A component x becomes floor(256 * x). The centroids enter each round's plan
as one literal array of arrays, K * DIM numbers whatever the table's size:
``zip_with`` and ``aggregate`` give a vector's squared distance to each,
``array_min`` of (distance, number) structs chooses the cluster, and DIM sum
columns, combined in the map tasks, give the next centroids. A round sends
one row per task and cluster through the shuffle and at most K rows to the
driver; no vector is shuffled, so a cluster that holds a third of all rows
costs nothing more. The integer vectors are written once below the shared
checkpoint folder and read by every round.

Centroids start as the K vectors with the smallest SHA-256 of
``<seed>:<id>``, in hash order. Sums, floors and distances are exact.

Defined cases: a null vector, one with another number of components than DIM
or with a null or non-finite component takes no part; a vector with a null id
is clustered but never a seed; repeated ids are rows of their own, equal
hashes go by the smaller vector; distance ties go to the smaller number;
empty clusters keep their centroid; with fewer than K vectors there are fewer
centroids, with none the result is empty; other columns of the input are not
read, so their names never clash. A scaled component beyond
``LIMIT`` raises, as distances would outgrow 64 bits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_dir, written

QUERY = "op11_centroid_clusters"

K = 40
DIM = 64
ROUNDS = 5
SEED = "2"
SCALE = 256
LIMIT = 1 << 27         # |scaled component|; 64 squared differences fit 64 bits


def usable(vec: Column) -> Column:
    """Every component is there and finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vec: Column) -> Column:
    """floor(SCALE * x) of every component; raises beyond LIMIT."""
    ints = F.transform(vec, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return F.when(F.exists(ints, lambda x: (x > LIMIT) | (x < -LIMIT)),
                  F.raise_error(F.lit(f"vector component beyond {LIMIT / SCALE:.0f}"))
                  ).otherwise(ints)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    vec = F.col(vec_col)
    return vectors.filter(usable(vec) & (F.size(vec) == dim)).select(
        F.col(id_col).cast("long").alias("vec_id"), scaled(vec).alias("v"))


def first_centroids(v: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The seed vectors: at most ``k`` rows come back."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = (v.filter("vec_id is not null").select(key.alias("h"), "v")
            .orderBy("h", "v").limit(k).collect())
    return [list(r["v"]) for r in rows]


def _literal(centroids: list[list[int]]) -> Column:
    """A constant array of arrays, folded when the plan is made."""
    return F.expr("array(" + ", ".join(
        "array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")


def nearest(vec: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid."""
    def measured(c: Column, number: Column) -> Column:
        squares = F.zip_with(vec, c, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x)
                        .alias("distance"), number.cast("int").alias("cluster"))
    return F.array_min(F.transform(_literal(centroids), measured))


def moved(v: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after one round: floors of exact column means."""
    near = v.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    sums = near.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]).collect()
    out = [list(c) for c in centroids]
    for r in sums:                              # at most one row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED,
             id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM
             ) -> tuple[DataFrame, DataFrame]:
    """(assigned, centroids): vec_id, cluster, distance per vector that takes
    part, and cluster, centroid, n, inertia per centroid (n = 0: empty)."""
    spark = vectors.sparkSession
    base = work_dir(spark, "centroids")
    v = written(integer_vectors(vectors, id_col, vec_col, dim), f"{base}/vectors")
    centroids = first_centroids(v, k, seed)
    made = "cluster int, centroid array<long>"
    if not centroids:
        # All ids are null, or no vector takes part: nothing to start from.
        return (spark.createDataFrame([], "vec_id long, cluster int, distance long"),
                spark.createDataFrame([], f"{made}, n long, inertia long"))
    for _ in range(rounds):
        centroids = moved(v, centroids, dim)
    assigned = written(v.select("vec_id", nearest(F.col("v"), centroids).alias("near"))
                       .select("vec_id", "near.cluster", "near.distance"), f"{base}/assigned")
    table = spark.createDataFrame(list(enumerate(centroids)), made)
    per = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                          F.sum("distance").alias("inertia"))
    # At most k rows on either side.
    return assigned, table.join(F.broadcast(per), "cluster", "left").select(
        "cluster", "centroid", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("inertia", F.lit(0)).cast("long").alias("inertia"))


def report(vectors: DataFrame, **options) -> DataFrame:
    """One row per clustered vector with the figures of its cluster."""
    assigned, centroids = clusters(vectors, **options)
    rows = centroids.collect()                  # at most k
    total = sum(r["inertia"] for r in rows)
    small = vectors.sparkSession.createDataFrame(
        [(r["cluster"], r["inertia"], total, digest(r["centroid"])) for r in rows],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every 64-component vector with its cluster of 40."""
    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The same rounds, unrolled."""
    near = """
near{r} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, c := c)) AS m FROM (
    SELECT v.rid, k.c, CAST(list_sum(list_transform(list_zip(v.v, k.v),
             lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM vecs v, cent{r} k) GROUP BY rid)"""
    move = """
sums{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (
    SELECT n.m.c AS c, unnest(v.v) AS x, unnest(range(1, 65)) AS i
    FROM near{p} n JOIN vecs v USING (rid)) GROUP BY c, i),
cent{r} AS MATERIALIZED (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM cent{p} k LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM sums{r} GROUP BY c) m ON m.c = k.c)"""
    parts = ["""
raw AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
vecs AS MATERIALIZED (
  SELECT rid, vec_id, list_transform(embedding,
           lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM raw WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
cent0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (
    SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM vecs
    WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40))"""]
    for r in range(ROUNDS):
        parts += [near.format(r=r), move.format(r=r + 1, p=r)]
    parts.append(near.format(r=ROUNDS))
    return ("WITH " + ",".join(parts) + f""",
ans AS (SELECT v.vec_id, n.m.c AS c, n.m.d AS d FROM near{ROUNDS} n JOIN vecs v USING (rid))
SELECT vec_id, a.c AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM ans a JOIN cent{ROUNDS} k ON k.c = a.c""")


ORACLE_SQL = _oracle()
