"""Approximate nearest neighbours by inner product: one hierarchical
navigable small-world graph per shard, kept as flat neighbour arrays.

Equal vectors form one class; only classes are indexed, so copies can't fill
a neighbour list, and a class keeps its k + 1 smallest ids, which are all
that ties can ask of it. Classes are dealt to shards by hash (SHARD_ROWS a
shard, a fixed bound of a task's memory). Inner product becomes proximity by
one more coordinate, sqrt(R^2 - |x|^2). Levels are drawn by hash; a node's
links at a level are chosen from its EF_BUILD nearest of that level by the
diversity rule, then made mutual up to the level's width. Searches descend
greedily through the upper levels and run a best-first beam of EF_SEARCH on
the lowest one, for a block of queries at a time. Shard results are merged
by exact score. A task searches one shard for QUERY_BYTES of queries, so the
index is shipped once per that many queries, not once per block.

Defined cases: null, zero or empty vectors, vectors with null or non-finite
components and rows without an id take no part; only vectors of one length
meet; repeated rows count once; fewer candidates than k give shorter lists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import U, mix, work_dir, written

QUERY = "op4_hnsw_neighbours"
ORACLE_SQL = None       # approximate; recall is tested against brute force

SHARD_ROWS = 8192
LINKS, LINKS_0 = 16, 32
EF_BUILD = 64
EF_SEARCH = 160
EXPAND = 4              # beam entries expanded per step
BLOCK = 512             # queries searched together
QUERY_BYTES = 32 << 20  # query vectors in one task; a shard is sent once for each
TOP = 20
QUERY_STEP = 20

INDEX = ("dim int, shard int, n int, ids binary, vectors binary, levels int, nodes binary, "
         "links binary, widths string, entry int")
FOUND = "q long, c long, score double"


# ------------------------------------------------------------------- graph

def _augmented(x: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", x, x)
    extra = np.sqrt(np.maximum(sq.max() - sq, 0.0))
    return np.concatenate([x, extra[:, None]], axis=1).astype(np.float32)


def _links(a: np.ndarray, out: int, width: int) -> np.ndarray:
    """Flat neighbour array (len(a) x width, -1 filled) of one level."""
    n = len(a)
    adj = np.full((n, width), -1, dtype=np.int32)
    if n < 2:
        return adj
    ef = min(EF_BUILD, n - 1)
    sq = np.einsum("ij,ij->i", a, a)
    src, dst, val = [], [], []
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(lo + 256, n))
        s = a[rows] @ a.T
        s[np.arange(len(rows)), rows] = -np.inf
        c = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
        v = np.take_along_axis(s, c, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        c, v = np.take_along_axis(c, order, 1), np.take_along_axis(v, order, 1)
        near = a[c]
        pair = near @ near.transpose(0, 2, 1)
        # Diversity: keep a candidate that is closer to the node than to
        # every neighbour kept before it (squared distances).
        to_node = sq[rows][:, None] + sq[c] - 2 * v
        apart = sq[c][:, :, None] + sq[c][:, None, :] - 2 * pair
        kept = np.zeros(c.shape, dtype=bool)
        for j in range(ef):
            rival = (kept & (apart[:, :, j] < to_node[:, j:j + 1])).any(axis=1)
            kept[:, j] = ~rival & (kept.sum(axis=1) < out)
        # Fill with the nearest of the rest.
        rank = np.where(kept, 0, 1) * ef + np.arange(ef)[None, :]
        pick = np.argsort(rank, axis=1, kind="stable")[:, :min(out, ef)]
        src.append(np.repeat(rows, pick.shape[1]))
        dst.append(np.take_along_axis(c, pick, 1).ravel())
        val.append(np.take_along_axis(v, pick, 1).ravel())
    src, dst, val = np.concatenate(src), np.concatenate(dst), np.concatenate(val)
    own = np.concatenate([np.zeros(len(src)), np.ones(len(src))])
    s2, d2 = np.concatenate([src, dst]), np.concatenate([dst, src])
    v2 = np.concatenate([val, val])
    order = np.lexsort((d2, -v2, own, s2))       # own links first, then mutual ones
    s2, d2 = s2[order], d2[order]
    _, first = np.unique(s2.astype(np.int64) * n + d2, return_index=True)
    first.sort()
    s2, d2 = s2[first], d2[first]
    begin = np.searchsorted(s2, np.arange(n))
    rank = np.arange(len(s2)) - begin[s2]
    ok = rank < width
    adj[s2[ok], rank[ok]] = d2[ok]
    return adj


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """The graph of one shard as flat arrays."""
    a = _augmented(x)
    with np.errstate(over="ignore"):
        u = (mix(ids.astype(np.int64).view(np.uint64) + U(0x51ED2701)) >> U(11)).astype(float)
    level = np.floor(-np.log((u + 1) / (1 << 53)) / math.log(LINKS)).astype(int)
    level = np.minimum(level, 6)
    nodes, links, widths = [], [], []
    for lv in range(level.max() + 1):
        at = np.flatnonzero(level >= lv).astype(np.int32)
        width = LINKS_0 if lv == 0 else LINKS
        local = _links(a[at], LINKS, width)
        nodes.append(at)
        links.append(np.where(local >= 0, at[np.maximum(local, 0)], -1).astype(np.int32))
        widths.append(width)
    return {"nodes": nodes, "links": links, "widths": widths,
            "entry": int(nodes[-1][0])}


def search(g: dict, x: np.ndarray, q: np.ndarray, k: int, ef: int = EF_SEARCH
           ) -> tuple[np.ndarray, np.ndarray]:
    """(positions, exact scores), best first, of the best found for each row
    of ``q``; -1 where there are fewer than ``k``."""
    n, m = len(x), len(q)
    f, fq = x.astype(np.float32), q.astype(np.float32)
    cur = np.full(m, g["entry"], dtype=np.int64)
    val = fq @ f[g["entry"]]
    for lv in range(len(g["nodes"]) - 1, 0, -1):     # greedy descent
        place = np.full(n, -1, dtype=np.int64)
        place[g["nodes"][lv]] = np.arange(len(g["nodes"][lv]))
        live = np.arange(m)
        while len(live):
            nb = g["links"][lv][place[cur[live]]]
            s = np.einsum("qd,qmd->qm", fq[live], f[np.maximum(nb, 0)])
            s[nb < 0] = -np.inf
            j = s.argmax(axis=1)
            best = s[np.arange(len(live)), j]
            up = best > val[live]
            cur[live[up]], val[live[up]] = nb[np.arange(len(live)), j][up], best[up]
            live = live[up]
    ef = min(max(ef, k), n)
    seen = np.zeros((m, n), dtype=bool)
    seen[np.arange(m), cur] = True
    beam = np.full((m, ef), -1, dtype=np.int64)
    sim = np.full((m, ef), -np.inf, dtype=np.float32)
    todo = np.zeros((m, ef), dtype=bool)
    beam[:, 0], sim[:, 0], todo[:, 0] = cur, val, True
    live = np.arange(m)
    flat = g["links"][0]
    while len(live):
        b, s, t = beam[live], sim[live], todo[live]
        want = np.where(t, s, -np.inf)
        e = min(EXPAND, ef)
        pick = np.argpartition(-want, e - 1, axis=1)[:, :e]
        ok = np.take_along_axis(want, pick, 1) > -np.inf
        np.put_along_axis(t, pick, False, 1)
        node = np.where(ok, np.take_along_axis(b, pick, 1), -1)
        nb = np.where(node[:, :, None] >= 0, flat[np.maximum(node, 0)], -1).reshape(len(live), -1)
        fresh = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
        # One entry each of neighbours that several expanded nodes share.
        r, c = np.nonzero(fresh)
        key = np.unique(r.astype(np.int64) * n + nb[r, c])
        r, v = key // n, key % n
        seen[live[r], v] = True
        new = np.einsum("id,id->i", fq[live[r]], f[v])
        count = np.bincount(r, minlength=len(live))
        wide = int(count.max()) if len(r) else 0
        if wide:
            col = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            nv = np.full((len(live), wide), -1, dtype=np.int64)
            ns = np.full((len(live), wide), -np.inf, dtype=np.float32)
            nv[r, col], ns[r, col] = v, new
            b = np.concatenate([b, nv], axis=1)
            s = np.concatenate([s, ns], axis=1)
            t = np.concatenate([t, nv >= 0], axis=1)
            top = np.argpartition(-s, ef - 1, axis=1)[:, :ef]
            b, s, t = (np.take_along_axis(z, top, 1) for z in (b, s, t))
        beam[live], sim[live], todo[live] = b, s, t
        live = live[t.any(axis=1)]
    # Exact scores in double precision, ties to the smaller position later.
    top = np.argsort(-sim, axis=1, kind="stable")[:, :min(ef, 2 * k)]
    got = np.take_along_axis(beam, top, 1)
    score = np.einsum("qd,qkd->qk", q, x[np.maximum(got, 0)])
    score[got < 0] = -np.inf
    return got, score


# ------------------------------------------------------------- Spark parts

def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid")
    ids = pdf["cid"].to_numpy(np.int64)
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    g = build(ids, x)
    return pd.DataFrame([{
        "dim": key[0], "shard": key[1], "n": len(ids), "ids": ids.tobytes(),
        "vectors": x.tobytes(), "levels": len(g["nodes"]),
        "nodes": b"".join(np.array([len(z)], np.int32).tobytes() + z.tobytes()
                          for z in g["nodes"]),
        "links": b"".join(z.tobytes() for z in g["links"]),
        "widths": ",".join(map(str, g["widths"])), "entry": g["entry"]}])


def _graph(row) -> tuple[dict, np.ndarray, np.ndarray]:
    """(graph, ids, vectors) of one stored shard."""
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    nodes, links, a, b = [], [], 0, 0
    for w in map(int, row["widths"].split(",")):
        n = int(np.frombuffer(row["nodes"], np.int32, 1, a)[0])
        nodes.append(np.frombuffer(row["nodes"], np.int32, n, a + 4))
        links.append(np.frombuffer(row["links"], np.int32, n * w, b).reshape(n, w))
        a, b = a + 4 + 4 * n, b + 4 * n * w
    return {"nodes": nodes, "links": links, "entry": int(row["entry"])}, ids, x


def _search_block(queries: pd.DataFrame, index: pd.DataFrame, k: int, ef: int) -> pd.DataFrame:
    if not len(queries) or not len(index):
        return pd.DataFrame({"q": [], "c": [], "score": []}).astype(
            {"q": "int64", "c": "int64", "score": "float64"})
    g, ids, x = _graph(index.iloc[0])
    queries = queries.sort_values("cid")
    got, score = [], []
    for at in range(0, len(queries), BLOCK):
        q = np.stack(queries["v"].iloc[at:at + BLOCK].to_numpy()).astype(np.float64)
        a, b = search(g, x, q, k, ef)
        got.append(a)
        score.append(b)
    got, score = np.concatenate(got), np.concatenate(score)
    who = np.repeat(queries["cid"].to_numpy(np.int64), got.shape[1])
    got, score = got.ravel(), score.ravel()
    ok = got >= 0
    return pd.DataFrame({"q": who[ok], "c": ids[got[ok]], "score": score[ok]})


def nearest(vectors: DataFrame, is_query, k: int = TOP, id_col: str = "vec_id",
            vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH,
            query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row
    that ``is_query(id column)`` names, among all other rows."""
    base = work_dir(vectors.sparkSession, "ann")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")))
    v = written(v.filter("vec_id is not null and v is not null").filter(
        finite & F.exists("v", lambda z: z != 0.0)).withColumn(
        "v", F.transform("v", lambda z: z + 0.0)), f"{base}/vectors")
    # Classes of equal vectors, by a 128-bit hash of the components.
    v = v.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("v")))
    cls = written(v.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid")), f"{base}/classes")
    ids = written(v.select("vec_id", "h1", "h2").distinct().join(cls, ["h1", "h2"]).select(
        "vec_id", "cid"), f"{base}/ids")
    rep = written(v.join(cls, ["h1", "h2"]).filter("vec_id = cid").dropDuplicates(["cid"]).select(
        "cid", "v", F.size("v").alias("dim")), f"{base}/representatives")
    n = rep.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double")
    shards = max(1, -(-n // shard_rows))
    index = written(rep.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int"))
                    .groupBy("dim", "shard").applyInPandas(_build_shard, INDEX), f"{base}/index")
    # The query set, in parts that a task can hold, against every shard.
    asked = written(ids.filter(is_query(F.col("vec_id"))), f"{base}/asked")
    q = rep.join(asked.select("cid").distinct(), "cid", "left_semi")
    n_bytes = q.agg(F.sum(8 * F.col("dim").cast("long"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // query_bytes))
    q = (q.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(blocks)).cast("int"))
         .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    parts = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    found = q.groupBy(*key).cogroup(parts.groupBy(*key)).applyInPandas(
        lambda a, b: _search_block(a, b, k + 1, ef), FOUND)
    best = W.partitionBy("q").orderBy(F.desc("score"), "c")
    found = written(found.withColumn("r", F.row_number().over(best)).filter(
        F.col("r") <= k + 1).drop("r"), f"{base}/found")
    # Back to rows: a class gives its k + 1 smallest ids, equal scores go by id.
    member = W.partitionBy("cid").orderBy("vec_id")
    members = written(ids.withColumn("r", F.row_number().over(member)).filter(
        F.col("r") <= k + 1).select(F.col("cid").alias("c"), "vec_id"), f"{base}/members")
    rows = (found.join(members, "c").select("q", "vec_id", "score"))
    near = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = written(rows.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1),
                   f"{base}/rows")
    ask = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q"))
    out = ask.join(rows, "q").filter("query_id <> vec_id")
    # A query's own row shifts those behind it by one.
    return out.withColumn("rank", F.row_number().over(
        W.partitionBy("query_id").orderBy("r"))).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 20 nearest of every 20th vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"),
                   lambda c: c % QUERY_STEP == 0)
