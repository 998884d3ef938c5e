"""Hard negatives by angular triangle filtering.

A component x becomes floor(256 * x); a row's score is its integer inner
product with the anchor. Every row stores its norm and its angles to a few
reference directions. For an anchor a and a row v each reference r bounds the
angle between them from both sides,

    |t(a,r) - t(v,r)|  <=  t(a,v)  <=  min(t(a,r) + t(v,r), 2 pi - both),

so the references together give an interval of the cosine and, times both
norms and widened by more than all rounding, an interval [low, high] of the
score. Only rows whose interval overlaps what is asked are scored:

* positives: the rows of the anchor's label whose ``high`` reaches the
  K-th largest ``low`` of such rows;
* negatives: the rows of other labels whose interval overlaps a window
  [low_percent, high_percent] of one of the anchor's positive scores.

Scoring is exact in integers, so the references decide the cost, never the
result. They are taken from a bounded sample of rows (``REFERENCE_SAMPLE`` by
smallest hash) by farthest-first traversal: tight clusters are told apart,
directions without structure are not, and then most rows are scored.

Anchors meet all rows in a grid of (anchor block, row chunk) cells, each
built from at most about BLOCK anchors and CHUNK rows whatever the data, dealt by hash of a
row number, so neither labels nor copies make a hot cell. A cell returns at most K rows per
list, and one top-K merge joins the cells of a list.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; only vectors of one length meet; a null id is no
anchor and sorts last among ties; repeated rows are rows of their own (each
is another row to its twin, each an anchor); an anchor without positives,
or with negative positive scores only, has no negatives; other columns are not
read, so their names never clash; an empty table gives an empty result. A
scaled component beyond ``centroids.LIMIT`` raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .centroids import scaled, usable
from .common import work_dir, written

QUERY = "op12_hard_negatives"

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100     # a negative's score, in percent of the positive's
REFERENCES = 8
REFERENCE_SAMPLE = 2048
BLOCK = 8192            # anchors of a cell
CHUNK = 16384           # rows of a cell
STEP = 2048             # rows of a cell bounded at once for one block of anchors
ANGLE_SLACK = 1e-6      # above the error of an angle between near-parallel vectors
EXACT_DOUBLE = 1 << 52  # products of norms below this are summed exactly in doubles
ANCHOR_STEP, SHIFT_STEP, LABELS = 100, 7, 10

_ROW = "row long, vec_id long, label long, v array<int>, norm double, angles array<double>"
_FOUND = "anchor long, list int, score long, vec_id long, row long"


# ------------------------------------------------------------ references

def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` entries."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def references(rows: DataFrame, count: int = REFERENCES) -> dict[int, np.ndarray]:
    """Unit reference directions per vector length, from a bounded sample."""
    sample = rows.orderBy(F.xxhash64("v"), "row").limit(REFERENCE_SAMPLE).select("v").collect()
    found: dict[int, np.ndarray] = {}
    for dim in sorted({len(r["v"]) for r in sample}):
        x = np.array([r["v"] for r in sample if len(r["v"]) == dim], dtype=np.float64)
        norm = np.linalg.norm(x, axis=1)
        x = x[norm > 0] / norm[norm > 0, None]
        if not len(x):
            continue
        picked, near = [0], x @ x[0]
        while len(picked) < min(count, len(x)):
            picked.append(int(near.argmin()))
            near = np.maximum(near, x @ x[picked[-1]])
        found[dim] = x[picked]
    return found


def _measured(refs: dict[int, np.ndarray]):
    """Adds norm and angles to (row, vec_id, label, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.array(v, dtype=np.float64) for v in batch.column("v").to_pylist()]
            norms = np.array([np.linalg.norm(v) for v in vecs], dtype=np.float64)
            angles = []
            for v, n in zip(vecs, norms, strict=True):
                r = refs.get(len(v))
                angles.append([] if r is None else
                              np.arccos(np.clip(r @ (v / n if n else v), -1.0, 1.0)).tolist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "vec_id", "label", "v")],
                 pa.array(norms), pa.array(angles, pa.list_(pa.float64()))],
                names=["row", "vec_id", "label", "v", "norm", "angles"])
    return run


# ----------------------------------------------------------------- cells

class _Rows:
    """The rows of one side of a cell as arrays."""

    def __init__(self, t: pa.Table, dim: int):
        t = t.combine_chunks()
        self.row = t.column("row").to_numpy()
        vid = t.column("vec_id")
        self.vec_id = vid
        self.no_id = vid.is_null().to_numpy()
        self.ids = vid.fill_null(0).to_numpy()
        self.label = t.column("label").to_numpy()
        self.v = _matrix(t.column("v"), dim).astype(np.int64)
        self.f = self.v.astype(np.float64)
        self.norm = t.column("norm").to_numpy()
        self.angles = _matrix(t.column("angles"), len(t.column("angles")[0]))


def _bounds(a: _Rows, i: int, b: _Rows, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers (low, high) around the scores of rows lo..hi-1 with anchor i."""
    product = a.norm[i] * b.norm[lo:hi]
    if not b.angles.shape[1]:
        least, most = np.zeros(hi - lo), np.full(hi - lo, np.pi)
    else:
        x, y = a.angles[i][None, :], b.angles[lo:hi]
        least = np.abs(x - y).max(axis=1) - ANGLE_SLACK
        both = x + y
        most = np.minimum(both, 2 * np.pi - both).min(axis=1) + ANGLE_SLACK
    spare = product * 1e-9 + 1.0
    high = np.ceil(product * np.cos(np.clip(least, 0.0, np.pi)) + spare)
    low = np.floor(product * np.cos(np.clip(most, 0.0, np.pi)) - spare)
    return low, high


def _scores(a: _Rows, i: int, b: _Rows, at: np.ndarray) -> np.ndarray:
    """Exact integer scores of rows ``at``; a mere product when most rows
    of the cell are asked for, which spares the gathering."""
    if a.norm[i] * (b.norm[at].max() if len(at) else 0.0) < EXACT_DOUBLE:
        if 2 * len(at) > len(b.row):
            return (b.f @ a.f[i])[at].astype(np.int64)
        return (b.f[at] @ a.f[i]).astype(np.int64)
    return b.v[at] @ a.v[i]


def _ordered(b: _Rows, at: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions in ``at``, best score first, ties by id, null ids last."""
    return np.lexsort((b.row[at], b.ids[at], b.no_id[at], -score))


def _cell(pick: Callable, dim_of=lambda t: len(t.column("v")[0])):
    """A cogroup function: ``pick(anchors, i, extra, rows)`` yields (list,
    positions, scores) of anchor i."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"anchor": [], "list": [], "score": [], "vec_id": [], "row": []}
        if left.num_rows and right.num_rows:
            dim = dim_of(right)
            a, b = _Rows(left, dim), _Rows(right, dim)
            extra = left.column("wanted").to_pylist() if "wanted" in left.column_names else None
            for i in range(left.num_rows):
                for number, at, score in pick(a, i, extra and extra[i], b):
                    out["anchor"].append(np.full(len(at), a.row[i]))
                    out["list"].append(np.full(len(at), number, np.int32))
                    out["score"].append(score)
                    out["row"].append(b.row[at])
                    out["vec_id"].append(b.vec_id.take(pa.array(at)))
        def joined(name: str, kind) -> pa.Array:
            return pa.array(np.concatenate(out[name]) if out[name] else [], kind)
        ids = pa.chunked_array([c for x in out["vec_id"] for c in (
            x.chunks if isinstance(x, pa.ChunkedArray) else [x])], pa.int64())
        return pa.table({"anchor": joined("anchor", pa.int64()), "list": joined("list", pa.int32()),
                         "score": joined("score", pa.int64()), "vec_id": ids,
                         "row": joined("row", pa.int64())})
    return run


def _blocks(b: _Rows) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(b.row), STEP):
        yield lo, min(lo + STEP, len(b.row))


def _positives(k: int):
    def pick(a: _Rows, i: int, _, b: _Rows):
        alike = np.flatnonzero((b.label == a.label[i]) & (b.row != a.row[i]))
        if not len(alike):
            return
        low, high = map(np.concatenate, zip(*[_bounds(a, i, b, lo, hi) for lo, hi in _blocks(b)],
                                            strict=True))
        low, high = low[alike], high[alike]
        floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        at = alike[high >= floor]
        score = _scores(a, i, b, at)
        best = _ordered(b, at, score)[:k]
        yield 0, at[best], score[best]
    return pick


def _negatives(k: int, low_percent: int, high_percent: int):
    def pick(a: _Rows, i: int, wanted: list[int], b: _Rows):
        """``wanted``: the anchor's distinct positive scores."""
        windows = [(-(-low_percent * p // 100), high_percent * p // 100) for p in wanted]
        live = []
        for lo, hi in _blocks(b):
            low, high = _bounds(a, i, b, lo, hi)
            asked = np.zeros(hi - lo, dtype=bool)
            for first, last in windows:
                asked |= (high >= first) & (low <= last)
            live.append(lo + np.flatnonzero(asked & (b.label[lo:hi] != a.label[i])))
        at = np.concatenate(live)
        score = _scores(a, i, b, at)
        inside = score >= min(w[0] for w in windows)
        at, score = at[inside], score[inside]
        order = _ordered(b, at, score)
        at, score = at[order], score[order]
        for number, (first, last) in enumerate(windows):
            start, end = np.searchsorted(-score, [-last, -first + 1])
            some = slice(int(start), int(min(end, start + k)))
            if some.stop > some.start:
                yield number, at[some], score[some]
    return pick


# -------------------------------------------------------------- operator

def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, chunks: int, pick: Callable
          ) -> DataFrame:
    """All cells of anchor blocks and row chunks."""
    def dealt(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    left = anchors.withColumn("block", dealt(blocks, 1)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = rows.withColumn("chunk", dealt(chunks, 2)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = [F.size("v").alias("dim"), "block", "chunk"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_cell(pick), _FOUND)


def _merged(found: DataFrame, k: int, path: str) -> DataFrame:
    """The first ``k`` of every list with their rank."""
    best = W.partitionBy("anchor", "list").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return written(found.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= k), path)


def hard_negatives(vectors: DataFrame, is_anchor: Callable[[Column], Column],
                   label: Callable[[Column, Column], Column] = lambda i, c: c,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW,
                   high_percent: int = HIGH, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). ``is_anchor(id)`` marks anchors; ``label(id, label)``
    is the label that counts."""
    spark = vectors.sparkSession
    base = work_dir(spark, "hardneg")
    vid = F.col(id_col).cast("long")
    rows = written(vectors.filter(F.col(label_col).isNotNull() & usable(F.col(vec_col))).select(
        F.monotonically_increasing_id().alias("row"), vid.alias("vec_id"),
        F.coalesce(label(vid, F.col(label_col).cast("long")), F.col(label_col)).cast("long")
        .alias("label"), scaled(F.col(vec_col)).cast("array<int>").alias("v")), f"{base}/rows")
    rows = written(rows.mapInArrow(_measured(references(rows)), _ROW), f"{base}/measured")
    anchors = written(rows.filter(F.coalesce(is_anchor(F.col("vec_id")), F.lit(False))),
                      f"{base}/anchors")
    n, m = rows.count(), anchors.count()
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-m // BLOCK))

    pos = _merged(_grid(anchors, rows, blocks, chunks, _positives(positives)), positives,
                  f"{base}/positives")
    # Equal scores of one anchor share a window; below zero it is empty.
    wanted = pos.filter("score >= 0").groupBy("anchor").agg(
        F.sort_array(F.collect_set("score")).alias("wanted"))       # at most ``positives`` each
    asked = anchors.join(wanted, F.col("row") == F.col("anchor")).drop("anchor")
    neg = _merged(_grid(asked, rows, blocks, chunks,
                        _negatives(negatives, low_percent, high_percent)), negatives,
                  f"{base}/negatives")
    p = pos.filter("score >= 0").join(wanted, "anchor").select(
        "anchor", (F.array_position("wanted", F.col("score")) - 1).cast("int").alias("list"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    name = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return p.join(neg, ["anchor", "list"]).join(name, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: hard negatives of every 100th vector, every seventh label noisy."""
    return hard_negatives(
        spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % ANCHOR_STEP == 0,
        lambda i, c: F.when(i % SHIFT_STEP == 0, (c + 1) % LABELS).otherwise(c))


ORACLE_SQL = """
WITH raw AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
r AS MATERIALIZED (
  SELECT rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM raw
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)
              AS BIGINT) AS score
  FROM r a JOIN r b ON a.rid <> b.rid AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, b AS pos, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.pos
                               ORDER BY score DESC, s.vec_id NULLS LAST, s.b) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same
            AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.pos
                           ORDER BY score DESC, s.vec_id NULLS LAST, s.b) <= 5
"""
