"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A ring of 64-bit positions holds VNODES points per shard; a document sits at
a hash of its id (without id: of its text) and belongs to the next point
clockwise. Loads are bounded: of n rows and m shards a shard takes n // m
rows, the first n % m shards one more, so row counts are at most one apart
(law ``rows``). Keys enter in ring order; one that meets a full shard
continues clockwise to the next shard with room.

That sequence needs no loop over rows. A row's place in it is its rank in
ring order (a range sort of ids and hashes, numbered within each sorted
partition; one row per partition gives the bases). The rest follows from the
row counts of the m * VNODES arcs: a sweep over them on the driver, bounded
by these parameters, cuts the ranks into at most m * VNODES + m runs with one
shard each, as a run ends only where an arc ends or a shard becomes full. The
runs come back as a broadcast table of that size.

Limited movement: with one shard more, every shard keeps its points, and keys
move to the new shard, or where the smaller loads fill a shard earlier
(``tests/llm`` and README hold the measured share).

Defined cases: a null text counts as empty; rows without id are placed by
their text; repeated ids share a position and are told apart by text, equal
rows by their place in the input, which changes no result as they are equal;
an empty table gives an empty result; other columns, whatever their names, are
only read when kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import work_dir, written

QUERY = "op13_ring_shards"
ORACLE_SQL = None       # the hash ring has no SQL form; tested against one-by-one insertion

SHARDS = 40
VNODES = 128
ROW_BYTES = 16          # counted besides a text's own bytes
LAW = "rows"
_LOCAL = 33             # bits of monotonically_increasing_id within a partition


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(positions ascending, shard of each) of all virtual nodes."""
    at = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
          for s in range(shards) for v in range(vnodes)]
    at.sort()
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int32)


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def runs(counts: list[int], owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first) of each run, from
    the row count of every arc in ring order."""
    room = quotas(sum(counts), shards)
    taken = [0] * shards
    out, rank, n = [], 0, len(owners)
    for arc, left in enumerate(counts):
        at = arc
        while left:
            s = int(owners[at % n])
            k = min(left, room[s])
            if k:
                out.append((arc, rank, rank + k, s, taken[s]))
                taken[s] += k
                room[s] -= k
                rank += k
                left -= k
            at += 1
    return out


def _arc(position: Column, points: np.ndarray) -> Column:
    """The arc of a position: the next point clockwise, in ring order."""
    n = len(points)

    @F.pandas_udf("int")
    def find(p: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, p.to_numpy(np.int64)) % n).astype(np.int32))
    return find(position)


def place(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id",
          text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, and the columns
    named in ``keep`` inside a struct ``kept``. Slots count from 0 in every
    shard, in ring order."""
    spark = docs.sparkSession
    base = work_dir(spark, "shards")
    points, owners = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("tie"),
        *([F.xxhash64(*keep).alias("rest"), F.struct(*keep).alias("kept")] if keep else []))
    rows = rows.withColumn("position", F.when(F.col("doc_id").isNull(), F.col("tie")).otherwise(
        F.xxhash64("doc_id")))
    # The last key only parts equal rows, so that no task takes all copies.
    rows = rows.withColumn("arc", _arc(F.col("position"), points)).withColumn(
        "salt", F.monotonically_increasing_id())
    if not keep:        # a range sort reads its input twice: narrow rows, not texts
        rows = written(rows, f"{base}/rows")
    order = ["arc", "position", "doc_id", "tie", "size", *(["rest"] if keep else []), "salt"]
    ranked = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "size", "text_crc32", "arc", *(["kept"] if keep else []),
        F.monotonically_increasing_id().alias("at")), f"{base}/ranked")
    part = F.shiftright("at", _LOCAL)
    # One row per range partition.
    bases = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = bases.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = [0] * len(points)
    for r in ranked.groupBy("arc").count().collect():       # at most shards * vnodes rows
        counts[r["arc"]] = r["count"]
    table = spark.createDataFrame(runs(counts, owners, shards),
                                  "arc int, lo long, hi long, shard int, first long")
    rank = F.col("base") + F.col("at") - F.shiftleft(F.col("part"), _LOCAL)
    return (ranked.withColumn("part", part).join(F.broadcast(bases), "part")
            .withColumn("rank", rank).join(F.broadcast(table), "arc")
            .filter("rank >= lo and rank < hi")
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
                    *(["kept"] if keep else [])))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, vnodes: int = VNODES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as Parquet below ``folder``, one ``shard=N``
    directory per shard, rows in slot order; returns what was written.
    A column named ``shard`` or ``slot`` of the input stays in ``kept``."""
    placed = place(docs, shards, vnodes, id_col, text_col, keep=tuple(docs.columns))
    out = placed.select("kept", "slot", "shard").repartitionByRange("shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's shard of 40 and slot."""
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
