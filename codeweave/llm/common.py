"""Helpers shared by the llm operators: the shared work folder, written
intermediates, and a vectorised word scanner over Arrow text buffers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# ------------------------------------------------------------ Spark side


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def make_dir(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def shared_uri(folder: str) -> str:
    """``folder`` as a URI that pyarrow's file systems open too."""
    return re.sub(r"^file:/(?!/)", "file:///", folder) if ":" in folder else f"file://{folder}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read back: cuts the lineage
    on shared storage, so a lost executor never recomputes what precedes."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows at most, for what runs inside: a batch of
    whole texts stands in the executor and in its Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, "10000")
    if not 0 < int(was) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def running_total(df: DataFrame, keys: list[str], value: str, out: str, path: str,
                  kind: str = "long") -> DataFrame:
    """``df`` with ``out`` = the sum of ``value`` over all rows before this
    one in ``keys`` order. Two levels: a range-partitioned, written
    copy carries partition-local totals; only one row per partition meets in
    the final running sum, so no task holds the whole table."""
    from pyspark.sql import Window as W
    local = (df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
             .withColumn("__part", F.spark_partition_id()))
    w = W.partitionBy("__part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    local = local.withColumn("__rn", F.row_number().over(w)).withColumn(
        "__upto", F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)),
                             F.lit(0)).cast(kind))
    local = written(local, path)
    per = local.groupBy("__part").agg(F.sum(value).alias("__sum"))
    # One row per partition of the range exchange: bounded by the partition
    # count, not by the data.
    base = per.withColumn("__base", F.coalesce(
        F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).cast(kind)).select("__part", "__base")
    return (local.join(F.broadcast(base), "__part")
            .withColumn(out, (F.col("__upto") + F.col("__base")).cast(kind))
            .drop("__part", "__base", "__upto", "__rn"))


# ------------------------------------------------------- Arrow / numpy side

PIECE = 1 << 18      # bytes of text scanned at once; numpy temporaries are ~40x
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
U = np.uint64

def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the two-byte letters U+00C0..U+00DE."""
    low = LOWER[data]
    if len(data) > 1:
        m = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][m] += 0x20
    return low


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("p", _MULT), ("i", pow(_MULT, -1, 1 << 64))):
                a = np.full(m, U(base))
                a[0] = U(1)
                _pow[key] = np.cumprod(a, dtype=np.uint64)
    return _pow["p"][:n], _pow["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wrap-around multiply and shift)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        import pyarrow.compute as pc
        col = pc.fill_null(col, "")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and len(offs) \
        and offs[-1] > 0 else np.zeros(0, np.uint8)
    return data, offs


def scan(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive texts ``buf[offs[i]:offs[i+1]]`` as (hash,
    start, end, first word index per text plus the total). ``buf`` is
    already folded; ``sep`` marks separator bytes; a text end also ends a
    word. The hash is a polynomial over the bytes, finalised with the word's
    length."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offs), np.int64)
    isw = ~sep[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(isw[:-1], out=before[1:])
    before |= edge[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(isw[1:], out=after[:-1])
    after |= edge[1:]
    starts = np.flatnonzero(isw & before)
    ends = np.flatnonzero(isw & after) + 1
    return span_hashes(buf, starts, ends), starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [starts, ends): equal bytes, equal hash."""
    n = len(buf)
    p, inv = _powers(n)
    with np.errstate(over="ignore"):
        c = buf.astype(np.uint64)
        c += U(1)
        c *= p
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(c, out=total[1:])
        h = (total[ends] - total[starts]) * inv[starts]
        h += (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(h)


def pieces(data: np.ndarray, offs: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of at most ``size`` bytes (one text at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def scanned(data: np.ndarray, offs: np.ndarray, fold=fold_ascii,
            sep: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, word hashes of texts i..j-1, first word of each and the total).
    Long texts are scanned in pieces cut at separators, so memory follows
    PIECE and the number of words, not the text."""
    for i, j in pieces(data, offs):
        lo, hi = int(offs[i]), int(offs[j])
        if j > i + 1 or hi - lo <= PIECE:
            h, _, _, first = scan(fold(data[lo:hi]), offs[i:j + 1] - lo, sep)
            yield i, j, h, first
            continue
        parts, a = [], lo
        while a < hi:
            b = min(a + PIECE, hi)
            cut = np.zeros(0, np.int64)
            while b < hi and not len(cut):       # one word may outgrow a piece
                cut = np.flatnonzero(sep[data[a:b]])
                if not len(cut):
                    b = min(b + PIECE, hi)
            if b < hi:
                b = a + int(cut[-1]) + 1
            parts.append(scan(fold(data[a:b]), np.array([0, b - a]), sep)[0])
            a = b
        h = np.concatenate(parts)
        yield i, j, h, np.array([0, len(h)])


def word_hashes(data: np.ndarray, offs: np.ndarray, fold=fold_ascii,
                sep: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(text index, word hashes) of every text."""
    for i, j, h, first in scanned(data, offs, fold, sep):
        for k in range(i, j):
            yield k, h[first[k - i]:first[k - i + 1]]


class HashSet:
    """Membership of 64-bit hashes in a fixed table: a bitmap on the top
    bits answers most misses, a binary search the rest."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bitmap = np.zeros(1 << self.BITS, dtype=bool)
        self.bitmap[(self.keys >> U(64 - self.BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h``, index of the matching key) of all members."""
        if not len(self.keys):
            z = np.zeros(0, np.int64)
            return z, z
        pos = np.flatnonzero(self.bitmap[(h >> U(64 - self.BITS)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[pos])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[pos]
        return pos[ok], self.order[k[ok]]


def py_word_hash(word: bytes) -> int:
    """``scan``'s hash of one folded word (for tables built on the driver)."""
    b = np.frombuffer(word, dtype=np.uint8)
    return int(scan(b, np.array([0, len(b)]), np.zeros(256, bool))[0][0])
