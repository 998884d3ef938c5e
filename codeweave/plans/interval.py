"""Point-in-interval and interval-overlap joins on (file, line ranges).

Equi-key is the file; to keep a hot file (one file with a third of all
spans) from landing in one task, lines are also cut into blocks, of
LEVELS sizes: a span sits at the first level whose blocks are as long as it
is, in one or two of them, however long it is; a point is looked up in one
block per level. A pair meets at the span's level only, in exactly one
block, so no deduplication is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = tuple(64 * 8 ** k for k in range(7))       # block lengths, 64 to 2^24 lines


def _block(line: Column, size: Column) -> Column:
    return F.floor(line / size).cast("long")


def _levelled(spans: DataFrame) -> DataFrame:
    """``spans`` once per block of their level: ``__size``, ``__block``."""
    length = F.col("line_end") - F.col("line_start") + 1
    size = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        size = F.when(length <= level, F.lit(level)).otherwise(size)
    return spans.withColumn("__size", size).withColumn("__block", F.explode(F.sequence(
        _block(F.col("line_start"), F.col("__size")), _block(F.col("line_end"), F.col("__size")))))


def _looked_up(points: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """``points`` once per level and block that ``lo``..``hi`` covers."""
    return (points.withColumn("__lo", lo).withColumn("__hi", hi)
            .withColumn("__size", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
            .withColumn("__block", F.explode(F.sequence(
                _block(F.col("__lo"), F.col("__size")), _block(F.col("__hi"), F.col("__size"))))))


def _meet(points: DataFrame, spans: DataFrame, lo: Column, hi: Column, file_col: str) -> DataFrame:
    p, s = _looked_up(points, lo, hi), _levelled(spans)
    first = F.greatest(_block(p["__lo"], p["__size"]), _block(s["line_start"], s["__size"]))
    return (p.join(s, (p[file_col] == s["src_file"]) & (p["__size"] == s["__size"])
                   & (p["__block"] == s["__block"]) & (s["line_start"] <= p["__hi"])
                   & (s["line_end"] >= p["__lo"]) & (p["__block"] == first))
            .drop(s["__size"]).drop(s["__block"]).drop(p["__size"]).drop(p["__block"])
            .drop("__lo", "__hi").drop(s["src_file"]))


def point_in_span(points: DataFrame, spans: DataFrame, file_col: str = "src_file",
                  line_col: str = "line") -> DataFrame:
    """All (point, span) pairs with ``line_start <= line <= line_end`` in
    the same file. ``spans`` needs ``src_file, line_start, line_end``."""
    return _meet(points, spans, F.col(line_col), F.col(line_col), file_col)


def window_overlaps(points: DataFrame, spans: DataFrame, radius: int,
                    file_col: str = "src_file", line_col: str = "line") -> DataFrame:
    """All (point, span) pairs where the span overlaps
    ``[line - radius, line + radius]``, each pair once."""
    return _meet(points, spans, F.col(line_col) - radius, F.col(line_col) + radius, file_col)
