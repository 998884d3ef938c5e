"""Search-pattern and presentation helpers shared by the operators.

Patterns are user strings in the service's glob-ish dialect: ``*`` is any
run of characters, ``_`` stays SQL's single-character wildcard, and a
pattern without wildcards means "contains". All helpers build Column
expressions, so they compile into the scan's filter (``LIKE 'x%'``
becomes a parquet ``StringStartsWith`` pushdown).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _check(pattern: str) -> None:
    # A backslash would be an escape in Spark's LIKE but a literal in
    # DuckDB's; reject it rather than answer differently per engine.
    if "\\" in pattern:
        raise ValueError(f"backslash is not allowed in a search pattern: {pattern!r}")


def normalize_wildcards(pattern: str) -> str:
    """Every ``*`` becomes ``%``; an empty pattern is returned as is."""
    if not pattern:
        return pattern
    return pattern.replace("*", "%")


def like_pattern(pattern: str) -> str:
    """Anchored as given when it holds a ``%`` after P1, else ``%p%``."""
    p = normalize_wildcards(pattern or "")
    _check(p)
    return p if "%" in p else f"%{p}%"


def like(c: str | Column, pattern: str) -> Column:
    """Case-sensitive pattern filter."""
    return _col(c).like(like_pattern(pattern))


def ilike(c: str | Column, pattern: str) -> Column:
    """Case-insensitive pattern filter."""
    return _col(c).ilike(like_pattern(pattern))


def starts_with(c: str | Column, value: str) -> Column:
    """P5: ``v%`` after ``*``→``%``; wildcards inside stay live."""
    v = normalize_wildcards(str(value))
    _check(v)
    return _col(c).like(v + "%")


def ends_with(c: str | Column, value: str) -> Column:
    v = normalize_wildcards(str(value))
    _check(v)
    return _col(c).like("%" + v)


def contains_literal(c: str | Column, s: str) -> Column:
    """P10: plain substring test, no wildcards."""
    return _col(c).contains(F.lit(s))


def has_text(c: str | Column) -> Column:
    """Not NULL and not empty."""
    return _col(c).isNotNull() & (_col(c) != F.lit(""))


def preview(c: str | Column, n: int) -> Column:
    """First ``n`` characters, plus ``...`` only when cut."""
    col = _col(c)
    cut = F.concat(F.substring(col, 1, n), F.lit(C.PREVIEW_ELLIPSIS))
    return F.when(F.length(col) > n, cut).otherwise(col)


def first_lines(c: str | Column, n: int) -> Column:
    """First ``n`` lines."""
    return F.array_join(F.slice(F.split(_col(c), "\n"), 1, n), "\n")


def or_default(c: str | Column, default: str) -> Column:
    """NULL and ``''`` both fall back to ``default``."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def count_substring(c: str | Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal ``token`` (bigint)."""
    col = _col(c)
    removed = F.length(col) - F.length(F.replace(col, F.lit(token), F.lit("")))
    return F.floor(removed / F.lit(len(token))).cast("bigint")
