"""Key tables: how an operator is restricted to some entities.

Every keyed operator takes ``keys`` as either ``None`` (all entities), a
DataFrame holding the key columns, or a small Python list. Lists are
turned into a DataFrame and broadcast: their size is known on the driver
and checked against ``MAX_LITERAL_KEYS``. DataFrame keys are joined
without a hint, so AQE measures them at runtime and broadcasts only when
they are under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LITERAL_KEYS = 100_000

Keys = Union[None, DataFrame, str, Sequence]


def key_frame(spark: SparkSession, keys: Keys, cols: Sequence[str]) -> DataFrame | None:
    if keys is None:
        return None
    if isinstance(keys, DataFrame):
        # The first key column is required, the others are optional.
        if cols[0] not in keys.columns:
            raise ValueError(f"key table lacks column {cols[0]!r}; has {keys.columns}")
        return keys.select(*[c for c in cols if c in keys.columns]).dropDuplicates()
    if isinstance(keys, str):
        keys = [keys]
    rows = [k if isinstance(k, (tuple, list)) else (k,) for k in keys]
    if len(rows) > MAX_LITERAL_KEYS:
        raise ValueError(f"{len(rows)} literal keys; pass a DataFrame above {MAX_LITERAL_KEYS}")
    width = {len(r) for r in rows} or {len(cols)}
    if len(width) != 1:
        raise ValueError("literal keys must all have the same arity")
    n = width.pop()
    use = list(cols[:n])
    schema = ", ".join(f"{c} string" for c in use)
    df = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows],
                               schema)
    return F.broadcast(df.dropDuplicates())


def restrict(df: DataFrame, keys: DataFrame | None, on: dict[str, str] | Sequence[str]) -> DataFrame:
    """Left-semi join ``df`` with the key table (a no-op for all entities).

    ``on`` maps key-table columns to ``df`` columns; a sequence means the
    names are equal. The first key column must match; a second one that
    is NULL in a key row means "any" (a key ``(name, None)`` is that name
    in every module).

    Keys with and without the optional column are applied as two plain
    equi semi-joins over disjoint row sets, never as one join on the first
    column with an OR residual: that would pair every row of a hot name
    with every key of that name before filtering.
    """
    if keys is None:
        return df
    mapping = dict(on) if isinstance(on, dict) else {c: c for c in on}
    items = [(kc, dc) for kc, dc in mapping.items() if kc in keys.columns]
    if len(items) > 2:
        raise ValueError("at most one optional key column is supported")
    (k0, d0) = items[0]
    k_first = keys.select(F.col(k0).alias("__k0"))
    if len(items) == 1:
        return df.join(k_first, df[d0] == F.col("__k0"), "left_semi")
    (k1, d1) = items[1]
    any_second = keys.filter(F.col(k1).isNull()).select(F.col(k0).alias("__k0"))
    exact = keys.filter(F.col(k1).isNotNull()).select(F.col(k0).alias("__k0"),
                                                     F.col(k1).alias("__k1"))
    loose = df.join(any_second, df[d0] == F.col("__k0"), "left_semi")
    strict = (df.join(any_second, df[d0] == F.col("__k0"), "left_anti")
              .join(exact, (df[d0] == F.col("__k0")) & (df[d1] == F.col("__k1")), "left_semi"))
    return loose.unionByName(strict)
