"""Registered queries: each operator applied to the fixture code graph,
paired with an independent DuckDB formulation of the same answer.

Every query runs over the whole fixture tables; a limit appears only
where the operator is a top-k report by definition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir
from .sources.fixture import fixture_graph, oracle_prefix
from .sources.ingest import write_table
from .sources.tables import ENTITY_SCHEMAS, CodeGraph

_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_FNS: dict[str, Callable[[CodeGraph, SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_GRAPHS: dict[tuple[str, str], CodeGraph] = {}


class _WrittenGraph(CodeGraph):
    """A graph whose tables are written as parquet under ``dest`` (as a load
    would) when they are first asked for, and read from there."""

    def __init__(self, g: CodeGraph | None = None, dest: str = "", **tables):
        if g is None:       # a copy by ``dataclasses.replace``: every table is given
            self._source = {}
            super().__init__(**tables)
            return
        self.spark, self._source, self._dest = g.spark, g.tables(), dest
        # The projection has none, as a dump without the entity.
        self.instance_function = g.spark.createDataFrame([], ENTITY_SCHEMAS["instance_function"])

    def __getattr__(self, attr: str):
        # Only for what is not set yet.
        if attr.startswith("_") or attr not in self._source:
            raise AttributeError(attr)
        df = write_table(self.spark, attr, self._source[attr], self._dest)
        setattr(self, attr, df)
        return df


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The fixture graph for ``sf_dir``, each table written once per
    application as parquet (as a load would) in the shared folder and read
    from there: the queries run the plans that a loaded graph gets, with column
    pruning and pushed filters. A table that no query reads is not written."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        dest = f"{ensure_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
        _GRAPHS[key] = _WrittenGraph(fixture_graph(spark, sf_dir), dest)
    return _GRAPHS[key]


def register(name: str, sql: str | None, recursive: bool = False):
    """Register ``fn(graph, spark, sf_dir)``; ``sql`` is the query body
    placed after the fixture CTE list (``None`` = no SQL oracle).
    ``recursive`` turns the CTE list into ``WITH RECURSIVE``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(graph(spark, sf_dir), spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _SPARK[name] = run
        _FNS[name] = fn
        if sql is not None:
            prefix = oracle_prefix()
            if recursive:
                prefix = "WITH RECURSIVE " + prefix[len("WITH "):]
            _SQL[name] = prefix + sql
        return fn
    return deco


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_SPARK)


def graph_queries() -> dict[str, Callable[[CodeGraph, SparkSession, str], DataFrame]]:
    """The same queries taking an explicit graph (e.g. one loaded from parquet)."""
    _load()
    return dict(_FNS)


def oracle_queries() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    # Query definitions register themselves on import.
    from . import queries  # noqa: F401
