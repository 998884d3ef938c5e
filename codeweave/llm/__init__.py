"""Operators of a training-data pipeline, one module each, and their
registered queries (``opN_<name>``). Nothing else in the library imports
this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (annindex, centroids, chatformat, decontam, hardneg, mixing, neardup, pii, quality,
               shards, tokenpack, toxicity, warc)

_MODULES = (tokenpack, neardup, warc, annindex, mixing, decontam, quality, pii, toxicity,
            chatformat, centroids, hardneg, shards)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in _MODULES}


def llm_oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}
