"""Code graph projected from the star-schema test tables.

The projection text (``fixture_views.sql``) is shared with the DuckDB
oracle, so both engines see exactly the same entity rows. In Spark each
entity is ``WITH <parquet scans>, <views> SELECT * FROM cg_x``: the CTEs
are inlined, so an operator that needs two columns of a view scans only
the parquet columns those two depend on.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import CodeGraph

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Base tables the projection reads.
_USED = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEW_OF = {
    "module": "cg_module", "function": "cg_function", "function_body": "cg_function_body",
    "where_function": "cg_where_function", "function_called": "cg_function_called",
    "function_dependency": "cg_function_dependency", "imports": "cg_import",
    "types": "cg_type", "constructor": "cg_constructor", "field": "cg_field",
    "classes": "cg_class", "instance": "cg_instance", "type_dependency": "cg_type_dependency",
}


@lru_cache(maxsize=1)
def view_text() -> str:
    """The CTE list (without the leading WITH), comments stripped."""
    raw = (Path(__file__).with_name("fixture_views.sql")).read_text()
    return "\n".join(line for line in raw.splitlines() if not line.lstrip().startswith("--"))


def oracle_prefix() -> str:
    """``WITH <views>`` for an engine where the base tables are views already."""
    return "WITH " + view_text() + "\n"


def spark_prefix(sf_dir: str) -> str:
    scans = ",\n".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in _USED)
    return "WITH " + scans + ",\n" + view_text() + "\n"


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    prefix = spark_prefix(sf_dir)
    frames = {attr: spark.sql(prefix + f"SELECT * FROM {view}") for attr, view in VIEW_OF.items()}
    return CodeGraph(spark=spark, **frames)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probe_id, src_file, line) location probes derived from ``events``."""
    return spark.sql(spark_prefix(sf_dir) + "SELECT * FROM cg_probe")


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, module) from ``documents``: the text operators' corpus
    (doc_id = function id, text = body, source = module)."""
    return base_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("module"))
