"""Entity tables of a code graph and how to load them.

A ``CodeGraph`` is a bundle of DataFrames, one per entity kind. Nothing is
materialised here: every attribute is a lazy plan (a parquet scan, or the
fixture projection), so column pruning and filter pushdown reach the scan
for whatever operator reads it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, S, I, B = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Declared schemas of the entity tables (what a dump load provides).
ENTITY_SCHEMAS: dict[str, T.StructType] = {
    "module": _schema(("id", L), ("name", S), ("path", S)),
    "function": _schema(
        ("id", L), ("name", S), ("module_id", L), ("module_name", S), ("type_enum", S),
        ("function_signature", S), ("src_file", S), ("line_start", L), ("line_end", L)),
    # Bodies live apart from the function rows: they are the only wide
    # column and most operators never read them.
    "function_body": _schema(("id", L), ("raw_string", S)),
    "where_function": _schema(("parent_function_id", L), ("name", S)),
    "function_called": _schema(
        ("function_id", L), ("callee_id", L), ("name", S), ("module_name", S), ("site", I),
        ("src_loc", S)),
    "function_dependency": _schema(("caller_id", L), ("callee_id", L)),
    "import": _schema(
        ("id", L), ("module_id", L), ("module_name", S), ("package_name", S),
        ("qualified_style", B), ("as_module_name", S), ("is_hiding", B),
        ("hiding_specs", S), ("line", L), ("src_loc", S)),
    "type": _schema(
        ("id", L), ("type_name", S), ("module_id", L), ("type_of_type", S), ("raw_code", S),
        ("src_file", S), ("line_start", L), ("line_end", L)),
    "constructor": _schema(("id", L), ("type_id", L), ("name", S)),
    "field": _schema(("constructor_id", L), ("field_name", S), ("field_type_raw", S)),
    "class": _schema(
        ("id", L), ("class_name", S), ("module_id", L), ("class_definition", S),
        ("src_file", S), ("line_start", I), ("line_end", I)),
    "instance": _schema(
        ("id", L), ("module_id", L), ("instance_definition", S), ("instance_signature", S),
        ("src_loc", S)),
    "instance_function": _schema(("instance_id", L), ("function_id", L)),
    "type_dependency": _schema(("dependent_id", L), ("dependency_id", L)),
}


@dataclass
class CodeGraph:
    """The code-entity tables. Attribute names follow ``ENTITY_SCHEMAS``
    (``imports``, ``types``, ``classes`` avoid Python keywords)."""

    spark: SparkSession
    module: DataFrame
    function: DataFrame
    function_body: DataFrame
    where_function: DataFrame
    function_called: DataFrame
    function_dependency: DataFrame
    imports: DataFrame
    types: DataFrame
    constructor: DataFrame
    field: DataFrame
    classes: DataFrame
    instance: DataFrame
    type_dependency: DataFrame
    instance_function: Optional[DataFrame] = None

    ATTR_OF = {"import": "imports", "type": "types", "class": "classes"}

    def table(self, entity: str) -> DataFrame:
        return getattr(self, self.ATTR_OF.get(entity, entity))

    def tables(self) -> dict[str, DataFrame]:
        out = {}
        for f in fields(self):
            if f.name == "spark":
                continue
            df = getattr(self, f.name)
            if df is not None:
                out[f.name] = df
        return out

    def register_views(self, prefix: str = "") -> None:
        """Expose every table as a temp view (for ``custom_sql``)."""
        inverse = {v: k for k, v in self.ATTR_OF.items()}
        for attr, df in self.tables().items():
            df.createOrReplaceTempView(prefix + inverse.get(attr, attr))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "CodeGraph":
        """Load tables written by ``sources.ingest.load_dump`` (one parquet
        directory per entity under ``root``)."""
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def read(entity: str) -> DataFrame:
            # An entity missing from the dump is an empty table.
            path = f"{root}/{entity}"
            p = jvm.org.apache.hadoop.fs.Path(path)
            if not p.getFileSystem(conf).exists(p):
                return spark.createDataFrame([], ENTITY_SCHEMAS[entity])
            return spark.read.schema(ENTITY_SCHEMAS[entity]).parquet(path)

        inst_fn = read("instance_function")
        return cls(
            spark=spark, module=read("module"), function=read("function"),
            function_body=read("function_body"), where_function=read("where_function"),
            function_called=read("function_called"),
            function_dependency=read("function_dependency"), imports=read("import"),
            types=read("type"), constructor=read("constructor"), field=read("field"),
            classes=read("class"), instance=read("instance"),
            type_dependency=read("type_dependency"), instance_function=inst_fn)
