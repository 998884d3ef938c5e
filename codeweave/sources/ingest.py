"""Loading a code dump into entity tables.

Dump layout: one directory per entity under the dump root, holding JSON
Lines files at any depth (``<root>/function/part-0001.json``,
``<root>/function/pkg/a/b.json``, ...), one object per line with the
columns of ``ENTITY_SCHEMAS``. Reading uses the declared schema (no
inference pass over the data) and PERMISSIVE mode: a malformed line is
kept as text in ``_corrupt_record`` and written to a quarantine table
instead of failing the load.

Output: one parquet directory per entity under ``dest`` (what
``CodeGraph.from_parquet`` reads), plus ``_quarantine/<entity>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import measured_joins
from .tables import ENTITY_SCHEMAS, CodeGraph

CORRUPT = "_corrupt_record"

# setup: create, refuse to overwrite; drop / clear: recreate from the
# dump; append: add a further dump to existing tables.
MODES = {"setup": "errorifexists", "drop": "overwrite", "clear": "overwrite",
         "append": "append", "overwrite": "overwrite", "errorifexists": "errorifexists"}


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def dump_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every ``*.json`` file below ``root`` (content is
    never read: only the listing columns are selected)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
            .option("recursiveFileLookup", "true").load(root).select("path", "length"))


def validate_dump_dir(spark: SparkSession, root: str) -> int:
    """The directory exists and holds at least one ``.json`` file."""
    if not _fs_exists(spark, root):
        raise FileNotFoundError(f"dump directory does not exist: {root}")
    n = dump_files(spark, root).limit(1).count()
    if n == 0:
        raise ValueError(f"no .json files below {root}")
    return n


def read_entity(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """One entity's rows with the declared schema plus ``_corrupt_record``."""
    schema = T.StructType(ENTITY_SCHEMAS[entity].fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
            .json(f"{root}/{entity}"))


def load_dump(spark: SparkSession, root: str, dest: str, mode: str = "setup") -> DataFrame:
    """S1 + S3: read every entity present in the dump and write it to
    ``dest/<entity>`` with the given mode; malformed lines go to
    ``dest/_quarantine/<entity>``. Returns the load report
    ``(entity, rows, corrupt_rows)``, counted while writing (no second pass);
    an append reports the whole tables."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    write_mode = MODES[mode]
    validate_dump_dir(spark, root)
    counts = []
    for entity in ENTITY_SCHEMAS:
        if not _fs_exists(spark, f"{root}/{entity}"):
            continue
        cols = [f.name for f in ENTITY_SCHEMAS[entity].fields]
        seen = Observation(f"load_{entity}")
        bad_line = F.col(CORRUPT).isNotNull()
        raw = read_entity(spark, root, entity).observe(
            seen, F.count_if(~bad_line).alias("rows"), F.count_if(bad_line).alias("corrupt_rows"))
        raw.filter(~bad_line).select(*cols).write.mode(write_mode).parquet(f"{dest}/{entity}")
        n = seen.get
        counts.append((entity, n["rows"], n["corrupt_rows"]))
        # Only a dump with broken lines is read again, for those lines.
        bad = read_entity(spark, root, entity).filter(bad_line).select(
            F.col(CORRUPT).alias("record"), F.input_file_name().alias("file"), *cols[:1])
        if not n["corrupt_rows"]:
            bad = spark.createDataFrame([], bad.schema)
        bad.write.mode("append" if write_mode == "append" else "overwrite").parquet(
            f"{dest}/_quarantine/{entity}")
    if write_mode == "append":      # what earlier loads wrote counts too
        return load_report(spark, dest, [entity for entity, *_ in counts])
    return spark.createDataFrame(counts, "entity string, rows long, corrupt_rows long")


def load_report(spark: SparkSession, dest: str, entities=None) -> DataFrame:
    """Row counts of the written tables and their quarantines, as one
    union of aggregations."""
    out = None
    for entity in entities or ENTITY_SCHEMAS:
        if not _fs_exists(spark, f"{dest}/{entity}"):
            continue
        rows = spark.read.parquet(f"{dest}/{entity}").agg(F.count(F.lit(1)).alias("rows"))
        qpath = f"{dest}/_quarantine/{entity}"
        if _fs_exists(spark, qpath):
            bad = spark.read.parquet(qpath).agg(F.count(F.lit(1)).alias("corrupt_rows"))
        else:
            bad = spark.range(1).select(F.lit(0).cast("long").alias("corrupt_rows"))
        r = (rows.select(F.lit(entity).alias("entity"), "rows",
                         F.lit(None).cast("long").alias("corrupt_rows"))
             .unionByName(bad.select(F.lit(entity).alias("entity"),
                                     F.lit(None).cast("long").alias("rows"), "corrupt_rows"))
             .groupBy("entity").agg(F.max("rows").alias("rows"),
                                    F.max("corrupt_rows").alias("corrupt_rows")))
        out = r if out is None else out.unionByName(r)
    if out is None:
        return spark.createDataFrame([], "entity string, rows long, corrupt_rows long")
    return out


def resolve_calls(g: CodeGraph) -> CodeGraph:
    """Fill ``function_called.callee_id`` where a dump leaves it empty, by
    the callee's (name, module), and derive ``function_dependency`` as the
    distinct resolved (caller, callee) pairs. A name defined twice in one
    module resolves to the smaller id."""
    fn = g.function.groupBy(F.col("name").alias("__n"), F.col("module_name").alias("__m")).agg(
        F.min("id").alias("__id"))
    fc = g.function_called
    joined = fc.join(fn, (fc["name"] == fn["__n"]) & (fc["module_name"] == fn["__m"]), "left")
    calls = joined.select(*[F.coalesce(fc["callee_id"], F.col("__id")).alias("callee_id")
                            if c == "callee_id" else fc[c] for c in fc.columns])
    deps = (calls.filter(F.col("callee_id").isNotNull())
            .select(F.col("function_id").alias("caller_id"), "callee_id").distinct())
    fields = dict(g.tables())
    fields.update(function_called=calls, function_dependency=deps)
    return CodeGraph(spark=g.spark, **fields)


def write_graph(g: CodeGraph, dest: str, mode: str = "overwrite") -> CodeGraph:
    """Materialise every table of ``g`` under ``dest`` (entity names as in
    ``ENTITY_SCHEMAS``) and return the graph read back from there."""
    for attr, df in g.tables().items():
        write_table(g.spark, attr, df, dest, mode)
    return CodeGraph.from_parquet(g.spark, dest)


def write_table(spark: SparkSession, attr: str, df: DataFrame, dest: str,
                mode: str = "overwrite") -> DataFrame:
    """Materialise one table under ``dest``; returns it read back from there."""
    entity = {v: k for k, v in CodeGraph.ATTR_OF.items()}.get(attr, attr)
    with measured_joins(spark):
        df.write.mode(MODES.get(mode, mode)).parquet(f"{dest}/{entity}")
    return spark.read.schema(ENTITY_SCHEMAS[entity]).parquet(f"{dest}/{entity}")
