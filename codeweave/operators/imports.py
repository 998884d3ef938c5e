"""Import operators: per-module listing, import graph and popularity,
heuristic review, bucketed details, import-statement generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import has_text, like
from ..plans.graph import bfs_masks
from ..plans.keys import Keys, key_frame, restrict
from ..sources.tables import CodeGraph
from ..functions import constants as C
from .functions import _top

IMPORT_COLS = ["import_id", "module_name", "package_name", "qualified_style", "as_module_name",
               "is_hiding", "hiding_specs", "line"]


def _imports(g: CodeGraph) -> DataFrame:
    """Imports with the importing module's name."""
    m = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("module"))
    return g.imports.withColumnRenamed("id", "import_id").join(m, "module_id")


def is_external(c: str = "package_name"):
    """An import is external when it names a package ('' counts as none)."""
    return has_text(c)


def analyze_imports(g: CodeGraph, module: str | None = None, import_pattern: str | None = None,
                    include_qualified: bool = True,
                    limit: int | None = C.LIMIT_LISTING) -> DataFrame:
    """Every import of the first ``limit`` importing modules (by name),
    with the module's import count. Flat rows: a module with millions of
    imports is many rows, never one array."""
    i = _imports(g)
    if module:
        i = i.filter(F.col("module") == module)
    if import_pattern:
        i = i.filter(like("module_name", import_pattern))
    if not include_qualified:
        i = i.filter(~F.coalesce("qualified_style", F.lit(False)))
    counts = i.groupBy("module_id", "module").agg(F.count(F.lit(1)).alias("n_imports"))
    if limit is not None:
        counts = counts.orderBy("module", "module_id").limit(limit)
    return i.join(counts, ["module_id", "module"]).select("module_id", "module", "n_imports",
                                                          *IMPORT_COLS)


def _name_edges(g: CodeGraph, include_external: bool) -> DataFrame:
    i = _imports(g)
    if not include_external:
        i = i.filter(~is_external())
    return i.select(F.col("module").alias("src"), F.col("module_name").alias("dst"))


def import_graph(g: CodeGraph, root: str | list[str], depth: int = 3,
                 include_external: bool = False) -> DataFrame:
    """O29 rooted: module names reachable from the root module(s) along
    import edges within ``depth`` hops, with the shortest hop count."""
    kf = key_frame(g.spark, root, ["name"])
    roots = kf.select(F.col("name").alias("root"), F.col("name").alias("node"))
    return (bfs_masks(_name_edges(g, include_external), roots, depth, lazy=True)
            .select("root", F.col("node").alias("module"),
                    F.col("depth").cast("bigint").alias("depth")))


def import_popularity(g: CodeGraph, include_external: bool = False,
                      limit: int | None = C.LIMIT_POPULAR_IMPORTS) -> DataFrame:
    """O29 unrooted: most imported module names over all imports."""
    i = g.imports if include_external else g.imports.filter(~is_external())
    c = i.groupBy("module_name").agg(F.count(F.lit(1)).alias("import_count"))
    return _top(c, limit, F.desc("import_count"), F.asc_nulls_last("module_name"))


def suspicious_imports(g: CodeGraph, module: str | None = None,
                       package_pattern: str | None = None,
                       limit: int | None = C.LIMIT_LISTING,
                       check_usage: bool = False) -> DataFrame:
    """Imports flagged by the review heuristics (not a usage analysis):
    qualified and aliased; hiding with a hiding list; external package
    whose name lacks 'test' (any case). ``check_usage`` adds
    ``truly_unused``: no call site in the module names a function of the
    imported module."""
    i = _imports(g)
    if module:
        i = i.filter(F.col("module") == module)
    if package_pattern:
        i = i.filter(like("package_name", package_pattern))
    reasons = F.filter(F.array(
        F.when(F.coalesce("qualified_style", F.lit(False)) & has_text("as_module_name"),
               F.lit("qualified_and_aliased")),
        F.when(F.coalesce("is_hiding", F.lit(False)) & has_text("hiding_specs"),
               F.lit("hiding_with_specs")),
        F.when(has_text("package_name") & ~F.lower("package_name").contains(C.TEST_PACKAGE_MARKER),
               F.lit("external_package"))), lambda x: x.isNotNull())
    out = (i.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
           .select("module_id", "module", *IMPORT_COLS, "reasons"))
    if check_usage:
        used = (g.function_called.join(
            g.function.select(F.col("id").alias("function_id"), "module_id"), "function_id")
            .select("module_id", F.col("module_name")).distinct())
        flagged = out.join(used, ["module_id", "module_name"], "left_anti").select(
            "import_id").withColumn("truly_unused", F.lit(True))
        out = out.join(flagged, "import_id", "left").withColumn(
            "truly_unused", F.coalesce("truly_unused", F.lit(False)))
    return _top(out, limit, "module", "import_id")


def import_details(g: CodeGraph, keys: Keys = None,
                   include_source_info: bool = False) -> DataFrame:
    """Imports of each key module in overlapping buckets: exactly
    one of internal / external, plus qualified, plus hiding.
    ``include_source_info`` adds where the import stands: its recorded
    location, else the importing module's file and the line."""
    kf = key_frame(g.spark, keys, ["name"])
    i = _imports(g)
    if kf is not None:
        i = restrict(i, kf, {"name": "module"})
    tags = F.filter(F.array(
        F.when(is_external(), F.lit("external")).otherwise(F.lit("internal")),
        F.when(F.coalesce("qualified_style", F.lit(False)), F.lit("qualified")),
        F.when(F.coalesce("is_hiding", F.lit(False)), F.lit("hiding"))), lambda x: x.isNotNull())
    cols = list(IMPORT_COLS)
    if include_source_info:
        path = g.module.select(F.col("id").alias("module_id"), "path")
        i = i.join(path, "module_id", "left")
        at = F.when(has_text("path") & F.col("line").isNotNull(),
                    F.concat_ws(":", "path", F.col("line").cast("string")))
        cols.append(F.when(has_text("src_loc"), F.col("src_loc")).otherwise(at).alias("source"))
    return i.select("module_id", "module", F.explode(tags).alias("bucket"), *cols)


def import_bucket_counts(g: CodeGraph, keys: Keys = None) -> DataFrame:
    """Bucket sizes per module (A8) in one pass."""
    return (import_details(g, keys).groupBy("module_id", "module", "bucket")
            .agg(F.count(F.lit(1)).alias("n_imports")))


def import_graph_overview(g: CodeGraph, root: str | list[str] | None = None, depth: int = 3,
                          include_external: bool = False, limit: int | None = 20) -> DataFrame:
    """O29 entry point: rooted -> reachable modules with hop counts;
    unrooted -> import popularity."""
    if root:
        return import_graph(g, root, depth, include_external)
    return import_popularity(g, include_external, limit)
