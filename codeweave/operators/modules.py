"""Module and corpus operators: listing, search, details, dependencies,
whole-corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import has_text, like
from ..plans.keys import Keys, key_frame, restrict
from ..sources.tables import CodeGraph
from ..functions import constants as C
from .functions import _per_group_limit, _top


def list_modules(g: CodeGraph, limit: int | None = C.LIMIT_MODULES) -> DataFrame:
    """Modules in name order."""
    return _top(g.module.select("id", "name", "path"), limit, "name", "id")


def search_modules(g: CodeGraph, pattern: str, limit: int | None = C.LIMIT_SEARCH) -> DataFrame:
    """Modules whose name matches the pattern."""
    return _top(g.module.filter(like("name", pattern)).select("id", "name", "path"),
                limit, "name", "id")


def _count_by(df: DataFrame, key: str, alias: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(alias))


def module_details(g: CodeGraph, keys: Keys = None,
                   sample: int = C.SAMPLE_FUNCTIONS_PER_MODULE) -> DataFrame:
    """Per module its path, function / import / type / class counts
    and the first ``sample`` function names (by name, id).

    Each count is a partial-aggregated groupBy left-joined to the module
    rows, so a module with a third of all functions costs nothing extra.
    """
    kf = key_frame(g.spark, keys, ["name"])
    m = restrict(g.module, kf, ["name"])
    first = _per_group_limit(g.function.select(F.col("module_id").alias("id"), "name",
                                               F.col("id").alias("fid")),
                             ["id"], sample, "name", "fid")
    names = first.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("name", "fid"))),
                    lambda s: s["name"]).alias("sample_functions"))
    out = m.select("id", "name", "path")
    for df, key, alias in ((g.function, "module_id", "n_functions"),
                           (g.imports, "module_id", "n_imports"),
                           (g.types, "module_id", "n_types"),
                           (g.classes, "module_id", "n_classes")):
        out = out.join(_count_by(df, key, alias), "id", "left")
    return (out.join(names, "id", "left")
            .select("id", "name", "path",
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                      for c in ("n_functions", "n_imports", "n_types", "n_classes")],
                    F.coalesce("sample_functions", F.array().cast("array<string>"))
                    .alias("sample_functions")))


def functions_by_module(g: CodeGraph, keys: Keys = None, limit: int | None = C.LIMIT_LISTING,
                        include_signatures: bool = True) -> DataFrame:
    """The functions of each key module, first ``limit`` by name."""
    kf = key_frame(g.spark, keys, ["name"])
    m = restrict(g.module, kf, ["name"]).select(F.col("id").alias("module_id"),
                                                F.col("name").alias("module"))
    f = g.function.select("module_id", "id", "name", "function_signature")
    out = m.join(f, "module_id")
    cols = ["module_id", "module", "id", "name"]
    if include_signatures:
        cols.append("function_signature")
    return _per_group_limit(out.select(*cols), ["module_id"], limit, "name", "id")


def module_dependencies(g: CodeGraph, keys: Keys = None, include_imports: bool = True,
                        include_dependents: bool = False) -> DataFrame:
    """What a module imports and, optionally, who imports it.

    One row per import statement (duplicates kept). Dependents match the
    imported module name exactly."""
    kf = key_frame(g.spark, keys, ["name"])
    m = restrict(g.module, kf, ["name"]).select(F.col("id").alias("module_id"),
                                                F.col("name").alias("module"))
    imp = g.imports.select(F.col("id").alias("import_id"), "module_id", "module_name",
                           "package_name", "qualified_style", "as_module_name")
    parts = []
    if include_imports:
        parts.append(m.join(imp, "module_id").select(
            "module", F.lit("imports").alias("direction"),
            F.col("module_name").alias("other"), "import_id", "package_name",
            "qualified_style", "as_module_name"))
    if include_dependents:
        importer = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("other"))
        dep = (imp.join(importer, "module_id")
               .join(m.select(F.col("module").alias("module_name")), "module_name")
               .select(F.col("module_name").alias("module"),
                       F.lit("imported_by").alias("direction"), "other", "import_id",
                       "package_name", "qualified_style", "as_module_name"))
        parts.append(dep)
    if not parts:
        raise ValueError("choose include_imports and/or include_dependents")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def code_statistics(g: CodeGraph, include_details: bool = False, top: int = 10) -> DataFrame:
    """(metric, value) rows: entity counts; with details also the
    signature share, functions per module and the top modules by function
    count (empty modules included, via the outer join)."""
    counts = [("modules", g.module), ("functions", g.function), ("types", g.types),
              ("classes", g.classes), ("imports", g.imports), ("instances", g.instance),
              ("function_calls", g.function_called)]
    rows = None
    for metric, df in counts:
        r = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit(metric).alias("metric"), "value")
        rows = r if rows is None else rows.unionByName(r)
    if not include_details:
        return rows
    fs = g.function.agg(F.count(F.lit(1)).alias("nf"),
                        F.count_if(has_text("function_signature")).alias("ns"))
    nm = g.module.agg(F.count(F.lit(1)).alias("nm"))
    # Two one-row aggregates side by side: union + max, not a join.
    tot = (fs.unionByName(nm, allowMissingColumns=True)
           .agg(F.max("nf").alias("nf"), F.max("ns").alias("ns"), F.max("nm").alias("nm")))
    derived = tot.select(F.explode(F.array(
        F.struct(F.lit("functions_with_signature").alias("metric"),
                 F.col("ns").cast("double").alias("value")),
        F.struct(F.lit("signature_percent").alias("metric"),
                 F.when(F.col("nf") > 0, F.round(F.col("ns") * 100.0 / F.col("nf"), 1))
                 .alias("value")),
        F.struct(F.lit("avg_functions_per_module").alias("metric"),
                 F.when(F.col("nm") > 0, F.round(F.col("nf") / F.col("nm"), 1))
                 .alias("value")))).alias("r")).select("r.metric", "r.value")
    per_module = (g.module.select("id", "name")
                  .join(_count_by(g.function, "module_id", "n"), "id", "left")
                  .select("id", "name", F.coalesce("n", F.lit(0)).alias("n")))
    top_rows = (per_module.orderBy(F.desc("n"), "name", "id").limit(top)
                .select(F.concat(F.lit("top_module:"), F.col("name")).alias("metric"),
                        F.col("n").cast("double").alias("value")))
    return rows.unionByName(derived).unionByName(top_rows)
