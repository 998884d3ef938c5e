"""Function and call-site operators (details, search, callers/callees,
cross-module calls, complexity, most-called)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import count_substring, has_text, like, or_default, preview
from ..plans.keys import Keys, key_frame, restrict
from ..sources.tables import CodeGraph
from ..functions import constants as C


def _top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first ``limit`` rows in a total order (a TakeOrderedAndProject);
    all rows, unsorted, without a limit: no range exchange for an order that
    no limit needs."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def _per_group_limit(df: DataFrame, group: list[str], limit: int | None, *order) -> DataFrame:
    """First ``limit`` rows per group. ``row_number() <= k`` lets Catalyst
    insert a partial WindowGroupLimit before the shuffle, so a hot group
    ships at most k rows per map task."""
    if limit is None:
        return df
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn")


def module_of(g: CodeGraph, name: str) -> DataFrame:
    """Point lookup of a module by exact name."""
    return g.module.filter(F.col("name") == F.lit(name))


def function_details(g: CodeGraph, keys: Keys = None) -> DataFrame:
    """Every function with the given name (optionally within a module)."""
    kf = key_frame(g.spark, keys, ["name", "module_name"])
    f = restrict(g.function, kf, ["name", "module_name"])
    return f.select(
        "id", "name", or_default("module_name", C.UNKNOWN).alias("module_name"),
        or_default("function_signature", C.NO_SIGNATURE).alias("signature"),
        "src_file", "line_start", "line_end",
        or_default("type_enum", C.UNKNOWN).alias("type_enum"))


def search_functions(g: CodeGraph, pattern: str, limit: int | None = C.LIMIT_SEARCH) -> DataFrame:
    """Functions whose name matches the pattern."""
    f = g.function.filter(like("name", pattern))
    out = f.select("id", "name", or_default("module_name", C.UNKNOWN).alias("module_name"),
                   or_default("function_signature", C.NO_SIGNATURE).alias("signature"))
    return _top(out, limit, "name", "id")


def most_called_functions(g: CodeGraph, limit: int | None = C.LIMIT_MOST_CALLED) -> DataFrame:
    """Call sites counted per callee (name, module), ranked by count.

    With a limit: top-k first (partial top-k per map task), then the k
    rows are numbered. Without one the result is every callee in rank
    order, without a ``rank`` column: numbering all rows would need a
    single-partition window."""
    c = (g.function_called
         .groupBy("name", "module_name").agg(F.count(F.lit(1)).alias("calls")))
    order = [F.desc("calls"), F.asc_nulls_last("name"), F.asc_nulls_last("module_name")]
    if limit is None:
        return c.orderBy(*order)
    top = c.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _hashed(df: DataFrame, keys: Keys) -> DataFrame:
    """The function side of a join with call sites. Unless a few names are asked
    for, it is hashed by partition: broadcast by the size of its files, it would
    be held whole by every task, at many times that size."""
    return df.hint("shuffle_hash") if keys is None or isinstance(keys, DataFrame) else df


def function_callers(g: CodeGraph, keys: Keys, limit: int | None = C.LIMIT_CALLERS,
                     resolve: str = "name") -> DataFrame:
    """Call sites whose callee name is the key name (J8), joined to
    the calling function (J1). One row per site with its location; ``limit``
    per key.

    ``resolve='name'`` takes every site of the name, whatever its module
    (keys are names; a module in them is not looked at). ``resolve='module'``
    takes the sites whose (name, module) is that of a function that the keys
    name (keys are names or (name, module) pairs; none: every function); a
    site without a module has no such function. The limit is then per
    (name, module)."""
    if resolve not in ("name", "module"):
        raise ValueError("resolve must be name or module")
    kf = key_frame(g.spark, keys, ["name", "module_name"])
    if resolve == "module":
        target = restrict(g.function, kf, ["name", "module_name"]).select(
            "name", "module_name").distinct()
        sites = g.function_called.join(_hashed(target, keys), ["name", "module_name"],
                                       "left_semi")
    else:
        sites = restrict(g.function_called, kf, ["name"])
    sites = sites.select(
        F.col("name").alias("callee"), F.col("module_name").alias("callee_module"),
        "function_id", "site", "src_loc")
    caller = g.function.select(F.col("id").alias("function_id"),
                               F.col("name").alias("caller"),
                               F.col("module_name").alias("caller_module"))
    out = sites.join(_hashed(caller, keys), "function_id").select(
        "callee", "callee_module", F.col("function_id").alias("caller_id"), "caller",
        "caller_module", "site", "src_loc")
    group = ["callee"] if resolve == "name" else ["callee", "callee_module"]
    return _per_group_limit(out, group, limit, "caller_id", "site", "callee_module", "src_loc")


def function_callees(g: CodeGraph, keys: Keys, limit: int | None = C.LIMIT_CALLERS) -> DataFrame:
    """Call sites inside the key functions (by caller id), with their
    locations."""
    kf = key_frame(g.spark, keys, ["name", "module_name"])
    f = restrict(g.function, kf, ["name", "module_name"]).select(
        F.col("id").alias("function_id"), F.col("name").alias("caller"),
        F.col("module_name").alias("caller_module"))
    out = _hashed(f, keys).join(g.function_called, "function_id").select(
        F.col("function_id").alias("caller_id"), "caller", "caller_module",
        F.col("name").alias("callee"), F.col("module_name").alias("callee_module"), "site",
        "src_loc")
    return _per_group_limit(out, ["caller_id"], limit, "callee", "site", "callee_module",
                            "src_loc")


def cross_module_calls(g: CodeGraph, source_module: str | None = None,
                       target_module: str | None = None,
                       limit: int | None = C.LIMIT_CROSS_MODULE_CALLS) -> DataFrame:
    """Call sites whose caller module differs from the callee module
    (J1 + J2 + J7). A NULL callee module never qualifies."""
    sites = g.function_called
    if target_module:
        sites = sites.filter(like("module_name", target_module))
    caller = g.function.join(
        g.module.select(F.col("id").alias("module_id"), F.col("name").alias("source_module")),
        "module_id")
    if source_module:
        caller = caller.filter(like("source_module", source_module))
    caller = caller.select(F.col("id").alias("function_id"),
                           F.col("name").alias("source_function"), "source_module")
    out = (sites.join(caller, "function_id")
           .filter(F.col("source_module") != F.col("module_name"))
           .select(F.col("function_id").alias("source_id"), "source_function", "source_module",
                   F.col("name").alias("target_function"),
                   F.col("module_name").alias("target_module"), "site"))
    return _top(out, limit, "source_module", "source_id", "site", "target_function",
                "target_module")


def function_complexity(g: CodeGraph, module: str | None = None,
                        min_complexity: int = C.MIN_COMPLEXITY,
                        limit: int | None = C.LIMIT_COMPLEXITY) -> DataFrame:
    """Heuristic complexity score per function.

    score = len(sig) // 20 + 2 * count('->') (0 without a signature)
          + call sites // 3 + 2 * local (where) definitions.

    The two per-function counts are pre-aggregated (partial aggregation
    map-side, so a function with a third of all call sites costs one row
    per map task) and left-joined, instead of one count per function.
    """
    f = g.function
    sites = g.function_called.select(F.col("function_id").alias("id"))
    local = g.where_function.select(F.col("parent_function_id").alias("id"))
    if module:
        f = f.join(module_of(g, module).select(F.col("id").alias("module_id")), "module_id",
                   "left_semi")
        # Only the module's own rows are counted.
        sites = sites.join(f.select("id"), "id", "left_semi")
        local = local.join(f.select("id"), "id", "left_semi")
    calls = sites.groupBy("id").agg(F.count(F.lit(1)).alias("call_count"))
    wheres = local.groupBy("id").agg(F.count(F.lit(1)).alias("where_count"))
    sig = F.col("function_signature")
    sig_score = F.when(has_text(sig),
                       F.floor(F.length(sig) / C.SIGNATURE_CHARS_PER_POINT)
                       + C.ARROW_WEIGHT * count_substring(sig, C.ARROW_TOKEN)
                       ).otherwise(F.lit(0)).cast("bigint")
    scored = (f.select("id", "name", "module_name", "function_signature")
              .join(calls, "id", "left").join(wheres, "id", "left")
              .select("id", "name", "module_name",
                      sig_score.alias("signature_score"),
                      F.coalesce("call_count", F.lit(0)).cast("bigint").alias("call_count"),
                      F.coalesce("where_count", F.lit(0)).cast("bigint").alias("where_count"),
                      preview("function_signature", C.SIGNATURE_PREVIEW).alias("signature"))
              .withColumn("complexity", F.col("signature_score")
                          + F.floor(F.col("call_count") / C.CALLS_PER_POINT).cast("bigint")
                          + C.LOCAL_DEFINITION_WEIGHT * F.col("where_count"))
              .filter(F.col("complexity") >= min_complexity))
    return _top(scored, limit, F.desc("complexity"), "id")
