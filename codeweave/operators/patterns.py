"""Structural pattern matching (O35) and cross-module dependency analysis
(O36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import contains_literal, like
from ..functions import constants as C
from ..sources.tables import CodeGraph
from .functions import _top

# ---------------------------------------------------------------- O35

HIGHER_ORDER_SIGNATURE = r"\([^)]*->"
CASE_OF_LINE = r"\bcase\b.*\bof\b"
LEADING_NAME = r"^([a-z_][A-Za-z0-9_']*)"
MIN_CLAUSES = 2


def match_function_calls(g: CodeGraph, function: str | None = None, target: str | None = None,
                         mode: str = "calls", caller: str | None = None,
                         callee: str | None = None) -> DataFrame:
    """Call sites (J1) whose two ends match name patterns (P2). ``calls``:
    ``function`` is the caller, ``target`` the callee; ``called_by``: the
    other way round. ``caller`` and ``callee`` name the ends themselves,
    whatever the mode."""
    if mode not in ("calls", "called_by"):
        raise ValueError("mode must be 'calls' or 'called_by'")
    caller_p, callee_p = (function, target) if mode == "calls" else (target, function)
    caller_p, callee_p = caller or caller_p, callee or callee_p
    sites = g.function_called
    if callee_p:
        sites = sites.filter(like("name", callee_p))
    f = g.function.select(F.col("id").alias("function_id"), F.col("name").alias("caller"),
                          F.col("module_name").alias("caller_module"))
    if caller_p:
        f = f.filter(like("caller", caller_p))
    return sites.join(f, "function_id").select(
        F.col("function_id").alias("caller_id"), "caller", "caller_module",
        F.col("name").alias("callee"), F.col("module_name").alias("callee_module"), "site")


def match_type_usage(g: CodeGraph, type_name: str, usage_in: str = "function") -> DataFrame:
    """Where a type name occurs literally: in function signatures, in
    field types of other types, or in class definitions. A single name is
    a plain filtered scan (``contains``); many names go through
    ``operators.types.type_usage_sites``."""
    if usage_in == "function":
        return g.function.filter(contains_literal("function_signature", type_name)).select(
            F.lit(type_name).alias("type"), F.col("id").alias("element_id"),
            F.col("name").alias("element"), "module_name")
    if usage_in == "type":
        fld = g.field.filter(contains_literal("field_type_raw", type_name))
        ctor = g.constructor.select(F.col("id").alias("constructor_id"), "type_id")
        m = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("module_name"))
        t = g.types.select(F.col("id").alias("type_id"), "type_name", "module_id")
        return (fld.join(ctor, "constructor_id").join(t, "type_id").join(m, "module_id", "left")
                .select(F.lit(type_name).alias("type"), F.col("type_id").alias("element_id"),
                        F.col("type_name").alias("element"), "module_name").distinct())
    if usage_in == "class":
        m = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("module_name"))
        return (g.classes.filter(contains_literal("class_definition", type_name))
                .join(m, "module_id", "left")
                .select(F.lit(type_name).alias("type"), F.col("id").alias("element_id"),
                        F.col("class_name").alias("element"), "module_name"))
    raise ValueError("usage_in must be 'function', 'type' or 'class'")


def defining_clauses(g: CodeGraph, min_clauses: int = MIN_CLAUSES,
                     leading_name: str = LEADING_NAME) -> DataFrame:
    """Runs of at least ``min_clauses`` unindented body lines that start with
    the same name, as the clauses of one definition do: ``(id, clause,
    first_line, n_clauses)``. Blank and indented lines continue a clause; a
    line that starts with anything else ends the run (gaps and islands over
    the lines of one body). ``leading_name`` is the pattern whose group 1 is
    the name at a line's start (default: an identifier in lower case)."""
    lines = g.function_body.select("id", F.posexplode(F.split("raw_string", "\n")).alias("at", "l"))
    heads = lines.filter(F.col("l").rlike(r"^[^\s]")).select(
        "id", "at", F.regexp_extract("l", leading_name, 1).alias("clause"))
    body = Window.partitionBy("id").orderBy("at")
    new = F.coalesce(F.col("clause") != F.lag("clause").over(body), F.lit(True)).cast("int")
    return (heads.withColumn("new", new).withColumn("run", F.sum("new").over(body))
            .filter(F.col("clause") != "").groupBy("id", "run", "clause").agg(
                (F.min("at") + 1).cast("bigint").alias("first_line"),
                F.count(F.lit(1)).alias("n_clauses"))
            .filter(F.col("n_clauses") >= min_clauses)
            .select("id", "clause", "first_line", "n_clauses"))


def match_code_structure(g: CodeGraph, structure: str = "nested_function",
                         leading_name: str = LEADING_NAME) -> DataFrame:
    """``nested_function``: (parent, nested definition) rows with the
    parent's nested count; ``higher_order``: functions whose signature has
    a function-typed argument; ``pattern_match``: functions whose body has
    a ``case ... of`` line or several defining clauses of one name."""
    f = g.function.select("id", "name", "module_name", "function_signature")
    if structure == "nested_function":
        w = g.where_function.select(F.col("parent_function_id").alias("id"),
                                    F.col("name").alias("nested"))
        n = w.groupBy("id").agg(F.count(F.lit(1)).alias("n_nested"))
        return f.join(w, "id").join(n, "id").select(
            F.col("id").alias("parent_id"), F.col("name").alias("parent"), "module_name",
            "nested", "n_nested")
    if structure == "higher_order":
        return f.filter(F.col("function_signature").rlike(HIGHER_ORDER_SIGNATURE))
    if structure == "pattern_match":
        lines = g.function_body.select("id", F.explode(F.split("raw_string", "\n")).alias("l"))
        hit = (lines.filter(F.col("l").rlike(CASE_OF_LINE)).select("id")
               .unionByName(defining_clauses(g, leading_name=leading_name).select("id")).distinct())
        return f.join(hit, "id", "left_semi")
    raise ValueError("structure must be nested_function, higher_order or pattern_match")


_CONFIG_KEYS = {"function_call": {"function", "target", "mode", "caller", "callee"},
                "type_usage": {"type_name", "usage_in"},
                "code_structure": {"structure_type", "structure", "leading_name"}}


def pattern_match(g: CodeGraph, pattern_type: str, config: dict, limit: int | None = 50
                  ) -> DataFrame:
    """O35 dispatcher over the three pattern kinds; unknown keys raise."""
    known = _CONFIG_KEYS.get(pattern_type)
    if known is None:
        raise ValueError(f"pattern_type must be one of {sorted(_CONFIG_KEYS)}")
    if set(config) - known:
        raise ValueError(f"unknown keys for {pattern_type}: {sorted(set(config) - known)}")
    if pattern_type == "function_call":
        out = match_function_calls(g, config.get("function"), config.get("target"),
                                   config.get("mode", "calls"), config.get("caller"),
                                   config.get("callee"))
        order = ["caller_id", "site", "callee", "callee_module"]
    elif pattern_type == "type_usage":
        out = match_type_usage(g, config["type_name"], config.get("usage_in", "function"))
        order = ["element_id"]
    else:
        out = match_code_structure(g, config.get("structure_type") or config.get(
            "structure", "nested_function"), config.get("leading_name", LEADING_NAME))
        order = [c for c in ("parent_id", "id", "nested") if c in out.columns]
    return _top(out, limit, *order)


# ---------------------------------------------------------------- O36

def _cross_sites(g: CodeGraph) -> DataFrame:
    """Call sites whose caller module differs from the callee module."""
    m = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("caller_module"))
    caller = g.function.select(F.col("id").alias("function_id"), "module_id").join(m, "module_id")
    return (g.function_called.join(caller, "function_id")
            .filter(F.col("caller_module") != F.col("module_name"))
            .select("caller_module", F.col("module_name").alias("callee_module")))


def _has(c: str, pattern: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).contains(F.lit(pattern))


def cross_module_dependencies(g: CodeGraph, module_pattern: str | None = None,
                              threshold: int = C.DEPENDENCY_THRESHOLD,
                              limit: int | None = C.LIMIT_CROSS_DEPENDENCIES) -> DataFrame:
    """O36 dependencies (A9): call count per (caller module, callee
    module). The module filter applies to either side and is pushed below
    the aggregation; the count threshold is applied after it."""
    s = _cross_sites(g)
    if module_pattern:
        s = s.filter(_has("caller_module", module_pattern) | _has("callee_module", module_pattern))
    out = (s.groupBy("caller_module", "callee_module")
           .agg(F.count(F.lit(1)).alias("call_count"))
           .filter(F.col("call_count") >= threshold))
    return _top(out, limit, F.desc("call_count"), "caller_module", "callee_module")


def module_coupling(g: CodeGraph, module_pattern: str | None = None, threshold: int = 1,
                    limit: int | None = 50) -> DataFrame:
    """O36 coupling (A10): incoming, outgoing and total cross-module calls
    per module. Each call is exploded into its two endpoint rows and
    summed in one aggregation."""
    s = _cross_sites(g)
    ends = s.select(F.explode(F.array(
        F.struct(F.col("caller_module").alias("name"), F.lit(0).alias("incoming"),
                 F.lit(1).alias("outgoing")),
        F.struct(F.col("callee_module").alias("name"), F.lit(1).alias("incoming"),
                 F.lit(0).alias("outgoing")))).alias("e")).select("e.*")
    if module_pattern:
        ends = ends.filter(_has("name", module_pattern))
    out = (ends.groupBy("name").agg(F.sum("incoming").cast("bigint").alias("incoming"),
                                    F.sum("outgoing").cast("bigint").alias("outgoing"))
           .withColumn("total", F.col("incoming") + F.col("outgoing"))
           .filter(F.col("total") >= threshold))
    return _top(out, limit, F.desc("total"), "name")


def coupling_totals(g: CodeGraph) -> DataFrame:
    """O36 coupling header: modules, cross-module calls, distinct module
    pairs, as (metric, value) rows."""
    s = _cross_sites(g)
    mods = g.module.agg(F.count(F.lit(1)).alias("v")).select(F.lit("module_count").alias("metric"),
                                                               "v")
    calls = s.agg(F.count(F.lit(1)).alias("v")).select(
        F.lit("total_cross_module_calls").alias("metric"), "v")
    pairs = (s.select("caller_module", "callee_module").distinct()
             .agg(F.count(F.lit(1)).alias("v"))
             .select(F.lit("dependency_count").alias("metric"), "v"))
    return mods.unionByName(calls).unionByName(pairs).select(
        "metric", F.col("v").cast("bigint").alias("value"))


def branch_points(body: Column) -> Column:
    """Decision points in a body: the words ``if`` and ``case`` (ASCII
    word tokens), ``&&``, ``||`` and single ``|`` (guards)."""
    # whole ASCII words only: no word character on either side
    kw = F.regexp_count(body, F.lit("(?<![A-Za-z0-9_])(?:if|case)(?![A-Za-z0-9_])"))
    no_or = F.replace(body, F.lit("||"), F.lit(""))
    n_and = (F.length(body) - F.length(F.replace(body, F.lit("&&"), F.lit("")))) / 2
    n_or = (F.length(body) - F.length(no_or)) / 2
    n_bar = F.length(no_or) - F.length(F.replace(no_or, F.lit("|"), F.lit("")))
    return (kw + n_and + n_or + n_bar).cast("bigint")


def complexity_metrics(g: CodeGraph, module_pattern: str | None = None, threshold: int = 1,
                       limit: int | None = 50) -> DataFrame:
    """O36 complexity: per function ``cyclomatic_complexity`` = 1 +
    branch points of the body, ``dependency_count`` = distinct resolved
    callees, ``nested_functions`` = local definitions, and their sum;
    kept when the sum reaches ``threshold``."""
    f = g.function.select("id", "name", "module_name")
    if module_pattern:
        f = f.filter(_has("module_name", module_pattern))
    bodies = g.function_body.select("id", "raw_string")
    sites = g.function_called.select(F.col("function_id").alias("id"), "callee_id")
    local = g.where_function.select(F.col("parent_function_id").alias("id"))
    if module_pattern:      # count and scan what the pattern leaves only
        bodies, sites, local = (d.join(f.select("id"), "id", "left_semi")
                                for d in (bodies, sites, local))
    body = bodies.select("id", (F.lit(1) + F.coalesce(branch_points(F.col("raw_string")),
                                                      F.lit(0))).alias("cc"))
    deps = sites.groupBy("id").agg(F.count_distinct("callee_id").alias("deps"))
    nested = local.groupBy("id").agg(F.count(F.lit(1)).alias("nested"))
    out = (f.join(body, "id", "left").join(deps, "id", "left").join(nested, "id", "left")
           .select("id", "name", "module_name",
                   F.coalesce("cc", F.lit(1)).cast("bigint").alias("cyclomatic_complexity"),
                   F.coalesce("deps", F.lit(0)).cast("bigint").alias("dependency_count"),
                   F.coalesce("nested", F.lit(0)).cast("bigint").alias("nested_functions"))
           .withColumn("total_complexity", F.col("cyclomatic_complexity")
                       + F.col("dependency_count") + F.col("nested_functions"))
           .filter(F.col("total_complexity") >= threshold))
    return _top(out, limit, F.desc("total_complexity"), "id")
