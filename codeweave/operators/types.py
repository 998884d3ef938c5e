"""Type operators: listing, search, details, dependency walks, usage in
signatures, graph statistics, nested-type closure, relationship subgraph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import contains_literal, like, or_default, preview
from ..plans.graph import bfs
from ..plans.keys import Keys, key_frame, restrict
from ..plans.substring import contains_pairs, name_pairs
from ..sources.tables import CodeGraph
from ..functions import constants as C
from .functions import _per_group_limit, _top


def _typed(g: CodeGraph) -> DataFrame:
    """Types with their module name."""
    m = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("module_name"))
    return g.types.join(m, "module_id", "left")


def list_types(g: CodeGraph, module: str | None = None, pattern: str | None = None,
               category: str | None = None, limit: int | None = C.LIMIT_LISTING) -> DataFrame:
    """Exact module name AND name pattern AND category equality."""
    t = _typed(g)
    if module:
        t = t.filter(F.col("module_name") == module)
    if pattern:
        t = t.filter(like("type_name", pattern))
    if category:
        t = t.filter(F.col("type_of_type") == category)
    out = t.select("id", "type_name", or_default("type_of_type", C.UNKNOWN).alias("category"),
                   "module_name", "src_file", "line_start", "line_end")
    return _top(out, limit, "type_name", "id")


def search_types(g: CodeGraph, pattern: str, module_pattern: str | None = None,
                 category: str | None = None, limit: int | None = C.LIMIT_SEARCH) -> DataFrame:
    """Name pattern, optional module-name pattern and category."""
    t = _typed(g).filter(like("type_name", pattern))
    if module_pattern:
        t = t.filter(like("module_name", module_pattern))
    if category:
        t = t.filter(F.col("type_of_type") == category)
    out = t.select("id", "type_name", or_default("type_of_type", C.UNKNOWN).alias("category"),
                   "module_name")
    return _top(out, limit, "type_name", "id")


def type_details(g: CodeGraph, keys: Keys = None, include_constructors: bool = True,
                 include_fields: bool = True, nested: bool = False) -> DataFrame:
    """Type -> constructors -> fields.

    Flat form (default): one row per (type, constructor, field), with
    outer joins so a type without constructors still appears. This is the
    form that scales: a type with millions of constructors is just many
    rows. ``nested=True`` folds the rows into one row per type with a
    sorted ``constructors`` array; use it for key lookups only.
    """
    kf = key_frame(g.spark, keys, ["type_name", "module_name"])
    t = restrict(_typed(g), kf, ["type_name", "module_name"]).select(
        F.col("id").alias("type_id"), "type_name",
        or_default("type_of_type", C.UNKNOWN).alias("category"), "module_name",
        preview("raw_code", C.TYPE_DEFINITION_PREVIEW).alias("definition"))
    if not include_constructors:
        return t
    c = g.constructor.select(F.col("type_id"), F.col("id").alias("constructor_id"),
                             F.col("name").alias("constructor"))
    out = t.join(c, "type_id", "left")
    if include_fields:
        f = g.field.select("constructor_id",
                           or_default("field_name", C.UNNAMED_FIELD).alias("field_name"),
                           or_default("field_type_raw", C.UNKNOWN_FIELD_TYPE).alias("field_type"))
        out = out.join(f, "constructor_id", "left")
    if not nested:
        return out
    head = ["type_id", "type_name", "category", "module_name", "definition"]
    if include_fields:
        per_ctor = out.groupBy(*head, "constructor_id", "constructor").agg(
            F.array_sort(F.collect_list(F.when(F.col("field_name").isNotNull(), F.struct(
                "field_name", "field_type")))).alias("fields"))
        item = F.struct("constructor_id", "constructor", "fields")
    else:
        per_ctor, item = out, F.struct("constructor_id", "constructor")
    return per_ctor.groupBy(*head).agg(F.array_sort(F.collect_list(
        F.when(F.col("constructor_id").isNotNull(), item))).alias("constructors"))


def _type_nodes(g: CodeGraph) -> DataFrame:
    return _typed(g).select(F.col("id").alias("node"), F.col("type_name").alias("node_name"),
                            F.col("module_name").alias("node_module"))


def _edges(g: CodeGraph) -> DataFrame:
    return g.type_dependency.select(F.col("dependent_id").alias("src"),
                                    F.col("dependency_id").alias("dst"))


def type_dependencies(g: CodeGraph, keys: Keys = None, include_dependents: bool = False,
                      depth: int = 2) -> DataFrame:
    """Types reachable from each root type within ``depth`` steps, by
    shortest depth; ``depends_on`` walks edges forward, ``depended_by``
    backwards. Every type with a key name is its own root. Targets that
    are not in the type table are reported with ``is_external``."""
    kf = key_frame(g.spark, keys, ["type_name", "module_name"])
    roots = restrict(_typed(g), kf, ["type_name", "module_name"]).select(
        F.col("id").alias("root"), F.col("id").alias("node"))
    dirs = [("depends_on", False)] + ([("depended_by", True)] if include_dependents else [])
    nodes = _type_nodes(g)
    out = None
    for label, rev in dirs:
        r = bfs(_edges(g), roots, depth, reverse=rev, lazy=True).withColumn(
            "direction", F.lit(label))
        out = r if out is None else out.unionByName(r)
    names = g.types.select(F.col("id").alias("root"), F.col("type_name").alias("root_name"))
    return (out.join(names, "root").join(nodes, "node", "left")
            .select(F.col("root").alias("root_id"), "root_name", "direction",
                    F.col("node").alias("type_id"), F.col("node_name").alias("type_name"),
                    F.col("node_module").alias("module_name"),
                    F.col("node_name").isNull().alias("is_external"),
                    F.col("depth").cast("bigint").alias("depth")))


def type_usage_sites(g: CodeGraph, keys: Keys = None,
                     functions: DataFrame | None = None, match: str = "substring") -> DataFrame:
    """Pairs (type name, function) where the function signature contains
    the type name literally (J9, exact q-gram join), or with
    ``match='identifier'`` as a whole identifier. ``functions`` (a
    frame with an ``id`` column) restricts the signature side first, so a
    question about a few functions does not scan the q-grams of all."""
    kf = key_frame(g.spark, keys, ["type_name"])
    tn = restrict(g.types.select("type_name"), kf, ["type_name"])
    sigs = g.function.select("id", "name", "module_name", "function_signature")
    if functions is not None:
        sigs = sigs.join(functions.select("id").distinct(), "id", "left_semi")
    pairs = name_pairs(tn, sigs, "type_name", "function_signature", match).select(
        F.col("name").alias("type_name"), F.col("text").alias("function_signature"))
    return (pairs.join(sigs, "function_signature")
            .select(F.col("name").alias("function_name"), "module_name",
                    F.col("id").alias("function_id"), "type_name"))


def type_functions(g: CodeGraph, keys: Keys = None, limit: int | None = C.LIMIT_TYPE_FUNCTIONS,
                   match: str = "substring") -> DataFrame:
    """O21 keyed: the first ``limit`` functions (by name, id) whose signature
    mentions each type name."""
    return _per_group_limit(type_usage_sites(g, keys, match=match), ["type_name"], limit,
                            "function_name", "function_id")


def type_usage(g: CodeGraph, keys: Keys = None, module: str | None = None,
               usage_threshold: int = 1) -> DataFrame:
    """Per type, the number of functions whose signature mentions its
    name; kept when at least ``usage_threshold``."""
    kf = key_frame(g.spark, keys, ["type_name"])
    t = restrict(_typed(g), kf, ["type_name"])
    if module:
        t = t.filter(F.col("module_name") == module)
    # Functions are counted per distinct signature before the names meet them.
    tn = restrict(g.types.select("type_name"), kf, ["type_name"])
    per_sig = g.function.groupBy("function_signature").agg(F.count_distinct("id").alias("n"))
    counts = (contains_pairs(tn, per_sig, "type_name", "function_signature")
              .select(F.col("name").alias("type_name"), F.col("text").alias("function_signature"))
              .join(per_sig, "function_signature").groupBy("type_name")
              .agg(F.sum("n").alias("n_using_functions")))
    return (t.join(counts, "type_name", "left")
            .select("id", "type_name", or_default("type_of_type", C.UNKNOWN).alias("category"),
                    "module_name",
                    F.coalesce("n_using_functions", F.lit(0)).cast("bigint")
                    .alias("n_using_functions"))
            .filter(F.col("n_using_functions") >= usage_threshold))


def types_by_category(g: CodeGraph, module: str | None = None,
                      per_category: int = C.SAMPLE_TYPES_PER_CATEGORY
                      ) -> DataFrame:
    """O21 without a type: types grouped by category with the category
    size and the first ``per_category`` types (by name, id)."""
    t = _typed(g)
    if module:
        t = t.filter(F.col("module_name") == module)
    t = t.select("id", "type_name", "module_name",
                 or_default("type_of_type", C.UNKNOWN).alias("category"))
    sizes = t.groupBy("category").agg(F.count(F.lit(1)).alias("n_types"))
    first = _per_group_limit(t, ["category"], per_category, "type_name", "id")
    return first.join(sizes, "category")


def type_graph_stats(g: CodeGraph) -> DataFrame:
    """O22 unrooted, whole graph: node count, edge count (edges of every
    type, external targets included), average out-degree (NULL on an
    empty graph)."""
    n = g.types.agg(F.count(F.lit(1)).alias("v")).select(F.lit("types").alias("metric"), "v")
    e = (g.type_dependency.join(g.types.select(F.col("id").alias("dependent_id")),
                                "dependent_id", "left_semi")
         .agg(F.count(F.lit(1)).alias("v")).select(F.lit("dependencies").alias("metric"), "v"))
    both = n.unionByName(e)
    avg = both.agg(
        F.max(F.when(F.col("metric") == "types", F.col("v"))).alias("n"),
        F.max(F.when(F.col("metric") == "dependencies", F.col("v"))).alias("e")).select(
        F.lit("avg_dependencies").alias("metric"),
        F.when(F.col("n") > 0, F.round(F.col("e") / F.col("n"), 3)).alias("value"))
    return both.select("metric", F.col("v").cast("double").alias("value")).unionByName(avg)


def type_graph_top(g: CodeGraph, module_pattern: str | None = None, top: int | None = 10
                   ) -> DataFrame:
    """O22 unrooted: most connected types (out-degree), module-name
    substring filter applied before ranking."""
    deg = g.type_dependency.groupBy(F.col("dependent_id").alias("id")).agg(
        F.count(F.lit(1)).alias("edge_count"))
    t = _typed(g).join(deg, "id", "left").select(
        "id", "type_name", "module_name",
        F.coalesce("edge_count", F.lit(0)).cast("bigint").alias("edge_count"))
    if module_pattern:
        t = t.filter(contains_literal(F.coalesce("module_name", F.lit("")), module_pattern))
    return _top(t, top, F.desc("edge_count"), "id")


def type_graph_edges(g: CodeGraph, root: str, module_pattern: str | None = None,
                     include_external: bool = False, max_depth: int = 3) -> DataFrame:
    """O22 rooted: the edges leaving every node within ``max_depth - 1``
    steps of a root type (every type of that name, optionally only those
    whose module contains ``module_pattern``), i.e. the edges of the
    depth-bounded subgraph. External targets only when asked."""
    roots = _typed(g).filter(F.col("type_name") == root)
    if module_pattern:
        roots = roots.filter(contains_literal(F.coalesce("module_name", F.lit("")),
                                              module_pattern))
    roots = roots.select(F.col("id").alias("root"), F.col("id").alias("node"))
    reached = bfs(_edges(g), roots, max_depth - 1) if max_depth > 1 else None
    inner = roots.withColumn("depth", F.lit(0))
    if reached is not None:
        inner = inner.unionByName(reached)
    nodes = _type_nodes(g)
    e = _edges(g).withColumnRenamed("src", "node")
    out = (inner.join(e, "node")
           .join(nodes.select(F.col("node").alias("dst"), F.col("node_name").alias("dst_name"),
                              F.col("node_module").alias("dst_module")), "dst", "left")
           .select(F.col("root").alias("root_id"), F.col("node").alias("src_id"),
                   F.col("depth").cast("bigint").alias("src_depth"),
                   F.col("dst").alias("dst_id"), "dst_name", "dst_module",
                   F.col("dst_name").isNull().alias("is_external")))
    if not include_external:
        out = out.filter(~F.col("is_external"))
    return out


def nested_types(g: CodeGraph, type_names: list[str], gateway_name: str,
                 exclude_pattern: str | None = None, include_raw: bool = True) -> DataFrame:
    """The named types and every type they reach (fixpoint), kept
    when their module name contains ``gateway_name`` and their name does
    not match ``exclude_pattern``; the definition, or its first line."""
    kf = key_frame(g.spark, type_names, ["type_name"])
    # Only the union of what is reachable matters: one walk from all
    # start types at once (a single pseudo-root), not one per type.
    start = restrict(g.types, kf, ["type_name"]).select(F.lit(0).cast("long").alias("root"),
                                                         F.col("id").alias("node"))
    reach = bfs(_edges(g), start, None).select("node")
    ids = start.select("node").unionByName(reach).distinct()
    t = _typed(g).join(ids.select(F.col("node").alias("id")), "id", "left_semi")
    t = t.filter(contains_literal(F.coalesce("module_name", F.lit("")), gateway_name))
    if exclude_pattern:
        t = t.filter(~like("type_name", exclude_pattern))
    definition = F.col("raw_code") if include_raw else F.trim(
        F.split(F.col("raw_code"), "\n").getItem(0))
    return t.select("id", "type_name", "module_name", definition.alias("definition"))


@dataclass
class TypeRelationships:
    nodes: DataFrame        # (type_id, type_name, module_name, depth)
    edges: DataFrame        # (src_id, dst_id, dst_name, is_external)
    dependents: DataFrame   # (type_id, type_name, module_name): outside, edge into the set


def type_relationships(g: CodeGraph, type_name: str, source_module: str,
                       analysis_depth: int = 2, include_dependents: bool = True,
                       module_filter: str | None = None) -> TypeRelationships:
    """The subgraph within ``analysis_depth`` of the type (in the
    given module), its edges, and the types outside it that point in (J12)."""
    roots = (_typed(g).filter((F.col("type_name") == type_name)
                              & (F.col("module_name") == source_module))
             .select(F.col("id").alias("root"), F.col("id").alias("node")))
    reached = bfs(_edges(g), roots, analysis_depth)
    members = (roots.withColumn("depth", F.lit(0)).unionByName(reached)
               .groupBy("node").agg(F.min("depth").alias("depth")))
    tn = _type_nodes(g)
    nodes = members.join(tn, "node", "left")
    if module_filter:
        nodes = nodes.filter(contains_literal(F.coalesce("node_module", F.lit("")),
                                              module_filter))
    nodes = nodes.select(F.col("node").alias("type_id"), F.col("node_name").alias("type_name"),
                         F.col("node_module").alias("module_name"),
                         F.col("depth").cast("bigint").alias("depth"))
    ids = nodes.select(F.col("type_id").alias("src"))
    edges = (_edges(g).join(ids, "src", "left_semi")
             .join(tn.select(F.col("node").alias("dst"), F.col("node_name").alias("dst_name")),
                   "dst", "left")
             .select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "dst_name",
                     F.col("dst_name").isNull().alias("is_external")))
    if include_dependents:
        inside = nodes.select(F.col("type_id").alias("n"))
        dep_ids = (_edges(g).join(inside, F.col("dst") == F.col("n"), "left_semi")
                   .join(inside, F.col("src") == F.col("n"), "left_anti")
                   .select(F.col("src").alias("node")).distinct())
        dependents = dep_ids.join(tn, "node", "left").select(
            F.col("node").alias("type_id"), F.col("node_name").alias("type_name"),
            F.col("node_module").alias("module_name"))
    else:
        dependents = nodes.limit(0).select("type_id", "type_name", "module_name")
    return TypeRelationships(nodes, edges, dependents)


def type_graph(g: CodeGraph, root: str | None = None, module_pattern: str | None = None,
               include_external: bool = False, max_depth: int = 3, top: int | None = 10):
    """O22 entry point: rooted -> the subgraph's edges; unrooted -> a
    ``(stats, top)`` pair of DataFrames over the whole graph."""
    if root:
        return type_graph_edges(g, root, module_pattern, include_external, max_depth)
    return type_graph_stats(g), type_graph_top(g, module_pattern, top)
