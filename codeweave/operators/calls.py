"""Call-graph operators over resolved call edges (function_dependency):
neighbourhoods to a depth, and the enhanced call graph in its tree, flat
and graph forms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import bfs_masks
from ..plans.keys import Keys, key_frame, restrict
from ..session import cut_lineage
from ..sources.tables import CodeGraph


def _dependencies(g: CodeGraph) -> DataFrame:
    return g.function_dependency.select(F.col("caller_id").alias("src"),
                                        F.col("callee_id").alias("dst"))


def call_edges(g: CodeGraph) -> DataFrame:
    return _dependencies(g).distinct()


def external_callees(g: CodeGraph) -> DataFrame:
    """(src, dst, name, module_name): calls of what no function of the graph
    defines. ``dst`` is a stable id of (module, name), negative, so that it
    never meets a function's id; such a node has no calls of its own."""
    sites = g.function_called.filter(F.col("callee_id").isNull() & F.col("name").isNotNull())
    key = F.xxhash64("module_name", "name").bitwiseAND(F.lit((1 << 63) - 1))
    return sites.select(F.col("function_id").alias("src"), (-key - 1).alias("dst"), "name",
                        "module_name").distinct()


def _roots(g: CodeGraph, keys: Keys, first_only: bool = False) -> DataFrame:
    """Every function with a key name (optionally within a module) is a
    root; ``first_only`` keeps the smallest id per key instead."""
    kf = key_frame(g.spark, keys, ["name", "module_name"])
    f = restrict(g.function, kf, ["name", "module_name"])
    if first_only:
        f = f.groupBy("name").agg(F.min("id").alias("id"))
    return f.select(F.col("id").alias("root"), F.col("id").alias("node"))


def _fn_info(g: CodeGraph, prefix: str = "") -> DataFrame:
    return g.function.select(F.col("id").alias(f"{prefix}id"), F.col("name").alias(f"{prefix}name"),
                             F.col("module_name").alias(f"{prefix}module"),
                             F.col("function_signature").alias(f"{prefix}signature"))


def call_neighbours(g: CodeGraph, keys: Keys = None, depth: int = 2,
                    include_callers: bool = True, include_callees: bool = True,
                    first_only: bool = False) -> DataFrame:
    """Functions within ``depth`` calls of each root, by shortest
    depth, as callees (forward) and callers (backward). A callee that no
    function of the graph defines is a neighbour too: ``is_external``, with
    the name and module of the call and no ``function_id``."""
    roots = _roots(g, keys, first_only)
    outside = external_callees(g)
    parts = []
    how = {"lazy": True, "by_id": keys is None}     # read once, below
    if include_callees:
        forward = _dependencies(g).unionByName(outside.select("src", "dst"))
        parts.append(bfs_masks(forward, roots, depth, **how)
                     .withColumn("direction", F.lit("callee")))
    if include_callers:
        parts.append(bfs_masks(_dependencies(g), roots, depth, reverse=True, **how)
                     .withColumn("direction", F.lit("caller")))
    if not parts:
        raise ValueError("choose include_callers and/or include_callees")
    info = _fn_info(g)
    names = info.select(F.col("id").alias("root"), F.col("name").alias("root_name"))
    nodes = (info.select(F.col("id").alias("node"), F.col("name").alias("function"),
                         F.col("module").alias("module_name"))
             .unionByName(outside.select(F.col("dst").alias("node"),
                                         F.col("name").alias("function"), "module_name")
                          .distinct()))
    if keys is None:
        # The pairs lie by node: hashed, the nodes meet them there without a sort.
        nodes = nodes.hint("shuffle_hash")
    out = reduce(DataFrame.unionByName, [p.join(nodes, "node", "left").join(names, "root")
                                         for p in parts])
    return out.select(F.col("root").alias("root_id"), "root_name", "direction",
                      F.when(F.col("node") >= 0, F.col("node")).alias("function_id"), "function",
                      "module_name", F.col("depth").cast("bigint").alias("depth"),
                      (F.col("node") < 0).alias("is_external"))


def module_filter(module: Column, patterns: list[str] | None) -> Column:
    """Keep a node when it has no module, or its module contains any of
    the patterns (literal substrings). No patterns keeps everything."""
    if not patterns:
        return F.lit(True)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | module.contains(F.lit(p))
    return module.isNull() | hit


def call_tree(g: CodeGraph, keys: Keys = None, max_depth: int = 3,
              filter_modules: list[str] | None = None, include_signatures: bool = False,
              first_only: bool = False) -> DataFrame:
    """O15 tree form: every simple call path of length <= ``max_depth``
    from each root, one row per tree node ``(root_id, depth, path,
    parent_id, function_id, ...)``. A node outside ``filter_modules`` is
    dropped together with its subtree; a call back into the path is cut.

    The tree is exponential in depth on dense graphs by nature; it is
    built level by level (one join per level). The levels above the last are
    checkpointed. The last one, by far the largest, is neither written nor
    shuffled: names and modules are put to the calls, and the result is one
    join of the level above with them."""
    info = _fn_info(g)
    kept = (g.function.filter(module_filter(F.col("module_name"), filter_modules))
            .select(F.col("id").alias("n_id")))
    calls = call_edges(g).join(kept, F.col("dst") == F.col("n_id")).select("src", "dst")
    level = (_roots(g, keys, first_only).join(kept, F.col("node") == F.col("n_id"))
             .select("root", F.lit(0).alias("depth"), F.array("node").alias("path"),
                     F.lit(None).cast("bigint").alias("parent_id"),
                     F.col("node").alias("function_id")))
    level = cut_lineage(level)
    levels = [level]
    # Read again at every level but the last: persisted once.
    e = calls.persist(StorageLevel.MEMORY_AND_DISK) if max_depth > 2 else calls

    def below(d: int, level: DataFrame, calls: DataFrame, *texts: str) -> DataFrame:
        return (level.select("root", "path", F.col("function_id").alias("src"))
                .join(calls, "src").filter(~F.array_contains("path", F.col("dst")))
                .select("root", F.lit(d).alias("depth"),
                        F.concat("path", F.array("dst")).alias("path"),
                        F.col("src").alias("parent_id"), F.col("dst").alias("function_id"), *texts))
    for d in range(1, max_depth):
        level = cut_lineage(below(d, level, e))
        levels.append(level)
    e.unpersist()
    texts = ["name", "module", "signature"] if include_signatures else ["name", "module"]
    out = reduce(DataFrame.unionByName, levels).join(
        info, F.col("function_id") == F.col("id")).select(*level.columns, *texts)
    if max_depth > 0:
        named = calls.join(info, F.col("dst") == F.col("id")).select("src", "dst", *texts)
        out = out.unionByName(below(max_depth, level, named, *texts))
    cols = [F.col("root").alias("root_id"), F.col("depth").cast("bigint").alias("depth"),
            "path", "parent_id", "function_id", F.col("name").alias("function"),
            F.col("module").alias("module_name")]
    if include_signatures:
        cols.append("signature")
    return out.select(*cols)


def _filtered_edges(g: CodeGraph, filter_modules: list[str] | None) -> DataFrame:
    e = _dependencies(g)      # a walk makes them distinct
    if not filter_modules:
        return e
    ok = (g.function.filter(module_filter(F.col("module_name"), filter_modules))
          .select(F.col("id").alias("dst")))
    return e.join(ok, "dst", "left_semi")


def call_graph_flat(g: CodeGraph, keys: Keys = None, max_depth: int = 3,
                    filter_modules: list[str] | None = None, first_only: bool = False
                    ) -> DataFrame:
    """O15 flat form: each function once per root with its shortest depth,
    walking only through nodes that pass the module filter (the root
    included, at depth 0)."""
    roots = _roots(g, keys, first_only)
    if filter_modules:
        ok = g.function.filter(module_filter(F.col("module_name"), filter_modules))
        roots = roots.join(ok.select(F.col("id").alias("node")), "node", "left_semi")
    reached = bfs_masks(_filtered_edges(g, filter_modules), roots, max_depth, lazy=True,
                        by_id=keys is None)
    info = _fn_info(g)
    # All functions as roots: the pairs lie by node, and hashed, the functions
    # meet them there without a sort.
    by_node = info.hint("shuffle_hash") if keys is None else info
    out = (roots.withColumn("depth", F.lit(0)).join(info, F.col("node") == F.col("id"))
           .unionByName(reached.join(by_node, F.col("node") == F.col("id"))))
    return out.select(
        F.col("root").alias("root_id"), F.col("node").alias("function_id"),
        F.col("name").alias("function"), F.col("module").alias("module_name"),
        F.col("depth").cast("bigint").alias("depth"))


def call_graph_edges(g: CodeGraph, keys: Keys = None, max_depth: int = 3,
                     filter_modules: list[str] | None = None, first_only: bool = False
                     ) -> DataFrame:
    """O15 graph form, edges: every call leaving a kept node that is less
    than ``max_depth`` deep, whatever its target (a filtered or already
    seen target keeps its edge, as in the reference). Nodes at ``max_depth``
    have none, so the walk stops one step before."""
    nodes = call_graph_flat(g, keys, max(max_depth - 1, 0), filter_modules, first_only)
    inner = nodes.filter(F.col("depth") < max_depth).select(
        "root_id", F.col("function_id").alias("src"))
    return inner.join(call_edges(g), "src").select(
        "root_id", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))


@dataclass
class CallGraph:
    nodes: DataFrame
    edges: DataFrame


def enhanced_call_graph(g: CodeGraph, keys: Keys, max_depth: int = 3, fmt: str = "tree",
                        include_signatures: bool = False,
                        filter_modules: list[str] | None = None, first_only: bool = False):
    """O15 dispatcher: ``tree`` -> DataFrame of tree rows, ``flat`` ->
    DataFrame of nodes, ``graph`` -> CallGraph(nodes, edges)."""
    if fmt == "tree":
        return call_tree(g, keys, max_depth, filter_modules, include_signatures, first_only)
    if fmt == "flat":
        return call_graph_flat(g, keys, max_depth, filter_modules, first_only)
    if fmt == "graph":
        return CallGraph(call_graph_flat(g, keys, max_depth, filter_modules, first_only),
                         call_graph_edges(g, keys, max_depth, filter_modules, first_only))
    raise ValueError(f"unknown format {fmt!r}; use tree, flat or graph")
