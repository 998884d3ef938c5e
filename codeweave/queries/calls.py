"""Call-graph operators on the fixture graph."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import calls as op
from ..registry import register

_E = ", e AS (SELECT DISTINCT caller_id AS src, callee_id AS dst FROM cg_function_dependency)"
_KEEP = ("({m} IS NULL OR position('NATION_1' IN {m}) > 0 "
         "OR position('NATION_2' IN {m}) > 0)")
_MODS = ["NATION_1", "NATION_2"]
_ROOT = f"""(SELECT id FROM cg_function WHERE module_name = (
  SELECT min(module_name) FROM cg_function WHERE {_KEEP.format(m='module_name')}))"""


def _root_keys(g):
    """The functions of the first module (by name) that passes the filter.
    The graph is dense: from every root, a walk of depth 3 lists nearly
    every pair of functions."""
    first = (g.function.filter(op.module_filter(F.col("module_name"), _MODS))
             .agg(F.min("module_name").alias("module_name")))
    return g.function.join(first, "module_name").select("name", "module_name")


@register("call_neighbours", f"""
{_E},
fw(root, node, depth) AS (SELECT id, id, 0 FROM cg_function
  UNION SELECT fw.root, e.dst, fw.depth + 1 FROM fw JOIN e ON e.src = fw.node WHERE fw.depth < 1),
bw(root, node, depth) AS (SELECT id, id, 0 FROM cg_function
  UNION SELECT bw.root, e.src, bw.depth + 1 FROM bw JOIN e ON e.dst = bw.node WHERE bw.depth < 1),
r AS (SELECT root, node, 'callee' AS direction, min(depth) AS depth FROM fw
        WHERE node <> root GROUP BY root, node
      UNION ALL SELECT root, node, 'caller', min(depth) FROM bw
        WHERE node <> root GROUP BY root, node)
SELECT r.root AS root_id, rf.name AS root_name, r.direction, r.node AS function_id,
  f.name AS function, f.module_name, CAST(r.depth AS BIGINT) AS depth, f.id IS NULL AS is_external
FROM r JOIN cg_function rf ON rf.id = r.root LEFT JOIN cg_function f ON f.id = r.node
""", recursive=True)
def call_neighbours(g, spark, sf_dir):
    """Every function as a root, depth 1, callers and callees."""
    return op.call_neighbours(g, None, depth=1)


@register("call_neighbours_keyed", f"""
{_E},
fw(root, node, depth) AS (SELECT id, id, 0 FROM cg_function WHERE id IN {_ROOT}
  UNION SELECT fw.root, e.dst, fw.depth + 1 FROM fw JOIN e ON e.src = fw.node WHERE fw.depth < 2),
bw(root, node, depth) AS (SELECT id, id, 0 FROM cg_function WHERE id IN {_ROOT}
  UNION SELECT bw.root, e.src, bw.depth + 1 FROM bw JOIN e ON e.dst = bw.node WHERE bw.depth < 2),
r AS (SELECT root, node, 'callee' AS direction, min(depth) AS depth FROM fw
        WHERE node <> root GROUP BY root, node
      UNION ALL SELECT root, node, 'caller', min(depth) FROM bw
        WHERE node <> root GROUP BY root, node)
SELECT r.root AS root_id, rf.name AS root_name, r.direction, r.node AS function_id,
  f.name AS function, f.module_name, CAST(r.depth AS BIGINT) AS depth, f.id IS NULL AS is_external
FROM r JOIN cg_function rf ON rf.id = r.root LEFT JOIN cg_function f ON f.id = r.node
""", recursive=True)
def call_neighbours_keyed(g, spark, sf_dir):
    """O10 keyed by one module's functions, depth 2, callers and callees."""
    return op.call_neighbours(g, _root_keys(g), depth=2)


@register("call_tree", f"""
{_E},
t(root, depth, path, parent_id, function_id) AS (
  SELECT f.id, 0, [f.id], CAST(NULL AS BIGINT), f.id FROM cg_function f
  WHERE f.id IN {_ROOT}
  UNION ALL
  SELECT t.root, t.depth + 1, list_append(t.path, e.dst), t.function_id, e.dst
  FROM t JOIN e ON e.src = t.function_id JOIN cg_function f ON f.id = e.dst
  WHERE t.depth < 3 AND NOT list_contains(t.path, e.dst) AND {_KEEP.format(m='f.module_name')})
SELECT t.root AS root_id, CAST(t.depth AS BIGINT) AS depth, array_to_string(t.path, '>') AS path,
  t.parent_id, t.function_id, f.name AS function, f.module_name
FROM t JOIN cg_function f ON f.id = t.function_id
""", recursive=True)
def call_tree(g, spark, sf_dir):
    """O15 tree: one module's functions as roots, depth 3, module filter; path as text."""
    return op.call_tree(g, _root_keys(g), 3, _MODS).withColumn(
        "path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


_FLAT = f"""
, ok AS (SELECT id FROM cg_function WHERE {_KEEP.format(m='module_name')}),
e AS (SELECT DISTINCT caller_id AS src, callee_id AS dst FROM cg_function_dependency
      WHERE callee_id IN (SELECT id FROM ok)),
w(root, node, depth) AS (SELECT id, id, 0 FROM cg_function
    WHERE id IN {_ROOT}
  UNION SELECT w.root, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3),
flat AS (SELECT w.root AS root_id, w.node AS function_id, f.name AS function, f.module_name,
    CAST(min(w.depth) AS BIGINT) AS depth
  FROM w JOIN cg_function f ON f.id = w.node GROUP BY w.root, w.node, f.name, f.module_name)
"""


@register("call_graph_flat", _FLAT + "SELECT * FROM flat", recursive=True)
def call_graph_flat(g, spark, sf_dir):
    """O15 flat: one module's functions as roots; each node once with its shortest depth."""
    return op.call_graph_flat(g, _root_keys(g), 3, _MODS)


@register("call_graph_edges", _FLAT + """
SELECT DISTINCT flat.root_id, flat.function_id AS src_id, d.callee_id AS dst_id
FROM flat JOIN cg_function_dependency d ON d.caller_id = flat.function_id
WHERE flat.depth < 3
""", recursive=True)
def call_graph_edges(g, spark, sf_dir):
    """O15 graph, the same roots: edges out of kept nodes above the depth bound."""
    return op.call_graph_edges(g, _root_keys(g), 3, _MODS)


_KNOWN = """
, known AS (SELECT function_id, CASE WHEN module_name IS NOT NULL THEN callee_id END AS callee_id,
    name, module_name FROM cg_function_called),
e AS (SELECT DISTINCT function_id AS src, CAST(callee_id AS VARCHAR) AS dst FROM known
      WHERE callee_id IS NOT NULL
      UNION SELECT DISTINCT function_id, concat('?', name) FROM known WHERE callee_id IS NULL)
"""


def _with_unknown_callees(g):
    """The graph as a dump without a definition for some callees gives it:
    sites without a module name stay unresolved."""
    sites = g.function_called.withColumn("callee_id", F.when(
        F.col("module_name").isNotNull(), F.col("callee_id")))
    deps = sites.filter("callee_id is not null").select(
        F.col("function_id").alias("caller_id"), "callee_id").distinct()
    return replace(g, function_called=sites, function_dependency=deps)


@register("call_neighbours_external", f"""
{_KNOWN},
one AS (SELECT src AS root, dst, 1 AS depth FROM e),
two AS (SELECT DISTINCT one.root, e.dst, 2 AS depth
        FROM one JOIN e ON e.src = try_cast(one.dst AS BIGINT)),
r AS (SELECT root, dst, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
      WHERE dst <> CAST(root AS VARCHAR) GROUP BY root, dst)
SELECT r.root AS root_id, rf.name AS root_name, 'callee' AS direction,
  try_cast(r.dst AS BIGINT) AS function_id,
  CASE WHEN r.dst LIKE '?%' THEN substring(r.dst, 2) ELSE f.name END AS function, f.module_name,
  CAST(r.depth AS BIGINT) AS depth, r.dst LIKE '?%' AS is_external
FROM r JOIN cg_function rf ON rf.id = r.root LEFT JOIN cg_function f ON f.id = try_cast(r.dst AS BIGINT)
""")
def call_neighbours_external(g, spark, sf_dir):
    """Every function as a root, callees to depth 2, unresolved ones included."""
    return op.call_neighbours(_with_unknown_callees(g), None, depth=2, include_callers=False)


@register("call_neighbours_all", f"""
{_E},
one AS (SELECT src AS root, dst AS node, 1 AS depth FROM e),
fw AS (SELECT * FROM one UNION SELECT one.root, e.dst, 2 FROM one JOIN e ON e.src = one.node),
b1 AS (SELECT dst AS root, src AS node, 1 AS depth FROM e),
bw AS (SELECT * FROM b1 UNION SELECT b1.root, e.src, 2 FROM b1 JOIN e ON e.dst = b1.node),
r AS (SELECT root, node, 'callee' AS direction, min(depth) AS depth FROM fw
        WHERE node <> root GROUP BY root, node
      UNION ALL SELECT root, node, 'caller', min(depth) FROM bw
        WHERE node <> root GROUP BY root, node)
SELECT root AS root_id, direction, CAST(depth AS BIGINT) AS depth, count(*) AS n,
  CAST(sum(node) AS BIGINT) AS id_sum, count(DISTINCT f.module_name) AS n_modules
FROM r LEFT JOIN cg_function f ON f.id = r.node GROUP BY root, direction, depth
""")
def call_neighbours_all(g, spark, sf_dir):
    """Every function as a root, depth 2, callers and callees, counted
    per root and depth."""
    return op.call_neighbours(g, None, depth=2).groupBy("root_id", "direction", "depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum("function_id").alias("id_sum"),
        F.count_distinct("module_name").alias("n_modules"))


_ALL = f"""
, ok AS (SELECT id FROM cg_function WHERE {_KEEP.format(m='module_name')}),
e AS (SELECT DISTINCT caller_id AS src, callee_id AS dst FROM cg_function_dependency
      WHERE callee_id IN (SELECT id FROM ok)),
one AS (SELECT src AS root, dst AS node, 1 AS depth FROM e WHERE src IN (SELECT id FROM ok)),
w AS (SELECT id AS root, id AS node, 0 AS depth FROM ok UNION SELECT * FROM one
      UNION SELECT one.root, e.dst, 2 FROM one JOIN e ON e.src = one.node),
flat AS (SELECT w.root AS root_id, w.node AS function_id, f.name AS function, f.module_name,
    CAST(min(w.depth) AS BIGINT) AS depth
  FROM w JOIN cg_function f ON f.id = w.node GROUP BY w.root, w.node, f.name, f.module_name)
"""


@register("call_graph_flat_all", _ALL + "SELECT * FROM flat")
def call_graph_flat_all(g, spark, sf_dir):
    """O15 flat: every function that passes the module filter as a root, depth 2."""
    return op.call_graph_flat(g, None, 2, _MODS)


@register("call_graph_edges_all", _ALL + """
SELECT flat.root_id, flat.function_id AS src_id, d.callee_id AS dst_id
FROM flat JOIN (SELECT DISTINCT caller_id, callee_id FROM cg_function_dependency) d
  ON d.caller_id = flat.function_id WHERE flat.depth < 2
""")
def call_graph_edges_all(g, spark, sf_dir):
    """O15 graph, the same roots: edges out of kept nodes above the depth bound."""
    return op.call_graph_edges(g, None, 2, _MODS)


@register("call_tree_all", _ALL + """
, ok2 AS (SELECT f.id, f.name, f.module_name FROM cg_function f JOIN ok ON ok.id = f.id),
t0 AS (SELECT id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS parent_id,
         id AS function_id FROM ok),
t1 AS (SELECT t0.root, 1, concat(path, '>', dst), function_id, dst FROM t0 JOIN e ON e.src = function_id
       WHERE dst <> t0.root),
t2 AS (SELECT a.root, 2, concat(a.root, '>', a.node, '>', b.dst), a.node, b.dst
       FROM one a JOIN e b ON b.src = a.node WHERE a.node <> a.root AND b.dst NOT IN (a.root, a.node))
SELECT t.root AS root_id, CAST(t.depth AS BIGINT) AS depth, t.path, t.parent_id, t.function_id,
  f.name AS function, f.module_name
FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2) t
JOIN ok2 f ON f.id = t.function_id
""")
def call_tree_all(g, spark, sf_dir):
    """O15 tree: every function that passes the module filter as a root, depth 2."""
    return op.call_tree(g, None, 2, _MODS).withColumn(
        "path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))
