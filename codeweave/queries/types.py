"""Type operators on the fixture graph."""

from pyspark.sql import functions as F

from ..operators import types as op
from ..registry import register

_CAT = "coalesce(nullif(t.type_of_type, ''), 'Unknown')"
_EDGES = ", e AS (SELECT DISTINCT dependent_id AS src, dependency_id AS dst FROM cg_type_dependency)"


def _first_type(g) -> tuple[str, str]:
    """(type name, module name) of the first type by id: an argument that
    exists at every scale."""
    m = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("module_name"))
    return tuple(g.types.join(m, "module_id").orderBy("id")
                 .select("type_name", "module_name").first())


@register("list_types", f"""
SELECT t.id, t.type_name, {_CAT} AS category, m.name AS module_name, t.src_file, t.line_start,
  t.line_end
FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id
WHERE t.type_name LIKE '%BUILDING_1%' AND t.type_of_type = 'DATA'
ORDER BY t.type_name, t.id LIMIT 100
""")
def list_types(g, spark, sf_dir):
    """Pattern + category."""
    return op.list_types(g, pattern="BUILDING_1", category="DATA")


@register("list_types_module", f"""
SELECT t.id, t.type_name, {_CAT} AS category, m.name AS module_name, t.src_file, t.line_start,
  t.line_end
FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id
WHERE m.name = (SELECT m1.name FROM cg_type t1 JOIN cg_module m1 ON m1.id = t1.module_id
  ORDER BY t1.id LIMIT 1)
ORDER BY t.type_name, t.id LIMIT 100
""")
def list_types_module(g, spark, sf_dir):
    """Exact module name only."""
    return op.list_types(g, module=_first_type(g)[1])


@register("search_types", f"""
SELECT t.id, t.type_name, {_CAT} AS category, m.name AS module_name
FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id
WHERE t.type_name LIKE 'MACHINERY%' AND m.name LIKE '%NATION_1%'
ORDER BY t.type_name, t.id LIMIT 50
""")
def search_types(g, spark, sf_dir):
    """Anchored name pattern and unanchored module pattern."""
    return op.search_types(g, "MACHINERY*", module_pattern="NATION_1")


@register("type_details", f"""
SELECT t.id AS type_id, t.type_name, {_CAT} AS category, m.name AS module_name,
  CASE WHEN length(t.raw_code) > 200 THEN concat(substring(t.raw_code, 1, 200), '...')
    ELSE t.raw_code END AS definition,
  c.id AS constructor_id, c.name AS constructor,
  CASE WHEN f.constructor_id IS NOT NULL
    THEN coalesce(nullif(f.field_name, ''), 'unnamed') END AS field_name,
  CASE WHEN f.constructor_id IS NOT NULL
    THEN coalesce(nullif(f.field_type_raw, ''), 'Unknown type') END AS field_type
FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id
LEFT JOIN cg_constructor c ON c.type_id = t.id
LEFT JOIN cg_field f ON f.constructor_id = c.id
""")
def type_details(g, spark, sf_dir):
    """O18 flat form for every type (type x constructor x field)."""
    return op.type_details(g)


@register("type_dependencies", f"""
{_EDGES},
fw(root, node, depth) AS (SELECT id, id, 0 FROM cg_type
  UNION SELECT fw.root, e.dst, fw.depth + 1 FROM fw JOIN e ON e.src = fw.node WHERE fw.depth < 2),
bw(root, node, depth) AS (SELECT id, id, 0 FROM cg_type
  UNION SELECT bw.root, e.src, bw.depth + 1 FROM bw JOIN e ON e.dst = bw.node WHERE bw.depth < 2),
r AS (SELECT root, node, 'depends_on' AS direction, min(depth) AS depth FROM fw
        WHERE node <> root GROUP BY root, node
      UNION ALL SELECT root, node, 'depended_by', min(depth) FROM bw
        WHERE node <> root GROUP BY root, node)
SELECT r.root AS root_id, rt.type_name AS root_name, r.direction, r.node AS type_id,
  t.type_name, m.name AS module_name, t.id IS NULL AS is_external,
  CAST(r.depth AS BIGINT) AS depth
FROM r JOIN cg_type rt ON rt.id = r.root LEFT JOIN cg_type t ON t.id = r.node
LEFT JOIN cg_module m ON m.id = t.module_id
""", recursive=True)
def type_dependencies(g, spark, sf_dir):
    """Every type as a root, depth 2, both directions."""
    return op.type_dependencies(g, None, include_dependents=True, depth=2)


@register("type_usage_sites", """
SELECT f.name AS function_name, f.module_name, f.id AS function_id, tn.type_name
FROM (SELECT DISTINCT type_name FROM cg_type) tn
JOIN cg_function f ON position(tn.type_name IN f.function_signature) > 0
""")
def type_usage_sites(g, spark, sf_dir):
    """Every (type name, function) with the name inside the signature."""
    return op.type_usage_sites(g)


@register("type_usage", f"""
, u AS (SELECT tn.type_name, count(DISTINCT f.id) AS n
        FROM (SELECT DISTINCT type_name FROM cg_type) tn
        JOIN cg_function f ON position(tn.type_name IN f.function_signature) > 0
        GROUP BY tn.type_name)
SELECT t.id, t.type_name, {_CAT} AS category, m.name AS module_name,
  CAST(coalesce(u.n, 0) AS BIGINT) AS n_using_functions
FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id
LEFT JOIN u ON u.type_name = t.type_name
WHERE coalesce(u.n, 0) >= 10
""")
def type_usage(g, spark, sf_dir):
    """O21 keyed by every type, usage threshold 10."""
    return op.type_usage(g, usage_threshold=10)


@register("types_by_category", f"""
SELECT category, id, type_name, module_name, n_types FROM (
  SELECT {_CAT} AS category, t.id, t.type_name, m.name AS module_name,
    count(*) OVER (PARTITION BY {_CAT}) AS n_types,
    row_number() OVER (PARTITION BY {_CAT} ORDER BY t.type_name, t.id) AS rn
  FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id) WHERE rn <= 10
""")
def types_by_category(g, spark, sf_dir):
    """O21 unkeyed: 10 types per category plus category sizes."""
    return op.types_by_category(g)


@register("type_graph_stats", """
, n AS (SELECT count(*) AS v FROM cg_type),
  d AS (SELECT count(*) AS v FROM cg_type_dependency WHERE dependent_id IN (SELECT id FROM cg_type))
SELECT 'types' AS metric, CAST(v AS DOUBLE) AS value FROM n
UNION ALL SELECT 'dependencies', CAST(v AS DOUBLE) FROM d
UNION ALL SELECT 'avg_dependencies',
  CASE WHEN n.v > 0 THEN round(d.v / n.v, 3) END FROM n, d
""")
def type_graph_stats(g, spark, sf_dir):
    """O22 unrooted totals over the whole graph."""
    return op.type_graph_stats(g)


@register("type_graph_top", """
SELECT t.id, t.type_name, m.name AS module_name, CAST(coalesce(d.n, 0) AS BIGINT) AS edge_count
FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id
LEFT JOIN (SELECT dependent_id, count(*) AS n FROM cg_type_dependency GROUP BY 1) d
  ON d.dependent_id = t.id
WHERE position('NATION_1' IN coalesce(m.name, '')) > 0
ORDER BY edge_count DESC, t.id LIMIT 10
""")
def type_graph_top(g, spark, sf_dir):
    """O22 unrooted: top 10 connected types in modules containing NATION_1."""
    return op.type_graph_top(g, "NATION_1")


@register("type_graph_edges", f"""
{_EDGES},
fw(root, node, depth) AS (SELECT id, id, 0 FROM cg_type WHERE type_name = 'BUILDING_10'
  UNION SELECT fw.root, e.dst, fw.depth + 1 FROM fw JOIN e ON e.src = fw.node WHERE fw.depth < 2),
i AS (SELECT root, node, min(depth) AS depth FROM fw GROUP BY root, node)
SELECT i.root AS root_id, i.node AS src_id, CAST(i.depth AS BIGINT) AS src_depth,
  d.dependency_id AS dst_id, t.type_name AS dst_name, m.name AS dst_module,
  t.id IS NULL AS is_external
FROM i JOIN cg_type_dependency d ON d.dependent_id = i.node
LEFT JOIN cg_type t ON t.id = d.dependency_id LEFT JOIN cg_module m ON m.id = t.module_id
""", recursive=True)
def type_graph_edges(g, spark, sf_dir):
    """O22 rooted at every BUILDING_10 type, depth 3, externals shown."""
    return op.type_graph_edges(g, "BUILDING_10", include_external=True, max_depth=3)


@register("nested_types", f"""
{_EDGES},
c(node) AS (SELECT id FROM cg_type WHERE type_name IN ('BUILDING_10', 'MACHINERY_3')
  UNION SELECT e.dst FROM c JOIN e ON e.src = c.node)
SELECT t.id, t.type_name, m.name AS module_name, t.raw_code AS definition
FROM cg_type t LEFT JOIN cg_module m ON m.id = t.module_id
WHERE t.id IN (SELECT node FROM c) AND position('NATION_1' IN coalesce(m.name, '')) > 0
  AND NOT t.type_name LIKE 'HOUSEHOLD%'
""", recursive=True)
def nested_types(g, spark, sf_dir):
    """Closure from two type names to the fixpoint, gateway NATION_1."""
    return op.nested_types(g, ["BUILDING_10", "MACHINERY_3"], "NATION_1",
                           exclude_pattern="HOUSEHOLD*")


_REL = f"""
{_EDGES},
fw(root, node, depth) AS (SELECT t.id, t.id, 0 FROM cg_type t JOIN cg_module m ON m.id = t.module_id
    WHERE (t.type_name, m.name) = (SELECT (t1.type_name, m1.name) FROM cg_type t1
      JOIN cg_module m1 ON m1.id = t1.module_id ORDER BY t1.id LIMIT 1)
  UNION SELECT fw.root, e.dst, fw.depth + 1 FROM fw JOIN e ON e.src = fw.node WHERE fw.depth < 2),
nodes AS (SELECT fw.node AS type_id, t.type_name, m.name AS module_name,
    CAST(min(fw.depth) AS BIGINT) AS depth
  FROM fw LEFT JOIN cg_type t ON t.id = fw.node LEFT JOIN cg_module m ON m.id = t.module_id
  GROUP BY fw.node, t.type_name, m.name)
"""


@register("type_relationships_nodes", _REL + "SELECT * FROM nodes", recursive=True)
def type_relationships_nodes(g, spark, sf_dir):
    """O24 subgraph nodes (depth 2) of the first type (by id), in its module."""
    return op.type_relationships(g, *_first_type(g)).nodes


@register("type_relationships_edges", _REL + """
SELECT e.src AS src_id, e.dst AS dst_id, t.type_name AS dst_name, t.id IS NULL AS is_external
FROM cg_type_dependency d JOIN e ON e.src = d.dependent_id AND e.dst = d.dependency_id
LEFT JOIN cg_type t ON t.id = e.dst
WHERE e.src IN (SELECT type_id FROM nodes)
""", recursive=True)
def type_relationships_edges(g, spark, sf_dir):
    """O24 edges leaving the subgraph nodes."""
    return op.type_relationships(g, *_first_type(g)).edges


@register("type_relationships_dependents", _REL + """
SELECT DISTINCT e.src AS type_id, t.type_name, m.name AS module_name
FROM e LEFT JOIN cg_type t ON t.id = e.src LEFT JOIN cg_module m ON m.id = t.module_id
WHERE e.dst IN (SELECT type_id FROM nodes) AND e.src NOT IN (SELECT type_id FROM nodes)
""", recursive=True)
def type_relationships_dependents(g, spark, sf_dir):
    """O24 reverse dependencies: outside types with an edge into the subgraph."""
    return op.type_relationships(g, *_first_type(g)).dependents


@register("type_usage_identifiers", """
SELECT f.name AS function_name, f.module_name, f.id AS function_id, tn.type_name
FROM (SELECT DISTINCT type_name FROM cg_type) tn JOIN cg_function f
  ON list_contains(regexp_extract_all(f.function_signature, '[A-Za-z0-9_]+'), tn.type_name)
""")
def type_usage_identifiers(g, spark, sf_dir):
    """J9 with whole identifiers: every (type name, function)."""
    return op.type_usage_sites(g, match="identifier")


@register("type_functions", """
SELECT function_name, module_name, function_id, type_name FROM (
  SELECT f.name AS function_name, f.module_name, f.id AS function_id, tn.type_name,
    row_number() OVER (PARTITION BY tn.type_name ORDER BY f.name, f.id) AS rn
  FROM (SELECT DISTINCT type_name FROM cg_type) tn
  JOIN cg_function f ON position(tn.type_name IN f.function_signature) > 0) WHERE rn <= 20
""")
def type_functions(g, spark, sf_dir):
    """O21 keyed by every type name: its first 20 functions."""
    return op.type_functions(g)
