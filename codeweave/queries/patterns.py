"""Pattern-match and cross-module dependency operators on the fixture graph."""

from ..operators import patterns as op
from ..registry import register


@register("pattern_function_calls", """
SELECT c.function_id AS caller_id, f.name AS caller, f.module_name AS caller_module,
  c.name AS callee, c.module_name AS callee_module, c.site
FROM cg_function_called c JOIN cg_function f ON f.id = c.function_id
WHERE f.name LIKE '%ring' AND c.name LIKE 'hot%'
""")
def pattern_function_calls(g, spark, sf_dir):
    """O35 function_call: callers ending in 'ring' calling 'hot*' (no limit)."""
    return op.pattern_match(g, "function_call", {"function": "*ring", "target": "hot*"},
                            limit=None)


@register("pattern_called_by", """
SELECT c.function_id AS caller_id, f.name AS caller, f.module_name AS caller_module,
  c.name AS callee, c.module_name AS callee_module, c.site
FROM cg_function_called c JOIN cg_function f ON f.id = c.function_id
WHERE c.name LIKE '%plate%' AND f.name LIKE 'red%'
ORDER BY caller_id, site, callee, callee_module LIMIT 50
""")
def pattern_called_by(g, spark, sf_dir):
    """O35 function_call in called_by mode, default limit 50."""
    return op.pattern_match(g, "function_call",
                            {"function": "plate", "target": "red*", "mode": "called_by"})


@register("pattern_type_in_functions", """
SELECT 'BUILDING_10' AS type, id AS element_id, name AS element, module_name
FROM cg_function WHERE position('BUILDING_10' IN function_signature) > 0
""")
def pattern_type_in_functions(g, spark, sf_dir):
    """O35 type_usage in function signatures."""
    return op.match_type_usage(g, "BUILDING_10", "function")


@register("pattern_type_in_types", """
SELECT DISTINCT 'BUILDING_1' AS type, t.id AS element_id, t.type_name AS element,
  m.name AS module_name
FROM cg_field f JOIN cg_constructor c ON c.id = f.constructor_id
JOIN cg_type t ON t.id = c.type_id LEFT JOIN cg_module m ON m.id = t.module_id
WHERE position('BUILDING_1' IN f.field_type_raw) > 0
""")
def pattern_type_in_types(g, spark, sf_dir):
    """O35 type_usage in field types of other types."""
    return op.match_type_usage(g, "BUILDING_1", "type")


@register("pattern_type_in_classes", """
SELECT 'NATION_1' AS type, c.id AS element_id, c.class_name AS element, m.name AS module_name
FROM cg_class c LEFT JOIN cg_module m ON m.id = c.module_id
WHERE position('NATION_1' IN c.class_definition) > 0
""")
def pattern_type_in_classes(g, spark, sf_dir):
    """O35 type_usage in class definitions."""
    return op.match_type_usage(g, "NATION_1", "class")


@register("pattern_nested_functions", """
SELECT f.id AS parent_id, f.name AS parent, f.module_name, w.name AS nested,
  count(*) OVER (PARTITION BY f.id) AS n_nested
FROM cg_function f JOIN cg_where_function w ON w.parent_function_id = f.id
""")
def pattern_nested_functions(g, spark, sf_dir):
    """O35 code_structure nested_function, all parents."""
    return op.match_code_structure(g, "nested_function")


# The fixture's bodies are prose: names start in either case.
_ANY_CASE = "^([A-Za-z_][A-Za-z0-9_']*)"
_CLAUSES = r"""
, body_lines AS (SELECT id, ln, l FROM (
    SELECT id, unnest(string_split(raw_string, chr(10))) AS l,
      unnest(range(1, len(string_split(raw_string, chr(10))) + 1)) AS ln FROM cg_function_body)
  WHERE regexp_matches(l, '^[^\s]')),
heads AS (SELECT id, ln, regexp_extract(l, '^([A-Za-z_][A-Za-z0-9_'']*)', 1) AS clause FROM body_lines),
marked AS (SELECT *, CASE WHEN clause = lag(clause) OVER (PARTITION BY id ORDER BY ln) THEN 0 ELSE 1 END AS fresh
  FROM heads),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY ln) AS run FROM marked),
clauses AS (SELECT id, clause, CAST(min(ln) AS BIGINT) AS first_line, count(*) AS n_clauses FROM numbered
  WHERE clause <> '' GROUP BY id, run, clause HAVING count(*) >= 2)
"""


@register("pattern_clauses", _CLAUSES + "SELECT id, clause, first_line, n_clauses FROM clauses")
def pattern_clauses(g, spark, sf_dir):
    """Runs of defining clauses in every body."""
    return op.defining_clauses(g, leading_name=_ANY_CASE)


@register("pattern_case_of", _CLAUSES + r"""
SELECT f.id, f.name, f.module_name, f.function_signature FROM cg_function f
WHERE f.id IN (SELECT id FROM (SELECT id, unnest(string_split(raw_string, chr(10))) AS l
                               FROM cg_function_body)
               WHERE regexp_matches(l, '\bcase\b.*\bof\b') UNION SELECT id FROM clauses)
""")
def pattern_case_of(g, spark, sf_dir):
    """O35 code_structure pattern_match: bodies with a case ... of line or several
    defining clauses."""
    return op.match_code_structure(g, "pattern_match", _ANY_CASE)


@register("cross_module_dependencies", """
SELECT m.name AS caller_module, c.module_name AS callee_module, count(*) AS call_count
FROM cg_function_called c JOIN cg_function f ON f.id = c.function_id
JOIN cg_module m ON m.id = f.module_id
WHERE m.name <> c.module_name
  AND (position('NATION_1' IN m.name) > 0 OR position('NATION_1' IN c.module_name) > 0)
GROUP BY m.name, c.module_name HAVING count(*) >= 2
""")
def cross_module_dependencies(g, spark, sf_dir):
    """O36 dependencies: pairs touching NATION_1 with >= 2 calls (no limit)."""
    return op.cross_module_dependencies(g, "NATION_1", threshold=2, limit=None)


_CROSS = """
, cs AS (SELECT m.name AS caller_module, c.module_name AS callee_module
         FROM cg_function_called c JOIN cg_function f ON f.id = c.function_id
         JOIN cg_module m ON m.id = f.module_id WHERE m.name <> c.module_name)
"""


@register("module_coupling", _CROSS + """
, ends AS (SELECT caller_module AS name, 0 AS incoming, 1 AS outgoing FROM cs
           UNION ALL SELECT callee_module, 1, 0 FROM cs)
SELECT name, CAST(sum(incoming) AS BIGINT) AS incoming, CAST(sum(outgoing) AS BIGINT) AS outgoing,
  CAST(sum(incoming) + sum(outgoing) AS BIGINT) AS total
FROM ends GROUP BY name
""")
def module_coupling(g, spark, sf_dir):
    """O36 coupling metrics for every module (no limit)."""
    return op.module_coupling(g, limit=None)


@register("coupling_totals", _CROSS + """
SELECT 'module_count' AS metric, CAST(count(*) AS BIGINT) AS value FROM cg_module
UNION ALL SELECT 'total_cross_module_calls', count(*) FROM cs
UNION ALL SELECT 'dependency_count', count(*) FROM (SELECT DISTINCT caller_module, callee_module FROM cs)
""")
def coupling_totals(g, spark, sf_dir):
    """O36 coupling header totals."""
    return op.coupling_totals(g)


@register("complexity_metrics", """
, b AS (SELECT id, raw_string AS s, replace(raw_string, '||', '') AS no_or FROM cg_function_body),
  cc AS (SELECT id, 1 + len(list_filter(regexp_extract_all(s, '[A-Za-z0-9_]+'),
                                         lambda w: w = 'if' OR w = 'case'))
           + CAST((length(s) - length(replace(s, '&&', ''))) / 2 AS BIGINT)
           + CAST((length(s) - length(no_or)) / 2 AS BIGINT)
           + (length(no_or) - length(replace(no_or, '|', ''))) AS cc FROM b),
  d AS (SELECT function_id AS id, count(DISTINCT callee_id) AS deps FROM cg_function_called
        GROUP BY function_id),
  w AS (SELECT parent_function_id AS id, count(*) AS nested FROM cg_where_function
        GROUP BY parent_function_id)
SELECT f.id, f.name, f.module_name, CAST(coalesce(cc.cc, 1) AS BIGINT) AS cyclomatic_complexity,
  CAST(coalesce(d.deps, 0) AS BIGINT) AS dependency_count,
  CAST(coalesce(w.nested, 0) AS BIGINT) AS nested_functions,
  CAST(coalesce(cc.cc, 1) + coalesce(d.deps, 0) + coalesce(w.nested, 0) AS BIGINT)
    AS total_complexity
FROM cg_function f LEFT JOIN cc ON cc.id = f.id LEFT JOIN d ON d.id = f.id
LEFT JOIN w ON w.id = f.id
""")
def complexity_metrics(g, spark, sf_dir):
    """O36 complexity metrics for every function (threshold 1, no limit)."""
    return op.complexity_metrics(g, limit=None)
