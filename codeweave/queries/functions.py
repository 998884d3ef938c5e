"""Function / call-site operators on the fixture graph."""

from pyspark.sql import functions as F

from ..operators import functions as op
from ..registry import register

SIG_PREVIEW_100 = ("CASE WHEN length({c}) > 100 THEN concat(substring({c}, 1, 100), '...') "
                   "ELSE {c} END")


@register("function_complexity", f"""
, scored AS (
  SELECT f.id, f.name, f.module_name,
    CASE WHEN f.function_signature IS NOT NULL AND f.function_signature <> ''
      THEN CAST(floor(length(f.function_signature) / 20) AS BIGINT)
         + 2 * CAST(floor((length(f.function_signature)
             - length(replace(f.function_signature, '->', ''))) / 2) AS BIGINT)
      ELSE 0 END AS signature_score,
    CAST(coalesce(c.n, 0) AS BIGINT) AS call_count,
    CAST(coalesce(w.n, 0) AS BIGINT) AS where_count,
    {SIG_PREVIEW_100.format(c='f.function_signature')} AS signature
  FROM cg_function f
  LEFT JOIN (SELECT function_id, count(*) AS n FROM cg_function_called GROUP BY function_id) c
    ON c.function_id = f.id
  LEFT JOIN (SELECT parent_function_id, count(*) AS n FROM cg_where_function
             GROUP BY parent_function_id) w ON w.parent_function_id = f.id)
SELECT id, name, module_name, signature_score, call_count, where_count, signature,
  CAST(signature_score + floor(call_count / 3) + 2 * where_count AS BIGINT) AS complexity
FROM scored
WHERE signature_score + floor(call_count / 3) + 2 * where_count >= 5
ORDER BY complexity DESC, id LIMIT 50
""")
def function_complexity(g, spark, sf_dir):
    """O14 flagship: top 50 functions by complexity (min 5)."""
    return op.function_complexity(g)


@register("function_complexity_all", """
, scored AS (
  SELECT f.id,
    CASE WHEN f.function_signature IS NOT NULL AND f.function_signature <> ''
      THEN CAST(floor(length(f.function_signature) / 20) AS BIGINT)
         + 2 * CAST(floor((length(f.function_signature)
             - length(replace(f.function_signature, '->', ''))) / 2) AS BIGINT)
      ELSE 0 END
    + CAST(floor(coalesce(c.n, 0) / 3) AS BIGINT) + 2 * coalesce(w.n, 0) AS complexity
  FROM cg_function f
  LEFT JOIN (SELECT function_id, count(*) AS n FROM cg_function_called GROUP BY function_id) c
    ON c.function_id = f.id
  LEFT JOIN (SELECT parent_function_id, count(*) AS n FROM cg_where_function
             GROUP BY parent_function_id) w ON w.parent_function_id = f.id)
SELECT id, CAST(complexity AS BIGINT) AS complexity FROM scored WHERE complexity >= 12
""")
def function_complexity_all(g, spark, sf_dir):
    """O14 without a limit: every function scoring at least 12."""
    return op.function_complexity(g, min_complexity=12, limit=None).select("id", "complexity")


@register("function_details", """
SELECT id, name, coalesce(nullif(module_name, ''), 'Unknown') AS module_name,
  coalesce(nullif(function_signature, ''), 'No signature') AS signature,
  src_file, line_start, line_end, coalesce(nullif(type_enum, ''), 'Unknown') AS type_enum
FROM cg_function WHERE name IN ('red plate', 'hot ring', 'no such function')
""")
def function_details(g, spark, sf_dir):
    """Every function carrying one of three names."""
    return op.function_details(g, ["red plate", "hot ring", "no such function"])


@register("function_details_all", """
SELECT id, name, coalesce(nullif(module_name, ''), 'Unknown') AS module_name,
  coalesce(nullif(function_signature, ''), 'No signature') AS signature,
  src_file, line_start, line_end, coalesce(nullif(type_enum, ''), 'Unknown') AS type_enum
FROM cg_function
""")
def function_details_all(g, spark, sf_dir):
    """O07 for all functions (no key table)."""
    return op.function_details(g)


@register("search_functions", """
SELECT id, name, coalesce(nullif(module_name, ''), 'Unknown') AS module_name,
  coalesce(nullif(function_signature, ''), 'No signature') AS signature
FROM cg_function WHERE name LIKE '%ring%' ORDER BY name, id LIMIT 50
""")
def search_functions(g, spark, sf_dir):
    """O08, unanchored pattern, default limit."""
    return op.search_functions(g, "ring")


@register("search_functions_all", """
SELECT id, name, coalesce(nullif(module_name, ''), 'Unknown') AS module_name,
  coalesce(nullif(function_signature, ''), 'No signature') AS signature
FROM cg_function WHERE name LIKE 'hot%'
""")
def search_functions_all(g, spark, sf_dir):
    """O08 anchored (``hot*``), no limit."""
    return op.search_functions(g, "hot*", limit=None)


@register("most_called_functions", """
SELECT name, module_name, calls,
  CAST(row_number() OVER (ORDER BY calls DESC, name ASC NULLS LAST,
                          module_name ASC NULLS LAST) AS BIGINT) AS rank
FROM (SELECT name, module_name, count(*) AS calls FROM cg_function_called
      GROUP BY name, module_name)
ORDER BY calls DESC, name ASC NULLS LAST, module_name ASC NULLS LAST LIMIT 20
""")
def most_called_functions(g, spark, sf_dir):
    """O09 top 20."""
    return op.most_called_functions(g)


@register("function_callers", """
SELECT callee, callee_module, caller_id, caller, caller_module, site, src_loc FROM (
  SELECT c.name AS callee, c.module_name AS callee_module, c.function_id AS caller_id,
    f.name AS caller, f.module_name AS caller_module, c.site, c.src_loc,
    row_number() OVER (PARTITION BY c.name
                       ORDER BY c.function_id, c.site, c.module_name, c.src_loc) AS rn
  FROM cg_function_called c JOIN cg_function f ON c.function_id = f.id) WHERE rn <= 50
""")
def function_callers(g, spark, sf_dir):
    """O11 for every callee name, 50 call sites each."""
    return op.function_callers(g, None)


@register("function_callers_keyed", """
SELECT c.name AS callee, c.module_name AS callee_module, c.function_id AS caller_id,
  f.name AS caller, f.module_name AS caller_module, c.site, c.src_loc
FROM cg_function_called c JOIN cg_function f ON c.function_id = f.id
WHERE c.name IN ('red plate', 'small widget')
""")
def function_callers_keyed(g, spark, sf_dir):
    """O11 for two names, every call site (no limit)."""
    return op.function_callers(g, ["red plate", "small widget"], limit=None)


@register("function_callers_resolved", """
SELECT c.name AS callee, c.module_name AS callee_module, c.function_id AS caller_id,
  f.name AS caller, f.module_name AS caller_module, c.site, c.src_loc
FROM cg_function_called c JOIN cg_function f ON c.function_id = f.id
WHERE EXISTS (SELECT 1 FROM cg_function t JOIN cg_type y ON y.module_id = t.module_id
              WHERE t.name = c.name AND t.module_name = c.module_name
                AND y.type_of_type = 'NEWTYPE')
""")
def function_callers_resolved(g, spark, sf_dir):
    """O11 by (name, module) for the functions of modules with a newtype."""
    newtype = g.types.filter("type_of_type = 'NEWTYPE'").select("module_id")
    keys = g.function.join(newtype, "module_id", "left_semi").select("name", "module_name")
    return op.function_callers(g, keys, limit=None, resolve="module")


@register("function_complexity_module", """
, one AS (SELECT min(name) AS name FROM cg_module),
  fs AS (SELECT f.* FROM cg_function f JOIN cg_module m ON m.id = f.module_id
         JOIN one ON one.name = m.name)
SELECT f.id, (SELECT count(*) FROM cg_function_called c WHERE c.function_id = f.id) AS call_count,
  (SELECT count(*) FROM cg_where_function w WHERE w.parent_function_id = f.id) AS where_count
FROM fs f
""")
def function_complexity_module(g, spark, sf_dir):
    """O14 for one module: the counts of its functions."""
    first = g.module.agg(F.min("name")).first()[0]
    return op.function_complexity(g, module=first, min_complexity=0, limit=None).select(
        "id", "call_count", "where_count")


@register("function_callees", """
SELECT caller_id, caller, caller_module, callee, callee_module, site, src_loc FROM (
  SELECT f.id AS caller_id, f.name AS caller, f.module_name AS caller_module,
    c.name AS callee, c.module_name AS callee_module, c.site, c.src_loc,
    row_number() OVER (PARTITION BY f.id
                       ORDER BY c.name, c.site, c.module_name, c.src_loc) AS rn
  FROM cg_function f JOIN cg_function_called c ON c.function_id = f.id) WHERE rn <= 50
""")
def function_callees(g, spark, sf_dir):
    """O12 for every function, 50 sites each."""
    return op.function_callees(g, None)


@register("cross_module_calls", """
SELECT f.id AS source_id, f.name AS source_function, m.name AS source_module,
  c.name AS target_function, c.module_name AS target_module, c.site
FROM cg_function_called c JOIN cg_function f ON c.function_id = f.id
JOIN cg_module m ON f.module_id = m.id
WHERE m.name <> c.module_name
""")
def cross_module_calls(g, spark, sf_dir):
    """O13 over all call sites (no limit)."""
    return op.cross_module_calls(g, limit=None)


@register("cross_module_calls_filtered", """
SELECT f.id AS source_id, f.name AS source_function, m.name AS source_module,
  c.name AS target_function, c.module_name AS target_module, c.site
FROM cg_function_called c JOIN cg_function f ON c.function_id = f.id
JOIN cg_module m ON f.module_id = m.id
WHERE m.name <> c.module_name AND m.name LIKE 'NATION_1%' AND c.module_name LIKE '%Supplier_00000001%'
ORDER BY source_module, source_id, site, target_function, target_module LIMIT 100
""")
def cross_module_calls_filtered(g, spark, sf_dir):
    """O13 with an anchored source and an unanchored target pattern."""
    return op.cross_module_calls(g, "NATION_1*", "Supplier_00000001")
