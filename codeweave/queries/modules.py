"""Module / corpus operators on the fixture graph."""

from pyspark.sql import functions as F

from ..operators import modules as op
from ..registry import register


@register("list_modules", """
SELECT id, name, path FROM cg_module ORDER BY name, id LIMIT 100
""")
def list_modules(g, spark, sf_dir):
    """O01 with the default limit of 100."""
    return op.list_modules(g)


@register("search_modules", """
SELECT id, name, path FROM cg_module WHERE name LIKE '%5.Supplier_0000000%'
ORDER BY name, id LIMIT 50
""")
def search_modules(g, spark, sf_dir):
    """Unanchored pattern (wrapped in %...%), ``_`` stays a wildcard."""
    return op.search_modules(g, "5.Supplier_0000000")


@register("search_modules_anchored", """
SELECT id, name, path FROM cg_module WHERE name LIKE 'NATION_1%.Supplier%'
ORDER BY name, id LIMIT 50
""")
def search_modules_anchored(g, spark, sf_dir):
    """O04 with ``*`` wildcards: the pattern is used anchored as given."""
    return op.search_modules(g, "NATION_1*.Supplier*")


@register("module_details", """
SELECT m.id, m.name, m.path,
  CAST(coalesce(f.n, 0) AS BIGINT) AS n_functions,
  CAST(coalesce(i.n, 0) AS BIGINT) AS n_imports,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_types,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_classes,
  coalesce(s.names, '') AS sample_functions
FROM cg_module m
LEFT JOIN (SELECT module_id, count(*) AS n FROM cg_function GROUP BY module_id) f ON f.module_id = m.id
LEFT JOIN (SELECT module_id, count(*) AS n FROM cg_import GROUP BY module_id) i ON i.module_id = m.id
LEFT JOIN (SELECT module_id, count(*) AS n FROM cg_type GROUP BY module_id) t ON t.module_id = m.id
LEFT JOIN (SELECT module_id, count(*) AS n FROM cg_class GROUP BY module_id) c ON c.module_id = m.id
LEFT JOIN (SELECT module_id, string_agg(name, '|' ORDER BY name, id) AS names
           FROM (SELECT module_id, name, id,
                   row_number() OVER (PARTITION BY module_id ORDER BY name, id) AS rn
                 FROM cg_function) WHERE rn <= 10 GROUP BY module_id) s ON s.module_id = m.id
""")
def module_details(g, spark, sf_dir):
    """O02 for every module; the sample list is joined with '|'."""
    return op.module_details(g).withColumn(
        "sample_functions", F.array_join("sample_functions", "|"))


@register("functions_by_module", """
SELECT module_id, module, id, name, function_signature FROM (
  SELECT m.id AS module_id, m.name AS module, f.id, f.name, f.function_signature,
    row_number() OVER (PARTITION BY m.id ORDER BY f.name, f.id) AS rn
  FROM cg_module m JOIN cg_function f ON f.module_id = m.id) WHERE rn <= 100
""")
def functions_by_module(g, spark, sf_dir):
    """O03 over all modules, 100 per module."""
    return op.functions_by_module(g)


@register("module_dependencies", """
SELECT m.name AS module, 'imports' AS direction, i.module_name AS other, i.id AS import_id,
  i.package_name, i.qualified_style, i.as_module_name
FROM cg_module m JOIN cg_import i ON i.module_id = m.id
UNION ALL
SELECT i.module_name AS module, 'imported_by' AS direction, im.name AS other, i.id AS import_id,
  i.package_name, i.qualified_style, i.as_module_name
FROM cg_import i JOIN cg_module im ON i.module_id = im.id
WHERE i.module_name IN (SELECT name FROM cg_module)
""")
def module_dependencies(g, spark, sf_dir):
    """O05 for every module, both directions."""
    return op.module_dependencies(g, include_imports=True, include_dependents=True)


@register("code_statistics", """
, fs AS (SELECT count(*) AS nf,
           count(*) FILTER (WHERE function_signature IS NOT NULL AND function_signature <> '') AS ns
         FROM cg_function),
  nm AS (SELECT count(*) AS nm FROM cg_module)
SELECT 'modules' AS metric, CAST(count(*) AS DOUBLE) AS value FROM cg_module
UNION ALL SELECT 'functions', count(*) FROM cg_function
UNION ALL SELECT 'types', count(*) FROM cg_type
UNION ALL SELECT 'classes', count(*) FROM cg_class
UNION ALL SELECT 'imports', count(*) FROM cg_import
UNION ALL SELECT 'instances', count(*) FROM cg_instance
UNION ALL SELECT 'function_calls', count(*) FROM cg_function_called
UNION ALL SELECT 'functions_with_signature', ns FROM fs
UNION ALL SELECT 'signature_percent', CASE WHEN nf > 0 THEN round(ns * 100.0 / nf, 1) END FROM fs
UNION ALL SELECT 'avg_functions_per_module',
  (SELECT CASE WHEN nm > 0 THEN round(nf / nm, 1) END FROM nm) FROM fs
UNION ALL SELECT metric, value FROM (
  SELECT concat('top_module:', m.name) AS metric, CAST(count(f.id) AS DOUBLE) AS value
  FROM cg_module m LEFT JOIN cg_function f ON f.module_id = m.id
  GROUP BY m.id, m.name ORDER BY count(f.id) DESC, m.name, m.id LIMIT 10)
""")
def code_statistics(g, spark, sf_dir):
    """O06 with details."""
    return op.code_statistics(g, include_details=True)
