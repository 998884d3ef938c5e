"""Import operators on the fixture graph."""

from ..operators import imports as op
from ..registry import register

_COLS = ("i.id AS import_id, i.module_name, i.package_name, i.qualified_style, i.as_module_name, "
         "i.is_hiding, i.hiding_specs, i.line")


@register("analyze_imports", f"""
, sel AS (SELECT i.*, m.name AS module FROM cg_import i JOIN cg_module m ON m.id = i.module_id
          WHERE i.module_name LIKE '%NATION_2%' AND NOT coalesce(i.qualified_style, false)),
  cnt AS (SELECT module_id, module, count(*) AS n_imports FROM sel GROUP BY module_id, module
          ORDER BY module, module_id LIMIT 100)
SELECT i.module_id, i.module, cnt.n_imports, {_COLS}
FROM sel i JOIN cnt ON cnt.module_id = i.module_id AND cnt.module = i.module
""")
def analyze_imports(g, spark, sf_dir):
    """Pattern filter, qualified imports excluded, first 100 modules."""
    return op.analyze_imports(g, import_pattern="NATION_2", include_qualified=False)


@register("import_graph", """
, e AS (SELECT DISTINCT m.name AS src, i.module_name AS dst
        FROM cg_import i JOIN cg_module m ON m.id = i.module_id
        WHERE i.package_name IS NULL OR i.package_name = ''),
  w(root, node, depth) AS (
    SELECT name, name, 0 FROM cg_module
    UNION SELECT w.root, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 2)
SELECT root, node AS module, CAST(min(depth) AS BIGINT) AS depth FROM w WHERE node <> root
GROUP BY root, node
""", recursive=True)
def import_graph(g, spark, sf_dir):
    """O29 rooted at every module, internal imports, depth 2."""
    return op.import_graph(g, g.module.select("name"), depth=2)


@register("import_popularity", """
SELECT module_name, count(*) AS import_count FROM cg_import
WHERE package_name IS NULL OR package_name = ''
GROUP BY module_name ORDER BY import_count DESC, module_name ASC NULLS LAST LIMIT 20
""")
def import_popularity(g, spark, sf_dir):
    """O29 unrooted: top 20 internal imports over all rows."""
    return op.import_popularity(g)


@register("suspicious_imports", f"""
SELECT module_id, module, import_id, module_name, package_name, qualified_style, as_module_name,
  is_hiding, hiding_specs, line, array_to_string(reasons, ',') AS reasons FROM (
  SELECT i.module_id, m.name AS module, {_COLS},
    list_filter([CASE WHEN coalesce(i.qualified_style, false) AND coalesce(i.as_module_name, '') <> ''
                   THEN 'qualified_and_aliased' END,
                 CASE WHEN coalesce(i.is_hiding, false) AND coalesce(i.hiding_specs, '') <> ''
                   THEN 'hiding_with_specs' END,
                 CASE WHEN coalesce(i.package_name, '') <> ''
                   AND position('test' IN lower(i.package_name)) = 0
                   THEN 'external_package' END], lambda x: x IS NOT NULL) AS reasons
  FROM cg_import i JOIN cg_module m ON m.id = i.module_id)
WHERE len(reasons) > 0
""")
def suspicious_imports(g, spark, sf_dir):
    """O30 over all imports (no limit); reasons joined with ','."""
    from pyspark.sql import functions as F
    return op.suspicious_imports(g, limit=None).withColumn(
        "reasons", F.array_join("reasons", ","))


@register("import_details", f"""
SELECT i.module_id, m.name AS module, b.bucket, {_COLS}
FROM cg_import i JOIN cg_module m ON m.id = i.module_id,
  unnest(list_filter([CASE WHEN coalesce(i.package_name, '') <> '' THEN 'external'
                        ELSE 'internal' END,
                      CASE WHEN coalesce(i.qualified_style, false) THEN 'qualified' END,
                      CASE WHEN coalesce(i.is_hiding, false) THEN 'hiding' END],
                     lambda x: x IS NOT NULL)) AS b(bucket)
""")
def import_details(g, spark, sf_dir):
    """O31 for every module: one row per (import, bucket)."""
    return op.import_details(g)


@register("import_details_source", f"""
SELECT i.module_id, m.name AS module, b.bucket, {_COLS},
  CASE WHEN coalesce(i.src_loc, '') <> '' THEN i.src_loc
    ELSE concat(m.path, ':', i.line) END AS source
FROM cg_import i JOIN cg_module m ON m.id = i.module_id,
  unnest(list_filter([CASE WHEN coalesce(i.package_name, '') <> '' THEN 'external'
                        ELSE 'internal' END,
                      CASE WHEN coalesce(i.qualified_style, false) THEN 'qualified' END,
                      CASE WHEN coalesce(i.is_hiding, false) THEN 'hiding' END],
                     lambda x: x IS NOT NULL)) AS b(bucket)
""")
def import_details_source(g, spark, sf_dir):
    """O31 for every module, with where each import stands."""
    return op.import_details(g, include_source_info=True)


@register("import_bucket_counts", """
SELECT i.module_id, m.name AS module, b.bucket, count(*) AS n_imports
FROM cg_import i JOIN cg_module m ON m.id = i.module_id,
  unnest(list_filter([CASE WHEN coalesce(i.package_name, '') <> '' THEN 'external'
                        ELSE 'internal' END,
                      CASE WHEN coalesce(i.qualified_style, false) THEN 'qualified' END,
                      CASE WHEN coalesce(i.is_hiding, false) THEN 'hiding' END],
                     lambda x: x IS NOT NULL)) AS b(bucket)
GROUP BY i.module_id, m.name, b.bucket
""")
def import_bucket_counts(g, spark, sf_dir):
    """Bucket sizes per module."""
    return op.import_bucket_counts(g)


@register("suspicious_imports_usage", f"""
, used AS (SELECT DISTINCT f.module_id, c.module_name
           FROM cg_function_called c JOIN cg_function f ON f.id = c.function_id)
SELECT module_id, module, import_id, module_name, package_name, qualified_style, as_module_name,
  is_hiding, hiding_specs, line, array_to_string(reasons, ',') AS reasons,
  NOT EXISTS (SELECT 1 FROM used u WHERE u.module_id = s.module_id
              AND u.module_name = s.module_name) AS truly_unused
FROM (
  SELECT i.module_id, m.name AS module, {_COLS},
    list_filter([CASE WHEN coalesce(i.qualified_style, false) AND coalesce(i.as_module_name, '') <> ''
                   THEN 'qualified_and_aliased' END,
                 CASE WHEN coalesce(i.is_hiding, false) AND coalesce(i.hiding_specs, '') <> ''
                   THEN 'hiding_with_specs' END,
                 CASE WHEN coalesce(i.package_name, '') <> ''
                   AND position('test' IN lower(i.package_name)) = 0
                   THEN 'external_package' END], lambda x: x IS NOT NULL) AS reasons
  FROM cg_import i JOIN cg_module m ON m.id = i.module_id) s
WHERE len(reasons) > 0
""")
def suspicious_imports_usage(g, spark, sf_dir):
    """O30 with the usage check: flagged imports whose module is never
    named by a call site of the importing module."""
    from pyspark.sql import functions as F
    return op.suspicious_imports(g, limit=None, check_usage=True).withColumn(
        "reasons", F.array_join("reasons", ","))
