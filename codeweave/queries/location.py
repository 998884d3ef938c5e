"""Location, context and import-generation operators on the fixture graph."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import location as op
from ..registry import register
from ..sources.fixture import probes

_SPANS = """
, spans AS (
  SELECT 'function' AS kind, id AS element_id, name, src_file, CAST(line_start AS BIGINT) AS line_start,
    CAST(line_end AS BIGINT) AS line_end FROM cg_function
  UNION ALL SELECT 'type', id, type_name, src_file, line_start, line_end FROM cg_type
  UNION ALL SELECT 'class', id, class_name, src_file, line_start, line_end FROM cg_class
  UNION ALL SELECT 'import', i.id, i.module_name, m.path, i.line, i.line
    FROM cg_import i JOIN cg_module m ON m.id = i.module_id)
"""
_AT = _SPANS + """
, hit_at AS (SELECT probe_id, kind, element_id, name, line_start, line_end FROM (
    SELECT p.probe_id, s.*, row_number() OVER (PARTITION BY p.probe_id, s.kind
                                               ORDER BY s.line_end - s.line_start, s.element_id) AS rn
    FROM cg_probe p JOIN spans s ON s.src_file = p.src_file
      AND p.line BETWEEN s.line_start AND s.line_end) WHERE rn = 1)
"""


@register("elements_at", _AT + "SELECT * FROM hit_at")
def elements_at(g, spark, sf_dir):
    """Innermost element of each kind at every probe location."""
    return op.elements_at(g, probes(spark, sf_dir))


@register("location_context", _SPANS + """
SELECT p.probe_id, s.kind, s.element_id, s.name, s.line_start, s.line_end,
  (s.line_start <= p.line AND s.line_end >= p.line) AS encloses
FROM cg_probe p JOIN spans s ON s.src_file = p.src_file
  AND s.line_start <= p.line + 5 AND s.line_end >= p.line - 5
""")
def location_context(g, spark, sf_dir):
    """Elements within 5 lines of every probe."""
    return op.location_context(g, probes(spark, sf_dir), 5)


@register("location_dependencies", _AT + """
SELECT probe_id, function_id, callee, callee_module, site FROM (
  SELECT hit_at.probe_id, hit_at.element_id AS function_id, c.name AS callee, c.module_name AS callee_module,
    c.site, row_number() OVER (PARTITION BY hit_at.probe_id ORDER BY c.name, c.site, c.module_name) AS rn
  FROM hit_at JOIN cg_function_called c ON c.function_id = hit_at.element_id
  WHERE hit_at.kind = 'function') WHERE rn <= 5
""")
def location_dependencies(g, spark, sf_dir):
    """O38 dependencies: 5 callees of the function enclosing each probe."""
    return op.location_dependencies(g, probes(spark, sf_dir))


_TU = """
, tu AS (SELECT f.id AS function_id, tn.type_name FROM (SELECT DISTINCT type_name FROM cg_type) tn
         JOIN cg_function f ON position(tn.type_name IN f.function_signature) > 0)
"""
_ITEMS = _TU + """
, sites AS (SELECT c.function_id,
      CASE WHEN cf.module_id = f.module_id THEN 'local_function' ELSE 'external_function' END AS kind,
      c.name, c.module_name
    FROM cg_function_called c JOIN cg_function f ON f.id = c.function_id
    LEFT JOIN cg_function cf ON cf.id = c.callee_id),
  loc AS (SELECT DISTINCT tu.function_id, 'local_type' AS kind, tu.type_name AS name,
      m.name AS module_name
    FROM tu JOIN cg_function f ON f.id = tu.function_id
    JOIN cg_type t ON t.type_name = tu.type_name AND t.module_id = f.module_id
    LEFT JOIN cg_module m ON m.id = t.module_id),
  ext AS (SELECT tu.function_id, 'external_type' AS kind, tu.type_name AS name, m.name AS module_name
    FROM tu JOIN cg_type t ON t.type_name = tu.type_name LEFT JOIN cg_module m ON m.id = t.module_id
    WHERE NOT EXISTS (SELECT 1 FROM loc WHERE loc.function_id = tu.function_id
                      AND loc.name = tu.type_name)),
  items AS (SELECT * FROM sites UNION SELECT * FROM loc UNION SELECT * FROM ext)
"""


@register("function_context_items", _ITEMS + "SELECT function_id, kind, name, module_name FROM items")
def function_context_items(g, spark, sf_dir):
    """O16 items for every function."""
    return op.function_context_items(g)


@register("function_context", _ITEMS + """
, cnt AS (SELECT function_id,
    count(*) FILTER (WHERE kind = 'local_function') AS a,
    count(*) FILTER (WHERE kind = 'external_function') AS b,
    count(*) FILTER (WHERE kind = 'local_type') AS c,
    count(*) FILTER (WHERE kind = 'external_type') AS d FROM items GROUP BY function_id)
SELECT f.id AS function_id, f.name, f.module_name, f.function_signature, f.src_file, f.line_start,
  f.line_end, CAST(length(b.raw_string) AS BIGINT) AS code_length,
  CAST(coalesce(cnt.a, 0) AS BIGINT) AS n_local_functions,
  CAST(coalesce(cnt.b, 0) AS BIGINT) AS n_external_functions,
  CAST(coalesce(cnt.c, 0) AS BIGINT) AS n_local_types,
  CAST(coalesce(cnt.d, 0) AS BIGINT) AS n_external_types
FROM cg_function f LEFT JOIN cg_function_body b ON b.id = f.id
LEFT JOIN cnt ON cnt.function_id = f.id
""")
def function_context(g, spark, sf_dir):
    """O16 summary row for every function."""
    return op.function_context(g)


_NEED = _TU + """
, fn AS (SELECT f.id AS function_id, f.module_id, m.name AS module
         FROM cg_function f JOIN cg_module m ON m.id = f.module_id),
  imp AS ({imports}),
  ie AS (SELECT id, module_id, module_name, is_hiding,
           regexp_extract_all(coalesce(hiding_specs, ''), '[A-Za-z_][A-Za-z0-9_.'']*') AS specs FROM imp),
  uf AS (SELECT fn.module_id, fn.module, c.module_name AS imported_module, c.name AS element,
           'function' AS element_type
         FROM cg_function_called c JOIN fn ON fn.function_id = c.function_id),
  ut AS (SELECT fn.module_id, fn.module, tu.type_name AS element FROM tu
         JOIN fn ON fn.function_id = tu.function_id),
  uc AS (SELECT i.module_id, m.name AS module, c.class_name AS element FROM cg_instance i
         JOIN cg_module m ON m.id = i.module_id
         JOIN (SELECT DISTINCT class_name FROM cg_class) c ON list_contains(
           regexp_extract_all(i.instance_definition, '[A-Za-z0-9_]+'), c.class_name)),
  defs AS (SELECT 'type' AS element_type, type_name AS element, module_id FROM cg_type
           UNION ALL SELECT 'class', class_name, module_id FROM cg_class),
  used AS (SELECT *, 'type' AS element_type FROM ut UNION ALL SELECT *, 'class' FROM uc),
  out_there AS (SELECT x.module_id, x.module, dm.name AS imported_module, x.element, x.element_type
         FROM used x JOIN defs d ON d.element = x.element AND d.element_type = x.element_type
         JOIN cg_module dm ON dm.id = d.module_id
         WHERE NOT EXISTS (SELECT 1 FROM defs o WHERE o.element = x.element
                           AND o.element_type = x.element_type AND o.module_id = x.module_id)),
  u AS (SELECT DISTINCT * FROM (SELECT * FROM uf UNION ALL SELECT * FROM out_there)
        WHERE imported_module IS NOT NULL AND imported_module <> module),
  got AS (SELECT DISTINCT u.module_id, u.imported_module, u.element FROM u
          JOIN ie ON ie.module_id = u.module_id AND ie.module_name = u.imported_module
          WHERE len(specs) = 0 OR CASE WHEN coalesce(is_hiding, false)
            THEN NOT list_contains(specs, u.element) ELSE list_contains(specs, u.element) END),
  settled AS (SELECT DISTINCT u.module_id, u.element_type, u.element FROM u JOIN got
              USING (module_id, imported_module, element) WHERE u.element_type <> 'function'),
  need AS (SELECT * FROM u
           WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.module_id = u.module_id
               AND got.imported_module = u.imported_module AND got.element = u.element)
             AND NOT EXISTS (SELECT 1 FROM settled s WHERE s.module_id = u.module_id
               AND s.element_type = u.element_type AND s.element = u.element))
"""
_PLAIN = _NEED.format(imports="SELECT * FROM cg_import")


@register("generate_imports_explicit", _PLAIN + """
SELECT DISTINCT module, imported_module, element_type, element,
  concat('import ', imported_module, ' (', element, ')') AS statement FROM need
""")
def generate_imports_explicit(g, spark, sf_dir):
    """O39 explicit style for every module: functions, types and classes."""
    return op.generate_imports(g, style="explicit")


@register("generate_imports_qualified", _PLAIN + """
SELECT DISTINCT module, imported_module, concat('import qualified ', imported_module) AS statement
FROM need WHERE element_type = 'function'
""")
def generate_imports_qualified(g, spark, sf_dir):
    """O39 qualified style, function usage only."""
    return op.generate_imports(g, element_type="function", style="qualified")


@register("generate_imports_classes", _PLAIN + """
SELECT DISTINCT module, imported_module, concat('import ', imported_module) AS statement
FROM need WHERE element_type = 'class'
""")
def generate_imports_classes(g, spark, sf_dir):
    """O39 for the classes that instances name."""
    return op.generate_imports(g, element_type="class")


def _with_lists(g):
    """Imports that hide, or list, the first and the last function of the
    imported module."""
    ends = g.function.groupBy("module_name").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    specs = F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), F.col("lo"), F.lit(", "), F.col("hi"),
                                                  F.lit("]")))
    return replace(g, imports=g.imports.join(ends, "module_name", "left").withColumn(
        "hiding_specs", specs).select(*g.imports.columns))


@register("generate_imports_lists", _NEED.format(imports="""
SELECT i.* REPLACE (CASE WHEN i.id % 3 = 0 THEN concat('[', e.lo, ', ', e.hi, ']') END AS hiding_specs)
FROM cg_import i LEFT JOIN (SELECT module_name, min(name) AS lo, max(name) AS hi FROM cg_function
                            GROUP BY module_name) e ON e.module_name = i.module_name""") + """
SELECT module, imported_module, count(DISTINCT element) AS n_elements,
  concat('import ', imported_module, ' (', array_to_string(list_sort(list(DISTINCT element)), ', '), ')')
    AS statement
FROM need GROUP BY module, imported_module
""")
def generate_imports_lists(g, spark, sf_dir):
    """O39 with hiding and import lists: one explicit statement per module pair."""
    return op.generate_imports(_with_lists(g), style="explicit", combine=True)


@register("location_items", _AT + _ITEMS + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY function_id, kind
                                          ORDER BY name, module_name NULLS LAST) AS rn FROM items)
SELECT h.probe_id, r.function_id, r.kind, r.rn AS rank, r.name, r.module_name
FROM hit_at h JOIN ranked r ON r.function_id = h.element_id WHERE h.kind = 'function' AND rn <= 5
""")
def location_items(g, spark, sf_dir):
    """O38 lists: five items of each kind at every probe."""
    return op.location_items(g, probes(spark, sf_dir))


@register("function_context_body", _ITEMS + """
, cnt AS (SELECT function_id, count(*) FILTER (WHERE kind = 'external_function') AS b,
    count(*) FILTER (WHERE kind = 'external_type') AS d FROM items GROUP BY function_id)
SELECT f.id AS function_id, f.name, f.module_name, f.function_signature, f.src_file, f.line_start,
  f.line_end, CAST(length(b.raw_string) AS BIGINT) AS code_length,
  CAST(coalesce(cnt.b, 0) AS BIGINT) AS n_external_functions,
  CAST(coalesce(cnt.d, 0) AS BIGINT) AS n_external_types, b.raw_string AS body,
  CASE WHEN length(b.raw_string) > 200 THEN concat(substring(b.raw_string, 1, 200), '...')
    ELSE b.raw_string END AS body_preview,
  array_to_string(list_slice(string_split(b.raw_string, chr(10)), 1, 5), chr(10)) AS body_head
FROM cg_function f LEFT JOIN cg_function_body b ON b.id = f.id
LEFT JOIN cnt ON cnt.function_id = f.id
""")
def function_context_body(g, spark, sf_dir):
    """O16 with the body, its preview and first lines, without local items."""
    return op.function_context(g, include_local_definitions=False, include_body=True)
