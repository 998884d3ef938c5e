"""Query-surface operators on the fixture graph."""

from ..operators import sqlapi as op
from ..registry import register


@register("custom_sql_named", """
SELECT module_name, count(*) AS n_functions, count(function_signature) AS n_with_signature
FROM cg_function WHERE module_name LIKE 'NATION_1%' GROUP BY module_name
""")
def custom_sql_named(g, spark, sf_dir):
    """O40 with a named parameter bound by Spark."""
    return op.custom_sql(g, """
        SELECT module_name, count(*) AS n_functions, count(function_signature) AS n_with_signature
        FROM cg_function WHERE module_name LIKE :pat GROUP BY module_name""",
                         {"pat": "NATION_1%"})


@register("custom_sql_positional", """
SELECT t.type_of_type AS category, count(*) AS n, count(DISTINCT t.type_name) AS n_names
FROM cg_type t JOIN cg_module m ON m.id = t.module_id
WHERE m.name LIKE '%Supplier_00000001%' GROUP BY t.type_of_type
""")
def custom_sql_positional(g, spark, sf_dir):
    """O40 with a positional parameter and a join between views."""
    return op.custom_sql(g, """
        SELECT t.type_of_type AS category, count(*) AS n, count(DISTINCT t.type_name) AS n_names
        FROM cg_type t JOIN cg_module m ON m.id = t.module_id
        WHERE m.name LIKE ? GROUP BY t.type_of_type""", ["%Supplier_00000001%"])


@register("basic_query_functions", """
SELECT id, name, module_id, module_name FROM cg_function WHERE name LIKE 'hot%'
ORDER BY name, id LIMIT 100
""")
def basic_query_functions(g, spark, sf_dir):
    """O41 functions by pattern, first 100 by name."""
    return op.basic_query(g, "functions", "hot*")


@register("basic_query_count", """
SELECT 'imports' AS query_type, count(*) AS total FROM cg_import
WHERE module_name LIKE '%Supplier_0000000_%' AND module_id = 7
""")
def basic_query_count(g, spark, sf_dir):
    """O41 total for imports by pattern and module id."""
    return op.basic_query_count(g, "imports", "Supplier_0000000_", module_id=7)


@register("entity_query_join", """
SELECT f.*, m.id AS module__id, m.name AS module__name, m.path AS module__path
FROM cg_function f LEFT JOIN cg_module m ON m.id = f.module_id
WHERE f.name LIKE '%plate' AND f.type_enum <> 'SMALL' AND m.path LIKE 'src/NATION_1%'
""")
def entity_query_join(g, spark, sf_dir):
    """Functions with a joined module, three conditions, no limit."""
    df = op.entity_query(g, {
        "type": "function", "joins": [{"entity": "module"}], "limit": None,
        "conditions": [{"field": "name", "operator": "like", "value": "*plate"},
                       {"field": "type_enum", "operator": "ne", "value": "SMALL"},
                       {"field": "module.path", "operator": "startswith", "value": "src/NATION_1"}]})
    return df.toDF(*[c.replace(".", "__") for c in df.columns])


@register("entity_query_import", """
SELECT * FROM cg_import
WHERE package_name IN ('pkg-1-urgent', 'Test-2-high') AND line BETWEEN 5 AND 10
  AND as_module_name IS NULL
ORDER BY id LIMIT 100
""")
def entity_query_import(g, spark, sf_dir):
    """In / between / eq-None conditions, default limit."""
    return op.entity_query(g, {
        "type": "import",
        "conditions": [{"field": "package_name", "operator": "in",
                        "value": ["pkg-1-urgent", "Test-2-high"]},
                       {"field": "line", "operator": "between", "value": [5, 10]},
                       {"field": "as_module_name", "operator": "eq", "value": None}]})


@register("entity_query_call_sites", """
SELECT f.* FROM cg_function f WHERE f.line_start > 40 AND f.line_end <= 400
  AND EXISTS (SELECT 1 FROM cg_function_called c WHERE c.function_id = f.id AND c.site >= 6
              AND c.module_name IS NULL)
""")
def entity_query_call_sites(g, spark, sf_dir):
    """Functions with an unresolved late call site; gt, le, ge, is_null."""
    return op.entity_query(g, {
        "type": "function", "joins": [{"entity": "function_called"}], "limit": None,
        "conditions": [{"field": "line_start", "operator": "gt", "value": 40},
                       {"field": "line_end", "operator": "le", "value": 400},
                       {"field": "function_called.site", "operator": "ge", "value": 6},
                       {"field": "function_called.module_name", "operator": "is_null"}]})


@register("entity_query_fields", """
SELECT t.* FROM cg_type t WHERE lower(t.type_name) LIKE '%build%' AND EXISTS (
  SELECT 1 FROM cg_constructor c JOIN cg_field f ON f.constructor_id = c.id
  WHERE c.type_id = t.id AND f.field_name IN ('f5', 'f6') AND position('_1' IN f.field_type_raw) > 0)
""")
def entity_query_fields(g, spark, sf_dir):
    """Types by a condition two joins down; ilike, in, contains."""
    return op.entity_query(g, {
        "type": "type", "joins": ["field"], "limit": None,
        "conditions": [{"field": "type_name", "operator": "ilike", "value": "*BUILD*"},
                       {"field": "field.field_name", "operator": "in", "value": ["f5", "f6"]},
                       {"field": "field.field_type_raw", "operator": "contains", "value": "_1"}]})


@register("entity_query_siblings", """
SELECT i.* FROM cg_instance i WHERE EXISTS (
  SELECT 1 FROM cg_module m JOIN cg_function f ON f.module_id = m.id
  WHERE m.id = i.module_id AND f.line_end < 60 AND f.type_enum NOT IN ('SMALL', 'LARGE')
    AND f.name LIKE '%e')
""")
def entity_query_siblings(g, spark, sf_dir):
    """Instances whose module holds a matching function (up to a parent
    and down again); lt, not_in, endswith."""
    return op.entity_query(g, {
        "type": "instance", "joins": [{"entity": "function"}], "limit": None,
        "conditions": [{"field": "function.line_end", "operator": "lt", "value": 60},
                       {"field": "function.type_enum", "operator": "not_in",
                        "value": ["SMALL", "LARGE"]},
                       {"field": "function.name", "operator": "endswith", "value": "e"}]})


@register("entity_query_on", """
SELECT m.* FROM cg_module m WHERE EXISTS (
  SELECT 1 FROM cg_import i WHERE i.module_name = m.name AND i.is_hiding AND i.line BETWEEN 3 AND 9)
""")
def entity_query_on(g, spark, sf_dir):
    """Modules that an import names, joined on the columns given."""
    return op.entity_query(g, {
        "type": "module", "joins": [{"entity": "import", "on": ["name", "module_name"]}],
        "limit": None,
        "conditions": [{"field": "import.is_hiding", "operator": "eq", "value": True},
                       {"field": "import.line", "operator": "between", "value": [3, 9]}]})
