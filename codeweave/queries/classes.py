"""Class operators on the fixture graph."""

from ..operators import classes as op
from ..registry import register


@register("list_classes", """
SELECT c.id, c.class_name, m.name AS module_name, c.src_file, c.line_start, c.line_end
FROM cg_class c LEFT JOIN cg_module m ON m.id = c.module_id
WHERE c.class_name LIKE '%NATION_1%' ORDER BY c.class_name, c.id LIMIT 100
""")
def list_classes(g, spark, sf_dir):
    """O25 with a name pattern."""
    return op.list_classes(g, pattern="NATION_1")


@register("search_classes", """
SELECT c.id, c.class_name, m.name AS module_name
FROM cg_class c LEFT JOIN cg_module m ON m.id = c.module_id
WHERE c.class_name LIKE 'NATION_2%' AND m.name LIKE '%Supplier%'
ORDER BY c.class_name, c.id LIMIT 50
""")
def search_classes(g, spark, sf_dir):
    """Anchored name pattern, module pattern."""
    return op.search_classes(g, "NATION_2*", module_pattern="Supplier")


@register("class_instances", """
SELECT c.class_name, i.id AS instance_id, i.instance_definition, i.instance_signature,
  i.module_id AS instance_module_id, i.src_loc AS instance_location
FROM (SELECT DISTINCT class_name FROM cg_class) c
JOIN cg_instance i ON position(c.class_name IN i.instance_definition) > 0
""")
def class_instances(g, spark, sf_dir):
    """Every (class, instance) pair by definition containment."""
    return op.class_instances(g)


@register("class_details", """
, ci AS (SELECT class_name, instance_id, instance, instance_module, instance_signature,
    instance_location FROM (
    SELECT c.class_name, i.id AS instance_id,
      CASE WHEN length(i.instance_definition) > 100
        THEN concat(substring(i.instance_definition, 1, 100), '...')
        ELSE i.instance_definition END AS instance,
      im.name AS instance_module, i.instance_signature, i.src_loc AS instance_location,
      row_number() OVER (PARTITION BY c.class_name ORDER BY i.id) AS rn
    FROM (SELECT DISTINCT class_name FROM cg_class) c
    JOIN cg_instance i ON position(c.class_name IN i.instance_definition) > 0
    LEFT JOIN cg_module im ON im.id = i.module_id) WHERE rn <= 10)
SELECT c.id AS class_id, c.class_name, m.name AS module_name,
  CASE WHEN length(c.class_definition) > 300
    THEN concat(substring(c.class_definition, 1, 300), '...') ELSE c.class_definition END
    AS definition,
  ci.instance_id, ci.instance, ci.instance_module, ci.instance_signature, ci.instance_location
FROM cg_class c LEFT JOIN cg_module m ON m.id = c.module_id
LEFT JOIN ci ON ci.class_name = c.class_name
""")
def class_details(g, spark, sf_dir):
    """O26 for every class, up to 10 instances each."""
    return op.class_details(g)


@register("class_instances_identifier", """
SELECT c.class_name, i.id AS instance_id, i.instance_definition, i.instance_signature,
  i.module_id AS instance_module_id, i.src_loc AS instance_location
FROM (SELECT DISTINCT class_name FROM cg_class) c JOIN cg_instance i
  ON list_contains(regexp_extract_all(i.instance_definition, '[A-Za-z0-9_]+'), c.class_name)
""")
def class_instances_identifier(g, spark, sf_dir):
    """J9 with whole identifiers: the instances of every class."""
    return op.class_instances(g, match="identifier")
