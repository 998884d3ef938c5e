"""Class (type class) operators: listing, search, details with instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import like, preview
from ..plans.keys import Keys, key_frame, restrict
from ..plans.substring import name_pairs
from ..sources.tables import CodeGraph
from ..functions import constants as C
from .functions import _per_group_limit, _top


def _classes(g: CodeGraph) -> DataFrame:
    m = g.module.select(F.col("id").alias("module_id"), F.col("name").alias("module_name"))
    return g.classes.join(m, "module_id", "left")


def list_classes(g: CodeGraph, module: str | None = None, pattern: str | None = None,
                 limit: int | None = C.LIMIT_LISTING) -> DataFrame:
    """Exact module name AND class-name pattern."""
    c = _classes(g)
    if module:
        c = c.filter(F.col("module_name") == module)
    if pattern:
        c = c.filter(like("class_name", pattern))
    out = c.select("id", "class_name", "module_name", "src_file", "line_start", "line_end")
    return _top(out, limit, "class_name", "id")


def search_classes(g: CodeGraph, pattern: str, module_pattern: str | None = None,
                   limit: int | None = C.LIMIT_SEARCH) -> DataFrame:
    """Class-name pattern and optional module-name pattern."""
    c = _classes(g).filter(like("class_name", pattern))
    if module_pattern:
        c = c.filter(like("module_name", module_pattern))
    return _top(c.select("id", "class_name", "module_name"), limit, "class_name", "id")


def class_instances(g: CodeGraph, keys: Keys = None, match: str = "substring") -> DataFrame:
    """Instances whose definition text contains the class name (J9 with
    the reference's substring semantics, names taken literally), or with
    ``match='identifier'`` as a whole identifier."""
    kf = key_frame(g.spark, keys, ["class_name"])
    names = restrict(g.classes.select("class_name"), kf, ["class_name"])
    inst = g.instance.select(F.col("id").alias("instance_id"), "instance_definition",
                             "instance_signature", F.col("module_id").alias("instance_module_id"),
                             F.col("src_loc").alias("instance_location"))
    pairs = name_pairs(names, inst, "class_name", "instance_definition", match).select(
        F.col("name").alias("class_name"), F.col("text").alias("instance_definition"))
    return (pairs.join(inst, "instance_definition")
            .select("class_name", "instance_id", "instance_definition",
                    "instance_signature", "instance_module_id", "instance_location"))


def class_details(g: CodeGraph, keys: Keys = None, include_instances: bool = True,
                  max_instances: int | None = C.SAMPLE_INSTANCES_PER_CLASS) -> DataFrame:
    """The class with its definition preview (300) and up to
    ``max_instances`` instances (by id) with previews (100), module and
    location. One row per (class, instance); a class without instances keeps one row."""
    kf = key_frame(g.spark, keys, ["class_name", "module_name"])
    c = restrict(_classes(g), kf, ["class_name", "module_name"]).select(
        F.col("id").alias("class_id"), "class_name", "module_name",
        preview("class_definition", C.CLASS_DEFINITION_PREVIEW).alias("definition"))
    if not include_instances:
        return c
    inst = _per_group_limit(class_instances(g, kf), ["class_name"], max_instances, "instance_id")
    m = g.module.select(F.col("id").alias("instance_module_id"),
                        F.col("name").alias("instance_module"))
    inst = inst.join(m, "instance_module_id", "left").select(
        "class_name", "instance_id", preview("instance_definition", C.INSTANCE_PREVIEW).alias("instance"),
        "instance_module", "instance_signature", "instance_location")
    return c.join(inst, "class_name", "left")
