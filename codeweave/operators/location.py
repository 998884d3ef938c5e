"""Source-location operators (O37, O38), function context (O16) and
import generation (O39)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import first_lines, preview
from ..plans.interval import point_in_span, window_overlaps
from ..functions import constants as C
from ..plans.keys import Keys, key_frame, restrict
from ..plans.substring import token_pairs
from ..sources.tables import CodeGraph
from .types import type_usage_sites

SPEC_NAME = r"[A-Za-z_][A-Za-z0-9_.']*"      # a name in a hiding or import list
KINDS = ("function", "type", "class", "import")
LIST_SLOTS = 16         # tasks, at least, that share the list of one type


def spans(g: CodeGraph, kinds=KINDS) -> DataFrame:
    """(kind, element_id, name, src_file, line_start, line_end) of every
    located element; an import spans its one line in the importing file."""
    parts = []
    cols = ["src_file", F.col("line_start").cast("long").alias("line_start"),
            F.col("line_end").cast("long").alias("line_end")]
    if "function" in kinds:
        parts.append(g.function.select(F.lit("function").alias("kind"),
                                       F.col("id").alias("element_id"), "name", *cols))
    if "type" in kinds:
        parts.append(g.types.select(F.lit("type").alias("kind"), F.col("id").alias("element_id"),
                                    F.col("type_name").alias("name"), *cols))
    if "class" in kinds:
        parts.append(g.classes.select(F.lit("class").alias("kind"),
                                      F.col("id").alias("element_id"),
                                      F.col("class_name").alias("name"), *cols))
    if "import" in kinds:
        m = g.module.select(F.col("id").alias("module_id"), F.col("path").alias("src_file"))
        parts.append(g.imports.join(m, "module_id").select(
            F.lit("import").alias("kind"), F.col("id").alias("element_id"),
            F.col("module_name").alias("name"), "src_file",
            F.col("line").cast("long").alias("line_start"),
            F.col("line").cast("long").alias("line_end")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _probes(probes: DataFrame, base_directory: str) -> DataFrame:
    p = probes.select("probe_id", "src_file", F.col("line").cast("long").alias("line"))
    if base_directory:
        base = base_directory.rstrip("/") + "/"
        p = p.withColumn("src_file", F.when(F.col("src_file").startswith(base),
                                            F.substring(F.col("src_file"), len(base) + 1, 1 << 30))
                         .otherwise(F.col("src_file")))
    return p


def elements_at(g: CodeGraph, probes: DataFrame, base_directory: str = "",
                element_types=("all",)) -> DataFrame:
    """For each probe ``(probe_id, src_file, line)`` and element kind,
    the innermost element whose span holds the line (shortest span, then
    smallest id)."""
    kinds = KINDS if "all" in element_types else tuple(element_types)
    hits = point_in_span(_probes(probes, base_directory), spans(g, kinds))
    w = Window.partitionBy("probe_id", "kind").orderBy(
        F.col("line_end") - F.col("line_start"), "element_id")
    return (hits.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1)
            .select("probe_id", "kind", "element_id", "name", "line_start", "line_end"))


def location_context(g: CodeGraph, probes: DataFrame, context_radius: int = 5,
                     base_directory: str = "") -> DataFrame:
    """Every element overlapping ``[line - r, line + r]`` of a probe,
    flagged ``encloses`` when its span holds the line itself."""
    p = _probes(probes, base_directory)
    hits = window_overlaps(p, spans(g), context_radius)
    return hits.select("probe_id", "kind", "element_id", "name", "line_start", "line_end",
                       ((F.col("line_start") <= F.col("line"))
                        & (F.col("line_end") >= F.col("line"))).alias("encloses"))


def location_dependencies(g: CodeGraph, probes: DataFrame,
                          limit: int = C.LOCATION_DEPENDENCIES,
                          base_directory: str = "") -> DataFrame:
    """O38 dependencies: the first ``limit`` callees (by name, site) of the
    innermost function enclosing each probe."""
    at = elements_at(g, probes, base_directory, ["function"]).select(
        "probe_id", F.col("element_id").alias("function_id"))
    calls = g.function_called.select("function_id", F.col("name").alias("callee"),
                                     F.col("module_name").alias("callee_module"), "site")
    # A probe has one enclosing function: its callees are cut per function,
    # so many probes in a function with many call sites never multiply.
    w = Window.partitionBy("function_id").orderBy("callee", "site", "callee_module")
    first = (calls.withColumn("__rn", F.row_number().over(w))
             .filter(F.col("__rn") <= limit).drop("__rn"))
    return at.join(first, "function_id")


def location_items(g: CodeGraph, probes: DataFrame, limit: int = C.LOCATION_DEPENDENCIES,
                   base_directory: str = "") -> DataFrame:
    """O38 lists: the first ``limit`` items of each kind (local and external
    functions and types, by name and module) of the innermost function at
    each probe. Items are cut per function before they meet the probes."""
    at = elements_at(g, probes, base_directory, ["function"]).select(
        "probe_id", F.col("element_id").alias("function_id"))
    by_module = F.asc_nulls_last("module_name")
    w = Window.partitionBy("function_id", "kind").orderBy("name", by_module)
    # Of the modules that define a type no more than ``limit`` can be listed:
    # they are cut per type before the types meet the functions.
    first_modules = Window.partitionBy("type_name").orderBy(by_module)
    parts = _item_parts(g)
    modules = (parts.modules.withColumn("__rn", F.row_number().over(first_modules))
               .filter(F.col("__rn") <= limit).drop("__rn"))
    first = (_listed(parts, modules).withColumn("rank", F.row_number().over(w))
             .filter(F.col("rank") <= limit))
    return at.join(first, "function_id").select(
        "probe_id", "function_id", "kind", F.col("rank").cast("bigint").alias("rank"), "name",
        "module_name")


@dataclass
class _ItemParts:
    """The items of ``function_context_items``, external types not listed yet."""
    sites: DataFrame      # distinct (function_id, name, module_name, kind)
    local: DataFrame      # distinct (function_id, name, module_name, kind)
    elsewhere: DataFrame  # distinct (function_id, type_name) of external types
    modules: DataFrame    # distinct (type_name, module_name): who defines a type


def _item_parts(g: CodeGraph, keys: Keys = None) -> _ItemParts:
    kf = key_frame(g.spark, keys, ["name", "module_name"])
    f = restrict(g.function, kf, ["name", "module_name"]).select(
        F.col("id").alias("function_id"), F.col("module_id").alias("caller_module_id"))
    callee = g.function.select(F.col("id").alias("callee_id"),
                               F.col("module_id").alias("callee_module_id"))
    called = g.function_called.select("function_id", "callee_id", "name", "module_name")
    if kf is not None:
        called = called.join(f.select("function_id"), "function_id", "left_semi")
    # The callers come last, so that the rows lie by function when they are made distinct.
    sites = (called.join(callee, "callee_id", "left").join(f, "function_id")
             .select("function_id", "name", "module_name",
                     F.when(F.col("callee_module_id") == F.col("caller_module_id"),
                            F.lit("local_function")).otherwise(F.lit("external_function"))
                     .alias("kind"))).distinct()
    subset = None if kf is None else f.select(F.col("function_id").alias("id"))
    used = (type_usage_sites(g, functions=subset)
            .select("function_id", "type_name").join(f, "function_id"))
    defs = g.types.select("type_name", F.col("module_id").alias("def_module_id"))
    m = g.module.select(F.col("id").alias("def_module_id"), F.col("name").alias("module_name"))
    local = (used.join(defs, "type_name")
             .filter(F.col("def_module_id") == F.col("caller_module_id"))
             .join(m, "def_module_id", "left")
             .select("function_id", F.col("type_name").alias("name"), "module_name",
                     F.lit("local_type").alias("kind")).distinct())
    elsewhere = used.select("function_id", "type_name").distinct().join(
        local.select("function_id", F.col("name").alias("type_name")),
        ["function_id", "type_name"], "left_anti")
    modules = (defs.join(m, "def_module_id", "left").select("type_name", "module_name").distinct())
    return _ItemParts(sites, local, elsewhere, modules)


def _listed(parts: _ItemParts, modules: DataFrame) -> DataFrame:
    """The items, one row each. Distinct pairs of (function, type) meet
    distinct pairs of (type, module), so the list needs no shuffle of its own.
    The pairs are few and the list is long: a type's functions are dealt to
    ``LIST_SLOTS`` slots and a fixed number of partitions, which AQE does not
    merge by the size of what goes in."""
    width = int(modules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = F.sequence(F.lit(0), F.lit(LIST_SLOTS - 1))
    dealt = parts.elsewhere.withColumn("slot", F.pmod(
        F.xxhash64("function_id"), F.lit(LIST_SLOTS)).cast("int")).repartition(
        width, "type_name", "slot")
    external = dealt.join(modules.withColumn("slot", F.explode(slots)).repartition(
        width, "type_name", "slot"), ["type_name", "slot"]).select(
        "function_id", F.col("type_name").alias("name"), "module_name",
        F.lit("external_type").alias("kind"))
    return parts.sites.unionByName(parts.local).unionByName(external).select(
        "function_id", "kind", "name", "module_name")


def function_context_items(g: CodeGraph, keys: Keys = None) -> DataFrame:
    """O16 items, one row each ``(function_id, kind, name, module_name)``:
    ``local_function`` (a resolved callee in the caller's module),
    ``external_function`` (any other callee), ``local_type`` (a type named
    in the signature and defined in the function's module) and
    ``external_type`` (named in the signature, defined only elsewhere;
    one row per defining module)."""
    parts = _item_parts(g, keys)
    return _listed(parts, parts.modules)


def _item_counts(g: CodeGraph, keys: Keys) -> DataFrame:
    """(function_id, kind, n): how many items ``function_context_items``
    lists, external types by the number of their modules, unlisted."""
    parts = _item_parts(g, keys)
    one = F.lit(1).cast("long").alias("n")
    per_type = parts.modules.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))
    return (parts.sites.select("function_id", "kind", one)
            .unionByName(parts.local.select("function_id", "kind", one))
            .unionByName(parts.elsewhere.join(per_type, "type_name").select(
                "function_id", F.lit("external_type").alias("kind"), "n")))


def function_context(g: CodeGraph, keys: Keys = None, include_local_definitions: bool = True,
                     include_external_references: bool = True, include_body: bool = False
                     ) -> DataFrame:
    """O16 summary, one row per function: signature, span, body length
    and the number of items of each kind. The flags leave out the counts of
    local or external items; ``include_body`` adds the body, its first
    characters and its first lines."""
    kf = key_frame(g.spark, keys, ["name", "module_name"])
    f = restrict(g.function, kf, ["name", "module_name"])
    counts = _item_counts(g, kf).groupBy("function_id").pivot(
        "kind", ["local_function", "external_function", "local_type", "external_type"]
    ).agg(F.sum("n"))
    texts = [F.col("raw_string").alias("body"),
             preview("raw_string", C.BODY_PREVIEW).alias("body_preview"),
             first_lines("raw_string", C.BODY_LINES).alias("body_head")] if include_body else []
    body = g.function_body.select(F.col("id").alias("function_id"),
                                  F.length("raw_string").cast("bigint").alias("code_length"), *texts)
    kinds = ([k for k, on in (("local", include_local_definitions),
                              ("external", include_external_references)) if on])
    return (f.select(F.col("id").alias("function_id"), "name", "module_name",
                     "function_signature", "src_file", "line_start", "line_end")
            .join(body, "function_id", "left").join(counts, "function_id", "left")
            .select("function_id", "name", "module_name", "function_signature", "src_file",
                    "line_start", "line_end", "code_length",
                    *[F.coalesce(f"{k}_{what}", F.lit(0)).cast("bigint").alias(f"n_{k}_{what}s")
                      for what in ("function", "type") for k in kinds],
                    *(["body", "body_preview", "body_head"] if include_body else [])))


STYLES = ("haskell", "qualified", "explicit")
ELEMENT_TYPES = ("any", "function", "type", "class")


@dataclass
class _Open:
    """Types or classes that modules name and do not define themselves: each
    may come from every module that defines the name."""
    kind: str
    used: DataFrame      # distinct (module_id, module, element)
    defs: DataFrame      # distinct (element, imported_module)


def _called(g: CodeGraph, fn: DataFrame) -> DataFrame:
    """(module_id, module, imported_module, element): the functions that each
    module calls; a call names its module."""
    return g.function_called.join(fn, "function_id").select(
        "module_id", "module", F.col("module_name").alias("imported_module"),
        F.col("name").alias("element"))


def _open_uses(g: CodeGraph, mods: DataFrame, fn: DataFrame, element_type: str, restricted: bool,
               element: str | None) -> list[_Open]:
    m = g.module.select(F.col("id").alias("def_module_id"), F.col("name").alias("imported_module"))

    def opened(kind: str, used: DataFrame, defs: DataFrame) -> _Open:
        if element is not None:
            used = used.filter(F.col("element") == element)
        own = defs.withColumnRenamed("def_module_id", "module_id")
        return _Open(kind, used.distinct().join(own, ["module_id", "element"], "left_anti"),
                     defs.join(m, "def_module_id").filter(F.col("imported_module").isNotNull())
                     .select("element", "imported_module").distinct())
    out = []
    if element_type in ("any", "type"):
        subset = fn.select(F.col("function_id").alias("id")) if restricted else None
        used = (type_usage_sites(g, functions=subset).select("function_id", "type_name")
                .join(fn, "function_id").select("module_id", "module",
                                                F.col("type_name").alias("element")))
        out.append(opened("type", used, g.types.select(
            F.col("type_name").alias("element"), F.col("module_id").alias("def_module_id"))))
    if element_type in ("any", "class"):
        inst = g.instance.join(mods, "module_id").select("module_id", "module",
                                                         "instance_definition")
        pairs = token_pairs(g.classes, inst, "class_name", "instance_definition").select(
            F.col("name").alias("element"), F.col("text").alias("instance_definition"))
        used = inst.join(pairs, "instance_definition").select("module_id", "module", "element")
        out.append(opened("class", used, g.classes.select(
            F.col("class_name").alias("element"), F.col("module_id").alias("def_module_id"))))
    return out


def _needed(g: CodeGraph, mods: DataFrame, element_type: str, restricted: bool,
            element: str | None) -> DataFrame:
    """(module, imported_module, element, element_type), distinct: what each
    module uses, where it may come from, and no import brings into scope.

    A type or class is listed with every module that defines it, which is the
    bulk of the rows: which of them are supplied is found from the imports, and
    the rest is joined with its modules last, pairs that are distinct on both
    sides, so that the list itself is never shuffled."""
    fn = g.function.select(F.col("id").alias("function_id"), "module_id").join(mods, "module_id")
    elsewhere = F.col("imported_module") != F.col("module")
    parts = []
    if element_type in ("any", "function"):
        u = _called(g, fn)
        if element is not None:
            u = u.filter(F.col("element") == element)
        u = u.filter(F.col("imported_module").isNotNull() & elsewhere).distinct()
        parts.append(u.join(_supplied(g, u), ["module_id", "imported_module", "element"],
                            "left_anti")
                     .select("module", "imported_module", "element",
                             F.lit("function").alias("element_type")).distinct())
    imported = g.imports.select("module_id", F.col("module_name").alias("imported_module")).distinct()
    for o in _open_uses(g, mods, fn, element_type, restricted, element):
        seen = (imported.join(o.defs, "imported_module").join(o.used, ["module_id", "element"])
                .filter(elsewhere).select("module_id", "imported_module", "element"))
        # Which module a type or class comes from is open: one supplier settles it.
        settled = _supplied(g, seen).select("module_id", "element").distinct()
        parts.append(o.used.join(settled, ["module_id", "element"], "left_anti")
                     .select("module", "element").distinct()
                     .join(o.defs, "element").filter(elsewhere)
                     .select("module", "imported_module", "element",
                             F.lit(o.kind).alias("element_type")))
    return reduce(DataFrame.unionByName, parts)


def import_elements(g: CodeGraph) -> DataFrame:
    """(import_id, module_id, imported_module, mode, element): ``all`` (no
    list; element NULL), ``hiding`` or ``only``, one row per listed element."""
    specs = F.regexp_extract_all(F.coalesce("hiding_specs", F.lit("")), F.lit(SPEC_NAME), 0)
    mode = (F.when(F.size("specs") == 0, F.lit("all"))
            .when(F.coalesce("is_hiding", F.lit(False)), F.lit("hiding")).otherwise(F.lit("only")))
    return g.imports.withColumn("specs", specs).select(
        F.col("id").alias("import_id"), "module_id", F.col("module_name").alias("imported_module"),
        mode.alias("mode"), F.explode_outer("specs").alias("element"))


def _supplied(g: CodeGraph, uses: DataFrame) -> DataFrame:
    """Distinct (module_id, imported_module, element) of ``uses`` that an
    import of the module brings into scope: an import without a list, one that
    lists the element, or one that hides others."""
    e = import_elements(g)
    pair = ["module_id", "imported_module"]
    u = uses.select(*pair, "element").distinct()
    whole = u.join(e.filter("mode = 'all'").select(*pair), pair, "left_semi")
    listed = u.join(e.filter("mode = 'only'").select(*pair, "element"), [*pair, "element"],
                    "left_semi")
    hiding = e.filter("mode = 'hiding'")
    per_pair = hiding.groupBy(*pair).agg(F.count_distinct("import_id").alias("n"))
    per_element = hiding.groupBy(*pair, "element").agg(F.count_distinct("import_id").alias("hid"))
    rest = (u.join(per_pair, pair).join(per_element, [*pair, "element"], "left")
            .filter(F.col("n") > F.coalesce("hid", F.lit(0))).select(*pair, "element"))
    return whole.unionByName(listed).unionByName(rest).distinct()


def generate_imports(g: CodeGraph, keys: Keys = None, element_type: str = "any",
                     style: str = "haskell", element: str | None = None,
                     combine: bool = False) -> DataFrame:
    """Import statements a module lacks. An element (called function,
    type named in a signature, class of an instance) used in module M but
    defined in another module D, where no import of M brings it into scope,
    yields ``import D``, ``import qualified D`` or ``import D (element)``.
    Hiding and import lists are taken into account element by element, and a
    type or class that one import supplies is asked of no other module.
    ``element`` keeps the statements that this name needs, in every style;
    ``combine`` writes the explicit style as one statement per imported
    module with the sorted list of its elements."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    if element_type not in ELEMENT_TYPES:
        raise ValueError(f"element_type must be one of {ELEMENT_TYPES}")
    kf = key_frame(g.spark, keys, ["name"])
    mods = restrict(g.module, kf, ["name"]).select(F.col("id").alias("module_id"),
                                                   F.col("name").alias("module"))
    need = _needed(g, mods, element_type, kf is not None, element)
    if style == "explicit" and combine:
        names = F.sort_array(F.collect_set("element"))
        return need.groupBy("module", "imported_module").agg(names.alias("names")).select(
            "module", "imported_module", F.size("names").cast("bigint").alias("n_elements"),
            F.array_join("names", ", ").alias("list")).select(
            "module", "imported_module", "n_elements",
            F.concat(F.lit("import "), F.col("imported_module"), F.lit(" ("), F.col("list"),
                     F.lit(")")).alias("statement"))
    if style == "explicit":
        return need.select("module", "imported_module", "element_type", "element",
                           F.concat(F.lit("import "), F.col("imported_module"), F.lit(" ("),
                                    F.col("element"), F.lit(")")).alias("statement"))
    kw = "import qualified " if style == "qualified" else "import "
    return need.select("module", "imported_module",
                       F.concat(F.lit(kw), F.col("imported_module")).alias("statement")).distinct()
