"""Query surfaces: user SQL over the entity views (O40), the basic
listing query (O41) and the JSON condition query (O42). All three build
a plan for Catalyst; nothing is evaluated on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ends_with, ilike, like, starts_with
from ..sources.tables import CodeGraph

VIEW_PREFIX = "cg_"


def custom_sql(g: CodeGraph, sql: str, params: Mapping | Sequence | None = None,
               limit: int | None = None, order_by: Sequence[str] | None = None,
               view_prefix: str = VIEW_PREFIX) -> DataFrame:
    """Run ``sql`` over the entity tables, registered as temp views
    ``cg_module``, ``cg_function``, ``cg_import``, ... Parameters are
    bound by Spark (``:name`` with a mapping, ``?`` with a sequence), never
    spliced into the text. All rows are returned unless ``limit`` is given:
    then the first rows by ``order_by`` (default: all columns in turn), so
    that the answer is the same on every run."""
    g.register_views(view_prefix)
    df = g.spark.sql(sql, args=params) if params else g.spark.sql(sql)
    return df if limit is None else df.orderBy(*(order_by or df.columns)).limit(limit)


# ---------------------------------------------------------------- O41

_BASIC = {
    "modules": ("module", ["id", "name", "path"], "name"),
    "functions": ("function", ["id", "name", "module_id", "module_name"], "name"),
    "types": ("type", ["id", "type_name", "module_id", "type_of_type"], "type_name"),
    "imports": ("import", ["id", "module_name", "module_id", "package_name"], "module_name"),
}


def _basic(g: CodeGraph, query_type: str, name_pattern: str | None, module_id: int | None
           ) -> tuple[DataFrame, str]:
    if query_type not in _BASIC:
        raise ValueError(f"query_type must be one of {sorted(_BASIC)}")
    entity, cols, name_col = _BASIC[query_type]
    df = g.table(entity).select(*cols)
    if name_pattern:
        df = df.filter(like(name_col, name_pattern))
    if module_id is not None:
        if "module_id" not in cols:
            raise ValueError("module_id does not apply to modules")
        df = df.filter(F.col("module_id") == F.lit(module_id))
    return df, name_col


def basic_query(g: CodeGraph, query_type: str, name_pattern: str | None = None,
                module_id: int | None = None, limit: int | None = 100) -> DataFrame:
    """O41 rows: the entities of one kind matching the filters, by name."""
    df, name_col = _basic(g, query_type, name_pattern, module_id)
    df = df.orderBy(name_col, "id")
    return df if limit is None else df.limit(limit)


def basic_query_count(g: CodeGraph, query_type: str, name_pattern: str | None = None,
                      module_id: int | None = None) -> DataFrame:
    """O41 total: how many entities match (before any limit)."""
    df, _ = _basic(g, query_type, name_pattern, module_id)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(query_type).alias("query_type"), "total")


# ---------------------------------------------------------------- O42

ENTITIES = ("function", "module", "type", "class", "import", "instance")

# The key graph: (child, parent) -> (child column, parent column).
JOIN_KEYS = {
    ("function", "module"): ("module_id", "id"),
    ("type", "module"): ("module_id", "id"),
    ("class", "module"): ("module_id", "id"),
    ("import", "module"): ("module_id", "id"),
    ("instance", "module"): ("module_id", "id"),
    ("constructor", "type"): ("type_id", "id"),
    ("field", "constructor"): ("constructor_id", "id"),
    ("function_called", "function"): ("function_id", "id"),
    ("where_function", "function"): ("parent_function_id", "id"),
    ("function_body", "function"): ("id", "id"),
}


class _Joined:
    """One entity of a query's join tree: its conditions and the entities
    joined to it, each with (own column, their column, is a parent)."""

    def __init__(self, entity: str):
        self.entity, self.conditions, self.below = entity, [], {}


def _key(a: str, b: str) -> tuple[str, str, bool] | None:
    """(column of a, column of b, b is a parent) of a known key."""
    if (a, b) in JOIN_KEYS:
        return (*JOIN_KEYS[a, b], True)
    if (b, a) in JOIN_KEYS:
        theirs, own = JOIN_KEYS[b, a]
        return own, theirs, False
    return None


def _path(start: str, goal: str) -> list[str]:
    """Shortest path between two entities in the key graph."""
    paths, seen = [[start]], {start}
    while paths:
        path = paths.pop(0)
        if path[-1] == goal:
            return path
        for nxt in sorted({e for pair in JOIN_KEYS for e in pair} - seen):
            if _key(path[-1], nxt):
                seen.add(nxt)
                paths.append([*path, nxt])
    raise ValueError(f"no join from {start} to {goal}")


def _join_tree(g: CodeGraph, root: str, joins: Sequence) -> dict[str, _Joined]:
    """All entities of the query by name, the root among them."""
    tree = {root: _Joined(root)}
    for j in joins:
        target = j["entity"] if isinstance(j, Mapping) else j
        on = j.get("on") if isinstance(j, Mapping) else None
        if target == root:
            raise ValueError(f"{root} cannot be joined to itself")
        if on:
            own, theirs = (on, on) if isinstance(on, str) else on
            for entity, col in ((root, own), (target, theirs)):
                if col not in g.table(entity).columns:
                    raise ValueError(f"unknown field {col!r} for {entity}")
            known = _key(root, target)
            parent = known is not None and known[2] and known[:2] == (own, theirs)
            tree[target] = _Joined(target)
            tree[root].below[target] = (own, theirs, parent)
            continue
        path = _path(root, target)
        for a, b in zip(path, path[1:], strict=False):
            tree.setdefault(b, _Joined(b))
            tree[a].below.setdefault(b, _key(a, b))
    return tree


def _matching(g: CodeGraph, tree: dict[str, _Joined], entity: str) -> DataFrame:
    """Rows of a joined entity that meet its conditions and have a match in
    every entity below it (semi-joins: rows never multiply)."""
    df, node = g.table(entity), tree[entity]
    for c in node.conditions:
        df = df.filter(c)
    for other, (own, theirs, _) in node.below.items():
        keys = _matching(g, tree, other).select(F.col(theirs).alias("__key"))
        df = df.join(keys, F.col(own) == F.col("__key"), "left_semi")
    return df


def _condition(col: Column, op: str, value) -> Column:
    if op == "eq":
        return col.isNull() if value is None else col == F.lit(value)
    if op == "ne":
        return col.isNotNull() if value is None else col != F.lit(value)
    if op == "gt":
        return col > F.lit(value)
    if op == "lt":
        return col < F.lit(value)
    if op == "ge":
        return col >= F.lit(value)
    if op == "le":
        return col <= F.lit(value)
    if op == "like":
        return like(col, str(value))
    if op == "ilike":
        return ilike(col, str(value))
    if op == "startswith":
        return starts_with(col, value)
    if op == "endswith":
        return ends_with(col, value)
    if op == "contains":
        return col.contains(F.lit(str(value)))
    if op in ("in", "not_in"):
        vals = list(value) if isinstance(value, (list, tuple, set)) else [value]
        c = col.isin(vals)
        return c if op == "in" else ~c
    if op == "between":
        lo, hi = value
        return col.between(F.lit(lo), F.lit(hi))
    if op == "is_null":
        return col.isNull()
    if op == "is_not_null":
        return col.isNotNull()
    raise ValueError(f"unknown operator {op!r}")


def entity_query(g: CodeGraph, query: Mapping) -> DataFrame:
    """``{"type": entity, "conditions": [{field, operator, value}],
    "joins": [{"entity": other, "on": [field, other's field]}], "limit": n}``.

    Conditions are ANDed; a field may name a joined entity's column as
    ``entity.column``. Entities are joined along the shortest path of known
    keys, or ``on`` the named columns. A parent (a function's module) adds its
    columns as ``entity.column``; rows without parent stay unless a condition
    asks for it. Everything else (a function's call sites, a type's
    constructors and their fields) keeps the rows for which one chain of
    matching rows exists that meets all their conditions, once each, and adds
    no columns. Unknown entities, fields or operators raise (the service
    ignored them silently). Rows come in id order."""
    etype = query.get("type")
    if etype not in ENTITIES:
        raise ValueError(f"type must be one of {ENTITIES}")
    tree = _join_tree(g, etype, query.get("joins") or [])
    own_columns = g.table(etype).columns
    attached = {p: on for p, on in tree[etype].below.items() if on[2] and not tree[p].below}
    conds = []
    for c in query.get("conditions", []) or []:
        field, op = c.get("field"), c.get("operator")
        if not field or not op:
            raise ValueError(f"condition needs field and operator: {c!r}")
        entity, _, column = field.rpartition(".")
        if (entity or etype) not in tree or column not in g.table(entity or etype).columns:
            raise ValueError(f"unknown field {field!r} for {etype}; fields: {own_columns} and "
                             f"those of {sorted(set(tree) - {etype})}")
        if entity in ("", etype) or entity in attached:
            conds.append(_condition(F.col(f"`{field if entity in attached else column}`"), op,
                                    c.get("value")))
        else:
            tree[entity].conditions.append(_condition(F.col(column), op, c.get("value")))
    df = g.table(etype)
    for other, (own, theirs, _) in tree[etype].below.items():
        if other in attached:
            p = g.table(other)
            p = p.select(*[F.col(c).alias(f"{other}.{c}") for c in p.columns])
            df = df.join(p, F.col(own) == F.col(f"`{other}.{theirs}`"), "left")
        else:
            keys = _matching(g, tree, other).select(F.col(theirs).alias("__key"))
            df = df.join(keys, F.col(own) == F.col("__key"), "left_semi")
    if conds:
        df = df.filter(reduce(lambda a, b: a & b, conds))
    limit = query.get("limit", 100)
    order = "id" if "id" in own_columns else own_columns[0]
    return df if limit is None else df.orderBy(order).limit(limit)
