"""Unit tests on hand-built tables: the edge cases of SURVEY §5."""

import pytest
from pyspark.sql import functions as F

from codeweave.functions.patterns import like_pattern
from codeweave.operators import calls, classes, functions, imports, modules, sqlapi, types
from codeweave.operators import location, patterns as pat
from helpers import make_graph, modules as mods


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_like_pattern_rules():
    assert like_pattern("") == "%%"
    assert like_pattern("abc") == "%abc%"
    assert like_pattern("a*c") == "a%c"
    assert like_pattern("*c") == "%c"
    assert like_pattern("a_c") == "%a_c%"          # underscore stays a wildcard
    with pytest.raises(ValueError):
        like_pattern("a\\_c")


def test_underscore_is_a_wildcard(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "a_b", "module_id": 0}, {"id": 2, "name": "axb", "module_id": 0},
        {"id": 3, "name": "ab", "module_id": 0}])
    got = rows(functions.search_functions(g, "a_b", limit=None), "id")
    assert got == [(1,), (2,)]


def test_complexity_signature_rules(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "f", "module_id": 0, "function_signature": "A -> B -> C"},
        {"id": 2, "name": "g", "module_id": 0, "function_signature": ""},
        {"id": 3, "name": "h", "module_id": 0, "function_signature": None}],
        function_called=[{"function_id": 1, "name": "x"}] * 7 + [{"function_id": 2, "name": "y"}] * 3,
        where_function=[{"parent_function_id": 1, "name": "w"}, {"parent_function_id": 3, "name": "v"}])
    out = {r["id"]: r["complexity"] for r in
           functions.function_complexity(g, min_complexity=0, limit=None).collect()}
    # f: 11//20 + 2*2 = 4, 7//3 = 2, 1 where -> 2  => 8
    assert out == {1: 8, 2: 1, 3: 2}
    top = functions.function_complexity(g, min_complexity=2, limit=1).collect()
    assert [r["id"] for r in top] == [1]


def test_cross_module_null_callee_module_dropped(spark):
    g = make_graph(spark, module=mods("A", "B"), function=[
        {"id": 1, "name": "f", "module_id": 0, "module_name": "A"}],
        function_called=[{"function_id": 1, "name": "g", "module_name": "B", "site": 1},
                         {"function_id": 1, "name": "h", "module_name": None, "site": 2},
                         {"function_id": 1, "name": "i", "module_name": "A", "site": 3}])
    got = rows(functions.cross_module_calls(g, limit=None), "target_function")
    assert got == [("g",)]


def test_module_details_empty_module(spark):
    g = make_graph(spark, module=mods("A", "Empty"), function=[
        {"id": i, "name": f"f{i:02d}", "module_id": 0} for i in range(12)])
    out = {r["name"]: r for r in modules.module_details(g).collect()}
    assert out["Empty"]["n_functions"] == 0 and out["Empty"]["sample_functions"] == []
    assert out["A"]["n_functions"] == 12
    assert out["A"]["sample_functions"] == [f"f{i:02d}" for i in range(10)]


def test_tie_at_limit_is_ordered_by_id(spark):
    g = make_graph(spark, module=[{"id": 5, "name": "same"}, {"id": 2, "name": "same"},
                                  {"id": 9, "name": "same"}])
    assert [r["id"] for r in modules.list_modules(g, limit=2).collect()] == [2, 5]


def test_call_neighbours_cycle_and_self_loop(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": i, "name": f"f{i}", "module_id": 0, "module_name": "M"} for i in (1, 2, 3, 4)],
        function_dependency=[{"caller_id": 1, "callee_id": 2}, {"caller_id": 2, "callee_id": 3},
                             {"caller_id": 3, "callee_id": 1}, {"caller_id": 2, "callee_id": 2},
                             {"caller_id": 3, "callee_id": 4}])
    out = calls.call_neighbours(g, ["f1"], depth=5, include_callers=False)
    assert rows(out, "function_id", "depth") == [(2, 1), (3, 2), (4, 3)]
    back = calls.call_neighbours(g, ["f1"], depth=1, include_callees=False)
    assert rows(back, "function_id", "depth") == [(3, 1)]


def test_call_tree_cuts_cycles(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": i, "name": f"f{i}", "module_id": 0, "module_name": "M"} for i in (1, 2, 3)],
        function_dependency=[{"caller_id": 1, "callee_id": 2}, {"caller_id": 2, "callee_id": 1},
                             {"caller_id": 2, "callee_id": 3}, {"caller_id": 1, "callee_id": 3}])
    t = calls.call_tree(g, ["f1"], max_depth=3)
    paths = sorted(tuple(r["path"]) for r in t.collect())
    assert paths == [(1,), (1, 2), (1, 2, 3), (1, 3)]


def test_module_filter_prunes_subtree_but_keeps_moduleless(spark):
    g = make_graph(spark, module=mods("Keep", "Drop"), function=[
        {"id": 1, "name": "r", "module_name": "Keep.A"},
        {"id": 2, "name": "x", "module_name": "Drop.B"},
        {"id": 3, "name": "y", "module_name": "Keep.C"},
        {"id": 4, "name": "z", "module_name": None}],
        function_dependency=[{"caller_id": 1, "callee_id": 2}, {"caller_id": 2, "callee_id": 3},
                             {"caller_id": 1, "callee_id": 4}])
    flat = calls.call_graph_flat(g, ["r"], 3, ["Keep"])
    assert rows(flat, "function_id", "depth") == [(1, 0), (4, 1)]
    edges = calls.call_graph_edges(g, ["r"], 3, ["Keep"])
    assert rows(edges, "src_id", "dst_id") == [(1, 2), (1, 4)]


def test_type_dependencies_external(spark):
    g = make_graph(spark, module=mods("M"), type=[
        {"id": 1, "type_name": "A", "module_id": 0}, {"id": 2, "type_name": "B", "module_id": 0}],
        type_dependency=[{"dependent_id": 1, "dependency_id": 2},
                         {"dependent_id": 2, "dependency_id": 99}])
    out = types.type_dependencies(g, ["A"], depth=3)
    assert rows(out, "type_id", "is_external", "depth") == [(2, False, 1), (99, True, 2)]
    rel = types.type_relationships(g, "B", "M", analysis_depth=1)
    assert rows(rel.dependents, "type_id") == [(1,)]
    assert rows(rel.edges, "dst_id", "is_external") == [(99, True)]


def test_import_buckets_overlap(spark):
    g = make_graph(spark, module=mods("M"), **{"import": [
        {"id": 1, "module_id": 0, "module_name": "X", "package_name": "pkg",
         "qualified_style": True, "is_hiding": True},
        {"id": 2, "module_id": 0, "module_name": "Y", "package_name": "",
         "qualified_style": False, "is_hiding": False}]})
    got = rows(imports.import_details(g), "import_id", "bucket")
    assert got == [(1, "external"), (1, "hiding"), (1, "qualified"), (2, "internal")]


def test_suspicious_import_reasons(spark):
    g = make_graph(spark, module=mods("M"), **{"import": [
        {"id": 1, "module_id": 0, "module_name": "X", "package_name": "my-Test-lib"},
        {"id": 2, "module_id": 0, "module_name": "Y", "qualified_style": True,
         "as_module_name": "Y"},
        {"id": 3, "module_id": 0, "module_name": "Z", "is_hiding": True, "hiding_specs": ""}]})
    got = rows(imports.suspicious_imports(g, limit=None), "import_id", "reasons")
    assert got == [(2, ["qualified_and_aliased"])]


def test_class_instances_literal_substring(spark):
    g = make_graph(spark, module=mods("M"), **{"class": [
        {"id": 1, "class_name": "Show", "module_id": 0}, {"id": 2, "class_name": "S_ow", "module_id": 0},
        {"id": 3, "class_name": "Eq", "module_id": 0}]},
        instance=[{"id": 10, "module_id": 0, "instance_definition": "instance Show Foo"},
                  {"id": 11, "module_id": 0, "instance_definition": "instance Eq Bar"}])
    got = rows(classes.class_instances(g), "class_name", "instance_id")
    assert got == [("Eq", 11), ("Show", 10)]


def test_elements_at_innermost(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "outer", "src_file": "f.hs", "line_start": 1, "line_end": 200},
        {"id": 2, "name": "inner", "src_file": "f.hs", "line_start": 60, "line_end": 70},
        {"id": 3, "name": "other", "src_file": "g.hs", "line_start": 1, "line_end": 500}])
    probes = spark.createDataFrame([(1, "f.hs", 65), (2, "f.hs", 150), (3, "f.hs", 300),
                                    (4, "/base/g.hs", 64)], "probe_id long, src_file string, line long")
    got = rows(location.elements_at(g, probes, base_directory="/base", element_types=["function"]),
               "probe_id", "element_id")
    assert got == [(1, 2), (2, 1), (4, 3)]


def test_entity_query_rejects_unknown(spark):
    g = make_graph(spark, module=mods("M"))
    with pytest.raises(ValueError):
        sqlapi.entity_query(g, {"type": "module", "conditions": [
            {"field": "nope", "operator": "eq", "value": 1}]})
    with pytest.raises(ValueError):
        sqlapi.entity_query(g, {"type": "module", "conditions": [
            {"field": "name", "operator": "regex", "value": "x"}]})
    with pytest.raises(ValueError):
        sqlapi.entity_query(g, {"type": "table"})


def test_entity_query_ne_drops_nulls(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "a", "type_enum": "X"}, {"id": 2, "name": "b", "type_enum": None},
        {"id": 3, "name": "c", "type_enum": "Y"}])
    out = sqlapi.entity_query(g, {"type": "function", "conditions": [
        {"field": "type_enum", "operator": "ne", "value": "X"}]})
    assert [r["id"] for r in out.collect()] == [3]


def test_coupling_totals_property(spark):
    g = make_graph(spark, module=mods("A", "B", "C"), function=[
        {"id": 1, "name": "f", "module_id": 0}, {"id": 2, "name": "g", "module_id": 1}],
        function_called=[{"function_id": 1, "module_name": "B"}, {"function_id": 1, "module_name": "C"},
                         {"function_id": 2, "module_name": "A"}, {"function_id": 2, "module_name": "B"}])
    cp = pat.module_coupling(g, limit=None).agg(
        F.sum("incoming").alias("i"), F.sum("outgoing").alias("o")).collect()[0]
    n_cross = pat.cross_module_dependencies(g, limit=None).agg(F.sum("call_count")).collect()[0][0]
    assert cp["i"] + cp["o"] == 2 * n_cross == 6


def test_generate_imports_skips_imported_and_own(spark):
    g = make_graph(spark, module=mods("A", "B", "C"), function=[
        {"id": 1, "name": "f", "module_id": 0, "module_name": "A"}],
        function_called=[{"function_id": 1, "name": "g", "module_name": "B"},
                         {"function_id": 1, "name": "h", "module_name": "C"},
                         {"function_id": 1, "name": "k", "module_name": "A"}],
        **{"import": [{"id": 1, "module_id": 0, "module_name": "C"}]})
    got = rows(location.generate_imports(g, style="explicit"), "statement")
    assert got == [("import B (g)",)]


def test_custom_sql_binds_parameters(spark):
    g = make_graph(spark, module=mods("A.x", "B.y", "A.z"))
    named = sqlapi.custom_sql(g, "SELECT name FROM cg_module WHERE name LIKE :p ORDER BY name",
                              {"p": "A.%"}, limit=None)
    assert [r["name"] for r in named.collect()] == ["A.x", "A.z"]
    pos = sqlapi.custom_sql(g, "SELECT count(*) AS n FROM cg_module WHERE name <> ?", ["B.y"])
    assert pos.collect()[0]["n"] == 2


def test_basic_query_and_count(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": i, "name": f"f{i}", "module_id": i % 2} for i in range(5)])
    rows_ = sqlapi.basic_query(g, "functions", "f*", module_id=0, limit=2).collect()
    assert [r["id"] for r in rows_] == [0, 2]
    assert sqlapi.basic_query_count(g, "functions", "f*", module_id=0).collect()[0]["total"] == 3
    with pytest.raises(ValueError):
        sqlapi.basic_query(g, "modules", module_id=1)


def test_pattern_match_dispatch(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "alpha", "module_name": "M", "function_signature": "(a -> b) -> c"},
        {"id": 2, "name": "beta", "module_name": "M", "function_signature": "Int"}],
        function_called=[{"function_id": 1, "name": "beta", "module_name": "M", "site": 1}],
        where_function=[{"parent_function_id": 1, "name": "go"}, {"parent_function_id": 1, "name": "h"}],
        function_body=[{"id": 2, "raw_string": "x = 1\n  case y of\n z"}])
    calls_ = pat.pattern_match(g, "function_call", {"function": "alpha", "target": "be*"})
    assert rows(calls_, "caller", "callee") == [("alpha", "beta")]
    by = pat.pattern_match(g, "function_call", {"function": "beta", "mode": "called_by"})
    assert rows(by, "caller") == [("alpha",)]
    nested = pat.pattern_match(g, "code_structure", {"structure": "nested_function"})
    assert rows(nested, "nested", "n_nested") == [("go", 2), ("h", 2)]
    ho = pat.pattern_match(g, "code_structure", {"structure": "higher_order"})
    assert rows(ho, "id") == [(1,)]
    co = pat.pattern_match(g, "code_structure", {"structure": "pattern_match"})
    assert rows(co, "id") == [(2,)]
    with pytest.raises(ValueError):
        pat.pattern_match(g, "nope", {})


def test_nested_types_gateway_and_exclusion(spark):
    g = make_graph(spark, module=mods("Gate.A", "Other"), type=[
        {"id": 1, "type_name": "Root", "module_id": 0, "raw_code": "data Root = R\n  | S"},
        {"id": 2, "type_name": "Child", "module_id": 0, "raw_code": "data Child"},
        {"id": 3, "type_name": "Far", "module_id": 1, "raw_code": "data Far"},
        {"id": 4, "type_name": "SkipMe", "module_id": 0, "raw_code": "data SkipMe"},
        {"id": 5, "type_name": "Deep", "module_id": 0, "raw_code": "data Deep"}],
        type_dependency=[{"dependent_id": 1, "dependency_id": 2}, {"dependent_id": 2, "dependency_id": 3},
                         {"dependent_id": 3, "dependency_id": 5}, {"dependent_id": 1, "dependency_id": 4}])
    out = types.nested_types(g, ["Root"], "Gate", exclude_pattern="Skip*", include_raw=False)
    assert rows(out, "id", "definition") == [(1, "data Root = R"), (2, "data Child"), (5, "data Deep")]


def test_checkpoint_dir_is_read_from_session(spark):
    from codeweave.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_type_details_nested_form(spark):
    g = make_graph(spark, module=mods("M"), type=[
        {"id": 1, "type_name": "T", "module_id": 0, "raw_code": "data T"},
        {"id": 2, "type_name": "Empty", "module_id": 0}],
        constructor=[{"id": 10, "type_id": 1, "name": "MkA"}, {"id": 11, "type_id": 1, "name": "MkB"}],
        field=[{"constructor_id": 10, "field_name": "x", "field_type_raw": "Int"},
               {"constructor_id": 10, "field_name": None, "field_type_raw": None}])
    out = {r["type_name"]: r for r in types.type_details(g, nested=True).collect()}
    assert out["Empty"]["constructors"] == []
    ctors = out["T"]["constructors"]
    assert [c["constructor"] for c in ctors] == ["MkA", "MkB"]
    assert sorted((f["field_name"], f["field_type"]) for f in ctors[0]["fields"]) == [
        ("unnamed", "Unknown type"), ("x", "Int")]
    assert ctors[1]["fields"] == []


def test_first_only_roots(spark):
    g = make_graph(spark, module=mods("A", "B"), function=[
        {"id": 7, "name": "f", "module_id": 0, "module_name": "A"},
        {"id": 3, "name": "f", "module_id": 1, "module_name": "B"},
        {"id": 9, "name": "g", "module_id": 1, "module_name": "B"}],
        function_dependency=[{"caller_id": 7, "callee_id": 9}, {"caller_id": 3, "callee_id": 9}])
    every = calls.call_neighbours(g, ["f"], depth=1, include_callers=False)
    assert rows(every, "root_id") == [(3,), (7,)]
    first = calls.call_neighbours(g, ["f"], depth=1, include_callers=False, first_only=True)
    assert rows(first, "root_id") == [(3,)]
    scoped = calls.call_neighbours(g, [("f", "A")], depth=1, include_callers=False)
    assert rows(scoped, "root_id") == [(7,)]


@pytest.mark.parametrize("walk", ["bfs", "bfs_masks"])
def test_walk_from_many_roots_equals_brute_force(spark, walk):
    """More roots than one block holds, a hub, cycles, several start nodes."""
    import random

    from codeweave.plans import graph
    bfs = getattr(graph, walk)
    random.seed(3)
    edges = {(random.randrange(150), random.randrange(150)) for _ in range(400)}
    edges |= {(0, i) for i in range(1, 90)} | {(i, i) for i in range(5)}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    roots = [(i, i) for i in range(150)] + [(900, 3), (900, 77)]
    r = spark.createDataFrame(roots, "root long, node long")
    for depth, reverse in ((1, False), (2, True), (None, False)):
        want = set()
        for root in {a for a, _ in roots}:
            seen = front = {b for a, b in roots if a == root}
            d = 0
            while front and (depth is None or d < depth):
                d += 1
                front = {(s if reverse else t) for s, t in edges
                         if (t if reverse else s) in front} - seen
                seen = seen | front
                want |= {(root, n, d) for n in front}
        got = bfs(e, r, depth, reverse=reverse)
        assert {tuple(x) for x in got.select("root", "node", "depth").collect()} == want
        assert got.count() == len(want)
    assert bfs(e, r.limit(0), 3).collect() == [] and bfs(e.limit(0), r, 3).collect() == []


def test_unresolved_callees_are_neighbours(spark):
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "f", "module_id": 0, "module_name": "M"},
        {"id": 2, "name": "g", "module_id": 0, "module_name": "M"}],
        function_called=[
            {"function_id": 1, "callee_id": 2, "name": "g", "module_name": "M", "site": 1},
            {"function_id": 2, "name": "lookup", "module_name": "Data.Map", "site": 1},
            {"function_id": 2, "name": "lookup", "module_name": "Data.Map", "site": 2},
            {"function_id": 2, "name": "lookup", "site": 3}],
        function_dependency=[{"caller_id": 1, "callee_id": 2}])
    got = rows(calls.call_neighbours(g, ["f"], depth=2), "function_id", "function", "module_name",
               "depth", "is_external")
    assert got == [(2, "g", "M", 1, False), (None, "lookup", "Data.Map", 2, True),
                   (None, "lookup", None, 2, True)]
    assert rows(calls.call_neighbours(g, ["g"], depth=1, include_callers=False), "function",
                "module_name") == [("lookup", "Data.Map"), ("lookup", None)]


def test_long_spans_make_few_rows(spark):
    from codeweave.plans import interval
    spans = [("a", 1, 1_000_000, 1), ("a", 60, 70, 2), ("a", 64, 64, 3), ("a", 500, 1100, 4),
             ("b", 1, 10, 5), ("a", 10, 4, 6)]
    s = spark.createDataFrame(spans, "src_file string, line_start long, line_end long, s long")
    assert interval._levelled(s).count() <= 2 * len(spans)
    points = [(i, "a", line) for i, line in enumerate((1, 63, 64, 70, 71, 800, 999_999, 2_000_000))]
    p = spark.createDataFrame(points, "probe_id long, src_file string, line long")
    for radius in (0, 5, 700):
        want = sorted((i, k) for i, f, x in points for f2, lo, hi, k in spans
                      if f == f2 and lo <= hi and lo <= x + radius and hi >= x - radius)
        got = interval.window_overlaps(p, s.filter("line_start <= line_end"), radius)
        assert rows(got, "probe_id", "s") == want
    assert rows(interval.point_in_span(p, s), "probe_id", "s") == sorted(
        (i, k) for i, f, x in points for f2, lo, hi, k in spans if f == f2 and lo <= x <= hi)


def test_identifier_match_is_whole(spark):
    from codeweave.plans.substring import token_pairs
    names = spark.createDataFrame([("T_1",), ("T",), (None,)], "name string")
    texts = spark.createDataFrame([("T_1 -> T_12",), ("(T)",), ("xT",), (None,), ("",)], "text string")
    assert rows(token_pairs(names, texts)) == [("T", "(T)"), ("T_1", "T_1 -> T_12")]


def test_entity_query_joins(spark):
    g = make_graph(spark, module=mods("A", "B"), function=[
        {"id": i, "name": f"f{i}", "module_id": i % 2, "module_name": "AB"[i % 2]} for i in range(4)],
        function_called=[{"function_id": 1, "name": "x", "site": s} for s in (1, 2, 3)]
        + [{"function_id": 2, "name": "y", "site": 9}],
        type=[{"id": 5, "type_name": "T", "module_id": 0}, {"id": 6, "type_name": "U", "module_id": 1}],
        constructor=[{"id": 50, "type_id": 5, "name": "MkT"}, {"id": 60, "type_id": 6, "name": "MkU"}],
        field=[{"constructor_id": 50, "field_name": "a"}, {"constructor_id": 60, "field_name": "b"}])

    def ids(**q):
        return [r.id for r in sqlapi.entity_query(g, {"limit": None, **q}).orderBy("id").collect()]

    def cond(field, value, op="eq"):
        return {"field": field, "operator": op, "value": value}
    calls_of = {"type": "function", "joins": ["function_called"]}
    assert ids(**calls_of) == [1, 2]                              # once each
    assert ids(**calls_of, conditions=[cond("function_called.name", "x")]) == [1]
    # one call site must meet both conditions
    assert ids(**calls_of, conditions=[cond("function_called.name", "x"),
                                       cond("function_called.site", 9)]) == []
    assert ids(type="type", joins=["field"], conditions=[cond("field.field_name", "a")]) == [5]
    assert ids(type="type", joins=["constructor", "field"], conditions=[
        cond("constructor.name", "MkU"), cond("field.field_name", "a")]) == []
    assert ids(type="function", joins=["module"], conditions=[cond("module.name", "B")]) == [1, 3]
    assert ids(type="type", joins=["function"], conditions=[cond("function.name", "f3")]) == [6]
    on = {"entity": "function", "on": ["name", "module_name"]}
    assert ids(type="module", joins=[on], conditions=[cond("function.id", 2)]) == [0]
    for bad in ({"joins": ["nothing"]}, {"joins": ["function"]}, {"joins": [{"entity": "module",
                "on": ["nope", "id"]}]}, {"conditions": [cond("module.name", "B")]}):
        with pytest.raises((ValueError, AttributeError)):
            ids(type="function", **bad)


def test_defining_clauses(spark):
    body = "go 0 = 1\n\ngo n = n\n  where x = 1\ngo _ = 2\nother = 3\ngo 5 = 1\n-- go\nmain = x"
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "f", "module_id": 0}, {"id": 2, "name": "g", "module_id": 0}],
        function_body=[{"id": 1, "raw_string": body}, {"id": 2, "raw_string": "a = 1\nb = 2"}])
    assert rows(pat.defining_clauses(g)) == [(1, "go", 1, 3)]
    assert rows(pat.match_code_structure(g, "pattern_match"), "id") == [(1,)]


def test_imports_supply_elements(spark):
    """An import list, a hiding list, and one supplier of two."""
    g = make_graph(spark, module=mods("M", "D", "E"), function=[
        {"id": 1, "name": "f", "module_id": 0, "module_name": "M", "function_signature": "T -> U"},
        {"id": 2, "name": "a", "module_id": 1, "module_name": "D"},
        {"id": 3, "name": "b", "module_id": 1, "module_name": "D"}],
        function_called=[{"function_id": 1, "callee_id": 2, "name": "a", "module_name": "D", "site": 1},
                         {"function_id": 1, "callee_id": 3, "name": "b", "module_name": "D", "site": 2}],
        type=[{"id": 1, "type_name": "T", "module_id": 1}, {"id": 2, "type_name": "T", "module_id": 2},
              {"id": 3, "type_name": "U", "module_id": 2}],
        **{"class": [{"id": 1, "class_name": "C", "module_id": 2}]},
        instance=[{"id": 1, "module_id": 0, "instance_definition": "instance C T"}])

    def need(*imports, **kw):
        from dataclasses import replace

        from codeweave.sources.tables import ENTITY_SCHEMAS
        schema = ENTITY_SCHEMAS["import"]
        data = [tuple({"id": k, "module_id": 0, **i}.get(f.name) for f in schema.fields)
                for k, i in enumerate(imports)]
        h = replace(g, imports=spark.createDataFrame(data, schema))
        return rows(location.generate_imports(h, style="explicit", **kw), "statement")
    both = [("import D (T, a, b)",), ("import E (C, T, U)",)]
    assert need(combine=True) == both
    d, only_a = {"module_name": "D"}, {"module_name": "D", "hiding_specs": "[a]"}
    hide_a = {**only_a, "is_hiding": True}
    # T comes from D now, so E is not asked for it.
    assert need(d, combine=True) == [("import E (C, U)",)]
    assert need(only_a, combine=True) == [("import D (T, b)",), ("import E (C, T, U)",)]
    assert need(hide_a, combine=True) == [("import D (a)",), ("import E (C, U)",)]
    assert need(hide_a, only_a, combine=True) == [("import E (C, U)",)]
    assert need(element_type="class") == [("import E (C)",)]


def test_location_items_and_type_functions(spark):
    path = "src/M.hs"
    g = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "f", "module_id": 0, "module_name": "M", "src_file": path, "line_start": 1,
         "line_end": 9, "function_signature": "T_1 -> T_1"},
        {"id": 2, "name": "g", "module_id": 0, "module_name": "M", "function_signature": "T_12"}],
        function_called=[{"function_id": 1, "callee_id": 2, "name": "g", "module_name": "M", "site": 1}]
        + [{"function_id": 1, "name": f"x{i}", "module_name": "X", "site": i} for i in range(9)],
        type=[{"id": 1, "type_name": "T_1", "module_id": 0}])
    probes = spark.createDataFrame([(7, path, 3), (8, path, 30)], "probe_id long, src_file string, line long")
    got = rows(location.location_items(g, probes), "probe_id", "kind", "rank", "name")
    assert got == [(7, "external_function", i + 1, f"x{i}") for i in range(5)] + [
        (7, "local_function", 1, "g"), (7, "local_type", 1, "T_1")]
    assert rows(types.type_functions(g, ["T_1"], limit=1), "function_name") == [("f",)]
    assert rows(types.type_functions(g, ["T_1"], match="identifier"), "function_name") == [("f",)]
    assert len(rows(types.type_functions(g, ["T_1"]))) == 2


def test_function_context_flags_and_body(spark):
    text = "\n".join(f"line {i} of a body" for i in range(30))
    g = make_graph(spark, module=mods("M"), function=[{"id": 1, "name": "f", "module_id": 0}],
                   function_body=[{"id": 1, "raw_string": text}])
    r = location.function_context(g, include_local_definitions=False, include_body=True).first()
    assert r.body == text and r.body_preview == text[:200] + "..." and r.body_head == "\n".join(
        text.split("\n")[:5])
    assert r.n_external_types == 0 and "n_local_types" not in r.asDict()


def test_locations_of_sites_imports_and_instances(spark):
    g = make_graph(spark, module=mods("A", "B"), function=[
        {"id": 1, "name": "f", "module_id": 0, "module_name": "A"},
        {"id": 2, "name": "g", "module_id": 1, "module_name": "B"}],
        function_called=[
            {"function_id": 1, "name": "g", "module_name": "B", "site": 1, "src_loc": "A.hs:4"},
            {"function_id": 1, "name": "g", "module_name": None, "site": 2},
            {"function_id": 1, "name": "g", "module_name": "Other", "site": 3}],
        **{"import": [
            {"id": 1, "module_id": 0, "module_name": "B", "line": 3, "src_loc": "gen/A.hs:9"},
            {"id": 2, "module_id": 0, "module_name": "C", "line": 7, "src_loc": ""},
            {"id": 3, "module_id": 0, "module_name": "D"}],
           "class": [{"id": 1, "class_name": "Show", "module_id": 0}]},
        instance=[{"id": 5, "module_id": 1, "instance_definition": "instance Show X",
                   "src_loc": "B.hs:8"}])
    assert rows(functions.function_callers(g, ["g"]), "site", "src_loc") == [
        (1, "A.hs:4"), (2, None), (3, None)]
    # by module: only the sites of a function that is defined there
    assert rows(functions.function_callers(g, [("g", "B")], resolve="module"), "site") == [(1,)]
    assert rows(functions.function_callers(g, ["g"], resolve="module"), "site") == [(1,)]
    assert rows(functions.function_callers(g, None, resolve="module"), "site") == [(1,)]
    assert rows(functions.function_callers(g, [("g", "A")], resolve="module"), "site") == []
    with pytest.raises(ValueError):
        functions.function_callers(g, ["g"], resolve="file")
    assert rows(functions.function_callees(g, ["f"], limit=1), "src_loc") == [("A.hs:4",)]
    assert rows(imports.import_details(g, ["A"], True), "import_id", "source") == [
        (1, "gen/A.hs:9"), (2, "src/A.hs:7"), (3, None)]
    assert "source" not in imports.import_details(g, ["A"]).columns
    assert rows(classes.class_details(g), "instance_module", "instance_location") == [
        ("B", "B.hs:8")]


def test_matched_lines_come_with_the_result(spark):
    from codeweave.operators import similarity
    corpus = spark.createDataFrame(
        [(1, "x = 1\n  foo x\nbar\nfoo y\nfoo z\nfoo", "M"), (2, "none", "M"), (3, None, "M"),
         (4, "", None), (5, "bar", None)], "id long, text string, module string")
    out = similarity.code_patterns(corpus, " foo \n\nbar", min_matches=1)
    got = [(r["id"], r["matches"], [tuple(x) for x in r["matched_lines"]]) for r in out.collect()]
    assert got == [(1, 5, [(2, "foo x"), (3, "bar"), (4, "foo y")]), (5, 1, [(1, "bar")])]
    assert rows(similarity.code_pattern_lines(corpus, "foo", 2), "id", "line_no") == [
        (1, 2), (1, 4), (1, 5)]
    assert "Exchange" not in similarity.code_patterns(
        corpus, "foo", limit=None)._jdf.queryExecution().executedPlan().toString()


def test_complexity_of_one_module_counts_its_own_sites(spark):
    g = make_graph(spark, module=mods("A", "B"), function=[
        {"id": 1, "name": "f", "module_id": 0}, {"id": 2, "name": "g", "module_id": 1}],
        function_called=[{"function_id": 1, "name": "x"}] * 3 + [{"function_id": 2, "name": "x"}] * 6,
        where_function=[{"parent_function_id": 2, "name": "w"}])
    out = functions.function_complexity(g, module="B", min_complexity=0, limit=None)
    assert rows(out, "id", "call_count", "where_count") == [(2, 6, 1)]
