"""Every tool method of the facade plans and runs on a small graph."""

import inspect

from codeweave.api import CodeAnalytics
from helpers import make_graph, modules as mods

TOOLS = ("list_modules get_function_details search_functions get_most_called_functions "
         "execute_query get_module_details get_functions_by_module search_modules "
         "get_module_dependencies get_function_call_graph get_function_callers "
         "get_function_callees execute_advanced_query find_cross_module_calls "
         "analyze_function_complexity get_code_statistics list_types get_type_details "
         "search_types get_type_dependencies analyze_type_usage list_classes get_class_details "
         "search_classes analyze_imports get_import_graph find_unused_imports get_import_details "
         "find_similar_functions find_code_patterns group_similar_functions "
         "build_type_dependency_graph get_nested_types analyze_type_relationships "
         "find_element_by_location get_location_context get_function_context "
         "generate_function_imports execute_custom_query pattern_match_code "
         "analyze_cross_module_dependencies enhanced_function_call_graph").split()


def test_all_tools_present():
    assert len(TOOLS) == 42
    assert all(inspect.isfunction(getattr(CodeAnalytics, t, None)) for t in TOOLS)


def test_tools_run(spark):
    g = make_graph(spark, module=mods("A", "B"),
                   function=[{"id": 1, "name": "f", "module_id": 0, "module_name": "A",
                              "function_signature": "T -> U", "src_file": "src/A.hs",
                              "line_start": 1, "line_end": 9},
                             {"id": 2, "name": "g", "module_id": 1, "module_name": "B",
                              "src_file": "src/B.hs", "line_start": 1, "line_end": 5}],
                   function_body=[{"id": 1, "raw_string": "f x = g x\n  where y = 1"},
                                  {"id": 2, "raw_string": "g x = x"}],
                   function_called=[{"function_id": 1, "callee_id": 2, "name": "g",
                                     "module_name": "B", "site": 1}],
                   function_dependency=[{"caller_id": 1, "callee_id": 2}],
                   type=[{"id": 5, "type_name": "T", "module_id": 0, "raw_code": "data T = T",
                          "src_file": "src/A.hs", "line_start": 20, "line_end": 22}],
                   type_dependency=[{"dependent_id": 5, "dependency_id": 9}],
                   **{"class": [{"id": 1, "class_name": "C", "module_id": 0,
                                 "class_definition": "class C a"}],
                      "import": [{"id": 1, "module_id": 0, "module_name": "B",
                                  "package_name": "pkg", "line": 2}]})
    ca = CodeAnalytics(g)
    probes = spark.createDataFrame([(1, "src/A.hs", 3)], "probe_id long, src_file string, line long")
    calls = {
        "list_modules": {}, "get_function_details": {"function_name": "f"},
        "search_functions": {"pattern": "f"}, "get_most_called_functions": {},
        "execute_query": {"query_type": "functions"}, "get_module_details": {"module_name": "A"},
        "get_functions_by_module": {"module_name": "A"}, "search_modules": {"pattern": "A"},
        "get_module_dependencies": {"module_name": "A", "include_dependents": True},
        "get_function_call_graph": {"function_name": "f"},
        "get_function_callers": {"function_name": "g"},
        "get_function_callees": {"function_name": "f"},
        "execute_advanced_query": {"query": {"type": "function", "conditions": [
            {"field": "name", "operator": "eq", "value": "f"}]}},
        "find_cross_module_calls": {}, "analyze_function_complexity": {"min_complexity": 0},
        "get_code_statistics": {"include_details": True}, "list_types": {},
        "get_type_details": {"type_name": "T"}, "search_types": {"pattern": "T"},
        "get_type_dependencies": {"type_name": "T"}, "analyze_type_usage": {"type_name": "T"},
        "list_classes": {}, "get_class_details": {"class_name": "C"},
        "search_classes": {"pattern": "C"}, "analyze_imports": {}, "get_import_graph": {},
        "find_unused_imports": {}, "get_import_details": {"module_name": "A"},
        "find_similar_functions": {"function_name": "f", "similarity_threshold": 0.1},
        "find_code_patterns": {"pattern_code": "where", "min_matches": 1},
        "group_similar_functions": {"similarity_threshold": 0.1},
        "build_type_dependency_graph": {"root_type": "T", "include_external": True},
        "get_nested_types": {"type_names": ["T"], "gateway_name": "A"},
        "analyze_type_relationships": {"type_name": "T", "source_module": "A"},
        "find_element_by_location": {"probes": probes},
        "get_location_context": {"probes": probes},
        "get_function_context": {"function_name": "f"},
        "generate_function_imports": {"import_style": "explicit"},
        "execute_custom_query": {"sql": "SELECT count(*) AS n FROM cg_function"},
        "pattern_match_code": {"pattern_type": "function_call", "pattern_config": {"function": "f"}},
        "analyze_cross_module_dependencies": {"analysis_type": "coupling"},
        "enhanced_function_call_graph": {"function_name": "f", "graph_format": "graph"},
    }
    assert sorted(calls) == sorted(TOOLS)
    for tool, kw in calls.items():
        out = getattr(ca, tool)(**kw)
        frames = out if isinstance(out, tuple) else (
            (out.nodes, out.edges) if hasattr(out, "nodes") and hasattr(out, "edges") else
            (out.nodes, out.edges, out.dependents) if hasattr(out, "dependents") else (out,))
        for df in frames:
            df.collect()


def _calls_graph(spark):
    return make_graph(
        spark, module=mods("A", "B"),
        function=[{"id": 1, "name": "alpha", "module_id": 0, "module_name": "A",
                   "function_signature": "foo -> (a -> b) -> b"},
                  {"id": 2, "name": "beta", "module_id": 1, "module_name": "B",
                   "function_signature": "Int"}],
        function_body=[{"id": 1, "raw_string": "let x = 1\nfoo x"}],
        function_called=[{"function_id": 1, "callee_id": 2, "name": "beta", "module_name": "B",
                          "site": 1}])


def test_pattern_match_honours_its_keys(spark):
    import pytest

    from codeweave.operators import patterns
    g = _calls_graph(spark)
    for mode in ("calls", "called_by"):
        out = patterns.pattern_match(g, "function_call", {"caller": "alpha", "callee": "beta",
                                                          "mode": mode})
        assert out.count() == 1
    assert patterns.pattern_match(g, "function_call", {"function": "beta", "target": "alpha",
                                                       "mode": "called_by"}).count() == 1
    high = patterns.pattern_match(g, "code_structure", {"structure_type": "higher_order"})
    assert [r["id"] for r in high.collect()] == [1]
    with pytest.raises(ValueError):
        patterns.pattern_match(g, "code_structure", {"kind": "higher_order"})


def test_code_patterns_read_bodies_only(spark):
    ca = CodeAnalytics(_calls_graph(spark))
    out = ca.find_code_patterns("foo", min_matches=1).collect()
    assert [(r["id"], r["matches"]) for r in out] == [(1, 1)]


def test_generate_imports_filters_by_element_in_every_style(spark):
    import pytest
    ca = CodeAnalytics(_calls_graph(spark))
    assert ca.generate_function_imports("noSuchElement").count() == 0
    assert [r["statement"] for r in ca.generate_function_imports("beta").collect()] == ["import B"]
    with pytest.raises(ValueError):
        ca.generate_function_imports("beta", import_style="prolog")
