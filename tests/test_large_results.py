"""The largest step of a job is neither written nor shuffled again."""

import random

import pytest
from pyspark.sql import functions as F

from codeweave.operators import calls, imports, location, types
from codeweave.plans import graph
from helpers import make_graph, modules as mods


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def written(monkeypatch):
    """How often a plan is written to the checkpoint folder."""
    seen = []
    for module in (graph, calls):
        inner = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, f=inner: (seen.append(1), f(df))[1])
    return seen


@pytest.fixture()
def chain(spark):
    return make_graph(spark, module=mods("M"), function=[
        {"id": i, "name": f"f{i}", "module_id": 0, "module_name": "M"} for i in range(5)],
        function_dependency=[{"caller_id": i, "callee_id": i + 1} for i in range(4)])


def test_last_tree_level_is_not_written(chain, written):
    t = calls.call_tree(chain, ["f0"], max_depth=2)
    assert len(written) == 2        # the roots and level 1
    assert sorted(r["path"] for r in t.collect()) == [[0], [0, 1], [0, 1, 2]]
    assert [r["path"] for r in calls.call_tree(chain, ["f0"], max_depth=0).collect()] == [[0]]


def test_edges_walk_stops_above_the_last_layer(chain, monkeypatch):
    depths, walk = [], calls.bfs_masks
    monkeypatch.setattr(calls, "bfs_masks",
                        lambda e, r, depth, **kw: (depths.append(depth), walk(e, r, depth, **kw))[1])
    e = calls.call_graph_edges(chain, ["f0"], max_depth=2)
    assert depths == [1]
    assert sorted((r["src_id"], r["dst_id"]) for r in e.collect()) == [(0, 1), (1, 2)]
    assert calls.call_graph_edges(chain, ["f0"], max_depth=0).collect() == []


def test_last_layer_of_a_walk_read_once_is_not_written(chain, written):
    flat = calls.call_graph_flat(chain, None, max_depth=1)
    assert len(written) == 1        # the start
    assert sorted((r["root_id"], r["function_id"], r["depth"]) for r in flat.collect()) == sorted(
        [(i, i, 0) for i in range(5)] + [(i, i + 1, 1) for i in range(4)])


def test_walks_that_end_in_a_plan_equal_written_ones(spark):
    random.seed(5)
    ids = [random.randrange(-200, 200) for _ in range(120)] + [-2**63, 2**63 - 1]
    edges = {(random.choice(ids), random.choice(ids)) for _ in range(300)}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    r = spark.createDataFrame([(i, i) for i in set(ids)] + [(None, 1)], "root long, node long")

    def found(df):
        return sorted(tuple(x) for x in df.select("root", "node", "depth").collect())
    for depth in (1, 3, None):
        want = found(graph.bfs_masks(e, r, depth))
        assert want == found(graph.bfs_masks(e, r, depth, lazy=True, by_id=True))
        assert want == [x for x in found(graph.bfs(e, r.filter("root is not null"), depth,
                                                   lazy=True))]


def test_import_and_type_walks_leave_the_last_layer_unwritten(spark, written):
    g = make_graph(spark, module=mods("A", "B"), imports=[], **{
        "import": [{"id": 1, "module_id": 0, "module_name": "B"}],
        "type": [{"id": 1, "type_name": "T", "module_id": 0}, {"id": 2, "type_name": "U"}],
        "type_dependency": [{"dependent_id": 1, "dependency_id": 2}]})
    got = imports.import_graph(g, ["A"], depth=1)
    assert len(written) == 2 and [r["module"] for r in got.collect()] == ["B"]
    got = types.type_dependencies(g, ["T"], depth=1)
    assert len(written) == 3 and [r["type_name"] for r in got.collect()] == ["U"]


@pytest.fixture()
def common_type(spark):
    """A type that four modules define, named in a signature of a fifth."""
    return make_graph(spark, module=mods("A", "B", "C", "D", "E"), function=[
        {"id": 1, "name": "f", "module_id": 4, "module_name": "E", "function_signature": "T -> T",
         "src_file": "src/E.hs", "line_start": 1, "line_end": 9}],
        type=[{"id": i, "type_name": "T", "module_id": i % 4} for i in range(8)])


def test_external_types_are_counted_without_listing_them(common_type):
    c = location.function_context(common_type)
    assert "Aggregate [type_name" in optimized(c).replace("#", " ").replace("T -", "")
    assert c.first()["n_external_types"] == 4


def test_listed_modules_are_cut_per_type(spark, common_type):
    probes = spark.createDataFrame([(1, "src/E.hs", 3)], "probe_id long, src_file string, line long")
    got = location.location_items(common_type, probes, limit=2)
    assert "windowspecdefinition(type_name" in optimized(got)
    assert sorted((r["rank"], r["module_name"]) for r in got.collect()) == [(1, "A"), (2, "B")]


def test_lists_of_types_are_not_shuffled(common_type):
    items = location.function_context_items(common_type)
    assert optimized(items).startswith(("Union", "Project"))
    assert sorted(r["module_name"] for r in items.collect()) == ["A", "B", "C", "D"]
    need = location.generate_imports(common_type, style="explicit")
    assert optimized(need).startswith(("Union", "Project"))
    assert sorted(r["statement"] for r in need.collect()) == [f"import {m} (T)" for m in "ABCD"]


def test_list_of_one_type_is_shared_by_tasks(spark):
    """The pairs of functions and a type are few, the list of its modules is not."""
    g = make_graph(spark, module=mods(*[f"M{i}" for i in range(40)]), function=[
        {"id": i, "name": f"f{i}", "module_id": 99, "module_name": "X",
         "function_signature": "T -> T"} for i in range(60)],
        type=[{"id": i, "type_name": "T", "module_id": i} for i in range(40)])
    items = location.function_context_items(g).filter("kind = 'external_type'")
    assert items.select("function_id", "module_name").distinct().count() == items.count() == 2400
    assert items.select(F.spark_partition_id()).distinct().count() > 3


def test_last_layer_is_shuffled_once(spark):
    """The pairs of the last layer go to their node as lists and meet its name there."""
    g = make_graph(spark, module=mods("M"), function=[
        {"id": i, "name": f"f{i}", "module_id": 0, "module_name": "M"} for i in range(300)],
        function_dependency=[{"caller_id": i, "callee_id": (i * k + k) % 300}
                             for i in range(300) for k in (3, 7, 11)])
    flat = calls.call_graph_flat(g, None, max_depth=2)
    plan = flat._jdf.queryExecution().executedPlan().toString()
    pairs = plan[plan.index("ShuffledHashJoin"):plan.index("REPARTITION_BY_NUM")]
    assert "Generate explode" in pairs
    assert pairs.count("Exchange") == 1     # that of the lists
    e = {i: {(i * k + k) % 300 for k in (3, 7, 11)} for i in range(300)}
    want = {}
    for r in range(300):
        for n in [r, *e[r], *(x for m in e[r] for x in e[m])]:
            want.setdefault((r, n), 0 if n == r else 1 if n in e[r] else 2)
    assert {(r["root_id"], r["function_id"]): r["depth"] for r in flat.collect()} == want
    assert flat.count() == len(want)


def test_edges_to_null_count_alike_in_a_last_layer_that_stays_a_plan(spark):
    e = spark.createDataFrame([(1, 2), (1, None), (2, None), (2, 3), (3, 1), (None, 2)],
                              "src long, dst long")
    r = spark.createDataFrame([(i, i) for i in (1, 2, 3)], "root long, node long")

    def found(df):
        return sorted(tuple(x) for x in df.selectExpr("root", "coalesce(node, -1)", "depth").collect())
    for depth in (1, 2, 3):
        want = found(graph.bfs_masks(e, r, depth))
        assert want == found(graph.bfs_masks(e, r, depth, lazy=True, by_id=True))
        assert want == found(graph.bfs_masks(e, r, depth, lazy=True))
