"""Custom plans against brute force, and plan-shape checks."""

import dataclasses
import itertools
import random

import pyarrow.compute  # noqa: F401
import pytest

from codeweave.plans.graph import bfs, connected_components
from codeweave.plans.interval import point_in_span, window_overlaps
from codeweave.plans.setsim import similar_sets
from codeweave.plans.substring import contains_pairs
from codeweave.operators.similarity import similar_functions, similarity_groups


def test_contains_pairs_matches_brute_force(spark):
    rnd = random.Random(7)
    alpha = "ab_c"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    names = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 5))) for _ in range(40)})
    tdf = spark.createDataFrame([(t,) for t in texts], "text string")
    ndf = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["name"], r["text"]) for r in contains_pairs(ndf, tdf).collect()}
    want = {(n, t) for n in names for t in set(texts) if n in t}
    assert got == want


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _corpus(spark, n=40, seed=3):
    rnd = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    docs = []
    for i in range(n):
        if i % 7 == 3 and docs:
            docs.append((i, docs[rnd.randrange(len(docs))][1], f"src{i % 3}"))  # exact copy
        else:
            words = rnd.sample(vocab, rnd.randint(1, 6))
            docs.append((i, " ".join(w.upper() if rnd.random() < .3 else w for w in words),
                         f"src{i % 3}"))
    docs.append((n, "123 !!", "src0"))  # no letter tokens
    return docs, spark.createDataFrame(docs, "id long, text string, module string")


def _toks(text):
    import re
    return frozenset(re.findall(r"[^\W\d_]+", text.lower()))


@pytest.mark.parametrize("t", [0.5, 0.7, 1.0])
def test_similar_sets_matches_brute_force(spark, t):
    docs, df = _corpus(spark)
    s = similar_sets(df, t)
    members = {r["id"]: r["rep"] for r in s.members.collect()}
    toks = {i: _toks(x) for i, x, _ in docs if _toks(x)}
    assert set(members) == set(toks)
    reps = {}
    for i, ts in toks.items():
        reps.setdefault(ts, min(j for j, u in toks.items() if u == ts))
    assert all(members[i] == reps[ts] for i, ts in toks.items())
    want = set()
    for a, b in itertools.combinations(sorted(set(reps.values())), 2):
        j = _jaccard(toks[a], toks[b])
        if j >= t - 1e-12:
            want.add((a, b, round(j, 6)))
    got = {(r["rep_a"], r["rep_b"], r["score"]) for r in s.pairs.collect()}
    assert got == want


def test_similar_functions_top_k_matches_brute_force(spark):
    docs, df = _corpus(spark, n=50, seed=11)
    toks = {i: _toks(x) for i, x, _ in docs if _toks(x)}
    want = set()
    for i in toks:
        cand = sorted(((-round(_jaccard(toks[i], toks[j]), 6), j) for j in toks
                       if j != i and _jaccard(toks[i], toks[j]) >= 0.6 - 1e-12))[:3]
        want |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(cand)}
    got = {(r["id"], r["other_id"], r["score"], r["rank"])
           for r in similar_functions(df, threshold=0.6, limit=3).collect()}
    assert got == want


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(35)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    comp = {}
    for x in nodes:
        comp.setdefault(find(x), set()).add(x)
    want = {(x, min(c)) for c in comp.values() for x in c}
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {(r["node"], r["component"]) for r in connected_components(df).collect()}
    assert got == want


def test_similarity_groups_partition_members(spark):
    _, df = _corpus(spark, n=45, seed=9)
    g = similarity_groups(df, 0.6, min_group_size=1, limit=None).collect()
    ids = [r["member_id"] for r in g]
    assert len(ids) == len(set(ids))                      # each member in one group
    assert all(r["group_id"] <= r["member_id"] for r in g)


def test_bfs_depth_monotone(spark):
    rnd = random.Random(2)
    edges = spark.createDataFrame([(rnd.randrange(30), rnd.randrange(30)) for _ in range(60)],
                                  "src long, dst long")
    roots = spark.createDataFrame([(1, 1), (2, 2)], "root long, node long")
    d2 = {(r["root"], r["node"]): r["depth"] for r in bfs(edges, roots, 2).collect()}
    d3 = {(r["root"], r["node"]): r["depth"] for r in bfs(edges, roots, 3).collect()}
    assert set(d2) <= set(d3) and all(d3[k] == v for k, v in d2.items())
    full = {(r["root"], r["node"]) for r in bfs(edges, roots, None).collect()}
    assert set(d3) <= full


def test_interval_joins_match_brute_force(spark):
    rnd = random.Random(4)
    spans = []
    for i in range(80):
        s = rnd.randint(1, 400)
        spans.append((i, rnd.choice(["a", "b"]), s, s + rnd.randint(0, 150)))
    pts = [(i, rnd.choice(["a", "b", "c"]), rnd.randint(1, 560)) for i in range(120)]
    sdf = spark.createDataFrame(spans, "element_id long, src_file string, line_start long, line_end long")
    pdf = spark.createDataFrame(pts, "probe_id long, src_file string, line long")
    got = {(r["probe_id"], r["element_id"]) for r in point_in_span(pdf, sdf).collect()}
    want = {(p, e) for p, pf, ln in pts for e, f, s, t in spans if f == pf and s <= ln <= t}
    assert got == want
    got = [(r["probe_id"], r["element_id"]) for r in window_overlaps(pdf, sdf, 7).collect()]
    want = {(p, e) for p, pf, ln in pts for e, f, s, t in spans
            if f == pf and s <= ln + 7 and t >= ln - 7}
    assert len(got) == len(set(got)) and set(got) == want


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def test_registered_plans_avoid_nested_loops_and_python(spark):
    import __spark_entry__ as entry
    bad = {}
    for name, fn in entry.queries().items():
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_pattern_pushdown_and_column_pruning(spark, scratch):
    from codeweave.operators import functions
    from codeweave.sources.ingest import write_graph
    from helpers import make_graph, modules as mods
    g0 = make_graph(spark, module=mods("M"), function=[
        {"id": 1, "name": "hotkey", "module_id": 0, "function_signature": "A -> B"}],
        function_called=[{"function_id": 1, "name": "x"}])
    g = write_graph(g0, f"{scratch}/graph")
    plan = functions.search_functions(g, "hot*")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,hot)" in plan
    cplan = functions.function_complexity(g)._jdf.queryExecution().executedPlan().toString()
    # the function scan reads only the four columns the score needs
    assert "ReadSchema: struct<id:bigint,name:string,module_name:string,function_signature:string>" in cplan
    assert "src_file" not in cplan and "raw_string" not in cplan


def test_keyed_similarity_equals_the_full_answer_for_the_keys(spark):
    _, df = _corpus(spark, n=40, seed=9)
    cols = ("id", "other_id", "score", "rank")
    full = {tuple(r[c] for c in cols)
            for r in similar_functions(df, threshold=0.6, limit=3).collect() if r["id"] in (4, 10)}
    keyed = {tuple(r[c] for c in cols)
             for r in similar_functions(df, keys=[4, 10], threshold=0.6, limit=3).collect()}
    assert keyed == full and full


def test_components_of_a_hub(spark):
    edges = [(500, i) for i in range(1, 200)] + [(700, 701)]
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 200)}, 500: 1, 700: 700, 701: 700}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("head", [0, 2, 16])
def test_pairs_are_whole_whatever_the_head(spark, monkeypatch, threshold, head):
    """Near copies of one text, where pairs share many prefix tokens."""
    import random
    from codeweave.plans import setsim
    monkeypatch.setattr(setsim, "HEAD", head)
    rng = random.Random(head)
    word = lambda i: "w" + "".join(chr(97 + int(d)) for d in str(i))
    texts = []
    for base in (0, 100, 1000):
        core = [word(base + i) for i in range(30)]
        for _ in range(12):
            t = [w for w in core if rng.random() > 0.15]
            texts.append(" ".join(t + [word(5000 + rng.randrange(40))
                                       for _ in range(rng.randrange(6))]))
    texts += ["", None, texts[0], "lone words here"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    s = setsim.similar_sets(corpus, threshold)
    rep = {r["id"]: r["rep"] for r in s.members.collect()}
    sets = {i: frozenset(t.split()) for i, t in enumerate(texts) if t}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert rep == {i: first[x] for i, x in sets.items()}
    want = {(a, b) for a in first.values() for b in first.values() if a < b
            and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    got = [(r["rep_a"], r["rep_b"]) for r in s.pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("percent", [50, 70, 100])
def test_prefix_rows_are_short_and_only_near_sets_pass(percent):
    """A set's parity bits lie once in a group's row, not with every token, and
    only pairs near the threshold leave the tasks, all similar ones among them."""
    import numpy as np
    import pyarrow as pa
    from codeweave.plans import setsim
    rng = np.random.default_rng(percent)
    word = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    sets = [set(rng.choice(word[2000:], int(n), replace=False)) | set(word[:60])
            for n in rng.integers(100, 500, 60)]
    for s in sets[:20]:                            # near copies of two in three
        keep = [x for x in s if rng.random() > rng.choice([0, 0.05, 0.2])]
        sets.append(set(keep) | set(rng.choice(word, int(rng.integers(0, 8)))))
    lengths = setsim._Lengths(percent, 100)
    rare = np.zeros(setsim.BUCKETS, np.uint8)
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
        pa.array([False] * len(sets)),
        pa.array([np.array(sorted(s)).view(np.int64) for s in sets], pa.list_(pa.int64()))],
        names=["rep", "n", "key", "hs"])
    rows = pa.Table.from_batches(list(setsim._rows(rare, 8, lengths)([batch])))
    size = sum(len(x) for c in ("sig", "toks") for x in rows[c].to_pylist())
    assert size < 20 * sum(map(len, sets))
    got = set()
    for g, k in set(zip(rows["g"].to_pylist(), rows["cls"].to_pylist(), strict=True)):
        part = rows.filter((pa.compute.field("g") == g) & (pa.compute.field("cls") == k))
        met = setsim._met(lengths, False)(part)
        got |= set(zip(met["rep_a"].to_pylist(), met["rep_b"].to_pylist(), strict=True))
    near = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]])
            for p in itertools.combinations(range(len(sets)), 2)}
    want = {p for p, j in near.items() if 100 * j >= percent - 1e-9}
    assert want <= got and len(got - want) < len(near) / 20


def _prefix_rows(sets, percent, groups):
    """The rows of the sets, by (group, class)."""
    import numpy as np
    import pyarrow as pa
    from codeweave.plans import setsim
    lengths = setsim._Lengths(percent, 100)
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
        pa.array([i % 3 == 0 for i in range(len(sets))]),
        pa.array([np.array(sorted(s)).view(np.int64) for s in sets], pa.list_(pa.int64()))],
        names=["rep", "n", "key", "hs"])
    rows = pa.Table.from_batches(list(setsim._rows(
        np.zeros(setsim.BUCKETS, np.uint8), groups, lengths)([batch])))
    for g, k in sorted(set(zip(rows["g"].to_pylist(), rows["cls"].to_pylist(), strict=True))):
        yield rows.filter((pa.compute.field("g") == g) & (pa.compute.field("cls") == k))


def test_a_groups_tokens_meet_in_slices(monkeypatch):
    """A task holds its rows and one slice of the tokens, not arrays of all tokens."""
    import tracemalloc
    import numpy as np
    from codeweave.plans import setsim
    monkeypatch.setattr(setsim, "SLICE_TOKENS", 1 << 14, raising=False)
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(4000)]
    part = max(_prefix_rows(sets, 70, 1), key=len)
    tokens = sum(len(x) for x in part["toks"].to_pylist()) // 8
    tracemalloc.start()
    setsim._met(setsim._Lengths(70, 100), False)(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * tokens       # 8 are the tokens themselves


@pytest.mark.parametrize("keyed", [False, True])
def test_slices_find_the_pairs_of_a_whole_group(monkeypatch, keyed):
    import numpy as np
    from codeweave.plans import setsim
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(6):
        core = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        sets += [{x for x in core if rng.random() > 0.1} for _ in range(20)]
    lengths, parts = setsim._Lengths(70, 100), list(_prefix_rows(sets, 70, 3))

    def pairs():
        out = set()
        for part in parts:
            for batch in setsim._met_batches(lengths, keyed)(part.to_batches(max_chunksize=7)):
                out |= set(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True))
        return out
    want = pairs()
    near = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2)
            if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])
            and (not keyed or a % 3 == 0 or b % 3 == 0)}
    assert near and near <= want
    monkeypatch.setattr(setsim, "SLICE_TOKENS", 50)
    monkeypatch.setattr(setsim, "TASK_PAIRS", 20)
    assert pairs() == want


def test_graph_tables_are_written_when_asked_for(spark, scratch):
    import os
    from codeweave.registry import _WrittenGraph
    from helpers import make_graph, modules as mods
    g = _WrittenGraph(make_graph(spark, module=mods("M", "N")), f"{scratch}/graph")
    assert not os.path.exists(f"{scratch}/graph")
    assert g.module.count() == 2 and g.module is g.module
    assert os.listdir(f"{scratch}/graph") == ["module"]
    assert set(g.tables()) >= {"module", "function", "imports", "instance_function"}
    copy = dataclasses.replace(g, module=g.module.limit(1))
    assert copy.module.count() == 1 and copy.imports is g.imports


def test_walk_runs_are_joined_where_they_lie(spark):
    """A round shuffles its new pairs only: the runs of what was seen are
    neither shuffled nor sorted again, and their number stays small."""
    from codeweave.plans.graph import _Seen
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.range(400).selectExpr("id % 20 AS root", "id AS node")
        seen = _Seen(pairs, ["root", "node"])
        assert seen.add(pairs.limit(0), False) is None
        for i in range(1, 11):
            seen.add(pairs.selectExpr("root", f"node + {1000 * i} AS node"), False)
            if i == 2:
                step = pairs.distinct()
                for _, _, run in seen.runs:
                    step = step.join(run, ["root", "node"], "left_anti")
                outer = plan_outside_caches(
                    step._jdf.queryExecution().executedPlan().toString().splitlines())
                assert sum("Exchange hashpartitioning" in x for x in outer) == 1
                assert sum("SortMergeJoin" in x for x in outer) == 3
                assert sum(" Sort [" in x for x in outer) == 1
        # Eleven layers of 400 pairs: eight merged into one run, three as they came.
        assert [(rank, run.count()) for rank, _, run in seen.runs] == [
            (1, 3200), (0, 400), (0, 400), (0, 400)]
        assert seen.by_depth().groupBy("depth").count().count() == 10
        seen.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def plan_outside_caches(lines):
    """The lines of a plan that do not lie below a cached table."""
    out, cut = [], None
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-|"))
        if cut is not None and at > cut:
            continue
        cut = at if "InMemoryTableScan" in line else None
        out.append(line)
    return out
