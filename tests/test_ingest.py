"""Dump loading (S1-S4) and the streaming variant."""

import json
import os

import pytest

from codeweave.sources.ingest import load_dump, resolve_calls, validate_dump_dir
from codeweave.sources.tables import CodeGraph
from codeweave.streaming.ingest import stream_dump
from codeweave.operators.functions import function_complexity


def _write(path, rows, broken=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
        if broken:
            f.write(broken + "\n")


def _dump(root):
    _write(f"{root}/module/m.json", [{"id": 1, "name": "A", "path": "src/A.hs"},
                                     {"id": 2, "name": "B", "path": "src/B.hs"}])
    _write(f"{root}/function/deep/nested/f.json", [
        {"id": 10, "name": "f", "module_id": 1, "module_name": "A",
         "function_signature": "X -> Y -> Z -> W -> V"},
        {"id": 11, "name": "g", "module_id": 2, "module_name": "B"}], broken='{"id": 12, "name": ')
    _write(f"{root}/function_called/c.json",
           [{"function_id": 10, "name": "g", "module_name": "B"}] * 4)
    with open(f"{root}/function/notes.txt", "w") as f:
        f.write("not json")


def test_validate_dump_dir(spark, scratch):
    with pytest.raises(FileNotFoundError):
        validate_dump_dir(spark, f"{scratch}/missing")
    os.makedirs(f"{scratch}/empty/x")
    with pytest.raises(ValueError):
        validate_dump_dir(spark, f"{scratch}/empty")


def test_load_dump_and_query(spark, scratch):
    root, dest = f"{scratch}/dump", f"{scratch}/tables"
    _dump(root)
    report = {r["entity"]: (r["rows"], r["corrupt_rows"]) for r in
              load_dump(spark, root, dest, "setup").collect()}
    assert report["module"] == (2, 0)
    assert report["function"] == (2, 1)
    with pytest.raises(Exception):
        load_dump(spark, root, dest, "setup")        # refuses to overwrite
    load_dump(spark, root, dest, "drop")
    g = resolve_calls(CodeGraph.from_parquet(spark, dest))
    deps = [(r["caller_id"], r["callee_id"]) for r in g.function_dependency.collect()]
    assert deps == [(10, 11)]
    out = function_complexity(g, min_complexity=0, limit=None).collect()
    # 4 arrows -> 8, len 21 // 20 -> 1, 4 calls // 3 -> 1
    assert {r["id"]: r["complexity"] for r in out} == {10: 10, 11: 0}


def test_stream_dump_is_incremental(spark, scratch):
    root, dest = f"{scratch}/dump", f"{scratch}/stream-tables"
    _dump(root)
    stream_dump(spark, root, dest, entities=["module"], checkpoint_root=f"{scratch}/ckpt")
    assert spark.read.parquet(f"{dest}/module").count() == 2
    _write(f"{root}/module/m2.json", [{"id": 3, "name": "C", "path": "src/C.hs"}])
    stream_dump(spark, root, dest, entities=["module"], checkpoint_root=f"{scratch}/ckpt")
    assert sorted(r["id"] for r in spark.read.parquet(f"{dest}/module").collect()) == [1, 2, 3]


def test_load_dump_append_adds_rows(spark, scratch):
    root, more, dest = f"{scratch}/dump", f"{scratch}/dump2", f"{scratch}/tables"
    _dump(root)
    _write(f"{more}/module/extra.json", [{"id": 7, "name": "Z", "path": "src/Z.hs"}])
    load_dump(spark, root, dest, "setup")
    report = {r["entity"]: r["rows"] for r in load_dump(spark, more, dest, "append").collect()}
    assert report == {"module": 3}
    assert sorted(r["id"] for r in spark.read.parquet(f"{dest}/module").collect()) == [1, 2, 7]


def test_load_command_line(spark, scratch, capsys):
    from codeweave.load import main
    root, dest = f"{scratch}/dump", f"{scratch}/cli-tables"
    _dump(root)
    main(["--src", root, "--dest", dest, "--mode", "setup", "--local"])
    out = capsys.readouterr().out
    assert "function" in out and "loaded in" in out
    assert spark.read.parquet(f"{dest}/function").count() == 2


def test_batch_and_stream_loads_mix(spark, scratch):
    root, more, dest = f"{scratch}/dump", f"{scratch}/dump2", f"{scratch}/tables"
    _dump(root)
    load_dump(spark, root, dest, "setup")
    before = spark.read.parquet(f"{dest}/module").count()
    _write(f"{more}/module/a.json", [{"id": 11, "name": "S", "path": "src/S.hs"}],
           broken='{"id": oops')
    stream_dump(spark, more, dest, entities=["module"])
    assert spark.read.parquet(f"{dest}/module").count() == before + 1
    assert any("oops" in r["record"] for r in spark.read.option("mergeSchema", "true").parquet(
        f"{dest}/_quarantine/module").collect())
    # A later process (nothing but the folder in common) reads new files only.
    _write(f"{more}/module/b.json", [{"id": 12, "name": "T", "path": "src/T.hs"}])
    stream_dump(spark.newSession(), more, dest, entities=["module"])
    ids = [r["id"] for r in spark.read.parquet(f"{dest}/module").collect()]
    assert len(ids) == before + 2 and {11, 12} <= set(ids)
    third = f"{scratch}/dump3"
    _write(f"{third}/module/c.json", [{"id": 13, "name": "U", "path": "src/U.hs"}])
    load_dump(spark, third, dest, "append")
    assert spark.read.parquet(f"{dest}/module").count() == before + 3
    # A second destination gets everything.
    other = f"{scratch}/tables2"
    stream_dump(spark, more, other, entities=["module"])
    assert sorted(r["id"] for r in spark.read.parquet(f"{other}/module").collect()) == [11, 12]
