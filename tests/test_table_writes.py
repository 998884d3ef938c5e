"""Tables are written without large broadcasts, whatever their size on disk."""

from pyspark.sql import functions as F

from codeweave.operators import functions
from codeweave.session import MERGED, ROW_BROADCAST, _bytes, measured_joins
from codeweave.sources.ingest import write_table
from helpers import make_graph, modules as mods

CONF = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def written_plan(spark) -> str:
    """The final plan of the session's last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return runs.apply(runs.size() - 1).physicalPlanDescription().split("== Initial Plan ==")[0]


def test_written_join_broadcasts_by_rows_not_by_files(spark, scratch):
    n = 200_000     # about 1 MB as files, 26 MB as rows
    spark.range(n).select("id", F.lit("x" * 100).alias("name")).write.parquet(f"{scratch}/side")
    side = spark.read.parquet(f"{scratch}/side")
    both = side.join(side.withColumnRenamed("name", "path"), "id")
    before = [spark.conf.get(k, None) for k in CONF]
    assert "BroadcastHashJoin" in both._jdf.queryExecution().executedPlan().toString()
    out = write_table(spark, "module", both, f"{scratch}/out")
    assert "BroadcastExchange" not in written_plan(spark)
    assert out.count() == n
    few = spark.range(3).withColumn("path", F.lit("p"))     # measured as small: still broadcast
    out = write_table(spark, "module", side.join(few, "id"), f"{scratch}/few")
    assert "BroadcastExchange" in written_plan(spark)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2]
    assert [spark.conf.get(k, None) for k in CONF] == before


def test_measured_joins_keep_lower_limits_and_come_back(spark):
    assert [_bytes(x) for x in ("256k", "10485760b", "10MB", "-1", "1g")] == [
        262144, 10485760, 10485760, -1, 1 << 30]
    before = [spark.conf.get(k, None) for k in CONF]
    for limit, held in (("256k", 262144), ("-1", -1), ("1g", ROW_BROADCAST)):
        spark.conf.set(CONF[0], limit)
        try:
            with measured_joins(spark):
                assert [spark.conf.get(k) for k in CONF[:2]] == ["-1", str(held)]
                assert int(spark.conf.get(CONF[4])) == MERGED
                raise KeyError
        except KeyError:
            assert spark.conf.get(CONF[0]) == limit
        finally:
            spark.conf.unset(CONF[0])
            if before[0] is not None:
                spark.conf.set(CONF[0], before[0])
    assert [spark.conf.get(k, None) for k in CONF] == before


def test_function_side_of_call_sites_is_hashed_by_partition(spark):
    g = make_graph(
        spark, module=mods("A", "B"),
        function=[{"id": 1, "name": "f", "module_id": 0, "module_name": "A"},
                  {"id": 1, "name": "f", "module_id": 0, "module_name": "A"},    # keys may repeat
                  {"id": 2, "name": "g", "module_id": 1, "module_name": "B"},
                  {"id": 3, "name": None, "module_id": 1, "module_name": "B"}],
        function_called=[{"function_id": 1, "name": "g", "module_name": "B", "site": 1},
                         {"function_id": 1, "name": "g", "module_name": None, "site": 2},
                         {"function_id": None, "name": "g", "module_name": "B", "site": 3},
                         {"function_id": 2, "name": None, "module_name": "B", "site": 4}])
    keys = g.function.select("name", "module_name")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def sites(df):
        return sorted(r["site"] for r in df.collect())

    for k in (None, keys):
        by_module = functions.function_callers(g, k, limit=None, resolve="module")
        assert plan(by_module).count("ShuffledHashJoin") == 2
        assert sites(by_module) == [1, 1]
        by_name = functions.function_callers(g, k, limit=None)
        assert "ShuffledHashJoin" in plan(by_name)
        assert sites(by_name) == ([1, 1, 2, 2, 4] if k is None else [1, 1, 2, 2])
        callees = functions.function_callees(g, k, limit=None)
        assert "ShuffledHashJoin" in plan(callees)
        assert sites(callees) == [1, 1, 2, 2, 4]
    few = functions.function_callers(g, ["g"], limit=None, resolve="module")
    assert "ShuffledHashJoin" not in plan(few)
    assert sites(few) == [1, 1]
