"""Spark session defaults and the lineage-cutting helper.

The library never creates a cluster session on its own: callers pass the
session they have. ``local_session`` exists for tests, the bench and the
examples, and sets only what a laptop run needs.
"""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on. AQE re-plans joins at runtime
# (a broadcast only when the measured side is under the threshold),
# coalesces small shuffle partitions and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A checkpoint's files go once nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# ``measured_joins``: the most bytes of rows that are broadcast, the least number
# of shuffle partitions before AQE merges small ones, and the most bytes it merges.
ROW_BROADCAST, MIN_PARTITIONS, MERGED = 10 << 20, 512, 16 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "codeweave") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is
    used as is. Only when it is unset (tests, local runs) is a fresh
    scratch folder created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        # A machine-local folder would not survive the loss of an executor.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store): "
                           "iterative operators checkpoint their state there")
    path = tempfile.mkdtemp(prefix="codeweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def _bytes(text: str) -> int:
    """A size as Spark's settings have it (``256k``, ``10485760b``, ``10MB``, ``-1``)."""
    n, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)b?\s*", text.lower()).groups()
    return int(n) << 10 * "bkmgtp".index(unit or "b")


@contextmanager
def measured_joins(spark: SparkSession):
    """What is written inside broadcasts a join side by its measured rows only,
    not by the size of its files: a table of 10 MB on disk can be hundreds of MB
    of rows, all of them sent through the driver and held by every task. Shuffles
    start with ``MIN_PARTITIONS`` at least and are merged up to ``MERGED`` bytes, so
    that a task's share does not grow with the table; a small side may fill few.
    Lower limits and higher counts of the session stay; its settings are put back
    at the end."""
    static = "spark.sql.autoBroadcastJoinThreshold"
    rows = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    filled = "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin"
    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = {k: spark.conf.get(k, None) for k in (static, rows, first, filled, merged)}
    most = _bytes(was[rows] or was[static] or str(ROW_BROADCAST))
    parts = int(was[first] or spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        spark.conf.set(static, "-1")
        spark.conf.set(rows, str(min(most, ROW_BROADCAST)))
        spark.conf.set(first, str(max(parts, MIN_PARTITIONS)))
        spark.conf.set(filled, "0")
        spark.conf.set(merged, str(min(_bytes(was[merged] or str(MERGED)), MERGED)))
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to reliable storage and return it with a short plan.

    Used by the iterative operators (frontier loops, components) so that
    each round's plan stays constant-size and a lost executor recomputes
    from the last checkpoint instead of from round zero.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
