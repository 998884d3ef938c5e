"""Incremental dump loading with Structured Streaming.

A dump directory that keeps receiving files (a compiler plugin writing new
JSON per build) is loaded as a file stream per entity: each new file is read
once, with the declared schema, in one pass. Good rows are appended to the
entity's plain parquet table (the one batch loads write, with no sink log,
so batch and stream loads of one table mix), malformed lines go to the
quarantine. The checkpoint lies beside the tables (``<dest>/_checkpoint``),
so another process goes on where the last one stopped.

A micro-batch is written to a staging folder and then moved under names that
carry its batch id; a batch that is run again after a failure first removes
what its earlier attempt moved. ``availableNow`` processes everything
present and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import CORRUPT
from ..sources.tables import ENTITY_SCHEMAS


def _publish(spark: SparkSession, df: DataFrame, dest: str, staging: str, tag: str) -> None:
    """Add ``df``'s files to ``dest`` under names that start with ``tag``,
    in place of any that do so already."""
    df.write.mode("overwrite").parquet(staging)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = path(dest)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    for f in fs.globStatus(path(f"{dest}/{tag}-*")):
        fs.delete(f.getPath(), False)
    for f in fs.globStatus(path(f"{staging}/part-*.parquet")):
        fs.rename(f.getPath(), path(f"{dest}/{tag}-{f.getPath().getName()}"))


def stream_entity(spark: SparkSession, root: str, dest: str, entity: str,
                  checkpoint_root: str | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    ckpt = f"{(checkpoint_root or dest.rstrip('/') + '/_checkpoint').rstrip('/')}/{entity}"
    fields = ENTITY_SCHEMAS[entity].fields
    schema = T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    cols = [f.name for f in fields]

    def load(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        tag, staging = f"stream-{batch_id:010d}", f"{ckpt}-staging"
        _publish(spark, batch.filter(F.col(CORRUPT).isNull()).select(*cols),
                 f"{dest}/{entity}", f"{staging}/good", tag)
        bad = batch.filter(F.col(CORRUPT).isNotNull()).select(
            F.col(CORRUPT).alias("record"), "file", *cols[:1])
        if not bad.isEmpty():
            _publish(spark, bad, f"{dest}/_quarantine/{entity}", f"{staging}/bad", tag)
        batch.unpersist()
    rows = reader.json(f"{root}/{entity}").withColumn("file", F.col("_metadata.file_path"))
    writer = rows.writeStream.foreachBatch(load).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="30 seconds")
    return writer.start()


def stream_dump(spark: SparkSession, root: str, dest: str, entities=None,
                checkpoint_root: str | None = None, available_now: bool = True,
                wait: bool = True) -> list[StreamingQuery]:
    """Start one stream per entity directory present under ``root``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    queries = []
    for entity in entities or ENTITY_SCHEMAS:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{entity}")
        if not p.getFileSystem(conf).exists(p):
            continue
        queries.append(stream_entity(spark, root, dest, entity, checkpoint_root, available_now))
    if wait and available_now:
        for q in queries:
            q.awaitTermination()
    return queries
