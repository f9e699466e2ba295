"""Tile events as streams: folded state, windows of progress, a keyed state machine, and deduplication by micro-batch.

Micro-batches write whole versions named by their batch id, so a batch that is replayed after a failure
overwrites its own version and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import merge_new
from ..operators.tiles import KEY

EVENT = "area_id string, tx int, ty int, status string, ts timestamp, event_id long"


def read_events(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; a path that is a file is read through its folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).format("parquet")
    if per_batch:
        stream = stream.option("maxFilesPerTrigger", per_batch)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return stream.option("pathGlobFilter", hadoop.getName()).load(str(hadoop.getParent()))
    return stream.load(path)


def last_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the last finished batch under root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((str(x) for x in done), default=None)


def _versions(root: str, schema: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the last version before this batch and the batch's rows make the next version."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{root}/v{batch_id:012d}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        before = []
        if fs.exists(path):
            before = sorted(str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName() < f"v{batch_id:012d}" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        old = spark.read.schema(schema).parquet(before[-1]) if before else spark.createDataFrame([], schema)
        step(old, batch).write.mode("overwrite").parquet(own)
        for stale in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(stale), True)

    return write


STATE = "area_id string, tx int, ty int, status string, ts timestamp, event_id long, n_events long"


def _fold(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Each tile's last event and how many there were."""
    rows = old.unionByName(batch.select("area_id", "tx", "ty", "status", "ts", "event_id", F.lit(1).cast("long").alias("n_events")))
    last = F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id"))
    return rows.groupBy(*KEY).agg(last.alias("l"), F.sum("n_events").alias("n_events")).select(*KEY, "l.*", "n_events")


def fold_stream(events: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Read what is available, fold it into the versions under root, and return the last one."""
    spark = events.sparkSession
    events.writeStream.foreachBatch(_versions(root, STATE, _fold)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    version = last_version(spark, root)
    return spark.read.schema(STATE).parquet(version) if version else spark.createDataFrame([], STATE)


def dedupe_stream(pois: DataFrame, root: str, checkpoint: str, schema: str) -> DataFrame:
    """Keep POIs batch by batch: what is kept so far and the batch's are deduplicated together (see operators.dedupe)."""
    spark = pois.sparkSession
    step = lambda old, batch: merge_new(old, batch, "ordinal")
    pois.writeStream.foreachBatch(_versions(root, schema, step)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    version = last_version(spark, root)
    return spark.read.schema(schema).parquet(version) if version else spark.createDataFrame([], schema)


def progress(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window, area and status; works on streams (with a watermark) and on tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), "area_id", "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "area_id", "status", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Spells of work on an area without a pause longer than the gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "area_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "area_id", "n")


#: What may follow each status; a tile that is done stays so.
NEXT = {None: {"queued", "captured", "visited", "discarded"}, "queued": {"captured", "visited", "discarded"}, "captured": {"visited", "discarded", "queued"}, "visited": set(), "discarded": set()}


def state_machine(events: DataFrame) -> DataFrame:
    """Accepted changes of each tile's state, kept per key by Spark; changes that the machine forbids are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        accepted = []
        for status in rows["status"]:
            if status in NEXT[now]:
                now = status
                accepted.append(status)
        if accepted:
            state.update((now,))
            yield pd.DataFrame({"area_id": key[0], "tx": key[1], "ty": key[2], "status": [now], "n_changes": [len(accepted)]})

    return events.groupBy(*KEY).applyInPandasWithState(step, "area_id string, tx int, ty int, status string, n_changes int", "status string", "update", "NoTimeout")
