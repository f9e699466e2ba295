"""Queries that run as streams over what is available."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import tiles as st
from .registry import query
from .views import STATES, TILE_EVENTS, tile_events

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = st.read_events(spark, f"{sf_dir}/events.parquet", _EVENTS)
    user = F.col("user_id")
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "captured").when(F.col("event_type") == "error", "discarded").otherwise("visited")
    return raw.select(F.concat(F.lit("a"), (user % 3).cast("string")).alias("area_id"), (user % 23 - 11).cast("int").alias("tx"), (user % 17 - 8).cast("int").alias("ty"), status.alias("status"), "ts", "event_id")


def _folder(spark: SparkSession) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{shared}/stream-{uuid.uuid4().hex}"


@query("SELECT area_id, tx, ty, status, n_events FROM states", TILE_EVENTS, STATES)
def stream_tile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    return st.fold_stream(_stream(spark, sf_dir), f"{folder}/state", f"{folder}/checkpoint").select("area_id", "tx", "ty", "status", "n_events")


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, area_id, status, count(*) AS n FROM tile_events GROUP BY ALL", TILE_EVENTS)
def progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.progress(tile_events(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "SELECT CAST(min(ts) AS VARCHAR)[:19] AS start, area_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY area_id ORDER BY ts, event_id) AS spell FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY area_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM tile_events)) GROUP BY area_id, spell",
    TILE_EVENTS,
)
def work_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.sessions(tile_events(spark, sf_dir))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "area_id", "n")
