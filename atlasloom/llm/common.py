"""What the corpus operators share: scratch tables, size-checked broadcasts, word classes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a broadcast may hold.
BROADCAST = 32 << 20
#: A key counts as hot if it holds more than a share of 1 / HOT of all rows, so there are fewer than HOT of them.
HOT = 100_000
#: What holds while a table is written: its shuffles are deleted as the write ends, and rows go to Python in batches that
#: stay small where texts are long.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: The white space that separates words; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where it is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="atlasloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, tag: str, **watched: Column) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: later jobs neither
    recompute it nor depend on an executor that held it. The shuffles of the write are deleted as it ends.
    What the write counted is in the table's seen: n, its rows, and the aggregates watched."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        # Snappy keeps buffers outside the heap until a collection; zstd frees its own.
        counts = Observation()
        df.observe(counts, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in watched.items())).write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    out.seen = counts.get
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def _bytes(field: T.StructField) -> "F.Column":
    """The bytes of a value of varying length."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(value)
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, _FIXED):
        return 8 * F.size(value)
    return F.octet_length(F.to_json(F.struct(value)))


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST) -> DataFrame:
    """df with a broadcast hint if its rows hold at most so many bytes; otherwise Spark shuffles it. rows, if known, is as many
    as df can have, which saves counting them."""
    fit = most // (16 + 8 * len(df.columns))
    if (df.limit(fit + 1).count() if rows is None else rows) > fit:
        return df
    wide = [f for f in df.schema.fields if not isinstance(f.dataType, _FIXED)]
    if wide:
        each = sum((F.coalesce(_bytes(f), F.lit(0)).cast("long") for f in wide), F.lit(16 + 8 * len(df.columns)))
        if (df.agg(F.sum(each)).first()[0] or 0) > most:
            return df
    return F.broadcast(df)


def spread_join(many: DataFrame, one: DataFrame, key: str, weight: str, rows: int, keys: int | None = None) -> DataFrame:
    """many, of about so many rows, with the row of one, unique by key, for each key, of which there are at most so many; weight
    counts the key's rows in many.
    A table that is small goes to every task. Otherwise the hot keys' rows alone do, fewer than HOT, and a key that is
    shuffled holds at most a share of 1 / HOT of the rows."""
    if (sent := small(one, keys)) is not one:
        return many.join(sent, key)
    hot = F.col(weight) > max(HOT, rows // HOT)
    held = many.join(F.broadcast(one.where(hot)), key)
    rest = many.join(F.broadcast(one.where(hot).select(key)), key, "left_anti").join(one.where(~hot), key)
    return held.unionByName(rest)


@functools.lru_cache(1)
def _trim():
    """glibc's call that returns free memory to the system; nothing elsewhere."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)


def lean(function):
    """function, for mapInArrow, so that its worker, which lives on for other tasks, gives back the memory that it used."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            _trim()(0)

    return run


def words(text) -> "F.Column":
    """The words of a text column as an array; empty for null."""
    trimmed = F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.length(trimmed) > 0, F.split(trimmed, rf"{SPACE}+")).otherwise(F.array().cast("array<string>"))
