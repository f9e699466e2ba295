"""Sharding by size-tiered compaction: immutable shards, runs of similar size merged into
target-sized files, and a manifest whose versions are committed by one atomic rename.

A run is what one append or one merge wrote: a folder of Parquet shards. Data moves through
Spark's readers and writers alone; the driver handles file names and sizes. Rows are kept as they
are, so nulls in any column, empty and very long texts, ties and repeated rows come back as they
went in; no column name is reserved. A table without rows has a schema and reads as empty.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 4  # runs of one tier that make a merge
BASE = 1 << 20  # bytes of the smallest tier
TARGET = 128 << 20  # bytes of a merged file
AT_ONCE = 4  # merges
CODEC = "zstd"  # Snappy keeps buffers outside the heap until a collection


@dataclass(frozen=True)
class Run:
    folder: str
    bytes: int
    files: int
    level: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """A table of immutable shards under root. Readers see the last committed version, whole."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, base: int = BASE, target: int = TARGET):
        self.spark, self.root, self.fanout, self.base, self.target = spark, root, fanout, base, target
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name: str) -> list[tuple[str, int]]:
        path = self._path(name)
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max((int(n[1:9]) for n, _ in self._list("manifests") if n.startswith("v")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "runs": []}
        stream = self._fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**r) for r in self._manifest(version)["runs"]]

    def schema(self, version: int | None = None) -> T.StructType | None:
        """The columns of a version; None before the first."""
        kept = self._manifest(version)["schema"]
        return kept and T.StructType.fromJson(kept)

    def commit(self, runs: list[Run], version: int, schema: T.StructType | None = None) -> int:
        """Publish runs as the given version. The rename does not overwrite, so of two writers one fails."""
        kept = schema.jsonValue() if schema else self._manifest(version - 1)["schema"]
        draft, final = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/v{version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"schema": kept, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} exists") from e
        return version

    def _run(self, folder: str, level: int) -> Run:
        sizes = [n for name, n in self._list(folder) if name.endswith(".parquet")]
        return Run(folder, sum(sizes), len(sizes), level)

    def append(self, arrivals: DataFrame, by: str | Column | None = None) -> int:
        """Add rows as small shards. A column that the store has not is added to it, and is null in all other rows; one of
        another type than the store's is refused. With by, a column or an expression, each of its values is an arrival of its own, null and the empty text are one; all are written in one pass, and each is
        committed as a version of its own. No rows make a version that adds none. A version that another writer
        took is tried again as the next."""
        own = {f.name.lower(): T.StructField(f.name, f.dataType) for f in arrivals.schema.fields}
        name = "arrival"
        while name in own:
            name += "_"
        stage = f"shards/{uuid.uuid4().hex}"
        value = F.lit(0) if by is None else F.col(by) if isinstance(by, str) else by
        # Spark lists no folder of hidden names, so the folders of partitions are named by value only.
        arrivals.withColumn(name, value).write.option("compression", CODEC).partitionBy(name).parquet(f"{self.root}/{stage}")
        new = [self._run(f"{stage}/{folder}", 0) for folder, _ in self._list(stage) if folder.startswith(f"{name}=")]
        for run in new or [None]:
            while True:
                now = self.version()
                kept = {f.name.lower(): f for f in self.schema(now) or []}
                if wrong := [c for c, f in own.items() if c in kept and kept[c].dataType != f.dataType]:
                    raise ValueError(f"of another type in the store: {', '.join(wrong)}")
                try:
                    self.commit([*self.runs(now), *([run] if run else [])], now + 1, T.StructType([*(kept | {c: f for c, f in own.items() if c not in kept}).values()]))
                    break
                except Conflict:
                    continue
        return self.version()

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.base, self.fanout)))

    def plan(self, runs: list[Run]) -> list[list[Run]]:
        """Groups of fanout runs of one tier, oldest first."""
        tiers: dict[int, list[Run]] = {}
        for run in runs:
            tiers.setdefault(self.tier(run), []).append(run)
        return [t[at : at + self.fanout] for _, t in sorted(tiers.items()) for at in range(0, len(t) - self.fanout + 1, self.fanout)]

    def read(self, runs: list[Run] | None = None) -> DataFrame:
        """The rows of the given runs, or of the last version; none, of its columns, from a version without rows."""
        schema = self.schema()
        if schema is None:
            raise FileNotFoundError(f"{self.root} has no version")
        kept = [f"{self.root}/{r.folder}" for r in (self.runs() if runs is None else runs) if r.files]
        if not kept:
            return self.spark.createDataFrame([], schema)
        # Paths are read as they are: a folder of one arrival has no partition column.
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*kept)

    def merge(self, group: list[Run], level: int) -> Run:
        """One run from several: files of about the target size, rows neither shuffled nor sorted."""
        folder = f"shards/{uuid.uuid4().hex}"
        files = max(1, round(sum(r.bytes for r in group) / self.target))
        self.read(group).coalesce(files).write.option("compression", CODEC).parquet(f"{self.root}/{folder}")
        return self._run(folder, level)

    def compact(self) -> int:
        """Merge until no tier holds fanout runs. Each round is one version; its merges are independent and run AT_ONCE
        together. If another writer commits first, what was merged is deleted and the round starts again."""
        while True:
            now = self.version()
            current = self.runs(now)
            groups = self.plan(current)
            if not groups:
                return self.version()
            with ThreadPoolExecutor(AT_ONCE) as pool:
                merged = list(pool.map(lambda g: self.merge(g, max(r.level for r in g) + 1), groups))
            gone = {r.folder for g in groups for r in g}
            try:
                self.commit([*(r for r in current if r.folder not in gone), *merged], now + 1)
            except Conflict:
                for run in merged:
                    self._fs.delete(self._path(run.folder), True)

    def vacuum(self) -> None:
        """Delete shards and manifests that the last version does not name. Readers of older versions must be done."""
        now = self.version()
        kept = {r.folder for r in self.runs(now)}
        for stage, _ in self._list("shards"):
            inside = [f"shards/{stage}/{n}" for n, _ in self._list(f"shards/{stage}") if "=" in n]
            if f"shards/{stage}" in kept:
                continue
            for folder in inside:
                if folder not in kept:
                    self._fs.delete(self._path(folder), True)
            if not any(f in kept for f in inside):
                self._fs.delete(self._path(f"shards/{stage}"), True)
        for name, _ in self._list("manifests"):
            if name != f"v{now:08d}.json":
                self._fs.delete(self._path(f"manifests/{name}"), False)
