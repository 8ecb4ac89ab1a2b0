"""A table of immutable files with a log of snapshots: readers keep what they began with, and a change happens whole or not at all.

Under the table's path lie
* data/batch=<id>/<key>=<value>/...: Parquet files, each of one key, sorted by time; never changed once written;
* lists/<id>: for each file of a snapshot its path, key, rows and least and greatest time, as a table;
* log/<version>.json: one line that names the snapshot's list. A version is committed when this file is whole.

A writer adds files, writes the list of what is to be valid and creates the next version's log file, which only one writer can. One that
dies before that leaves files that no list names (vacuum removes them); one that comes second gets Conflict, and appends, which
hold beside any other change, are then put upon the newer snapshot. Readers take a version's list, choose the files whose key and time
range are asked for, and open no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.store import kept

c = F.col
LIST = "file string, key string, low long, high long, rows long"


class Conflict(Exception):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Snapshot:
    """One committed version of a table."""

    version: int
    list: str
    schema: str
    marks: tuple[str, ...] = ()
    manifest: str | None = None


class Table:
    """A snapshot table laid out by a key column, with times in a timestamp column; per_file: rows of a file, about."""

    def __init__(self, spark: SparkSession, path: str, key: str = "symbol", ts: str = "ts", per_file: int = 5_000_000):
        self.spark, self.path, self.key, self.ts, self.per_file = spark, path.rstrip("/"), key, ts, per_file
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # the log

    def _log(self) -> dict[int, str]:
        top = self._jpath(f"{self.path}/log")
        if not self._fs.exists(top):
            return {}
        names = [s.getPath() for s in self._fs.listStatus(top)]
        return {int(p.getName().removesuffix(".json")): p for p in names if p.getName().endswith(".json")}

    def _text(self, at) -> str:
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """A version, by default the newest; a log file that isn't whole was never committed."""
        log = self._log()
        for n in sorted(log, reverse=True) if version is None else [version]:
            if n in log and (text := self._text(log[n])).endswith("\n"):
                told = json.loads(text)
                return Snapshot(n, told["list"], told["schema"], tuple(told["marks"]), told["manifest"])
        if version is not None:
            raise ValueError(f"no version {version} of {self.path}")
        return None

    def versions(self) -> list[int]:
        return sorted(n for n, at in self._log().items() if self._text(at).endswith("\n"))

    def files(self, snapshot: Snapshot | None) -> DataFrame:
        """file, key, low, high (microseconds) and rows of each file of a snapshot."""
        return self.spark.createDataFrame([], LIST) if snapshot is None else self.spark.read.schema(LIST).parquet(snapshot.list)

    def commit(self, base: Snapshot | None, files: DataFrame, schema: str, mark: str | None = None, manifest: DataFrame | None = None) -> Snapshot:
        """Makes files the table's next snapshot after base; Conflict if there is a newer one."""
        top = f"{self.path}/lists/{uuid.uuid4().hex}"
        files.select("file", "key", "low", "high", "rows").write.parquet(top)
        told = None
        if manifest is not None:
            told = f"{self.path}/lists/{uuid.uuid4().hex}"
            manifest.write.parquet(told)
        newest = self.snapshot()
        if (newest and newest.version) != (base and base.version):
            raise Conflict(f"{self.path} is at {newest and newest.version}, not at {base and base.version}")
        n = max(self._log(), default=0) + 1
        marks = [*(base.marks if base else ()), *([mark] if mark else [])][-1000:]
        line = json.dumps({"list": top, "schema": schema, "marks": marks, "manifest": told}) + "\n"
        at = self._jpath(f"{self.path}/log/{n:020d}.json")
        try:
            stream = self._fs.create(at, False)  # fails if another writer was there first
        except Exception as e:
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                raise Conflict(f"version {n} of {self.path} was committed meanwhile") from e
            raise
        stream.write(bytearray(line.encode()))
        stream.close()
        return Snapshot(n, top, schema, tuple(marks), told)

    # writing

    def add_files(self, df: DataFrame) -> DataFrame:
        """Writes df into new files, which no snapshot names yet; returns their list.

        Rows are dealt out by ranges of key and time, so a key with most of the rows is many tasks and files, and files
        have narrow ranges."""
        batch = f"{self.path}/data/batch={uuid.uuid4().hex}"
        parts = max(1, -(-df.count() // self.per_file))
        df.repartitionByRange(parts, self.key, self.ts).sortWithinPartitions(self.key, self.ts).write.partitionBy(self.key).parquet(batch)
        micros = F.unix_micros(c(self.ts).cast("timestamp"))
        stats = [F.min(micros).alias("low"), F.max(micros).alias("high"), F.count(F.lit(1)).alias("rows")]
        held = self._read([batch], df.schema)
        file = F.url_decode(F.replace(c("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # as a path, not as a URI
        return kept(held.select(file.alias("file"), c(self.key).cast("string").alias("key"), self.ts).groupBy("file", "key").agg(*stats))

    def _read(self, files: list[str], schema: T.StructType) -> DataFrame:
        fields = [*[f for f in schema.fields if f.name != self.key], T.StructField("batch", T.StringType()), schema[self.key]]
        return self.spark.read.schema(T.StructType(fields)).option("basePath", f"{self.path}/data").parquet(*files)

    def append(self, df: DataFrame, mark: str | None = None, tries: int = 10) -> Snapshot:
        """Adds rows. mark: a name of this change; a change whose name a snapshot has is not made again."""
        files = None
        for _ in range(tries):
            base = self.snapshot()
            if base and mark and mark in base.marks:
                return base
            files = self.add_files(df) if files is None else files
            try:
                return self.commit(base, self.files(base).unionByName(files), df.schema.json(), mark, self.manifest(base))
            except Conflict:
                continue  # an append holds upon any newer snapshot
        raise Conflict(f"{self.path}: {tries} other commits came first")

    def manifest(self, snapshot: Snapshot | None) -> DataFrame | None:
        return self.spark.read.parquet(snapshot.manifest) if snapshot and snapshot.manifest else None

    def replace(self, df: DataFrame, gone: DataFrame, base: Snapshot | None, manifest: DataFrame | None = None) -> Snapshot:
        """In one commit, takes all files of the keys in gone (key, as text) out of base and puts in df."""
        stay = self.files(base).join(gone.select(c("key").alias("_key")), c("key").eqNullSafe(c("_key")), "left_anti")
        return self.commit(base, stay.unionByName(self.add_files(df)), df.schema.json(), None, manifest)

    def refresh(self, source: DataFrame) -> Snapshot:
        """Brings the table to what source has: keys with another row count or hash are written anew, vanished ones leave, the rest stays.

        The hash is a sum over rows, so repeated rows count each time. All of it is one commit; if nothing differs, there is none."""
        base = self.snapshot()
        total = F.sum(F.xxhash64(*[f"`{x}`" for x in sorted(source.columns)]).cast("decimal(38,0)")).cast("string")
        now = source.groupBy(c(self.key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows"), total.alias("hash"))
        now = kept(now)
        old = self.manifest(base)
        old = self.spark.createDataFrame([], now.schema) if old is None else old
        alike = old.select(c("key").alias("_key"), c("rows").alias("_rows"), c("hash").alias("_hash"))
        same = c("key").eqNullSafe(c("_key")) & (c("rows") == c("_rows")) & (c("hash") == c("_hash"))
        changed = now.join(alike, same, "left_anti").select("key")
        vanished = self.files(base).select("key").distinct().join(now.select(c("key").alias("_key")), c("key").eqNullSafe(c("_key")), "left_anti")
        gone = kept(changed.unionByName(vanished).distinct())
        if gone.isEmpty() and base is not None:
            return base
        fresh = source.join(gone.select(c("key").alias("_key")), c(self.key).cast("string").eqNullSafe(c("_key")), "left_semi")
        return self.replace(fresh, gone, base, now)

    # reading

    def chosen(self, snapshot: Snapshot, keys: list[str] | None = None, start: str | None = None, end: str | None = None) -> list[str]:
        """The files of a snapshot that may have rows of the keys in [start, end)."""
        micros = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
        listed = self.files(snapshot)
        if keys is not None:
            listed = listed.filter(c("key").isin(keys))
        if start is not None:
            listed = listed.filter(c("high") >= micros(start))
        if end is not None:
            listed = listed.filter(c("low") < micros(end))
        return [r[0] for r in listed.select("file").collect()]

    def read(self, snapshot: Snapshot | None = None, keys: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows of a snapshot, by default the newest, of the keys in [start, end)."""
        snapshot = snapshot or self.snapshot()
        if snapshot is None:
            raise ValueError(f"{self.path} has no snapshot")
        schema = T.StructType.fromJson(json.loads(snapshot.schema))
        files = self.chosen(snapshot, keys, start, end)
        if not files:
            return self.spark.createDataFrame([], schema)
        out = self._read(files, schema)
        kind = schema[self.ts].dataType
        if start is not None:
            out = out.filter(c(self.ts) >= F.lit(start).cast(kind))
        if end is not None:
            out = out.filter(c(self.ts) < F.lit(end).cast(kind))
        return out.select(*[c(f"`{f.name}`") for f in schema.fields])

    def vacuum(self, keep: int = 1) -> int:
        """Removes the versions before the last keep ones, and files and lists that no version left names; returns how many.

        Not to be run beside a writer, whose files no snapshot names yet."""
        left = [self.snapshot(n) for n in self.versions()[-keep:]]
        batch = F.regexp_extract("file", "/batch=([^/]+)/", 1)
        batches = {r[0] for s in left for r in self.files(s).select(batch).distinct().collect()}
        lists = {x.rsplit("/", 1)[1] for s in left for x in (s.list, s.manifest) if x}
        gone = 0
        for folder, used in (("data", {f"batch={b}" for b in batches}), ("lists", lists), ("log", {f"{s.version:020d}.json" for s in left})):
            top = self._jpath(f"{self.path}/{folder}")
            for status in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if status.getPath().getName() not in used:
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        return gone


def sink(table: Table, run: str):
    """A foreachBatch function that appends each micro-batch once, however often it is delivered."""
    return lambda df, batch_id: table.append(df, mark=f"{run}/{batch_id}")
