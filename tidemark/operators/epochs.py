"""A versioned table on disk: an append-only log of changes by epoch, published by a manifest.

Commit writes one epoch's changes as Parquet, to a path of its own, and then creates the epoch's manifest entry, which only one commit can; readers
see only what the manifest names, so a commit is seen whole or not at all, a refused one touches nothing that is published, and one entry can publish
changes of several tables. Versions are derived from the log (``versions``). ``compact`` stores them: later reads take the last
compaction and the epochs after it. A commit checks its batch against the log rows of the batch's keys alone.
Rolling back drops manifest entries, and compactions that reach beyond it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.errors import EpochError
from tidemark.operators import store


@dataclass(frozen=True)
class Entry:
    incremental: int
    user: int
    paths: Mapping[str, str]
    #: The stream and the number of the micro-batch that this entry publishes, if it is one.
    source: tuple[str, int] | None = None


class EpochStore:
    """Tables (name: key columns) under one folder. ``mode``: open an existing store, create one where there is none, or reset."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, Sequence[str]], mode: str = "open", first: int = 0) -> None:
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), {k: list(v) for k, v in tables.items()}
        exists = self._exists(f"{self.folder}/manifest")
        if mode == "create" and exists:
            raise EpochError(f"there is a store at {folder}")
        if mode == "open" and not exists:
            raise EpochError(f"there is no store at {folder}")
        if mode == "reset" and exists:
            self._fs(self.folder).delete(self._path(self.folder), True)
        if mode in ("create", "reset"):
            self._write(f"{self.folder}/manifest/{0:012d}.json", {"incremental": 0, "user": first, "paths": {}, "source": None})

    # -- files, by the file system of the folder, so that any store Spark writes to will do
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs(name).exists(self._path(name))

    def _write(self, name: str, value: dict) -> None:
        """Creates a file with all of its content, or fails if there is one: of two writers one succeeds."""
        fs, draft, target = self._fs(name), self._path(f"{name}.{uuid.uuid4().hex}.draft"), self._path(name)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local rename would replace the file; a link never does
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark._jvm.org.apache.hadoop.fs
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
                jvm.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, none)
        except Exception as e:
            if fs.exists(target):
                raise EpochError(f"{name} was written by another commit") from e
            raise
        finally:
            fs.delete(draft, False)

    def _read(self, pattern: str) -> list[dict]:
        if not self._fs(pattern).globStatus(self._path(pattern)):
            return []
        return [json.loads(r.value) for r in self.spark.read.option("wholetext", True).text(pattern).collect()]

    def entries(self) -> list[Entry]:
        found = self._read(f"{self.folder}/manifest/*.json")
        return sorted((Entry(x["incremental"], x["user"], x["paths"], tuple(x["source"]) if x.get("source") else None) for x in found), key=lambda e: e.incremental)

    # -- reading
    def mapper(self) -> DataFrame:
        return self.spark.createDataFrame([(e.user, e.incremental) for e in self.entries()], "user_epoch bigint, incremental_epoch bigint")

    def current(self) -> Entry:
        return self.entries()[-1]

    def versions(self, table: str, only: DataFrame | None = None) -> DataFrame | None:
        """All versions of a table in incremental epochs, or those of the keys in ``only``; None before its first commit."""
        key, entries = self.tables[table], self.entries()
        done = max((x for x in self._read(f"{self.folder}/compacted/{table}/*.json") if x["through"] <= entries[-1].incremental), key=lambda x: x["through"], default=None)
        paths = [e.paths[table] for e in entries if table in e.paths and (done is None or e.incremental > done["through"])]
        some = (lambda rows: rows.join(only, key, "left_semi")) if only is not None else (lambda rows: rows)
        if done is None:
            return store.build_versions(some(self.spark.read.option("mergeSchema", True).parquet(*paths)), key, "epoch", "deleted") if paths else None
        old = some(self.spark.read.parquet(done["path"]))
        if not paths:
            return old
        # Versions that have ended stay as they are; those still open are the log's rows before the later epochs.
        later = some(self.spark.read.option("mergeSchema", True).parquet(*paths))
        still = old.where(F.col(store.UNTIL) == store.OPEN).withColumnRenamed(store.FROM, "epoch").drop(store.UNTIL).withColumn("deleted", F.lit(False))
        new = store.build_versions(still.unionByName(later, allowMissingColumns=True), key, "epoch", "deleted")
        return old.where(F.col(store.UNTIL) != store.OPEN).unionByName(new, allowMissingColumns=True)

    def at(self, table: str, user_epoch: int) -> DataFrame | None:
        """The table's live rows at a user epoch."""
        known = [e for e in self.entries() if e.user <= user_epoch]
        if not known or user_epoch > self.current().user:
            raise EpochError(f"epoch {user_epoch} is before the first or in the future")
        versions = self.versions(table)
        return None if versions is None else store.snapshot_at(versions, known[-1].incremental)

    # -- writing
    def commit(self, user_epoch: int, batches: Mapping[str, DataFrame], checked: bool = True, source: tuple[str, int] | None = None) -> Entry:
        """Publishes one epoch with the operations of ``batches`` (table: rows with op, seq, key and value columns). An empty commit is an epoch too."""
        last = self.current()
        if user_epoch <= last.user:
            raise EpochError(f"epoch {user_epoch} is not after {last.user}")
        number, paths = last.incremental + 1, {}
        try:
            for table, batch in batches.items():
                key = self.tables[table]
                if checked:
                    versions = self.versions(table, batch.select(*key).distinct())
                    if versions is None:
                        kinds = StructType([batch.schema[k] for k in key] + [StructField(store.UNTIL, LongType())])
                        versions = self.spark.createDataFrame([], kinds)
                    store.check_batch(versions, batch, key)
                net = store.net_changes(batch, key)
                rows = net.withColumn("deleted", F.col("op") == store.DELETE).withColumn("epoch", F.lit(number).cast("bigint")).drop("op", "seq", "__first", "__bad")
                paths[table] = f"{self.folder}/{table}/epoch-{number:012d}-{uuid.uuid4().hex}"
                rows.write.parquet(paths[table])
            entry = Entry(number, user_epoch, paths, source)
            self._write(f"{self.folder}/manifest/{number:012d}.json", {"incremental": number, "user": user_epoch, "paths": paths, "source": source})
        except Exception:
            for path in paths.values():  # nothing names them
                self._fs(path).delete(self._path(path), True)
            raise
        return entry

    def rollback(self, user_epoch: int) -> None:
        """Drops all epochs after a user epoch; the current one is no change."""
        entries = self.entries()
        if user_epoch < entries[0].user:
            raise EpochError(f"epoch {user_epoch} is before the first")
        if user_epoch > entries[-1].user:
            raise EpochError(f"epoch {user_epoch} is in the future")
        for e in reversed(entries):
            if e.user > user_epoch:  # compactions that know of it go before it does
                for table in self.tables:
                    for x in self._read(f"{self.folder}/compacted/{table}/*.json"):
                        if x["through"] >= e.incremental:
                            self._fs(self.folder).delete(self._path(x["entry"]), False)
        for e in reversed(entries):  # newest first: what is left is a whole history at any time
            if e.user > user_epoch:
                name = f"{self.folder}/manifest/{e.incremental:012d}.json"
                self._fs(name).delete(self._path(name), False)

    def compact(self, table: str, folder: str | None = None) -> DataFrame | None:
        """The table's versions, stored sorted by key for scans that skip files by key and epoch, and read from there from now on. None before its
        first commit."""
        through, versions = self.current().incremental, self.versions(table)
        if versions is None:
            return None
        name = f"{table}/{through:012d}-{uuid.uuid4().hex}"
        path = folder or f"{self.folder}/versions/{name}"
        versions.repartitionByRange(*self.tables[table]).sortWithinPartitions(*self.tables[table], store.FROM).write.parquet(path)
        entry = f"{self.folder}/compacted/{name}.json"
        self._fs(entry).mkdirs(self._path(f"{self.folder}/compacted/{table}"))
        self._write(entry, {"through": through, "path": path, "entry": entry})
        return self.spark.read.parquet(path)
