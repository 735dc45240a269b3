"""One versioned value: the history of a setting or a tree's state, in an epoch store of its own."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from tidemark.errors import KeyStateError
from tidemark.operators import store
from tidemark.operators.epochs import EpochStore

_TABLE = "value"


class ValueStore:
    """A value of one SQL type by epoch. ``mode`` and ``first`` are those of the epoch store."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "string", mode: str = "open", first: int = 0) -> None:
        self.spark, self.kind = spark, kind
        self.epochs = EpochStore(spark, folder, {_TABLE: ["id"]}, mode, first)

    def fetch_at(self, epoch: int) -> Any:
        """The value at a user epoch; None before the first one was stored."""
        live = self.epochs.at(_TABLE, epoch)
        row = None if live is None else live.select("value").first()
        return None if row is None else row[0]

    def fetch(self) -> Any:
        return self.fetch_at(self.epochs.current().user)

    def store(self, epoch: int, value: Any) -> None:
        """Stores a value as a new epoch, whether or not there is one."""
        self._write(epoch, value, store.INSERT if self.fetch() is None else store.UPDATE)

    def update(self, epoch: int, value: Any) -> None:
        """Stores a value as a new epoch; there must be one already."""
        if self.fetch() is None:
            raise KeyStateError("there is no value to update")
        self._write(epoch, value, store.UPDATE)

    def _write(self, epoch: int, value: Any, op: str) -> None:
        rows = self.spark.createDataFrame([(op, 0, 0, value)], f"op string, seq int, id int, value {self.kind}")
        self.epochs.commit(epoch, {_TABLE: rows}, checked=False)

    def rollback(self, epoch: int) -> None:
        self.epochs.rollback(epoch)
