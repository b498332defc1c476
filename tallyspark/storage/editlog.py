"""An append-only log of edits that is read as a snapshot and a tail.

``append`` adds a batch; ``state`` folds the batches since the last snapshot and lays them over it;
``compact`` makes what ``state`` read the new snapshot and forgets the tail. Both are versions of one store
(``versions.Versions``), so a reader sees each batch either in the tail or in the snapshot. A snapshot
has one row a key, also of keys that an edit took back: a later edit still knows their first original.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.storage.versions import Conflict, Versions

SNAPSHOT = "snapshot"


class EditLog:
    """``keys`` name a cell; ``time`` (then the column ``id``) orders entries; ``revert``: whether an entry takes its cell's edits back."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], time: str, value: str, original: str, revert: Column) -> None:
        self.store = Versions(spark, root)
        self.keys, self.time, self.value, self.original, self.revert = list(keys), time, value, original, revert

    def _folded(self, log: DataFrame) -> DataFrame:
        """``keys, first, last, edits``: one row a key, combined before the shuffle."""
        at = [F.col(self.time).alias("t"), F.col("id").alias("id")]
        first = F.struct(*at, F.col(self.original).alias("o"))
        last = F.struct(*at, F.col(self.value).alias("v"), self.revert.alias("r"))
        return log.groupBy(*self.keys).agg(F.min(first).alias("first"), F.max(last).alias("last"), F.count(F.lit(1)).alias("edits"))

    def _state(self, tables: dict[str, str]) -> DataFrame | None:
        """All keys' folds, from the snapshot and the tail alone."""
        spark, parts = self.store.spark, []
        tail = [p for n, p in sorted(tables.items()) if n != SNAPSHOT]
        if SNAPSHOT in tables:
            parts.append(spark.read.parquet(tables[SNAPSHOT]))
        if tail:
            parts.append(self._folded(spark.read.parquet(*tail)))
        if len(parts) < 2:
            return parts[0] if parts else None
        return parts[0].unionByName(parts[1]).groupBy(*self.keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("edits").alias("edits"))

    def append(self, edits: DataFrame, tries: int = 5) -> int:
        """A further batch of entries; the version that holds it."""
        for _ in range(tries):
            base = self.store.last()
            try:
                return self.store.publish({f"tail-{base + 1:09d}": edits}, base)
            except Conflict:
                continue
        raise Conflict(f"no free version in {tries} tries")

    def compact(self) -> int:
        """The snapshot as of now instead of the tail. Batches that come in meanwhile make it fail, not vanish."""
        base = self.store.last()
        tables = self.store.tables(base)
        tail = [n for n in tables if n != SNAPSHOT]
        state = self._state(tables)
        return base if not tail or state is None else self.store.publish({SNAPSHOT: state}, base, drop=tail)

    def all_keys(self) -> DataFrame | None:
        return self._state(self.store.tables())

    def state(self) -> DataFrame:
        """``keys, original_value, value, edited_at, edits`` of the keys whose last entry stands; what ``edits.fold`` makes of the whole log."""
        rows = self.all_keys()
        if rows is None:
            raise ValueError("the log has no batch")
        return rows.where(~F.col("last.r")).select(*self.keys, F.col("first.o").alias("original_value"), F.col("last.v").alias("value"), F.col("last.t").alias("edited_at"), "edits")
