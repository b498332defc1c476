"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class HashTable:
    """Numbers by 64-bit hash: open addressing in two arrays, all lookups of a batch side by side."""

    def __init__(self, most: int) -> None:
        self.slots = 1 << max(4, (2 * most - 1).bit_length())
        self.keys, self.values, self.size = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), 0

    def _walk(self, hashes: np.ndarray, on: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Calls ``on(places, slots)`` for what is left, slot by slot, until it says that all are done."""
        todo = np.arange(len(hashes))
        at = (mix64(hashes) & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            left = ~on(todo, at)
            todo, at = todo[left], (at[left] + 1) & (self.slots - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 for those without one; hashes are not 0."""
        out = np.full(len(hashes), -1, np.int64)

        def look(todo: np.ndarray, at: np.ndarray) -> np.ndarray:
            key = self.keys[at]
            hit = key == hashes[todo]
            out[todo[hit]] = self.values[at[hit]]
            return hit | (key == 0)

        self._walk(hashes, look)
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """New hashes, each once."""

        def put(todo: np.ndarray, at: np.ndarray) -> np.ndarray:
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[todo[free]]
            own = free & (self.keys[at] == hashes[todo])
            self.values[at[own]] = numbers[todo[own]]
            return own

        self._walk(hashes, put)
        self.size += len(hashes)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset a temporary one, on one machine only (an error elsewhere)."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df``, dealt by ``key`` over as many partitions as shuffles have, as a table of as many buckets in the shared folder: joins by ``key`` don't shuffle it again."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts(spark), key).sortBy(key).option("compression", "zstd").option("path", shared_dir(spark, name)).saveAsTable(table)
    return spark.table(table)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_of(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``limit`` at most (a larger single item stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def id_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """About ``n - 1`` ascending bounds that cut the rows by a whole-number column into even ranges; one pass over that column."""
    if n < 2:
        return []
    ids = df.select(F.col(column).cast("long").alias("id"))
    return sorted({int(x) for x in ids.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n)})


def range_of(column: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the value: the ranges' numbers ascend with the ids, null is in the last one."""
    if not bounds:
        return F.lit(0)
    at, n = F.array(*[F.lit(b).cast("long") for b in bounds]), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    # A search by halves: as many steps as the number of bounds has bits.
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(at, low + step - 1) < column), low + step).otherwise(low))
    return F.when(column.isNull(), F.lit(n)).otherwise(found)


def small_or_shuffled(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows at most (of a few short columns); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(rows: DataFrame, groups: DataFrame, key: str, size: str, salt_from: str, per: int = 5000) -> DataFrame:
    """Left join of many ``rows`` to one row a key in ``groups``, large groups dealt over several tasks.

    A group of ``size`` rows is repeated ``ceil(size / per)`` times under as many salts, and each of
    its rows meets one of them, picked by the hash of ``salt_from``. Two hash joins: the first only
    looks up how many salts a key has among the few large groups, whose number is at most rows / per.
    """
    large = groups.where(F.col(size) > per).select(key, F.ceil(F.col(size) / per).cast("int").alias("__salts"))
    small = groups.where(F.col(size) <= per)
    dealt = rows.join(small_or_shuffled(large, 20_000), key, "left").withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(F.col(salt_from)), F.col("__salts"))).otherwise(F.lit(0)).cast("int"))
    spread = groups.where(F.col(size) > per).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / per).cast("int") - 1)))
    right = small.withColumn("__salt", F.lit(0)).unionByName(spread)
    return dealt.join(right, [key, "__salt"], "left").drop("__salt", "__salts")
