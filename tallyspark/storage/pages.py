"""Sorted tables that are read page by page.

``write`` deals rows over ranges of their sort keys, sorts each range and keeps a directory: how many rows
each range has. A page's place is found in the directory, so it reads only the ranges that hold it, and
the number of rows reads none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a range on average.
RANGE = 100_000


def write(rows: DataFrame, order: Sequence[Column], path: str, ranges: int | None = None) -> None:
    """``rows`` under ``path`` in an order that tells all rows apart (so equal keys never lie in two ranges)."""
    n = ranges or max(1, -(-rows.count() // RANGE))
    name = "range"
    while name in rows.columns:
        name += "_"
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.spark_partition_id())
    dealt.write.partitionBy(name).parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/empty")
    held = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy(F.col(name).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    held.coalesce(1).write.parquet(f"{path}/directory")


def directory(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(range, rows) in order: one short row a range."""
    return [(r["range"], r["n"]) for r in spark.read.parquet(f"{path}/directory").orderBy("range").collect()]


def pagination(spark: SparkSession, path: str, number: int, size: int) -> dict[str, int]:
    """``total, page, page_size, pages`` from the directory alone."""
    total = sum(n for _, n in directory(spark, path))
    return {"total": total, "page": number, "page_size": size, "pages": -(-total // size) if size > 0 else 0}


def page(spark: SparkSession, path: str, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page in order; past the end, or of a size of 0, it is empty. Only the ranges that it lies in are read."""
    first, size = max(0, number - 1) * max(0, size), max(0, size)
    before, hit, skip = 0, [], 0
    for place, n in directory(spark, path):
        if before < first + size and first < before + n:
            skip = skip if hit else first - before
            hit.append(place)
        before += n
    if not hit:
        return spark.read.parquet(f"{path}/empty")
    name = spark.read.parquet(f"{path}/rows").columns[-1]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/{name}={place}" for place in hit])
    return rows.drop(name).orderBy(*order).offset(skip).limit(size)
