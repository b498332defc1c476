"""Tables bucketed by document and sorted: reads in order, joins and counts by document without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; all that are joined have as many. About 128 MB of a table's rows a bucket.
BUCKETS = 64


def save(rows: DataFrame, name: str, key: str = "document_id", order: Sequence[str] = ("id",), buckets: int = BUCKETS, path: str | None = None) -> None:
    """A table of ``buckets`` buckets by ``key``, each one file sorted by key, then ``order``; where ``path`` is given its files are there."""
    dealt = rows.repartition(buckets, key)
    writer = dealt.write.bucketBy(buckets, key).sortBy(key, *order).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def document_counts(spark: SparkSession, documents: str, values: str, checks: str, key: str = "document_id") -> DataFrame:
    """``key, n_values, n_findings`` of every document; with equal buckets no row is shuffled."""
    count = lambda name, n: spark.table(name).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    findings = spark.table(checks).where(F.col("status").isin("ERROR", "WARNING", "REVIEW_REQUIRED")).groupBy(key).agg(F.count(F.lit(1)).alias("n_findings"))
    out = spark.table(documents).select(key).join(count(values, "n_values"), key, "left").join(findings, key, "left")
    return out.select(key, F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def with_files(spark: SparkSession, values: str, documents: str, key: str = "document_id") -> DataFrame:
    """Values with their document's file; with equal buckets no row is shuffled."""
    return spark.table(values).join(spark.table(documents).select(key, "file_path"), key, "left")


def read_in_order(spark: SparkSession, name: str, ids: Sequence[int], key: str = "document_id", order: Sequence[str] = ("id",)) -> DataFrame:
    """The rows of some documents, in order: only their buckets are read."""
    return spark.table(name).where(F.col(key).isin(*ids)).orderBy(key, *order)
