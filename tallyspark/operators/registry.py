"""Registration of documents, duplicates, selection and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IN_FLIGHT = ("PROCESSING", "EXTRACTING", "VALIDATING")


def salted_join(rows: DataFrame, groups: DataFrame, key: str, size: str, salt_from: str, per: int = 50_000) -> DataFrame:
    """Rows with their group's columns (one row a group, ``size`` rows in it); groups of over ``per`` rows are dealt over several tasks.

    Large groups are at most rows / ``per`` many; each is repeated under as many salts as it needs.
    """
    salts = F.ceil(F.col(size) / per).cast("int")
    large = groups.where(F.col(size) > per).select(key, salts.alias("__salts"))
    dealt = rows.join(large, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(salt_from), F.col("__salts")).cast("int"), F.lit(0)))
    spread = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("__salts").join(spread, [key, "__salt"], "left").drop("__salt")


def first_of_hash(documents: DataFrame, file_hash: str = "file_hash", key: str = "id") -> DataFrame:
    """Adds ``duplicate_of``: the lowest id with the same content, null for that one itself."""
    first = documents.groupBy(file_hash).agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n"))
    out = salted_join(documents, first, file_hash, "__n", key)
    return out.withColumn("duplicate_of", F.when(F.col("__first") != F.col(key), F.col("__first"))).drop("__first", "__n")


def register(found: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown paths as DISCOVERED, or DUPLICATE if a document that didn't fail (or an earlier new path) has the content."""
    new = found.join(known.select("file_path"), "file_path", "left_anti")
    old = known.where("status <> 'FAILED'").select("file_hash").distinct().withColumn("__old", F.lit(True))
    first = new.groupBy("file_hash").agg(F.min("file_path").alias("__first"), F.count(F.lit(1)).alias("__n")).join(old, "file_hash", "left")
    out = salted_join(new, first, "file_hash", "__n", "file_path")
    status = F.when(F.col("__old") | (F.col("file_path") != F.col("__first")), "DUPLICATE").otherwise("DISCOVERED")
    return out.withColumn("__old", F.coalesce("__old", F.lit(False))).withColumn("status", status).drop("__old", "__first", "__n")


def select_for_run(documents: DataFrame, force: bool = False, retry_failed: bool = False, retry_review: bool = False) -> DataFrame:
    """Documents to process; those left in flight by a broken run count as discovered."""
    wanted = ["DISCOVERED", *IN_FLIGHT]
    if retry_failed:
        wanted.append("FAILED")
    if retry_review:
        wanted.append("REVIEW_REQUIRED")
    rows = documents.where(F.col("status") != "DUPLICATE") if force else documents.where(F.col("status").isin(*wanted))
    return rows.withColumn("status", F.lit("DISCOVERED"))


def replace_documents(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the documents in ``new`` replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def acquisition_plan(companies: DataFrame, years: range, present: DataFrame) -> DataFrame:
    """Every company and year, ``AlreadyPresent`` or ``Missing``; the years are a short list."""
    axis = companies.sparkSession.range(years.start, years.stop).select(F.col("id").cast("int").alias("year"))
    have = present.select("company", "year").distinct().withColumn("__have", F.lit(True))
    plan = companies.crossJoin(F.broadcast(axis)).join(have, ["company", "year"], "left")
    return plan.withColumn("status", F.when(F.col("__have"), "AlreadyPresent").otherwise("Missing")).drop("__have")


def reset_for_retry(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is in ``ids`` as if newly found: status, error, times and results cleared; the others as they are."""
    chosen = ids.select("id").distinct().withColumn("__reset", F.lit(True))
    rows = documents.join(chosen, "id", "left")
    cleared = {c: F.when(F.col("__reset"), F.lit(None).cast(t)).otherwise(F.col(c)) for c, t in documents.dtypes if c in ("error_message", "started_at", "completed_at", "processing_time", "extraction_status", "validation_status", "avg_confidence")}
    return rows.withColumns(cleared | {"status": F.when(F.col("__reset"), "DISCOVERED").otherwise(F.col("status"))}).drop("__reset")
