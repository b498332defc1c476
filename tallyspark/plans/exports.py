"""Reports: ordered tables, the review queue, summaries; and how they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.quality import export_flag


def ordinal(column: str, order: Sequence[str]) -> Column:
    """A name's place in ``order``, after all of them if it isn't there."""
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col(column) == name, F.lit(i)).otherwise(place)
    return place


def report_order(statements: Sequence[str], headline: Sequence[str]) -> list[Column]:
    """Year (null last), statement, headline field, field, page, id; the report puts the company before them."""
    return [F.col("year").asc_nulls_last(), ordinal("statement", statements), ordinal("field", headline), F.col("field"), F.col("page"), F.col("id")]


def financial_report(values: DataFrame, documents: DataFrame, statements: Sequence[str], headline: Sequence[str]) -> DataFrame:
    """Every value with its file and flags, by company and ``report_order``: one range sort."""
    joined = values.join(documents.select(F.col("id").alias("document_id"), "file_path"), "document_id", "left")
    flagged = joined.withColumn("data_flags", export_flag(F.col("normalized_value"), F.col("field"), F.col("unit"), F.col("currency")))
    return flagged.orderBy("company", *report_order(statements, headline))


def diagnostics(checks: DataFrame, documents: DataFrame) -> DataFrame:
    """Checks with their file and the status of the company's first document."""
    first = documents.groupBy("company").agg(F.min_by("status", "id").alias("company_status"))
    files = documents.select(F.col("id").alias("document_id"), "file_path")
    return checks.join(files, "document_id", "left").join(first, "company", "left").orderBy("company", F.col("year").cast("string"), "check_name")


def document_log(documents: DataFrame) -> DataFrame:
    stamp = F.coalesce("completed_at", "updated_at", "created_at")
    return documents.select("id", "company", "filename", "status", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("finished"), F.round("processing_time", 2).alias("seconds"), F.when(F.col("ocr_used"), "YES").otherwise("NO").alias("ocr")).orderBy("company", "id")


def review_queue(values: DataFrame, checks: DataFrame, documents: DataFrame, review_below: float = 0.8) -> dict[str, DataFrame]:
    """The six review outputs by name."""
    failed = documents.where("status = 'FAILED'")
    return {
        "low_confidence": values.where(F.col("confidence") < review_below),
        "extraction_errors": failed.select("id", "company", F.explode(F.split("error_message", "; ")).alias("error")),
        "validation_errors": checks.where("status = 'ERROR'"),
        "validation_warnings": checks.where("status IN ('WARNING', 'REVIEW_REQUIRED')"),
        "failed_documents": failed,
        "duplicates": documents.where("status = 'DUPLICATE'"),
    }


def review_counts(outputs: dict[str, DataFrame]) -> DataFrame:
    """``output, n`` of all outputs."""
    out = None
    for name, df in outputs.items():
        one = df.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def statement_sheets(values: DataFrame, headline: Sequence[str], path: str) -> None:
    """One folder a statement, fields in the canonical order."""
    values.withColumn("field_ord", ordinal("field", headline)).sortWithinPartitions("statement", "field_ord").write.mode("overwrite").partitionBy("statement").parquet(path)


def errors_sheet(documents: DataFrame, checks: DataFrame) -> DataFrame:
    failed = documents.where("status = 'FAILED'").select("company", F.lit("document").alias("kind"), F.col("error_message").alias("message"))
    return failed.unionByName(checks.where("status = 'ERROR'").select("company", F.lit("check").alias("kind"), F.col("message")))


def rounded_metrics(documents: DataFrame, column: str = "metrics") -> DataFrame:
    """The JSON metrics with every fraction, however deep, rounded to three places; all else stays as it is written, also what is no JSON.

    The text is cut once into strings, numbers and what lies between; only numbers with a fraction change.
    """
    token = r'"(?:[^"\\]|\\.)*+"|-?[0-9]++(?:[.][0-9]++)?+(?:[eE][-+]?[0-9]++)?+|[^"0-9-]++|-'
    rounded = lambda t: F.when(t.rlike("^-?[0-9].*[.eE]"), F.round(t.try_cast("double"), 3).cast("string")).otherwise(t)
    text = F.col(column)
    sound = F.expr(f"try_parse_json(`{column}`)").isNotNull()
    return documents.withColumn(column, F.when(sound, F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), rounded), "")).otherwise(text))


def document_json(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One JSON text a key with all of its rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias(name))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header and empty nulls; ``one_file`` only for reports of a bounded size."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_partitioned_json(df: DataFrame, path: str, by: str = "company") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


REPORT = ("company", "year", "section", "field", "label", "raw_value", "normalized_value", "text_value", "currency", "unit", "page", "page_section", "source_file", "confidence", "extraction_method", "status", "data_flags")


def report_columns(report: DataFrame) -> DataFrame:
    """A financial report's 17 columns under their names in the file; columns that the values lack are null."""
    given = {"section": "statement", "label": "raw_label", "page_section": "section"}
    has = lambda c: F.col(c) if c in report.columns else F.lit(None).cast("string")
    file = F.element_at(F.split("file_path", "/"), -1)
    out = {c: has(given.get(c, c)) for c in REPORT} | {"source_file": F.coalesce(file, F.lit("")), "text_value": F.coalesce(has("text_value"), F.lit("")), "page_section": F.coalesce(has("section"), F.lit(""))}
    return report.select(*[c.alias(n) for n, c in out.items()])


def processing_report(documents: DataFrame) -> DataFrame:
    """One row a document as the processing report lists it."""
    return documents.select("company", F.col("file_path").alias("file"), "status", "pdf_type", F.col("page_count").alias("pages"), F.coalesce("ocr_used", F.lit(False)).alias("ocr_used"), "reporting_year", "avg_confidence", "extraction_status", "validation_status", "processing_time", F.col("error_message").alias("error"))


def write_processing(summary: DataFrame, documents: DataFrame, path: str) -> None:
    """``extraction_summary`` (one JSON line) and ``processing_report`` (a JSON line a document) under ``path``."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/extraction_summary")
    processing_report(documents).write.mode("overwrite").json(f"{path}/processing_report")


def summary_sheet(values: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The best value of each company, year and field, a column a field."""
    best = values.where(F.col("field").isin(*fields)).groupBy("company", "year", "field").agg(F.min_by("value", F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id"))).alias("value"))
    return best.groupBy("company", "year").pivot("field", list(fields)).agg(F.first("value"))


def raw_data(values: DataFrame, documents: DataFrame) -> DataFrame:
    """The raw-data sheet: every value with its file."""
    files = documents.select(F.col("id").alias("document_id"), F.element_at(F.split("file_path", "/"), -1).alias("source_file"))
    names = [c for c in ("company", "year", "statement", "field", "raw_label", "raw_value", "normalized_value", "currency", "unit", "page", "confidence", "extraction_method", "status") if c in values.columns]
    return values.join(files, "document_id", "left").select(*names, "source_file")


def validation_sheet(checks: DataFrame) -> DataFrame:
    return checks.select(*[c for c in ("company", "year", "check_name", "expected", "actual", "difference", "status", "severity", "category", "message") if c in checks.columns])
