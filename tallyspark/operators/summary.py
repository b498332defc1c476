"""Counts, distributions, coverage and shares over documents, checks and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower edges and names of the confidence buckets.
BUCKETS = ((0.0, 0.7, "0-70%"), (0.7, 0.8, "70-80%"), (0.8, 0.95, "80-95%"), (0.95, 1.01, "95-100%"))


def status_map(rows: DataFrame, key: str, status: str) -> DataFrame:
    """``key, documents, statuses``: the number of rows by status, as a map."""
    per = rows.groupBy(key, status).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("documents"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "n")))).alias("statuses"))


def totals(documents: DataFrame, company: str, pages: str, confidence: str) -> DataFrame:
    """One row: companies, documents, pages (null as 0), mean confidence."""
    return documents.agg(F.countDistinct(company).alias("companies"), F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(pages, F.lit(0))).alias("pages"), F.round(F.avg(confidence), 4).alias("mean_confidence"))


def run_summary(documents: DataFrame, values: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: companies, documents, pages, documents read by OCR and as text, values, checks, mean confidence, and documents by status as a map."""
    per = documents.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    statuses = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    main = documents.agg(
        F.countDistinct("company").alias("companies"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.count_if(F.coalesce("ocr_used", F.lit(False))).alias("ocr_documents"),
        F.count_if(F.coalesce(F.col("pdf_type") == "TEXT", F.lit(False))).alias("text_documents"), F.round(F.avg("avg_confidence"), 4).alias("average_confidence"),
    )
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return main.crossJoin(statuses).crossJoin(count(values, "extracted_values")).crossJoin(count(checks, "validation_checks"))  # one row each


def dashboard_counts(documents: DataFrame, values: DataFrame, checks: DataFrame, review_below: float = 0.8) -> DataFrame:
    """``section, name, status, n``: documents by their three statuses, checks by status, name and category, values of low confidence. One pass a table."""
    docs = documents.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("name"), F.lit(None).cast("string").alias("status")) for s, c in (("document_status", "status"), ("extraction_status", "extraction_status"), ("validation_status", "validation_status"))])))
    told = checks.select(F.inline(F.array(
        F.struct(F.lit("check_status").alias("section"), F.col("status").alias("name"), F.lit(None).cast("string").alias("status")),
        F.struct(F.lit("check_name").alias("section"), F.col("check_name").alias("name"), F.col("status").alias("status")),
        F.struct(F.lit("check_category").alias("section"), F.col("category").alias("name"), F.lit(None).cast("string").alias("status")),
    )))
    counts = docs.unionByName(told).where("name IS NOT NULL AND name <> ''").groupBy("section", "name", "status").agg(F.count(F.lit(1)).alias("n"))
    low = values.agg(F.lit("values").alias("section"), F.lit("low_confidence").alias("name"), F.lit(None).cast("string").alias("status"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < review_below).alias("n"))
    return counts.unionByName(low)


def coverage(documents: DataFrame, values: DataFrame) -> DataFrame:
    """One row: companies discovered, with and without values; documents in all and with values."""
    read = values.select(F.col("document_id").alias("id")).distinct().withColumn("__read", F.lit(True))
    per = documents.join(read, "id", "left").groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.count("__read").alias("read"))
    return per.agg(F.count(F.lit(1)).alias("companies_discovered"), F.count_if(F.col("read") > 0).alias("companies_with_values"), F.count_if(F.col("read") == 0).alias("companies_without_values"), F.sum("n").alias("documents_total"), F.sum("read").alias("documents_with_values"))


def unread_documents(documents: DataFrame, values: DataFrame) -> DataFrame:
    """``company, status, n`` of the companies none of whose documents has values."""
    owners = documents.join(values.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi").select("company").distinct()
    return documents.join(owners, "company", "left_anti").groupBy("company", "status").agg(F.count(F.lit(1)).alias("n"))


def unread_by_status(documents: DataFrame, values: DataFrame) -> DataFrame:
    """Those documents by status over all companies, most first."""
    return unread_documents(documents, values).groupBy("status").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "status")


def subsector_counts(subsectors: DataFrame, n: int = 12) -> DataFrame:
    """The subsectors with most companies (``company, subsector`` rows, one a company), ties by name."""
    return subsectors.groupBy("subsector").agg(F.count(F.lit(1)).alias("companies")).orderBy(F.desc("companies"), "subsector").limit(n)


def undeclared_subsectors(values: DataFrame, subsectors: DataFrame) -> DataFrame:
    """``undeclared``: companies with values but without a subsector."""
    return values.select("company").distinct().join(subsectors, "company", "left_anti").agg(F.count(F.lit(1)).alias("undeclared"))


def confidence_histogram(rows: DataFrame, column: str) -> DataFrame:
    """``bucket, n`` with empty buckets kept."""
    c = F.col(column)
    bucket = F.when(c < 0, None)
    for low, high, name in BUCKETS:
        bucket = bucket.when((c >= low) & (c < high), name)
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([(b[2],) for b in BUCKETS], "bucket string")
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def worst(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The keys with most rows, ties by key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), key).limit(n)


def field_coverage(winners: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, companies`` with a number; fields without any stay with 0."""
    counts = winners.where("value IS NOT NULL").groupBy("field").agg(F.countDistinct("company").alias("companies"))
    names = winners.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(counts, "field", "left").select("field", F.coalesce("companies", F.lit(0)).alias("companies"))


def without_values(documents: DataFrame, values: DataFrame, company: str) -> DataFrame:
    return documents.join(values.select(company), company, "left_anti")


def document_counts(documents: DataFrame, values: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Documents with their numbers of values and findings, 0 for none; counted before the joins."""
    v = values.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"))
    c = checks.where(F.col("status").isin("ERROR", "WARNING", "REVIEW_REQUIRED")).groupBy(key).agg(F.count(F.lit(1)).alias("n_findings"))
    return documents.join(v, key, "left").join(c, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_values", "n_findings")})


def statement_of_check(name: Column) -> Column:
    """The statement that a check's name speaks of; the first that fits."""
    return (
        F.when(name.contains("gross_profit") | name.contains("net_income"), "Income Statement").when(name.contains("cash"), "Cash Flow")
        .when(name.contains("treasury") | name.contains("capital"), "Equity").when(name == "no_checks_possible", "Document").otherwise("Balance Sheet")
    )


def statement_histogram(checks: DataFrame) -> DataFrame:
    """``statement, status, n``."""
    return checks.groupBy(statement_of_check(F.col("check_name")).alias("statement"), "status").agg(F.count(F.lit(1)).alias("n"))


def document_shares(checks: DataFrame) -> DataFrame:
    """``document_id, errors, valid, not_applicable``."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.groupBy("document_id").agg(n("ERROR").alias("errors"), n("VALID").alias("valid"), n("NOT_APPLICABLE").alias("not_applicable"))


def status_shares(checks: DataFrame) -> DataFrame:
    """``status, n, percent`` by whole-number division of all checks."""
    counts = checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", F.floor(F.col("n") * 100 / F.col("total")).cast("long").alias("percent"))


def mode_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; the smallest of equals."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))
    return per.groupBy(*keys).agg(F.min(rank).alias("m")).select(*keys, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


def slices(rows: DataFrame, category: str, value: str, order: Sequence[str]) -> DataFrame:
    """Sums by category in a fixed order, others after it, zeros dropped, with their place."""
    sums = rows.groupBy(category).agg(F.sum(value).alias("total")).where("total <> 0")
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col(category) == name, F.lit(i)).otherwise(place)
    return sums.withColumn("place", place)


def equity_shares(wide: DataFrame, keys: list[str], parts: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Each part over the first total that is there."""
    base = F.coalesce(*[F.col(t) for t in totals])
    return wide.select(*keys, base.alias("base"), *[F.when(base != 0, F.col(p) / base).alias(f"{p}_share") for p in parts])


def balance_bars(wide: DataFrame, keys: list[str], assets: str, liabilities: str, equity: str) -> DataFrame:
    """Liabilities and equity as percentages of assets between 0 and 100 (null where absent), and whether they add up within 1 %."""
    a, owed, e = F.col(assets), F.col(liabilities), F.col(equity)
    share = lambda x: F.when((a > 0) & x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x / a * 100)))
    return wide.select(*keys, share(owed).alias("liabilities_pct"), share(e).alias("equity_pct"), F.when(a > 0, F.abs(owed + e - a) / a < 0.01).alias("balanced"))
