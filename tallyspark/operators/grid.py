"""The results grid and the lists beside it: filters, facets, pivot, order, pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.names import company_key
from tallyspark.operators.winners import cell_winner, subsector_winner


def contains(column: str, wanted: str) -> Column:
    return F.lower(column).contains(wanted.lower())


def search(columns: Sequence[str], wanted: str) -> Column:
    """Case-insensitive in the columns' joined text; nulls left out."""
    return F.lower(F.concat_ws(" ", *columns)).contains(wanted.lower())


def currency_is(column: Column, wanted: str) -> Column:
    return column.isNull() if wanted.lower() == "none" else F.lower(F.trim(column)) == wanted.lower()


def in_subsectors(column: Column, wanted: Sequence[str]) -> Column:
    named = [w.lower() for w in wanted if w.lower() != "none"]
    out = F.lower(F.trim(column)).isin(*named) if named else F.lit(False)
    return F.coalesce(out, F.lit(False)) | column.isNull() if "none" in [w.lower() for w in wanted] else out


def profit_filter(rows: DataFrame, winners: DataFrame, keys: list[str], kind: str, field: str = "total_profit_loss") -> DataFrame:
    """Rows whose winning profit is above (``laba``) or below (``rugi``) zero; a missing one counts as 0."""
    kind = "laba" if kind.lower() in ("true", "1", "on", "yes") else kind
    profit = winners.where(F.col("field") == field).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("value").alias("__profit"))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(profit[f"__{k}"])  # a null year is a key
    joined = rows.join(profit, same, "left")
    value = F.coalesce("__profit", F.lit(0))
    return joined.where(value > 0 if kind == "laba" else value < 0).drop("__profit", *[f"__{k}" for k in keys])


def shown_columns(present: Sequence[str], headline: Sequence[str], requested: Sequence[str] | None = None) -> list[str]:
    """Requested fields once each, in order, all known; else the headline ones that are present."""
    if not requested:
        return [f for f in headline if f in set(present)]
    unknown = [f for f in requested if f not in set(present) | set(headline)]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return list(dict.fromkeys(requested))


def pivot(winners: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row a company and year with a column a field; by company in lower case, latest year first, undated last."""
    wide = winners.groupBy("company", "year").pivot("field", list(fields)).agg(F.first("value"))
    return wide.orderBy(F.lower("company"), F.col("year").desc_nulls_last(), "company")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the rows in order; past the end, or of a size of 0, it is empty."""
    return rows.orderBy(*order).offset(max(0, number - 1) * max(0, size)).limit(max(0, size))


def pagination(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One row: ``total, page, page_size, pages``."""
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), (F.ceil(F.col("total") / size) if size > 0 else F.lit(0)).cast("long").alias("pages"))


def scope(rows: DataFrame, company: str | None = None, year: int | None = None) -> DataFrame:
    """Rows of companies whose name holds the text, and of the year."""
    if company and company.strip():
        rows = rows.where(contains("company", company.strip()))
    return rows if year is None else rows.where(F.col("year") == year)


def _exact(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def documents_list(documents: DataFrame, wanted: str = "", company: str | None = None, **exact: object) -> DataFrame:
    """Documents by exact columns (status, validation_status), company and a search over company, file name and path."""
    rows = _exact(scope(documents, company), exact)
    return rows.where(search(["company", "filename", "file_path"], wanted.strip())) if wanted.strip() else rows


def checks_list(checks: DataFrame, wanted: str = "", company: str | None = None, **exact: object) -> DataFrame:
    """Checks by exact columns (status, check_name, category, year), company and a search over five columns."""
    rows = _exact(scope(checks, company), exact)
    return rows.where(search(["company", "check_name", "message", "expected", "actual"], wanted.strip())) if wanted.strip() else rows


def values_list(values: DataFrame, wanted: str = "", company: str | None = None, currency: str | None = None, least_confidence: float = 0.0, columns: Sequence[str] = ("company", "field", "raw_label", "raw_value", "text_value"), **exact: object) -> DataFrame:
    """Values by exact columns (statement, field, year, status), company, currency, confidence (null as 0) and a search."""
    rows = _exact(scope(values, company), exact).where(F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    if currency:
        rows = rows.where(currency_is(F.col("currency"), currency))
    return rows.where(search([c for c in columns if c in values.columns], wanted.strip())) if wanted.strip() else rows


def pages_list(pages: DataFrame, with_text: bool = False) -> DataFrame:
    """Pages with their text's length; the text itself only if it is asked for, so it isn't read otherwise than for that."""
    return pages.select(*[c for c in pages.columns if c != "text"], F.length(F.coalesce("text", F.lit(""))).alias("text_length"), *(["text"] if with_text else []))


def sort_columns(requested: str, allowed: dict[str, str], fallback: str, descending: bool = False) -> list[Column]:
    """Whitelisted sort: nulls last ascending, first descending; ties by id."""
    c = F.col(allowed.get(requested, fallback))
    return [c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col("id")]


def facet(rows: DataFrame, column: str, empty: str | None = "none") -> DataFrame:
    """``value, n``; nulls as ``empty``, or left out."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(empty)) if empty else F.col(column).cast("string")
    return rows.select(value.alias("value")).where("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``facet, value, n`` of several columns in one pass by grouping sets; nulls and empty values left out."""
    typed = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    grouped = typed.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"__g_{c}") for c in columns])
    which = F.coalesce(*[F.when(F.col(f"__g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"__g_{c}") == 0, F.col(c)) for c in columns])
    return grouped.select(which.alias("facet"), value.alias("value"), "n").where("value IS NOT NULL AND value <> ''")


@dataclass(frozen=True)
class Facet:
    """``value`` counted beside every filter but ``own``; ``selected`` values stay at 0. ``empty``: what nulls are called, or None to leave them out."""

    value: Column
    own: str | None = None
    selected: Sequence[str] = ()
    empty: str | None = "none"


def failed_bits(filters: dict[str, Column]) -> Column:
    """One bit a filter, in order, set where it isn't true."""
    total = F.lit(0).cast("long")
    for i, condition in enumerate(filters.values()):
        total = total + F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(F.lit(1 << i))
    return total


def filtered(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """The rows that all filters leave."""
    return rows.where(failed_bits(filters) == 0)


def facet_table(rows: DataFrame, filters: dict[str, Column], facets: dict[str, Facet]) -> DataFrame:
    """``facet, value, n`` of all facets in one scan: a row counts in a facet if it fails no filter but the facet's own.

    Each row carries the bits of the filters that it fails; it gives a row for each facet whose own bit
    alone, or no bit, is set. Counts combine before their one shuffle.
    """
    bit = {name: 1 << i for i, name in enumerate(filters)}
    cells = F.array(*[F.struct(F.lit(name).alias("facet"), F.nullif(F.coalesce(f.value.cast("string"), F.lit(f.empty)), F.lit("")).alias("value"), F.lit(bit.get(f.own, 0)).cast("long").alias("own")) for name, f in facets.items()])
    counted = rows.select(failed_bits(filters).alias("failed"), cells.alias("cells")).select(F.inline(F.filter("cells", lambda c: c["value"].isNotNull() & (F.col("failed").bitwiseAND(F.bitwise_not(c["own"])) == 0))))
    counts = counted.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    wanted = [(name, s.strip()) for name, f in facets.items() for s in dict.fromkeys(f.selected) if s.strip()]
    if not wanted:
        return counts
    # A facet's values and the selected ones are few; one that is there in whatever case isn't added.
    chosen = rows.sparkSession.createDataFrame(wanted, "facet string, value string")
    have = counts.select("facet", F.lower("value").alias("__low"))
    new = chosen.join(have, (chosen["facet"] == have["facet"]) & (F.lower(chosen["value"]) == have["__low"]), "left_anti")
    return counts.unionByName(new.withColumn("n", F.lit(0).cast("long")))


def facet_with_selected(counts: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Selected values stay in a facet with a count of 0."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(s,) for s in selected], "value string")
    return counts.unionByName(wanted.join(counts, "value", "left_anti").withColumn("n", F.lit(0).cast("long")))


def _seeded(counts: DataFrame, selected: Sequence[str], spell) -> DataFrame:
    """Selected values that a facet lacks, whatever their case, join it with a count of 0."""
    wanted = [spell(s.strip()) for s in dict.fromkeys(selected) if s.strip()]
    if not wanted:
        return counts
    rows = counts.sparkSession.createDataFrame([(s,) for s in wanted], "value string")
    have = counts.select(F.lower("value").alias("__have"))
    new = rows.join(have, F.lower(rows["value"]) == have["__have"], "left_anti")
    return counts.unionByName(new.withColumn("n", F.lit(0).cast("long")))


def currency_facet(values: DataFrame, columns: Sequence[str], selected: str | None = None) -> DataFrame:
    """``value, n`` over the shown columns' readings, whatever currency is selected; that one stays at 0."""
    counts = facet(values.where(F.col("field").isin(*columns)), "currency")
    return _seeded(counts, [selected] if selected else [], lambda s: s if s.lower() == "none" else s.upper())


def subsector_facet(rows: DataFrame, selected: Sequence[str] = ()) -> DataFrame:
    """``value, n`` of the rows that all other filters leave, before the subsector's own; selected ones stay at 0."""
    return _seeded(facet(rows, "subsector"), selected, lambda s: "none" if s.lower() == "none" else s)


def listed_before(rows: DataFrame, year: int, listed_on: str = "listed_on") -> DataFrame:
    """Rows of companies listed before the year; those without a date leave."""
    return rows.where(F.col(listed_on) < F.make_date(F.lit(year), F.lit(1), F.lit(1)))


def with_subsector(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Rows with their company's subsector, of all years, whatever years the rows are of."""
    return rows.join(subsector_winner(values), "company", "left")


def row_currency(values: DataFrame, keys: list[str]) -> DataFrame:
    """A row's only currency, ``Mixed`` for several (null is one of its own), ``Not detected`` for none."""
    codes = values.groupBy(*keys).agg(F.countDistinct(F.coalesce("currency", F.lit(""))).alias("n"), F.max("currency").alias("code"))
    return codes.select(*keys, F.when(F.col("n") > 1, "Mixed").otherwise(F.coalesce("code", F.lit("Not detected"))).alias("currency"))


def failed_checks(checks: DataFrame) -> DataFrame:
    """``company, year, failed``: a map of check to status, the last of equal names."""
    last = checks.where(F.col("status").isin("ERROR", "WARNING", "REVIEW_REQUIRED")).groupBy("company", "year", "check_name").agg(F.max_by("status", "id").alias("status"))
    return last.groupBy("company", "year").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("check_name", "status")))).alias("failed"))


def contributing_documents(values: DataFrame) -> DataFrame:
    """``company, year, documents``: by number of statements, then id."""
    per = values.groupBy("company", "year", "document_id").agg(F.array_sort(F.collect_set("statement")).alias("statements"))
    listed = F.sort_array(F.collect_list(F.struct((-F.size("statements")).alias("few"), F.col("document_id"), F.col("statements"))))
    return per.groupBy("company", "year").agg(F.transform(listed, lambda d: F.struct(d["document_id"].alias("document_id"), d["statements"].alias("statements"))).alias("documents"))


def results(values: DataFrame, fields: Sequence[str], checks: DataFrame | None = None, currency: str | None = None) -> DataFrame:
    """The whole grid: winners, masked by their own currency, pivoted, with currency and failed checks."""
    winners = cell_winner(values.where(F.col("field").isin(*fields)), ["company", "year", "field"])
    if currency:
        winners = winners.where(currency_is(F.col("currency"), currency))
    rows = pivot(winners, fields).join(row_currency(winners, ["company", "year"]).withColumnRenamed("company", "__c").withColumnRenamed("year", "__y"), F.col("company").eqNullSafe(F.col("__c")) & F.col("year").eqNullSafe(F.col("__y")), "left").drop("__c", "__y")
    if checks is not None:
        failed = failed_checks(checks).withColumnRenamed("company", "__c").withColumnRenamed("year", "__y")
        rows = rows.join(failed, F.col("company").eqNullSafe(F.col("__c")) & F.col("year").eqNullSafe(F.col("__y")), "left").drop("__c", "__y")
    return rows.orderBy(F.lower("company"), F.col("year").desc_nulls_last(), "company")


def export_rows(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The grid's rows for a file: failed checks and source documents comma-joined in order.

    ``documents``: ``company, year, documents`` as ``contributing_documents`` gives them.
    """
    named = documents.select(F.col("company").alias("__c"), F.col("year").alias("__y"), F.array_join(F.array_sort(F.transform("documents", lambda d: d["document_id"].cast("string"))), ", ").alias("source_documents"))
    out = rows.join(named, rows["company"].eqNullSafe(named["__c"]) & rows["year"].eqNullSafe(named["__y"]), "left").drop("__c", "__y")
    return out.withColumn("failed", F.array_join(F.array_sort(F.map_keys("failed")), ", ")) if "failed" in rows.columns else out


def export_notes(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """``note, value``: the filters in force and the number of rows."""
    spark = rows.sparkSession
    told = spark.createDataFrame([(k, v) for k, v in filters.items()], "note string, value string")
    return told.unionByName(rows.agg(F.lit("rows").alias("note"), F.count(F.lit(1)).cast("string").alias("value")))


def company_profile(values: DataFrame, documents: DataFrame, checks: DataFrame) -> DataFrame:
    """One row a company with documents: totals, currencies and the quality of its cells, by the grid's own winners.

    A cell is a year's field. Failed checks are distinct names, undated or of a year that has values
    (of any year where none has).
    """
    known = values.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    totals = known.groupBy("company").agg(
        F.countDistinct("document_id").alias("documents_with_values"), F.count(F.lit(1)).alias("figures"), F.countDistinct("year").alias("years"),
        F.countDistinct("field").alias("fields"), F.array_sort(F.collect_set("currency")).alias("currencies"),
    )
    order = F.struct((~F.coalesce("edited", F.lit(False))).alias("u"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id")) if "edited" in values.columns else F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id"))
    first = F.min_by(F.struct("status", "currency", *(["edited"] if "edited" in values.columns else [])), order)
    top, low = F.max("value"), F.min("value")
    cells = known.groupBy("company", "year", "field").agg(first.alias("w"), F.coalesce(F.when((F.count("value") >= 2) & (top > 0), (top - low) / top) > 0.5, F.lit(False)).alias("disputed"))
    settled = F.coalesce("w.edited", F.lit(False)) if "edited" in values.columns else F.lit(False)  # an edit settles a dispute
    quality = cells.groupBy("company").agg(F.count_if(F.col("disputed") & ~settled).alias("disputed_cells"), F.count_if(F.col("w.status") != "OK").alias("flagged_cells"), F.count_if(F.col("w.currency").isNull()).alias("cells_without_currency"))
    years = known.where("year IS NOT NULL").select("company", "year").distinct().withColumn("__has", F.lit(True))
    found = checks.where(F.col("status").isin("ERROR", "WARNING", "REVIEW_REQUIRED")).select("company", "year", "check_name").distinct()
    dated = found.join(years, ["company", "year"], "left").join(totals.select("company", F.col("years").alias("__axis")), "company", "left")
    failed = dated.where("year IS NULL OR __has OR coalesce(__axis, 0) = 0").groupBy("company").agg(F.countDistinct("check_name").alias("failed_checks"))
    out = documents.groupBy("company").agg(F.count(F.lit(1)).alias("documents")).join(totals, "company", "left").join(quality, "company", "left").join(failed, "company", "left")
    zeros = ("documents_with_values", "figures", "years", "fields", "disputed_cells", "flagged_cells", "cells_without_currency", "failed_checks")
    return out.withColumns({z: F.coalesce(z, F.lit(0)) for z in zeros} | {"currencies": F.coalesce("currencies", F.array().cast("array<string>"))})


def value_at(values: DataFrame, field: str, year: int | None) -> DataFrame:
    """The readings of one field in one year (null: undated)."""
    return values.where((F.col("field") == field) & F.col("year").eqNullSafe(F.lit(year)))


def listing_dates(companies: DataFrame, register: DataFrame, company: str = "company") -> DataFrame:
    """Companies with ``listed_on`` from a register ``code, name, listed_on``: by code and name, by name, by name without a leading ticker.

    Of register rows with one full key the last in the file (``row_no``; without it by date) stands, of one name the first.
    """
    row = F.col("row_no" if "row_no" in register.columns else "listed_on")
    named = register.select(company_key(F.col("name")).alias("__name"), company_key(F.concat_ws(" ", "code", "name")).alias("__full"), "listed_on", row.alias("__row")).where("__name <> ''")
    full = named.groupBy("__full").agg(F.max_by("listed_on", "__row").alias("__by_full"))
    by_name = named.groupBy("__name").agg(F.min_by("listed_on", "__row").alias("__by_name"))
    ticker = F.trim(company).rlike("^[^ a-z]*[A-Z][^ a-z]* ") & (F.length(F.substring_index(F.trim(company), " ", 1)).between(2, 6))
    rest = F.when(ticker, company_key(F.regexp_replace(F.trim(company), "^[^ ]+ ", "")))
    rows = companies.withColumns({"__k": company_key(F.col(company)), "__r": rest})
    out = rows.join(full, rows["__k"] == full["__full"], "left").join(by_name, F.col("__k") == by_name["__name"], "left").drop("__name", "__full")
    again = by_name.select(F.col("__name").alias("__again"), F.col("__by_name").alias("__by_rest"))
    out = out.join(again, F.col("__r") == F.col("__again"), "left")
    return out.withColumn("listed_on", F.coalesce("__by_full", "__by_name", "__by_rest")).drop("__k", "__r", "__by_full", "__by_name", "__by_rest", "__again")
