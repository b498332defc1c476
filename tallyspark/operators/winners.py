"""Which of several readings counts: extraction, grid, latest and leading ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.quality import on_statement_page


def extraction_rank(implausible: Column, parent_only: Column, header_year: Column, statement_page: Column) -> Column:
    return F.when(implausible, -2).when(parent_only, -1).when(statement_page, 3).when(header_year, 2).otherwise(1)


def authority_winner(candidates: DataFrame, keys: list[str], rank: str, confidence: str, order: list[str]) -> DataFrame:
    """The candidate of highest rank, then confidence (null last), then first in ``order`` (null first); combined before the shuffle."""
    rest = [c for c in candidates.columns if c not in keys]
    place = F.struct((-F.col(rank)).alias("r"), (-F.coalesce(F.col(confidence), F.lit(float("-inf")))).alias("c"), *order)
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("w")).select(*keys, "w.*")


def validation_winner(candidates: DataFrame, keys: list[str], rank: str, confidence: str, order: list[str]) -> DataFrame:
    """The candidates that the checks see: implausible ones (rank -2) don't take part."""
    return authority_winner(candidates.where(F.col(rank) > -2), keys, rank, confidence, order)


def cell_winner(values: DataFrame, keys: list[str], edited: Column | None = None) -> DataFrame:
    """An edited reading first, then the highest confidence (null as 0), then the lowest id; combined before the shuffle."""
    edited = F.lit(False) if edited is None else edited
    rest = [c for c in values.columns if c not in keys]
    order = F.struct((~edited).alias("u"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id"))
    return values.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("w")).select(*keys, "w.*")


def dispute(values: DataFrame, keys: list[str]) -> DataFrame:
    """Readings of a cell that differ by more than half of the largest one; candidates by value, null last.

    A cell's readings are those of one company's filings of a year, so their list is short.
    """
    top, low = F.max("value"), F.min("value")
    share = F.when((F.count("value") >= 2) & (top > 0), (top - low) / top)
    listed = F.sort_array(F.collect_list(F.struct(F.col("value").isNotNull().alias("known"), F.col("value"), (-F.col("id")).alias("by_id"))), asc=False)
    return values.groupBy(*keys).agg(F.coalesce(share > 0.5, F.lit(False)).alias("disputed"), F.count(F.lit(1)).alias("readings"), F.transform(listed, lambda x: F.struct((-x["by_id"]).alias("id"), x["value"].alias("value"))).alias("candidates"))


def latest(winners: DataFrame, keys: list[str]) -> DataFrame:
    """The dated winner with a number of the largest year."""
    dated = winners.where("year IS NOT NULL AND value IS NOT NULL")
    rest = [c for c in winners.columns if c not in keys]
    return dated.groupBy(*keys).agg(F.max_by(F.struct(*rest), "year").alias("w")).select(*keys, "w.*")


def leaders(rows: DataFrame, field: str, n: int = 8) -> DataFrame:
    """The ``n`` largest values of each field, ties by company."""
    w = W.partitionBy(field).orderBy(F.col("value").desc(), "company")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def year_on_year(winners: DataFrame, keys: list[str]) -> DataFrame:
    """Change against the value as of the year before it in the series: a ratio from a positive base, else a state."""
    w = W.partitionBy(*keys).orderBy("year")
    base, v = F.col("base"), F.col("value")
    rows = winners.where("year IS NOT NULL").withColumn("base", F.lag("value").over(w)).withColumn("base_year", F.lag("year").over(w))
    pct = F.when(base > 0, (v - base) / base)
    tone = F.when(pct.isNotNull(), F.when(F.abs(pct) < 0.0005, "flat").when(pct > 0, "up").otherwise("down"))
    state = F.when((base <= 0) & v.isNotNull(), F.when(v > 0, "back to profit").when(v < base, "loss widened").when(v > base, "loss narrowed").otherwise("flat"))
    return rows.withColumn("pct", pct).withColumn("tone", tone).withColumn("state", state)


def fill_gaps(winners: DataFrame, company: str, field: str, years: DataFrame) -> DataFrame:
    """Every year of the axis for every series of a company; missing values stay null."""
    keys = [company, field, "year"]
    series = winners.select(company, field).distinct().crossJoin(F.broadcast(years))
    held = winners.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & series[k].eqNullSafe(held[f"__{k}"])
    return series.join(held, same, "left").drop(*[f"__{k}" for k in keys])


def capped_pages(pages: DataFrame, filing: list[str], cap: int = 60) -> DataFrame:
    """Statement pages first, then by score and page number, at most ``cap`` a filing."""
    w = W.partitionBy(*filing).orderBy(~on_statement_page(F.col("section")), F.col("score").desc(), "page_number")
    return pages.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= cap).drop("__place")


def running_fraction(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Each slice's fraction of its group's total and the fraction before it."""
    w = W.partitionBy(*group)
    before = F.sum(value).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    total = F.sum(value).over(w)
    return rows.withColumn("fraction", F.col(value) / total).withColumn("offset", F.coalesce(before, F.lit(0)) / total)


def subsector_winner(values: DataFrame) -> DataFrame:
    """``company, subsector``: one a company, over all of its years, by the grid's rule among readings with text."""
    named = values.where((F.col("field") == "sub_sector") & (F.trim("text_value") != ""))
    return cell_winner(named.select("company", "id", "confidence", F.trim("text_value").alias("subsector")), ["company"]).select("company", "subsector")


def latest_subsector(values: DataFrame) -> DataFrame:
    """``company, subsector, year``: what the latest dated reading with text declares (of equals the highest id)."""
    named = values.where((F.col("field") == "sub_sector") & (F.trim("text_value") != "") & F.col("year").isNotNull())
    last = named.groupBy("company").agg(F.max_by(F.struct("text_value", "year"), F.struct("year", "id")).alias("w"))
    return last.select("company", F.trim("w.text_value").alias("subsector"), "w.year")
