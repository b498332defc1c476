"""From classified pages and their rows to values: units, labels, amounts, years, status, one winner a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import amounts, names, quality, units
from tallyspark.operators import labels, winners

KEY = ["document_id", "statement", "field", "year"]
ORDER = ["producer", "page_number", "row_idx", "value_idx"]
#: How far into a page units are looked for, and on how many pages.
UNIT_CHARS, UNIT_PAGES, FIRST_PAGES = 2500, 8, 4


def resolve_units(pages: DataFrame, declared: DataFrame) -> DataFrame:
    """``document_id, currency, unit, multiplier`` of each document.

    A scale that the cover declares stands. Else the first of at most eight statement pages (without
    any, relevant pages; without those, the first four) that states a unit in its head: by a phrase,
    or surely by its words. Else what the heads of the first two say.
    """
    relevant = F.coalesce(F.col("is_relevant"), F.lit(False)) if "is_relevant" in pages.columns else F.lit(False)
    tier = F.when(quality.on_statement_page(F.col("section")), 0).when(relevant, 1).otherwise(2)
    heads = _best_tier(pages.select("document_id", "page_number", F.substring(F.coalesce("text", F.lit("")), 1, UNIT_CHARS).alias("head"), tier.alias("tier")))
    heads = heads.withColumn("sure", units.stated_unit(F.col("head")))
    first_two = F.concat_ws(" ", *[F.max(F.when((F.col("place") == n) & F.col("sure").isNull(), F.col("head"))) for n in (1, 2)])
    found = heads.groupBy("document_id").agg(F.min_by("sure", F.when(F.col("sure").isNotNull(), F.col("place"))).alias("sure"), first_two.alias("joined"))
    found = found.withColumn("u", F.coalesce("sure", units.detect_unit(F.substring("joined", 1, UNIT_CHARS))))
    told = declared.select("document_id", F.col("multiplier").alias("__declared"), F.col("currency").alias("__currency"), (F.col("unit") if "unit" in declared.columns else F.lit(None).cast("string")).alias("__unit"))
    out = found.join(told, "document_id", "full_outer")
    is_declared = F.col("__declared").isNotNull()
    return out.select(
        "document_id", F.when(is_declared, F.col("__currency")).otherwise(F.col("u.currency")).alias("currency"),
        F.when(is_declared, F.coalesce("__unit", units.unit_name(F.col("__declared")))).otherwise(F.col("u.unit")).alias("unit"),
        F.coalesce("__declared", F.col("u.multiplier"), F.lit(1).cast("long")).alias("multiplier"),
    )


def _best_tier(heads: DataFrame) -> DataFrame:
    """A document's pages of its best tier, at most ``UNIT_PAGES`` (of the last tier ``FIRST_PAGES``), with their place: one sort, and no more than these of a document before the shuffle."""
    w = W.partitionBy("document_id").orderBy("tier", "page_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = heads.withColumns({"best": F.first("tier").over(w), "place": F.row_number().over(w)}).where(F.col("place") <= UNIT_PAGES)
    return placed.where((F.col("tier") == F.col("best")) & ((F.col("tier") < 2) | (F.col("place") <= FIRST_PAGES))).drop("best")


def page_units(pages: DataFrame, unit: DataFrame) -> DataFrame:
    """``document_id, page_number, currency, unit, multiplier``: a page's own phrase over the document's unit, 1 where its figures contradict it."""
    rows = pages.select("document_id", "page_number", "text").join(unit, "document_id", "left")
    own, document = units.page_unit(F.col("text")), F.coalesce("multiplier", F.lit(1).cast("long"))
    rows = rows.withColumn("__own", F.when((own > 1) & (own != document), own)).withColumn("__m", units.checked_multiplier(F.coalesce("text", F.lit("")), F.coalesce("__own", document)))
    name = F.when(F.col("__m") == 1, F.when(F.col("__own").isNull() & (document == 1), F.col("unit"))).when(F.col("__own").isNotNull(), units.unit_name(F.col("__own"))).otherwise(F.col("unit"))
    return rows.select("document_id", "page_number", "currency", name.alias("unit"), F.col("__m").alias("multiplier"))


def scale_values(candidates: DataFrame) -> DataFrame:
    """``normalized_value`` from ``value`` and ``multiplier``; amounts that would overflow stay as read, without unit, at 0.75."""
    money = quality.is_monetary(F.col("field"), F.lit(None).cast("string"))
    scaled = F.when(money, F.col("value") * F.coalesce("multiplier", F.lit(1))).otherwise(F.col("value")).cast("double")
    over = F.abs(scaled) > quality.OVERFLOW
    unit = F.col("unit") if "unit" in candidates.columns else F.when(F.col("multiplier") > 1, F.col("multiplier").cast("string"))
    return candidates.withColumns({"normalized_value": F.when(over, F.col("value").cast("double")).otherwise(scaled), "unit": F.when(~over & money, unit), "confidence": F.when(over, 0.75).otherwise(F.col("confidence"))})


def ranked(candidates: DataFrame, review_below: float = 0.8) -> DataFrame:
    """Adds ``status`` and ``rank``; years outside the filing's band (anchor: its own year, else its file name's) go."""
    anchor = F.coalesce("reporting_year", names.year_in(F.col("filename")))
    rows = candidates.where(quality.year_is_plausible(F.col("year"), anchor))
    bad = quality.is_implausible(F.col("normalized_value"), F.col("field"), F.col("unit"), F.col("currency"))
    rank = winners.extraction_rank(bad, F.coalesce("is_parent_only", F.lit(False)), F.coalesce("year_from_header", F.lit(False)), quality.on_statement_page(F.col("section")))
    return rows.withColumns({"status": quality.value_status(bad, F.col("confidence"), review_below), "rank": rank})


def _with_value(parsed: DataFrame) -> DataFrame:
    """Rows with a value. The row number keeps the optimizer from copying the parser's steps into the filter, where they would grow by powers."""
    return parsed.withColumn("__row", F.monotonically_increasing_id()).where("value IS NOT NULL AND __row >= 0").drop("__row")


def table_candidates(rows: DataFrame, pages: DataFrame, unit: DataFrame, documents: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of table rows on relevant pages, and rows whose label is unknown.

    ``rows``: row_id, document_id, page_number, row_idx, label, values (array of year and raw) and, if
    there are any, header_years. ``pages``: document_id, page_number, section, is_parent_only, text.
    ``documents``: document_id, reporting_year, filename. Percentages count only for fields that are
    one; numbers of shares belong to equity and are never scaled.
    """
    parent = F.coalesce("is_parent_only", F.lit(False))
    own_section = F.when(quality.on_statement_page(F.col("section")) & ~parent, F.col("section"))
    placed = pages.where(F.coalesce("is_relevant", F.lit(False)) | F.col("section").isNotNull()) if "is_relevant" in pages.columns else pages
    placed = rows.join(placed.select("document_id", "page_number", own_section.alias("section"), parent.alias("is_parent_only")), ["document_id", "page_number"])
    mapped = labels.map_labels(placed, dictionary, "row_id")
    mapped = mapped.withColumn("field", labels.treasury_field(F.col("field"), F.get("values", F.lit(0))["raw"]))
    known, unmapped = labels.split_unmapped(mapped)
    home = dictionary.groupBy("field").agg(F.min_by("statement", "stmt_ord").alias("__home"))
    shares = F.col("field") == "treasury_shares_quantity"
    known = known.join(home, "field", "left").withColumn("section", F.when(shares, "equity").otherwise(F.col("section")))
    known = known.withColumn("statement", F.coalesce("section", "__home", F.lit("balance_sheet")))
    headers = F.col("header_years") if "header_years" in rows.columns else F.lit(None).cast("array<int>")
    long = known.select("row_id", "document_id", "page_number", "row_idx", F.col("label").alias("raw_label"), "field", "statement", "section", "is_parent_only", headers.alias("header_years"), F.posexplode("values").alias("value_idx", "v"))
    long = long.select("*", F.col("v.year").alias("__own_year"), F.col("v.raw").alias("raw_value")).drop("v")
    percent, kind = amounts.is_percentage(F.col("raw_value")), F.col("field").isin(*quality.NOT_MONEY)
    long = long.where(F.when(shares, amounts.is_share_quantity(F.col("raw_value"))).otherwise(~percent | kind)).withColumn("__percent", percent & ~shares)
    parsed = amounts.parse_percentages(amounts.parse_shares(amounts.parse_amounts(long, "raw_value"), "raw_value", "__shares"), "raw_value", "__pct")
    parsed = parsed.withColumn("value", F.when(shares, F.col("__shares")).when(F.col("__percent"), F.col("__pct")).otherwise(F.col("value")))
    parsed = _with_value(parsed)
    full = parsed.join(documents.select("document_id", "reporting_year", "filename"), "document_id").join(page_units(pages, unit), ["document_id", "page_number"], "left")
    full = full.withColumns({
        "year": F.coalesce("__own_year", names.value_year(F.col("reporting_year"), F.col("header_years"), F.col("filename"))), "year_from_header": F.col("__own_year").isNotNull(),
        "unit": F.when(shares, "shares").when(F.col("__percent"), "percent").otherwise(F.col("unit")), "currency": F.when(~shares & ~F.col("__percent"), F.col("currency")),
        "extraction_method": F.lit("table"), "producer": F.lit(0), "text_value": F.lit(None).cast("string"),
    })
    plain = shares | F.col("__percent")
    unit_name = F.col("unit")
    full = full.withColumn("__unit", unit_name).withColumn("confidence", quality.page_confidence(F.col("section"), F.col("year_from_header")))
    full = scale_values(full.withColumn("multiplier", F.when(plain, F.lit(1).cast("long")).otherwise(F.col("multiplier"))))
    return full.withColumn("unit", F.when(plain, F.col("__unit")).otherwise(F.col("unit"))).drop("__unit", "__shares", "__pct", "__percent", "__own_year", "is_error"), unmapped


def cover_candidates(subsectors: DataFrame, documents: DataFrame) -> DataFrame:
    """The declared subsector (``document_id, sub_sector``) as a value without a number."""
    rows = subsectors.where("sub_sector IS NOT NULL").join(documents.select("document_id", "reporting_year", "filename"), "document_id")
    text = F.col("sub_sector")
    return rows.select(
        "document_id", "reporting_year", "filename", F.coalesce("reporting_year", names.year_in(F.col("filename"))).alias("year"), F.lit("cover").alias("statement"), F.lit("sub_sector").alias("field"),
        F.lit("Subsektor").alias("raw_label"), text.alias("raw_value"), F.lit(None).cast("double").alias("normalized_value"), text.alias("text_value"), F.lit(1.0).alias("confidence"),
        F.lit("cover_text").alias("extraction_method"), F.lit(1).alias("producer"), F.lit(1).alias("page_number"), F.lit(0).alias("row_idx"), F.lit(0).alias("value_idx"),
    )


def external_candidates(observations: DataFrame, unit: DataFrame, documents: DataFrame) -> DataFrame:
    """External observations (``document_id, statement, field, label, value, year, currency, unit, confidence`` and, if told, ``normalized``) as candidates.

    What they don't say comes from the document. A number that is smaller than the text's own figure,
    with no unit of its own, is the figure times the document's multiplier; numbers of shares never scale.
    """
    rows = observations.withColumnsRenamed({"value": "raw_value", "label": "raw_label", "unit": "__unit", "currency": "__currency"})
    rows = rows.withColumn("normalized", F.col("normalized").cast("double") if "normalized" in rows.columns else F.lit(None).cast("double"))
    parsed = amounts.parse_shares(amounts.parse_amounts(rows, "raw_value"), "raw_value", "__shares")
    full = parsed.join(unit, "document_id", "left").join(documents.select("document_id", "reporting_year", "filename"), "document_id")
    shares = (F.col("field") == "treasury_shares_quantity") & F.col("__shares").isNotNull()
    read, many = F.col("value").cast("double"), F.coalesce("multiplier", F.lit(1).cast("long"))
    told = F.coalesce("normalized", read)
    rescale = (many > 1) & F.col("__unit").isNull() & (F.col("field") != "treasury_shares_quantity") & read.isNotNull() & ((F.abs(told) < F.abs(read)) | F.col("normalized").isNull())
    value = F.when(shares, F.col("__shares").cast("double")).when(rescale, (F.col("value") * many).cast("double")).otherwise(told)
    conf = F.round(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), 3)
    full = _with_value(full.withColumn("value", value).where("field IS NOT NULL"))
    return full.select(
        "document_id", "reporting_year", "filename", F.coalesce("year", "reporting_year", names.year_in(F.col("filename"))).alias("year"), "statement", F.col("statement").alias("section"), "field", "raw_label", "raw_value",
        F.col("value").alias("normalized_value"), F.when(~shares, F.coalesce("__currency", "currency")).alias("currency"), F.when(shares, "shares").otherwise(F.coalesce("__unit", "unit")).alias("unit"), conf.alias("confidence"),
        F.lit("ai").alias("extraction_method"), F.lit(2).alias("producer"), F.lit(None).cast("int").alias("page_number"), F.lit(0).alias("row_idx"), F.lit(0).alias("value_idx"),
    )


def settle(*producers: DataFrame) -> DataFrame:
    """All producers' candidates as one, ranked, with one winner a key; of equals the earlier producer, page, row and value."""
    union = producers[0]
    for p in producers[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return winners.authority_winner(ranked(union), KEY, "rank", "confidence", ORDER)


def checked_values(candidates: DataFrame) -> DataFrame:
    """The values that the checks see: ranked candidates settled without implausible ones and those without a number."""
    return winners.validation_winner(candidates.where("normalized_value IS NOT NULL"), KEY, "rank", "confidence", ORDER)


def extract_values(rows: DataFrame, pages: DataFrame, unit: DataFrame, documents: DataFrame, dictionary: DataFrame, *others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values (of tables, and of ``others``: cover and external candidates) and unmapped observations."""
    table, unmapped = table_candidates(rows, pages, unit, documents, dictionary)
    return settle(table, *others).drop("rank"), unmapped


def document_confidence(values: DataFrame, review_below: float = 0.8) -> DataFrame:
    """``document_id, avg_confidence, low_confidence``."""
    return values.groupBy("document_id").agg(F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < review_below).alias("low_confidence"))
