"""Plausibility, confidence and status of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors and ceiling of a credible amount; what isn't money.
FLOOR_PLAIN, FLOOR_OTHER, CEILING, OVERFLOW = 1e3, 1e9, 1e16, 1e17
FLOORS = {"IDR": 1e9, "USD": 1e5}
NOT_MONEY = ("treasury_shares_quantity", "treasury_shares_percentage", "treasury_shares_nominal_value", "treasury_shares_carrying_value")
NOT_MONEY_UNITS = ("percent", "shares")
#: Worst first.
STATUSES = ("ERROR", "WARNING", "REVIEW_REQUIRED", "VALID", "NOT_APPLICABLE")
FINDINGS = ("ERROR", "WARNING", "REVIEW_REQUIRED")


def is_monetary(field: Column, unit: Column) -> Column:
    return ~F.coalesce(field.isin(*NOT_MONEY), F.lit(False)) & ~F.coalesce(unit.isin(*NOT_MONEY_UNITS), F.lit(False))


def floor_of(currency: Column, unit: Column) -> Column:
    of = F.lit(FLOOR_OTHER)
    for code, floor in FLOORS.items():
        of = F.when(currency == code, F.lit(floor)).otherwise(of)
    return F.when(unit.isNull(), F.lit(FLOOR_PLAIN)).otherwise(of)


def export_flag(value: Column, field: Column, unit: Column, currency: Column) -> Column:
    """``IMPLAUSIBLE_MAGNITUDE`` above the ceiling, ``IMPLAUSIBLE_SCALE`` below the floor, else empty."""
    size = F.abs(value)
    counts = value.isNotNull() & (size > 0) & is_monetary(field, unit)
    return F.when(counts & (size > CEILING), "IMPLAUSIBLE_MAGNITUDE").when(counts & (size < floor_of(currency, unit)), "IMPLAUSIBLE_SCALE").otherwise("")


def is_implausible(value: Column, field: Column, unit: Column, currency: Column) -> Column:
    return export_flag(value, field, unit, currency) != ""


def value_status(implausible: Column, confidence: Column, review_below: float = 0.8) -> Column:
    return F.when(implausible, "IMPLAUSIBLE").when(confidence < review_below, "REVIEW_REQUIRED").otherwise("OK")


#: Sections of primary statements; others (notes, comprehensive income) rank as none.
STATEMENT_PAGES = ("balance_sheet", "income_statement", "cash_flow", "equity")


def on_statement_page(section: Column) -> Column:
    return F.coalesce(section.isin(*STATEMENT_PAGES), F.lit(False))


def page_confidence(section: Column, year_from_header: Column) -> Column:
    """1.0 on a primary statement's page, 0.9 for a year from a header elsewhere, else 0.75."""
    return F.when(on_statement_page(section), 1.0).when(year_from_header, 0.9).otherwise(0.75)


def year_is_plausible(year: Column, anchor: Column) -> Column:
    """Within ten years before and one after the anchor; true without one."""
    return anchor.isNull() | year.isNull() | year.between(anchor - 10, anchor + 1)


def worst_status(status: Column) -> Column:
    """Aggregate: the worst status present, ``NOT_FOUND`` for none."""
    rank = F.lit(None).cast("int")
    for i, s in enumerate(STATUSES):
        rank = F.when(status == s, F.lit(i)).otherwise(rank)
    return F.coalesce(F.element_at(F.array(*map(F.lit, STATUSES)), F.min(rank) + 1), F.lit("NOT_FOUND"))
