"""Company keys, dates, years and field titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in two languages, legal-form words.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "mei": 5, "jun": 6, "jul": 7, "agu": 8, "agt": 8, "sep": 9, "okt": 10, "nov": 11, "des": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
LEGAL_WORDS = ("pt", "tbk", "persero")


def company_key(name: Column) -> Column:
    """Lower case, other than letters and digits to spaces, legal-form words left out."""
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9\\s]", " "), "\\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_WORDS)), " ")


def listing_date(text: Column) -> Column:
    """``9 Des 1997``, ``09/12/1997``, ``09-12-1997`` or ``1997-12-09``; null for anything else."""
    at = r"^\s*(\d{1,2})\s+([A-Za-z]+)\.?\s+(\d{4})"
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.lower(F.regexp_extract(text, at, 2)))
    named = F.concat_ws("-", F.regexp_extract(text, at, 3), month, F.regexp_extract(text, at, 1))
    by_name = F.when(month.isNotNull(), F.try_to_timestamp(named, F.lit("yyyy-M-d")))
    trimmed = F.trim(text)
    as_number = lambda shape, form: F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(form)))
    return F.coalesce(by_name, as_number(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), as_number(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), as_number(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d")).cast("date")


def year_in(text: Column) -> Column:
    found = F.regexp_extract(text, r"(20\d{2})", 1)
    return F.when(found != "", found.cast("int"))


#: What names a fiscal year in a text, in order.
YEAR_PHRASES = (
    r"(?:Tahun\s+Buku|Fiscal\s+Year|Year\s+Ended|Year\s+then\s+Ended)\s*:?\s*(20[0-2]\d)",
    r"(?:31|30)\s+(?:Desember|December)\s+(20[0-2]\d)",
    r"(?:Desember|December)\s+(?:31|30),?\s+(20[0-2]\d)",
    r"Laporan\s+(?:Keuangan|Tahunan)\s+(20[0-2]\d)",
)


def year_in_text(text: Column, within: int = 5000) -> Column:
    """The first phrase that names a year, else the most frequent year from 2005 on (of equals the smallest)."""
    head = F.substring(text, 1, within)
    named = [F.nullif(F.regexp_extract(head, f"(?iU){p}", 1), F.lit("")).cast("int") for p in YEAR_PHRASES]
    years = F.filter(F.transform(F.regexp_extract_all(head, F.lit(r"(20[0-2]\d)"), F.lit(1)), lambda y: y.cast("int")), lambda y: y >= 2005)
    counted = F.transform(F.array_distinct(years), lambda y: F.struct((-F.size(F.filter(years, lambda z: z == y))).alias("n"), y.alias("y")))
    return F.coalesce(*named, F.array_min(counted)["y"])


def field_title(field: Column, titles: dict[str, str] | None = None) -> Column:
    """The given title, else the name with spaces and one capital."""
    plain = F.replace(field, F.lit("_"), F.lit(" "))
    plain = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substr(plain, F.lit(2))))
    if not titles:
        return plain
    known = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
    return F.coalesce(F.try_element_at(known, field), plain)


def signed(value: Column) -> Column:
    """Accounting form: two places, negatives in parentheses; null stays null."""
    return F.when(value < 0, F.concat(F.lit("("), F.format_number(-value, 2), F.lit(")"))).otherwise(F.format_number(value, 2))


def tax_direction(paid: Column) -> Column:
    return F.when(paid < 0, "paid").when(paid > 0, "refund")


def value_year(reporting: Column, headers: Column, filename: Column) -> Column:
    """The year of a value without its own: the filing's, else the latest header's, else the file name's."""
    return F.coalesce(reporting, F.array_max(headers), year_in(filename))
