import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import amounts, names, quality, units

CASES = {
    None: None, "": None, "-": None, "—": None, "n/a": None, "NIL": None, "1.": None, "(14,": None, "021,": None, "1.234.567": "1234567", "1.234.567,89": "1234567.89", "Rp 1.234.567.890": "1234567890",
    "(1.234.567)": "-1234567", "-1.234.567": "-1234567", "1,234,567.89": "1234567.89", "(520,193": "-520193", "1.234.OOO": "1234000", "Rp l.234.567": "1234567", "9007199254740993": "9007199254740993", "1234,56": "1234.56",
    "1234.56": "1234.56", "1.234.567.": "1234567", "12 345": "12345", "US$ 5": "5", "– 7": "-7",
}


def test_amounts(spark):
    rows = spark.createDataFrame([(k,) for k in CASES] + [("1,2,3",), ("abc",), ("1.2.3,4,5",)], "raw string")
    got = {r.raw: (r.value, r.is_error) for r in amounts.parse_amounts(rows, "raw").collect()}
    for raw, want in CASES.items():
        assert got[raw] == (None if want is None else Decimal(want), False), raw
    assert all(got[x] == (None, True) for x in ("1,2,3", "abc", "1.2.3,4,5"))


def test_shares_and_percentages(spark):
    rows = spark.createDataFrame([("1.000.000 saham",), ("6,000,000 shares",), ("4%",), ("(2,5)%",), ("15,6 %",), ("12",)], "raw string")
    out = [(r.shares, r.percent) for r in amounts.parse_percentages(amounts.parse_shares(rows, "raw"), "raw").collect()]
    assert out == [(1000000, None), (6000000, None), (None, 4), (None, Decimal("-2.5")), (None, Decimal("15.6")), (None, None)]


@pytest.mark.parametrize("text,want", [("Disajikan dalam jutaan Rupiah", ("IDR", "juta", 10**6, 0.85)), ("Dalam Rupiah", ("IDR", None, 1, 0.9)), ("Rp1.15 trillion", (None, None, 1, 0.0)), ("expressed in thousands of USD", ("USD", "ribuan", 1000, 0.85))])
def test_units(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(units.detect_unit(F.col("t")).alias("u")).first().u) == want


def test_page_units_and_check(spark):
    rows = spark.createDataFrame([("(dalam Jutaan) saham; dalam miliaran Rupiah", 1), ("(Rp juta) 17.527.130.084 12.000.000.000", 2), ("no unit", 3), (None, 4)], "t string, i int")
    rows = rows.withColumn("m", units.page_unit(F.col("t")))
    assert [r.m for r in rows.orderBy("i").collect()] == [10**9, 10**6, 1, 1]
    assert [r.c for r in rows.select("i", units.checked_multiplier(F.col("t"), F.col("m")).alias("c")).orderBy("i").collect()] == [10**9, 1, 1, 1]


def test_dates_and_keys(spark):
    texts = {"09 Des 1997": datetime.date(1997, 12, 9), "1 May. 2001": datetime.date(2001, 5, 1), "31/12/1999": datetime.date(1999, 12, 31), "1999-02-30": None, "31 Feb 2000": None, "x": None, None: None}
    out = {r.t: r.d for r in spark.createDataFrame([(k,) for k in texts], "t string").select("t", names.listing_date(F.col("t")).alias("d")).collect()}
    assert out == texts
    assert spark.createDataFrame([("PT Astra Agro Lestari Tbk.",)], "t string").select(names.company_key(F.col("t"))).first()[0] == "astra agro lestari"


def test_flags(spark):
    rows = [(5e8, "cash", "juta", "IDR", "IMPLAUSIBLE_SCALE"), (5e8, "cash", None, "IDR", ""), (2e16, "cash", None, None, "IMPLAUSIBLE_MAGNITUDE"), (0.0, "cash", "juta", None, ""), (None, "cash", None, None, ""), (37.0, "cash", None, "USD", "IMPLAUSIBLE_SCALE"), (5.0, NOT := "treasury_shares_quantity", None, None, ""), (2e5, "cash", "juta", "USD", "")]
    df = spark.createDataFrame(rows, "v double, f string, u string, c string, want string")
    assert df.where(quality.export_flag(*map(F.col, "vfuc")) != F.col("want")).count() == 0


def test_unit_words_are_found_whatever_their_case_and_letters(spark):
    """The fast search is for texts without letters that another case turns into i or s; both find the same words, and a text without any says nothing."""
    for said in ("dalam jutaan Rupiah", "expressed in thousands of US$", "disajikan dalam miliar", "US 5 in billions"):
        rows = spark.createDataFrame([(said,), (f"{said} ıİſ",), (f"x\u0001y {said}" if not said.startswith("US") else said,), (f"{said} " + "x" * 5000,)], "t string")
        got = [r.u for r in rows.select(units.stated_unit(F.col("t")).alias("u")).collect()]
        assert got[0] is not None and got == got[:1] * 4
    said = spark.createDataFrame([("dı İn juta",), ("x" * 5000,), (None,)], "t string").select(units.stated_unit(F.col("t")).alias("s"), units.detect_unit(F.col("t")).alias("u")).collect()
    assert [r.s for r in said] == [None] * 3 and [tuple(r.u) for r in said] == [(None, None, 1, 0.0)] * 3


def test_unit_search_tries_one_character_first():
    """What is tried at every place of a text is one class of ASCII letters, nothing behind a lookahead."""
    assert units._begun("q", {}).startswith("(?s)[") and units._begun("q", {}).isascii()
