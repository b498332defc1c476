import pytest
from pyspark.sql import functions as F

from tallyspark.functions import quality
from tallyspark.operators import extract, labels, pages, reconcile

DICTIONARY = [
    ("balance_sheet", 0, "total_assets", "Total aset", 0), ("balance_sheet", 0, "total_liabilities", "Total liabilitas", 1), ("balance_sheet", 0, "total_equity", "Total ekuitas", 2),
    ("income_statement", 1, "sales", "Penjualan", 0), ("equity", 3, "treasury_shares_carrying_value", "Saham treasuri", 0),
]


@pytest.fixture
def filing(spark):
    """One filing in millions: a balance sheet, notes that clip a total, a page without section, the parent's sheet."""
    page = [("d", 1, "balance_sheet", False, True, "dalam jutaan Rupiah"), ("d", 2, "notes", False, True, "notes"), ("d", 3, None, False, True, "x"), ("d", 4, "balance_sheet", True, True, "x"), ("d", 5, None, False, False, "x")]
    page = spark.createDataFrame(page, "document_id string, page_number int, section string, is_parent_only boolean, is_relevant boolean, text string")
    rows = [
        (1, "d", 1, 0, "Total aset", [(2023, "1.000.000"), (2022, "900.000")], [2023, 2022]), (2, "d", 1, 1, "Total liabilitas", [(2023, "600.000"), (2022, "500.000")], [2023, 2022]), (3, "d", 1, 2, "Total ekuitas", [(2023, "400.000"), (2022, "400.000")], [2023, 2022]),
        (4, "d", 2, 0, "Total aset", [(2023, "187.614")], [2023]), (5, "d", 3, 0, "Penjualan", [(None, "258.230")], [2021, 2020]), (6, "d", 3, 1, "Penjualan", [(2023, "435.507")], [2023]), (7, "d", 4, 0, "Total aset", [(2023, "77.000")], [2023]),
        (8, "d", 1, 3, "Saham treasuri", [(2023, "4 persen"), (2022, "5")], [2023, 2022]), (9, "d", 1, 4, "Saham treasuri", [(2023, "1.000.000 saham")], [2023]), (10, "d", 1, 5, "Total aset", [(2031, "5.000.000")], [2031]),
        (11, "d", 1, 6, "Total ekuitas", [(2023, "86%")], [2023]), (12, "d", 5, 0, "Penjualan", [(2022, "999.999")], [2022]), (13, "d", 1, 7, "Tak dikenal", [(2023, "5")], [2023]), (14, "d", 1, 8, "Total aset", [(2020, "1")], [2020]),
    ]
    rows = spark.createDataFrame(rows, "row_id long, document_id string, page_number int, row_idx int, label string, values array<struct<year:int,raw:string>>, header_years array<int>")
    docs = spark.createDataFrame([("d", 2023, "d 2023")], "document_id string, reporting_year int, filename string")
    dictionary = spark.createDataFrame(DICTIONARY, "statement string, stmt_ord int, field string, label string, label_ord int")
    unit = extract.resolve_units(page, spark.createDataFrame([], "document_id string, multiplier long, currency string"))
    return rows, page, unit, docs, dictionary


def test_authority_and_checks(spark, filing):
    rows, page, unit, docs, dictionary = filing
    assert [tuple(r) for r in unit.collect()] == [("d", "IDR", "juta", 1_000_000)]
    table, unmapped = extract.table_candidates(rows, page, unit, docs, dictionary)
    cover = extract.cover_candidates(spark.createDataFrame([("d", "Banks")], "document_id string, sub_sector string"), docs)
    outside = spark.createDataFrame([("d", "balance_sheet", "total_assets", "TA", "5", 2023, None, None, 1.0), ("d", "cash_flow", "ending_cash_balance", "E", "7.000", None, None, None, 0.7), ("d", "equity", "treasury_shares_quantity", "q", "12 saham", 2022, None, None, 0.9)], "document_id string, statement string, field string, label string, value string, year int, currency string, unit string, confidence double")
    external = extract.external_candidates(outside, unit, docs)
    got = {(r.statement, r.field, r.year): r for r in extract.settle(table, cover, external).collect()}
    assert got["balance_sheet", "total_assets", 2023].normalized_value == 1e12 and got["balance_sheet", "total_assets", 2023].extraction_method == "table"
    sales = got["income_statement", "sales", 2023]  # a header's year counts for more than a figure without one
    assert (sales.normalized_value, sales.confidence, sales.status) == (435_507e6, 0.9, "OK") and ("income_statement", "sales", 2022) not in got
    quantity = got["equity", "treasury_shares_quantity", 2023]
    assert (quantity.normalized_value, quantity.unit, quantity.currency) == (1e6, "shares", None)
    assert got["equity", "treasury_shares_quantity", 2022].normalized_value == 12
    assert ("balance_sheet", "total_assets", 2031) not in got and got["balance_sheet", "total_assets", 2020].status == "IMPLAUSIBLE"
    assert got["cover", "sub_sector", 2023].text_value == "Banks" and got["cover", "sub_sector", 2023].status == "OK"
    cash = got["cash_flow", "ending_cash_balance", 2023]
    assert (cash.normalized_value, cash.status, cash.currency) == (7e9, "REVIEW_REQUIRED", "IDR")
    assert {r.label for r in unmapped.collect()} == {"Tak dikenal"}
    checked = extract.checked_values(extract.ranked(table.unionByName(external, allowMissingColumns=True)))
    checks = {(r.year, r.name): r.status for r in reconcile.identity_checks(checked, ["document_id", "year"]).collect()}
    assert checks[2023, "assets_equals_liabilities_plus_equity"] == "VALID" and checks[2022, "assets_equals_liabilities_plus_equity"] == "VALID"
    assert (2020, "assets_equals_liabilities_plus_equity") not in checks  # its only figure is implausible


def test_year_falls_back_to_the_latest_header(spark, filing):
    rows, page, unit, _, dictionary = filing
    docs = spark.createDataFrame([("d", None, "report")], "document_id string, reporting_year int, filename string")
    table, _ = extract.table_candidates(rows.where("row_id = 5"), page, unit, docs, dictionary)
    assert [(r.year, r.year_from_header, r.confidence) for r in table.collect()] == [(2021, False, 0.75)]


@pytest.mark.parametrize("section,header,want", [("balance_sheet", False, 1.0), ("equity", True, 1.0), ("notes", False, 0.75), ("comprehensive_income", True, 0.9), (None, True, 0.9), (None, False, 0.75)])
def test_page_confidence(spark, section, header, want):
    df = spark.createDataFrame([(section, header)], "s string, h boolean")
    assert df.select(quality.page_confidence(F.col("s"), F.col("h"))).first()[0] == want


def test_treasury_field(spark):
    cases = {"4 persen": "treasury_shares_percentage", "% saham": "treasury_shares_percentage", "1.000 saham": "treasury_shares_quantity", "(5.000)": "treasury_shares_carrying_value", None: "treasury_shares_carrying_value"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.f for r in df.select("v", labels.treasury_field(F.lit("treasury_shares_quantity"), F.col("v")).alias("f")).collect()} == cases


def test_window_key_cuts_bytes(spark):
    import hashlib

    text = "é" * 60_000
    rows = spark.createDataFrame([("m", "f", 1, "x" + text)], "company string, filename string, n int, text string")
    got = pages.page_windows(rows, ["company", "filename"], "n", model="gpt").first().cache_key
    assert got == hashlib.sha256(b"gptmf" + ("x" + text).encode()[:100_000]).hexdigest()


def test_units_take_one_sort_and_limit_pages_before_the_shuffle(spark):
    rows = [("a", n, None, False, "in thousands" if n == 5 else "Rp") for n in range(1, 9)] + [("b", n, "equity" if n > 2 else None, n == 1, "in millions" if n in (1, 11) else "x") for n in range(1, 14)]
    rows += [("c", n, None, n % 2 == 0, "in billions" if n in (1, 16) else "x") for n in range(1, 20)] + [("d", n, None, None, "in millions" if n == 4 else "x") for n in range(1, 6)]
    pages_ = spark.createDataFrame(rows, "document_id string, page_number int, section string, is_relevant boolean, text string")
    got = extract.resolve_units(pages_, spark.createDataFrame([], "document_id string, multiplier long, currency string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), 8, Partial") and plan.count("+- Window [") == 1
    assert {r.document_id: (r.currency, r.multiplier) for r in got.collect()} == {"a": ("IDR", 1), "b": (None, 1), "c": (None, 1_000_000_000), "d": (None, 1_000_000)}
