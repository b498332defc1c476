import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import edits, grid, reconcile, registry, summary, winners
from tallyspark.plans import exports


def test_winner_prefers_edited_then_confidence_then_id(spark):
    rows = [(1, "a", 2020, "f", 1.0, None, False), (2, "a", 2020, "f", 2.0, 0.9, False), (3, "a", 2020, "f", 3.0, 0.9, False), (4, "b", None, "f", 4.0, 1.0, False), (5, "b", None, "f", 5.0, 0.1, True)]
    df = spark.createDataFrame(rows, "id long, company string, year int, field string, value double, confidence double, edited boolean")
    got = {r.company: r.id for r in winners.cell_winner(df, ["company", "year", "field"], F.col("edited")).collect()}
    assert got == {"a": 2, "b": 5}


def test_dispute(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 4.0), (3, "b", 10.0), (4, "b", 5.0), (5, "c", -1.0), (6, "c", -9.0), (7, "d", None), (8, "d", 3.0)], "id long, k string, value double")
    got = {r.k: (r.disputed, [c.id for c in r.candidates]) for r in winners.dispute(df, ["k"]).collect()}
    assert got == {"a": (True, [1, 2]), "b": (False, [3, 4]), "c": (False, [5, 6]), "d": (False, [8, 7])}


def test_year_on_year_states(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in [(2018, -5.0), (2019, -9.0), (2020, -2.0), (2021, 4.0), (2022, 4.001), (2023, 2.0), (2025, None)]], "k string, year int, value double")
    got = [(r.tone, r.state) for r in winners.year_on_year(df, ["k"]).orderBy("year").collect()]
    assert got == [(None, None), (None, "loss widened"), (None, "loss narrowed"), (None, "back to profit"), ("flat", None), ("down", None), (None, None)]


SHEET, INCOME, CASH, EQUITY = "balance_sheet", "income_statement", "cash_flow", "equity"
BASE_CASH = {(CASH, "beginning_cash_balance"): 10e6, (CASH, "ending_cash_balance"): 25e6}
#: Figures of a filing's year and what the checks must say: name to status, missing fields.
CHECK_CASES = [
    ({(SHEET, "total_assets"): 100e6, (SHEET, "total_liabilities"): 60e6, (SHEET, "total_equity"): 40e6}, {"assets_equals_liabilities_plus_equity": ("VALID", None), "assets_split": ("NOT_APPLICABLE", ["current_assets", "non_current_assets"]), "liabilities_split": ("NOT_APPLICABLE", ["current_liabilities", "non_current_liabilities"])}),
    ({(SHEET, "total_assets"): 100e6, (SHEET, "total_equity"): 40e6}, {"assets_equals_liabilities_plus_equity": ("NOT_APPLICABLE", ["total_liabilities"])}),
    ({(SHEET, "total_assets"): 100e6, (SHEET, "total_liabilities"): 60e6, (SHEET, "total_equity"): 40.5e6}, {"assets_equals_liabilities_plus_equity": ("WARNING", None)}),
    ({(SHEET, "total_assets"): 100e6, (SHEET, "total_liabilities"): 60e6, (SHEET, "total_equity"): 50e6}, {"assets_equals_liabilities_plus_equity": ("ERROR", None)}),
    ({(SHEET, "total_assets"): 2e12, (SHEET, "total_liabilities"): 1e12, (SHEET, "total_equity"): 1e12 - 9e8}, {"assets_equals_liabilities_plus_equity": ("VALID", None)}),
    ({(SHEET, "total_equity"): 1e6, (EQUITY, "total_equity"): 5e6}, {"assets_split": ("NOT_APPLICABLE", ["total_assets", "current_assets", "non_current_assets"])}),
    ({(INCOME, "sales_and_revenue"): 21e6, (INCOME, "cost_of_revenue"): -18e6, (INCOME, "gross_profit"): 3e6}, {"gross_profit_identity": ("VALID", None)}),
    ({(INCOME, "sales"): 21e6, (INCOME, "cost_of_revenue"): 18e6, (INCOME, "gross_profit"): 4e6}, {"gross_profit_identity": ("ERROR", None)}),
    ({(INCOME, "gross_profit"): 4e6}, {"gross_profit_identity": ("NOT_APPLICABLE", ["sales", "sales_and_revenue", "cost_of_revenue"])}),
    ({(INCOME, "net_income"): 4e6}, {"gross_profit_identity": ("NOT_APPLICABLE", ["sales", "sales_and_revenue", "cost_of_revenue", "gross_profit"])}),
    (BASE_CASH | {(CASH, "cash_flow_operating"): 20e6, (CASH, "cash_flow_investing"): -10e6, (CASH, "cash_flow_financing"): 5e6}, {"cash_flow_reconciliation": ("VALID", None)}),
    (BASE_CASH | {(CASH, "net_change_in_cash"): 15e6}, {"cash_change_reconciliation": ("VALID", None)}),
    (BASE_CASH, {"cash_flow_reconciliation": ("NOT_APPLICABLE", ["net_change_in_cash"])}),
    ({(CASH, "cash_flow_operating"): 1e6}, {"no_checks_possible": ("NOT_APPLICABLE", None)}),
    ({(CASH, "ending_cash_balance"): 5e6, (SHEET, "cash_and_cash_equivalents"): 6e6}, {"cash_matches_balance_sheet": ("ERROR", None)}),
    ({(EQUITY, "treasury_shares_carrying_value"): 5.0}, {"treasury_shares_positive_value": ("WARNING", None)}),
    ({(EQUITY, "treasury_shares_carrying_value"): -5.0}, {"no_checks_possible": ("NOT_APPLICABLE", None)}),
    ({("cover", "sub_sector"): None}, {"no_checks_possible": ("NOT_APPLICABLE", None)}),
]


def test_checks(spark):
    rows = [(i, s, f, v) for i, (figures, _) in enumerate(CHECK_CASES) for (s, f), v in figures.items()]
    out = reconcile.identity_checks(spark.createDataFrame(rows, "id long, statement string, field string, normalized_value double"), ["id"]).collect()
    got = {}
    for r in out:
        got.setdefault(r.id, {})[r.name] = r
    for i, (_, want) in enumerate(CHECK_CASES):
        for name, (status, missing) in want.items():
            assert (got[i][name].status, got[i][name].evidence.missing_fields) == (status, missing), (i, name)
    assert set(got[0]) == set(CHECK_CASES[0][1]) and set(got[11]) == {"cash_change_reconciliation"}
    across = got[14]["cash_matches_balance_sheet"]
    assert (across.expected, across.actual, across.severity, across.category) == (5e6, 6e6, "ERROR", "accounting_mismatch")
    assert (got[2]["assets_equals_liabilities_plus_equity"].severity, got[2]["assets_equals_liabilities_plus_equity"].category) == ("WARNING", "rounding_difference")
    assert got[6]["gross_profit_identity"].evidence.top_line == "sales_and_revenue" and got[4]["assets_equals_liabilities_plus_equity"].evidence.unit_scale == 1e6


def test_subsectors(spark):
    rows = [(1, "a", 2023, 0.9, " Banks "), (2, "a", 2024, 1.0, "  "), (3, "a", None, 0.9, "Other"), (4, "b", 2020, None, "Mines"), (5, "b", 2021, None, "Oil"), (6, "c", 2020, 1.0, None)]
    values = spark.createDataFrame([(*r, "sub_sector") for r in rows], "id long, company string, year int, confidence double, text_value string, field string")
    assert {r.company: r.subsector for r in winners.subsector_winner(values).collect()} == {"a": "Banks", "b": "Mines"}
    assert {r.company: (r.subsector, r.year) for r in winners.latest_subsector(values).collect()} == {"a": ("Banks", 2023), "b": ("Oil", 2021)}
    grid_rows = spark.createDataFrame([("a", 2020), ("a", 2021), ("c", 2020)], "company string, year int")
    facet = grid.subsector_facet(grid.with_subsector(grid_rows, values), ["banks", "Gold", "NONE"])
    assert {r.value: r.n for r in facet.collect()} == {"Banks": 2, "none": 1, "Gold": 0}


def test_listing_dates(spark):
    day = datetime.date
    register = spark.createDataFrame([("AALI", "Astra Agro Lestari Tbk.", day(1997, 12, 9)), ("BBCA", "Bank Central Asia Tbk", day(2000, 5, 31)), ("X", "PT Tbk", day(1999, 1, 1))], "code string, name string, listed_on date")
    cases = {"AALI Astra Agro Lestari Tbk": day(1997, 12, 9), "PT Astra Agro Lestari Tbk.": day(1997, 12, 9), "XXXX Bank Central Asia": day(2000, 5, 31), "Xxxx Bank Central Asia": None, "TOOLONGX Bank Central Asia": None, "Unknown": None, None: None}
    got = {r.company: r.listed_on for r in grid.listing_dates(spark.createDataFrame([(c,) for c in cases], "company string"), register).collect()}
    assert got == cases


def test_company_profile(spark):
    values = spark.createDataFrame([(1, 1, "a", 2020, "x", 10.0, 1.0, "OK", "IDR"), (2, 1, "a", 2020, "x", 1.0, 0.9, "OK", None), (3, 2, "a", None, "y", 1.0, 0.9, "IMPLAUSIBLE", None), (4, 9, "z", 2020, "y", 1.0, 0.9, "OK", None)], "id long, document_id long, company string, year int, field string, value double, confidence double, status string, currency string")
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, company string")
    checks = spark.createDataFrame([("a", 2020, "c", "ERROR"), ("a", 2019, "d", "ERROR"), ("a", None, "e", "WARNING"), ("b", 2019, "f", "ERROR"), ("b", 2019, "g", "VALID")], "company string, year int, check_name string, status string")
    got = {r.company: r.asDict() for r in grid.company_profile(values, docs, checks).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == {"company": "a", "documents": 2, "documents_with_values": 2, "figures": 3, "years": 1, "fields": 2, "currencies": ["IDR"], "disputed_cells": 1, "flagged_cells": 1, "cells_without_currency": 1, "failed_checks": 2}
    assert (got["b"]["figures"], got["b"]["failed_checks"], got["b"]["currencies"]) == (0, 1, [])


def test_null_years_are_keys(spark):
    w = spark.createDataFrame([("a", None, "total_profit_loss", 5.0), ("a", None, "x", 1.0), ("a", 2020, "x", 1.0)], "company string, year int, field string, value double")
    assert sorted((r.field, r.year) for r in grid.profit_filter(w, w, ["company", "year"], "laba").collect()) == [("total_profit_loss", None), ("x", None)]
    axis = spark.createDataFrame([(2020,), (None,)], "year int")
    got = {(r.field, r.year): r.value for r in winners.fill_gaps(w, "company", "field", axis).collect()}
    assert got == {("total_profit_loss", None): 5.0, ("total_profit_loss", 2020): None, ("x", None): 1.0, ("x", 2020): 1.0}


def test_grid_columns_filters_and_facets(spark):
    assert grid.shown_columns(["b", "a"], ["a", "c"]) == ["a"] and grid.shown_columns(["b"], ["a"], ["b", "b", "a"]) == ["b", "a"]
    with pytest.raises(ValueError):
        grid.shown_columns(["a"], [], ["zz"])
    df = spark.createDataFrame([(1, "IDR"), (2, None), (3, " idr ")], "id int, c string")
    assert [r.id for r in df.where(grid.currency_is(F.col("c"), "idr")).collect()] == [1, 3]
    assert [r.id for r in df.where(grid.in_subsectors(F.col("c"), ["none", "IDR"])).orderBy("id").collect()] == [1, 2, 3]
    assert {r.value: r.n for r in grid.facet_with_selected(grid.facet(df, "c"), ["USD", "IDR"]).collect()} == {"IDR": 1, "none": 1, " idr ": 1, "USD": 0}


def test_results_grid_has_failed_checks_and_null_years(spark):
    values = spark.createDataFrame([(1, "a", None, "x", 1.0, 1.0, "IDR"), (2, "a", 2020, "y", 2.0, 1.0, None)], "id long, company string, year int, field string, value double, confidence double, currency string")
    checks = spark.createDataFrame([(1, "a", None, "c1", "ERROR"), (2, "a", None, "c1", "WARNING"), (3, "a", 2020, "c2", "VALID")], "id long, company string, year int, check_name string, status string")
    got = {r.year: (r.x, r.y, r.currency, r.failed) for r in grid.results(values, ["x", "y"], checks).collect()}
    assert got == {None: (1.0, None, "IDR", {"c1": "WARNING"}), 2020: (None, 2.0, "Not detected", None)}


def test_edits(spark):
    t = datetime.datetime
    log = spark.createDataFrame([(1, "k", t(2020, 1, 1), 5.0, 1.0, False), (2, "k", t(2020, 1, 2), 6.0, 5.0, False), (3, "gone", t(2020, 1, 1), 1.0, 0.0, False), (4, "gone", t(2020, 1, 3), None, None, True)], "id long, key string, ts timestamp, new double, old double, revert boolean")
    got = edits.fold(log, ["key"], "ts", "new", "old", F.col("revert")).collect()
    assert [(r.key, r.original_value, r.value, r.edits) for r in got] == [("k", 1.0, 6.0, 2)]
    values = spark.createDataFrame([(1, None, 10.0, "table", "IMPLAUSIBLE"), (1, 2020, 20.0, "table", "OK")], "document_id long, year int, value double, method string, status string")
    changes = spark.createDataFrame([(1, None, 11.0), (2, 2021, 7.0)], "document_id long, year int, value double")
    out = {(r.document_id, r.year): (r.value, r.original_value, r.method, r.status) for r in edits.overlay(values, changes, ["document_id", "year"]).collect()}
    assert out == {(1, None): (11.0, 10.0, "manual", "OK"), (1, 2020): (20.0, None, "table", "OK"), (2, 2021): (7.0, None, "manual", "OK")}
    new = spark.createDataFrame([(1, None), (3, 2020)], "document_id long, year int")
    free, clash = edits.add_missing(values, new, ["document_id", "year"])
    assert [tuple(r) for r in free.collect()] == [(3, 2020)] and [tuple(r) for r in clash.collect()] == [(1, None)]
    good, bad = edits.admit(spark.createDataFrame([("1,000.5",), ("abc",), ("9007199254740993",), (None,)], "raw string"))
    assert [r.raw for r in good.collect()] == ["1,000.5"] and {r.raw for r in bad.collect()} >= {"abc", "9007199254740993"}


def test_remap_in_rounds(spark, tmp_path):
    rows = spark.createDataFrame([(1, "d", "a", "b"), (2, "d", "b", "c"), (3, "d", "x", "y"), (4, "e", "m", "z"), (5, "e", "n", "z"), (6, "f", "p", "q"), (7, "f", "q", "p")], "id long, doc string, old string, new string")
    n = [0]

    def table(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / str(n[0])))
        return spark.read.parquet(str(tmp_path / str(n[0])))

    got = {r.id: r.old for r in edits.apply_remap(rows, ["doc"], "old", "new", table).collect()}
    assert got == {1: "b", 2: "c", 3: "y", 4: "z", 5: "n", 6: "p", 7: "q"}


def test_registry(spark):
    docs = spark.createDataFrame([(1, "FAILED"), (2, "PROCESSING"), (3, "DUPLICATE"), (4, "COMPLETED"), (5, "DISCOVERED")], "id long, status string")
    ids = lambda **k: sorted(r.id for r in registry.select_for_run(docs, **k).collect())
    assert ids() == [2, 5] and ids(retry_failed=True) == [1, 2, 5] and ids(force=True) == [1, 2, 4, 5]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "document_id long, v string"), spark.createDataFrame([(2, "z")], "document_id long, v string")
    assert sorted(tuple(r) for r in registry.replace_documents(old, new).collect()) == [(1, "x"), (2, "z")]


def test_modes_slices_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("d", "b"), ("d", "a"), ("d", "b"), ("d", "a"), ("e", None)], "k string, v string")
    assert [tuple(r) for r in summary.mode_of(df, ["k"], "v").collect()] == [("d", "a", 2)]
    s = spark.createDataFrame([("x", 1), ("new", 2), ("zero", 0)], "c string, n int")
    assert sorted((r.place, r.c, r.total) for r in summary.slices(s, "c", "n", ["zero", "x"]).collect()) == [(1, "x", 1), (2, "new", 2)]
    docs = spark.createDataFrame([(1, '{"a": 1.23456}'), (2, '{"a": 2, "t\\"x": "TEXT, 1.23456", "n": null, "l": [1, 2], "f": -0.00049, "b": true}'), (3, None), (4, "{}")], "id long, metrics string")
    assert [r.metrics for r in exports.rounded_metrics(docs).orderBy("id").collect()] == ['{"a":1.235}', '{"a":2,"t\\"x":"TEXT, 1.23456","n":null,"l":[1, 2],"f":0.0,"b":true}', None, "{}"]
    exports.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"), one_file=True)
    assert next((tmp_path / "out").glob("*.csv")).read_text().splitlines() == ["a,b", "1,"]


def test_page_cap_and_gaps(spark):
    p = spark.createDataFrame([("d", 1, None, 9), ("d", 2, "equity", 1), ("d", 3, None, 5)], "doc string, page_number int, section string, score int")
    assert sorted(r.page_number for r in winners.capped_pages(p, ["doc"], 2).collect()) == [1, 2]
    w = spark.createDataFrame([("a", "f", 2020, 1.0)], "company string, field string, year int, value double")
    axis = spark.createDataFrame([(2019,), (2020,)], "year int")
    assert sorted((r.year, r.value) for r in winners.fill_gaps(w, "company", "field", axis).collect()) == [(2019, None), (2020, 1.0)]


def test_rules_are_data(spark):
    """A rule table of one's own: a sum of three with an alternative, told as missing only beside its first field."""
    rows = [("net", "is", reconcile.EXPECTED, 1, "net", 0), ("net", "is", reconcile.ACTUAL, 1, "gross", 1), ("net", "is", reconcile.ACTUAL, 1, "revenue", 1), ("net", "is", reconcile.ACTUAL, -1, "tax", 2), ("net", "is", reconcile.ACTUAL, 0, "other.cost", 3)]
    rules = reconcile.Rules(rows, [reconcile.Check("net", due=("net",), shown=True)])
    figures = [(1, "is", "net", 50.0), (1, "is", "revenue", 100.0), (1, "is", "tax", 20.0), (1, "other", "cost", -30.0), (2, "is", "net", 1.0), (2, "is", "tax", 1.0), (3, "is", "tax", 1.0), (4, "other", "cost", 2e9), (4, "is", "net", 9e9), (4, "is", "gross", 5e9), (4, "is", "tax", 0.0)]
    out = {r.id: r for r in reconcile.identity_checks(spark.createDataFrame(figures, "id long, statement string, field string, normalized_value double"), ["id"], rules=rules).collect()}
    assert (out[1].status, out[1].expected, out[1].actual, out[1].evidence.top_line) == ("VALID", 50.0, 50.0, "revenue")
    assert out[1].message == "Difference 0.00 within tolerance (abs<=1,000 or rel<=0.1000%)" and out[1].evidence.values_used == {"net": 50.0, "gross": None, "revenue": 100.0, "tax": 20.0, "cost": -30.0}
    assert (out[2].status, out[2].evidence.missing_fields, out[2].evidence.reason) == ("NOT_APPLICABLE", ["gross", "revenue", "cost"], "Insufficient data")
    assert out[3].name == "no_checks_possible" and out[3].message.startswith("Not enough")
    assert (out[4].status, out[4].message) == ("ERROR", "Difference 6,000,000,000.00 (66.6667%) exceeds tolerance")


def test_plans_of_checks_stay_small_and_leave_out_what_nobody_reads(spark):
    values = spark.range(10).selectExpr("id", "'cash_flow' AS statement", "'ending_cash_balance' AS field", "1.0D AS normalized_value")
    checks = reconcile.identity_checks(values, ["id"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    counted = plan(checks.groupBy("status").count())
    assert len(counted) < 20_000 and "format_string" not in counted and "missing" not in counted
    assert len(plan(checks)) < 40_000


def test_admitted_and_rejected_edits_are_apart(spark):
    df = spark.createDataFrame([(1, None, "12"), (2, 2020, "1,234.5"), (3, None, "x"), (4, 2020, None), (5, None, "9007199254740992"), (6, 2020, "(5)")], "id long, year int, raw string")
    good, bad = edits.admit(df)
    assert sorted((r.id, float(r.new_value)) for r in good.collect()) == [(1, 12.0), (2, 1234.5)] and sorted(r.id for r in bad.collect()) == [3, 4, 5, 6]
    assert bad.columns == df.columns


def test_metrics_keep_what_is_nested(spark):
    texts = ['{"a":{"b":{"c":1.23456}}}', '{"a":[[1.5,2.25],[3]],"x":1.23456}', '{"t":"1.23456 \\" 2.34567","e":-1.5e-3}', "{}", "no 1.23456", None, "[1.00049, null]"]
    rows = exports.rounded_metrics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, metrics string")).orderBy("id").collect()
    assert [r.metrics for r in rows] == ['{"a":{"b":{"c":1.235}}}', '{"a":[[1.5,2.25],[3]],"x":1.235}', '{"t":"1.23456 \\" 2.34567","e":-0.002}', "{}", "no 1.23456", None, "[1.0, null]"]


def test_facets_beside_filters_in_one_scan(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 1, "x"), ("b", 1, ""), ("c", None, "y")]
    df = spark.createDataFrame(rows, "k string, n int, s string")
    filters = {"k": F.col("k").isin("a", "b"), "n": F.col("n") == 1}
    facets = {"k": grid.Facet(F.col("k"), "k", ("A", "q")), "n": grid.Facet(F.col("n"), "n"), "s": grid.Facet(F.col("s"), None), "t": grid.Facet(F.col("s"), "n", empty=None)}
    out = grid.facet_table(df, filters, facets)
    assert sorted(tuple(r) for r in out.collect()) == [("k", "a", 1), ("k", "b", 2), ("k", "q", 0), ("n", "1", 3), ("n", "2", 1), ("s", "x", 2), ("t", "x", 2)]
    assert grid.filtered(df, filters).count() == 3
    plan = grid.facet_table(df, filters, {"k": grid.Facet(F.col("k"), "k"), "n": grid.Facet(F.col("n"), "n")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    assert grid.pagination(df, 1, 0).first().pages == 0 and grid.page(df, [F.col("k")], 3, 0).count() == 0


def test_checks_meet_their_documents_without_a_broadcast(spark):
    from tallyspark import catalog_company

    plan = catalog_company.named_checks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan
