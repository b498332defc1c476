import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cells, labels, pages
from tallyspark.sources import filings

MERGES = [
    (["5", ",960,396"], ["5,960,396"]), (["5", "", ",960,396"], ["5,960,396"]), (["12", "", "x"], ["12", "", "x"]), (["(1.234", ".567)"], ["(1.234.567)"]), (["1.234.567", "8"], ["1.234.567", "8"]),
    (["Kas", "1.2", "34.567"], ["Kas", "1.234.567"]), (["(", "520.193", ")"], ["(520.193)"]), (["a", None, "b"], ["a", None, "b"]), ([], []), (["7"], ["7"]), (["1.", None, "5"], ["1.", None, "5"]),
]


def test_fragments(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(MERGES)], "i int, c array<string>")
    for r in df.select("i", cells.merge_fragments(F.col("c")).alias("m")).collect():
        assert r.m == MERGES[r.i][1], MERGES[r.i]


ROWS = [
    (["Kas dan setara kas", "4", "1.234.567", "987.654"], ("Kas dan setara kas", ["4", "1.234.567", "987.654"])), (["Total aset", "2023", "1.000", "Total assets"], ("Total aset 2023", ["1.000"])),
    (["", "Laba", None, "(5.000)", "", "7%"], ("Laba", ["(5.000)", "7%"])), (["Peningkatan sebesar", "5.000"], None), (["1.000", "2.000"], None), (["Label only"], None), (["Note 12a", "5.000"], ("Note 12a", ["5.000"])), ([], None),
]


def test_split(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(ROWS)], "i int, cells array<string>")
    got = {r.i: (r.label, r["values"]) for r in cells.split_rows(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(ROWS) if want}


def test_years(spark):
    df = spark.createDataFrame([([["x", "31 Dec 2023"], ["2022"], [None], ["2023"]],), ([["a"]] * 5 + [["2019 2018"]],)], "t array<array<string>>")
    out = df.select(cells.header_years(F.col("t")).alias("y")).collect()
    assert [r.y for r in out] == [[2023, 2022], [2019, 2018]]
    one = spark.createDataFrame([(["1", "2"], [2022, 2023])], "v array<string>, y array<int>").select(cells.zip_years(F.col("v"), cells.preferred_first(F.col("y"), F.lit(2023))).alias("z"), cells.zip_years(F.col("v"), F.array(F.lit(2023))).alias("u")).first()
    assert [tuple(x) for x in one.z] == [(2023, "1"), (2022, "2")] and [tuple(x) for x in one.u] == [(None, "1"), (None, "2")]


@pytest.mark.parametrize("text,section,parent", [("LAPORAN POSISI KEUANGAN\nAset", "balance_sheet", False), ("(Entitas Induk)\nNeraca", "balance_sheet", True), ("Entitas induk\ndan entitas anak\nNeraca", "balance_sheet", False), ("Informasi keuangan tambahan\nx", None, True), ("Statement of cash flows", "cash_flow", False), ("nothing", None, False), (None, None, False)])
def test_pages(spark, text, section, parent):
    r = pages.classify(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.section, r.is_parent_only) == (section, parent)


def test_scores_and_windows(spark):
    df = spark.createDataFrame([("laporan arus kas " + "1" * 60,), ("aset " + "2" * 201,), (None,)], "t string")
    assert [r[0] for r in df.select(pages.score(F.col("t"))).collect()] == [5, 3, 0]
    rows = spark.createDataFrame([("a", i, f"p{i}") for i in range(1, 9)], "d string, n int, text string")
    assert [(r.window, r.n_pages) for r in pages.page_windows(rows, ["d"], "n").orderBy("window").collect()] == [(0, 6), (1, 2)]
    words = spark.createDataFrame([(1, 0, 0, 2, "kas"), (1, 0, 0, 1, "arus"), (1, 0, 1, 1, "5")], "page int, block int, line int, word int, text string")
    assert sorted(r.text for r in pages.lines_from_words(words, ["page"]).collect()) == ["5", "arus kas"]


def test_label_cascade(spark):
    entries = [("balance_sheet", 0, "cash", "Kas dan setara kas", 0), ("cash_flow", 2, "cash_end", "Kas dan setara kas", 0), ("balance_sheet", 0, "assets", "Total aset", 1), ("income_statement", 1, "profit", "Laba (rugi) bersih", 0)]
    dictionary = spark.createDataFrame(entries, "statement string, stmt_ord int, field string, label string, label_ord int")
    rows = [(1, "KAS dan  setara kas", "cash_flow"), (2, "Kas dan setara kas", None), (3, "1. Total aset (catatan 4)", None), (4, "TOTALASET", None), (5, "other", None), (6, None, None)]
    got = {r.i: (r.field, r.tier) for r in labels.map_labels(spark.createDataFrame(rows, "i int, label string, section string"), dictionary, "i").collect()}
    assert got == {1: ("cash_end", 1), 2: ("cash", 1), 3: ("assets", 2), 4: ("assets", 3), 5: (None, None), 6: (None, None)}


def brute_rows(text):
    years = []
    for y in re.findall(r"\b(20\d{2})\b", text[:800]):
        if int(y) not in years:
            years.append(int(y))
    out = []
    for n, line in enumerate(text.split("\n")):
        line = line.strip()
        m = re.match(r"^(.*?)[\s.…]+((?:[\s]*+[-–(]?[\s]*+(?:Rp[\s]*+)?[\d.,]++[\s]*+[)]?)+)[\s]*+$", line) if len(line) >= 4 else None
        if not m:
            continue
        label = m[1].strip(" .:|-")
        tokens = [t.strip() for t in re.findall(r"[-–(]?\s*(?:Rp\s*)?\d[\d.,]*\)?", m[2])]
        if not label or not tokens or re.search("[A-Za-z]{3,}", label.split()[-1]):
            continue
        fits = years and len(years) == len(tokens)
        out += [(n, label, k, years[k] if fits else None, t) for k, t in enumerate(tokens)]
    return out


def test_free_text(spark):
    texts = ["2023 2022\nAset (A) .... 1.234 (567)\nLaba neto 5\nTotal 9 a\nKas Rp 12", "x", "", "No 1 .... 5\nItem b2 - 7,5 8 9", "a" * 5000, "ab 1 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r.i, r.line_no, r.label, r.value_idx, r.year, r.raw) for r in filings.free_text_rows(df, "t", ["i"]).collect())
    assert got == sorted((i, *row) for i, t in enumerate(texts) for row in brute_rows(t))
