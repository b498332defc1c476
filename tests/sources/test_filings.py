from tallyspark.operators import grid
import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import extract, pages as page_ops, cells, registry
from tallyspark.sources import filings
from tallyspark.streaming.ingest import ingest_new

COVER_PAGE = "<html><head><title>x</title></head><body><table><tr><td>Mata uang pelaporan</td></tr></table><p>Rupiah / IDR</p><p>Description of presentation currency</p><p>Jutaan / In Million</p><p>Level of rounding used in financial statements</p><p>Subsektor</p><p>Banks &amp; Co</p><p>Subsector</p></body></html>"
SHEET = "<body><p>Laporan posisi keuangan</p><table><tr><td></td><td>2023</td><td>2022</td></tr><tr><td>Kas dan setara kas</td><td>1.234.567</td><td>987.654</td></tr><tr><td>Total aset</td><td>5.000.000</td><td>(4.000.000)</td></tr><tr><td> </td></tr><tr><td>Tidak dikenal</td><td>1.000.000</td><td>2.000.000</td></tr></table></body>"


def tree(tmp_path):
    for company, folder, name, text in [("AAA", "2023", "1000000.html", COVER_PAGE), ("AAA", "2023", "1210000.html", SHEET), ("AAA", "notes", "x.html", SHEET), ("BBB", "FY 2022", "b.html", SHEET), ("BBB", "FY 2022", "a.html", "<p> </p>")]:
        (tmp_path / company / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / company / folder / name).write_text(text)
    return str(tmp_path)


def test_folder_to_values(spark, tmp_path):
    found = filings.read_filing_tree(spark, tree(tmp_path))
    docs = filings.filings_of(found)
    assert sorted((r.company, r.year, r.filename, r.file_path.rpartition("/")[2], r.page_count) for r in docs.collect()) == [("AAA", 2023, "AAA 2023", "1000000.html", 2), ("BBB", 2022, "BBB 2022", "a.html", 2)]
    assert {r.company for r in filings.read_filing_tree(spark, str(tmp_path), limit=1).collect()} == {"AAA"}
    docs = docs.withColumns({"document_id": F.col("filename"), "reporting_year": F.col("year")})
    lined = found.withColumn("lines", filings.visible_lines(F.col("html"))).withColumn("text", F.array_join("lines", "\n")).withColumn("document_id", F.col("filename"))
    numbered = filings.number_pages(lined, ["document_id"])
    assert sorted((r.document_id, r.page_number, r.name) for r in numbered.collect()) == [("AAA 2023", 1, "1000000.html"), ("AAA 2023", 2, "1210000.html"), ("BBB 2022", 2, "b.html")]
    lines = numbered.select("document_id", "page_number", F.posexplode("lines").alias("line_no", "line"))
    cover = filings.cover_attributes(lines, ["document_id", "page_number"])
    declared = filings.document_attributes(cover, ["document_id"], ["multiplier", "currency", "sub_sector"])
    assert {r.document_id: (r.multiplier, r.currency, r.sub_sector) for r in declared.collect()} == {"AAA 2023": (10**6, "IDR", "Banks & Co"), "BBB 2022": (None, None, None)}
    pages = page_ops.classify(numbered)
    grid = filings.cell_grid(pages, "html", ["document_id", "page_number"])
    rows = grid.groupBy("document_id", "page_number", "table_idx", "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell_idx", "raw"))), lambda c: c["raw"]).alias("cells"))
    years = rows.groupBy("document_id", "page_number", "table_idx").agg(cells.header_years(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"])).alias("years"))
    split = cells.split_rows(rows.join(years, ["document_id", "page_number", "table_idx"])).withColumn("values", cells.zip_years(F.col("values"), F.col("years"))).withColumn("row_id", F.xxhash64("document_id", "page_number", "table_idx", "row_idx"))
    dictionary = spark.createDataFrame([("balance_sheet", 0, "cash", "Kas dan setara kas", 0), ("balance_sheet", 0, "total_assets", "Total aset", 1)], "statement string, stmt_ord int, field string, label string, label_ord int")
    values, unmapped = extract.extract_values(split, pages, extract.resolve_units(pages, declared), docs, dictionary)
    got = {(r.document_id, r.field, r.year): (r.normalized_value, r.currency, r.status) for r in values.collect()}
    assert got[("AAA 2023", "cash", 2023)] == (1_234_567e6, "IDR", "OK") and got[("AAA 2023", "total_assets", 2022)] == (-4e12, "IDR", "OK") and got[("BBB 2022", "cash", 2022)][0] == 987_654
    assert len(got) == 8 and {r.status for r in unmapped.collect()} == {"UNMAPPED_FIELD"}


def test_flat_corpus(spark, tmp_path):
    (tmp_path / "root" / "CCC").mkdir(parents=True)
    (tmp_path / "root" / "CCC" / "report 2021.pdf").write_bytes(b"x")
    (tmp_path / "root" / "top.pdf").write_bytes(b"x")
    got = filings.read_flat_corpus(spark, str(tmp_path / "root"))
    assert sorted((r.company, r.filename, r.year) for r in got.collect()) == [("CCC", "report 2021.pdf", 2021), ("root", "top.pdf", None)]
    found = got.select("file_path", "file_hash")
    known = found.limit(0).withColumn("status", F.lit("COMPLETED"))
    assert sorted(r.status for r in registry.register(found, known).collect()) == ["DISCOVERED", "DUPLICATE"]


def test_register_and_company_list(spark, tmp_path):
    df = spark.createDataFrame([("1", "AALI", "Astra Agro", "09 Des 1997"), ("x", "y", "z", "no date")], "a string, b string, c string, d string")
    assert [tuple(r) for r in filings.listing_register(df).collect()] == [("AALI", "Astra Agro", datetime.date(1997, 12, 9))]
    with pytest.raises(ValueError):
        filings.listing_register(df.where("a = 'x'"))
    (tmp_path / "list.csv").write_text("No,Kode,Nama Perusahaan\n1,AALI,Astra\n2,,none\n")
    assert [tuple(r) for r in filings.company_list(spark, str(tmp_path / "list.csv")).collect()] == [("AALI", "Astra")]


def test_entities(spark):
    cases = {"a &amp; b &eacute;&#233;&#xE9;": "a & b ééé", "&amp;lt; &lt;": "&lt; <", "&unknown; & &#0; &#x110000; &#55296;": "&unknown; & \ufffd \ufffd \ufffd", "&#8211;&#128512;&nbsp;&apos;": "–😀\xa0'", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(filings.unescape(F.col("t"))).collect()] == list(cases.values())
    page = spark.createDataFrame([("<p>Caf&eacute; &#8211; x</p><table><tr><td>&lt;b&gt;&nbsp;1</td></tr></table>",)], "h string")
    assert page.select(filings.visible_lines(F.col("h"))).first()[0] == ["Café – x", "<b> 1"]


def test_visible_lines_read_the_entities_of_their_sql(spark, tmp_path):
    import duckdb

    from tallyspark import catalog

    pages = ["<h1>cut&amp</h1><p>a&amp;amp &lt &lt;b&gt;&nbsp;&#39;&#39 &eacute;&copy &copy;&amp;lt;</p>", "<p>R&amp;D &AMP; &amp</p><br>&hellip;&mdash;&ndash;&middot;&reg;&quot;", "&amp", ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["html_visible_lines"](spark, str(tmp_path)).orderBy("page_id").collect()
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert [tuple(r) for r in got] == sorted(duckdb.sql(catalog.ORACLE["html_visible_lines"]).fetchall())
    assert spark.createDataFrame([("cut&amp</b>",)], "h string").select(filings.visible_lines(F.col("h"))).first()[0] == ["cut&"]  # the operator's default


def test_replies_that_do_not_parse_are_rejects(spark):
    rows = [(1, 'x {"equity": [{"field": "f", "label": "l", "value": "5", "year": 2020}], "cash_flow": []}'), (2, '{"equity": ['), (3, None), (4, "no braces"), (5, "{}")]
    good, bad = filings.external_observations(spark.createDataFrame(rows, "id int, reply string"), "reply", ["id"])
    assert [(r.id, r.statement, r.field, r.year) for r in good.collect()] == [(1, "equity", "f", 2020)] and sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_second_run_takes_nothing(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        ingest_new(spark, str(tmp_path / "in"), "id long", str(tmp_path / "state"), lambda batch, n: seen.append(batch.count()))
    assert sum(seen) == 5


def test_entities_are_those_of_the_standard_library(spark):
    import html
    import random
    from html.entities import html5

    rng = random.Random(4)
    names = sorted(html5)
    made = ["&" + rng.choice(names)[: rng.randrange(1, 12)] + rng.choice(["", ";", "x", " ", "&", "1;"]) for _ in range(600)] + ["&" + n for n in names]
    made += [f"&#{rng.choice(['', 'x', 'X'])}{rng.choice([0, 1, 7, 9, 10, 13, 65, 127, 128, 129, 141, 150, 159, 160, 8364, 55296, 57343, 64976, 65534, 131071, 1114111, 1114112, 99999999999])}{rng.choice(['', ';', 'g', ' 5'])}" for _ in range(300)]
    made += ["&#x80;", "&#X1F600 x", "a & b", "&&amp;amp;", "&notit;", "&notin;", "&", "&;", "&#;", "&#x;", "no entity", "&NotEqualTilde;", "&ampersand", "&lt&gt"]
    made += ["".join(rng.choice(made) for _ in range(5)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in made], "t string").select("t", filings.unescape(F.col("t")).alias("u")).collect()
    assert [(r.t, r.u) for r in rows if r.u != html.unescape(r.t)] == []


def test_register_of_three_columns(spark):
    rows = [("Kode", "Nama", "Tanggal"), ("AALI", "Astra Agro Lestari Tbk.", "09 Des 1997"), ("BBBB", None, "1 Jan 2001"), (None, "No code", "1 Jan 2001"), ("CCCC", "Later Tbk", "belum tercatat"), ("DDDD", "PT Tbk.", "1 Jan 2001"), ("AALI", "Astra Agro Lestari", "1 Jan 1990"), ("ZZZZ", "Astra Agro Lestari", "1 Jan 2005")]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, a string, b string, c string").coalesce(1)
    out = filings.listing_register(raw.select("a", "b", "c", "n"), F.col("n"))
    assert [(r.code, str(r.listed_on), r.row_no) for r in out.orderBy("row_no").collect()] == [("AALI", "1997-12-09", 1), ("AALI", "1990-01-01", 6), ("ZZZZ", "2005-01-01", 7)]
    companies = spark.createDataFrame([("AALI Astra Agro Lestari Tbk",), ("PT Astra Agro Lestari",)], "company string")
    assert [str(r.listed_on) for r in grid.listing_dates(companies, out).orderBy("company").collect()] == ["1990-01-01", "1997-12-09"]  # of one full key the last row, of one name the first


def test_a_companys_year_lists_one_folder(spark, tmp_path):
    for company in ("PT AAA Tbk", "PT B{1} Tbk", "PT CCC Tbk"):
        for year in ("2023", "FY 2024", "2019-2020", "none"):
            (tmp_path / company / year).mkdir(parents=True)
            for name in ("1000000.html", "1210000.html"):
                (tmp_path / company / year / name).write_text(f"<p>{company} {year} {name}</p>")
    whole = filings.read_filing_tree(spark, str(tmp_path))
    assert whole.count() == 18
    for companies, years, n in [(["PT AAA Tbk"], [2024], 2), (["PT B{1} Tbk"], None, 6), (None, [2023, 2024], 12), (["PT AAA Tbk"], [2020], 0), (["PT AAA Tbk", "PT CCC Tbk"], [2019], 4)]:
        some = filings.read_filing_tree(spark, str(tmp_path), companies=companies, years=years)
        want = whole.where((F.col("company").isin(*companies) if companies else F.lit(True)) & (F.col("year").isin(*years) if years else F.lit(True)))
        assert sorted(r.path for r in some.collect()) == sorted(r.path for r in want.collect()) and some.count() == n
    one = filings.read_filing_tree(spark, str(tmp_path), companies=["PT AAA Tbk"], years=[2024])
    assert len(one.inputFiles()) == 2 and all("AAA" in f and "2024" in f for f in one.inputFiles())


def test_pages_that_come_into_the_tree_by_a_stream(spark, tmp_path):
    root, seen = tmp_path / "tree", []
    for year in (2023, 2024):
        (root / "PT AAA Tbk" / str(year)).mkdir(parents=True)
        (root / "PT AAA Tbk" / str(year) / "1000000.html").write_text(f"<p>{year}</p>")
        query = filings.stream_filing_tree(spark, str(root)).writeStream.foreachBatch(lambda b, _: seen.extend((r.company, r.year, r.html) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert seen == [("PT AAA Tbk", 2023, "<p>2023</p>"), ("PT AAA Tbk", 2024, "<p>2024</p>")]
