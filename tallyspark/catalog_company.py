"""Registered queries over companies, documents and whole reports, and the SQL each must agree with.

An order is a document of its customer's and at once a reading (``catalog.READINGS``); the text behind
its priority's number is the subsector that it declares, blank on every fourth.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog import CHECKS_SQL, FIELDS, KEYS, READINGS, WINNERS, filing_checks, query, readings, table, won
from tallyspark.functions import names, units
from tallyspark.operators import cells, edits, extract, grid, pages, registry, summary, winners
from tallyspark.plans import exports

DOCS = """docs AS (SELECT o_orderkey AS id, 'C' || o_custkey AS company, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'DUPLICATE' ELSE 'COMPLETED' END AS status,
    CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 40 AS INTEGER) END AS page_count, o_orderkey % 5 = 0 AS ocr_used, CASE WHEN o_orderkey % 5 > 1 THEN 'TEXT' ELSE 'SCANNED' END AS pdf_type,
    CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 21) / 20.0E0 END AS avg_confidence, CASE WHEN o_orderkey % 4 > 0 THEN 'OK' ELSE '' END AS extraction_status, CASE WHEN o_orderkey % 9 > 0 THEN 'VALID' END AS validation_status,
    'f' || o_orderkey || '.html' AS filename, '/in/C' || o_custkey || '/f' || o_orderkey || '.html' AS file_path FROM orders)"""
CHECKS = f"""{CHECKS_SQL}, named AS (SELECT k AS id, 'C' || o_custkey AS company, CASE WHEN k % 10 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, name AS check_name, status,
    CASE WHEN name = 'treasury_shares_positive_value' THEN 'low_confidence' WHEN name = 'no_checks_possible' THEN 'incomplete_statement' WHEN status = 'NOT_APPLICABLE' THEN 'missing_fields' WHEN status = 'WARNING' THEN 'rounding_difference' ELSE 'accounting_mismatch' END AS category
    FROM checks JOIN orders ON o_orderkey = k)"""
SUBSECTORS = """told AS (SELECT o_orderkey AS id, 'C' || o_custkey AS company, CASE WHEN o_orderkey % 5 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 6 > 0 THEN ' ' || substr(o_orderpriority, 3) ELSE '  ' END AS text_value,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0.75E0 ELSE 1.0E0 END AS confidence FROM orders),
    subsectors AS (SELECT company, trim(text_value) AS subsector FROM told WHERE trim(text_value) <> '' QUALIFY row_number() OVER (PARTITION BY company ORDER BY coalesce(confidence, 0) DESC, id) = 1)"""


def documents(spark, sf):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/in/C"), "o_custkey", F.lit("/f"), k, F.lit(".html"))
    return table(spark, sf, "orders").select(
        k.alias("id"), F.concat(F.lit("C"), "o_custkey").alias("company"), F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "DUPLICATE").otherwise("COMPLETED").alias("status"),
        F.when(k % 7 > 0, (k % 40).cast("int")).alias("page_count"), (k % 5 == 0).alias("ocr_used"), F.when(k % 5 > 1, "TEXT").otherwise("SCANNED").alias("pdf_type"), F.when(k % 6 > 0, (k % 21) / 20).alias("avg_confidence"),
        F.when(k % 4 > 0, "OK").otherwise("").alias("extraction_status"), F.when(k % 9 > 0, "VALID").alias("validation_status"), F.concat(F.lit("f"), k, F.lit(".html")).alias("filename"), path.alias("file_path"),
    )


def named_checks(spark, sf):
    k = F.col("o_orderkey")
    owners = table(spark, sf, "orders").select(k.alias("document_id"), F.concat(F.lit("C"), "o_custkey").alias("company"), F.when(k % 10 > 0, F.year("o_orderdate")).alias("year"))
    # Merged, not broadcast: Spark guesses the checks' size from before their explode and would send all of them through the driver.
    return filing_checks(spark, sf).join(owners.hint("merge"), "document_id").withColumnsRenamed({"document_id": "id", "name": "check_name"})


def declared(spark, sf):
    k = F.col("o_orderkey")
    text = F.when((k % 4 > 0) & (F.col("o_custkey") % 6 > 0), F.concat(F.lit(" "), F.substr("o_orderpriority", F.lit(3)))).otherwise("  ")
    conf = F.when(k % 3 == 1, 0.75).when(k % 3 == 2, 1.0)
    return table(spark, sf, "orders").select(k.alias("id"), F.concat(F.lit("C"), "o_custkey").alias("company"), F.when(k % 5 > 0, F.year("o_orderdate")).alias("year"), F.lit("sub_sector").alias("field"), text.alias("text_value"), conf.alias("confidence"))


@query(f"WITH {SUBSECTORS} SELECT * FROM subsectors")
def subsector_winner(spark, sf):
    return winners.subsector_winner(declared(spark, sf))


@query(f"WITH {SUBSECTORS} SELECT company, trim(text_value) AS subsector, year FROM told WHERE trim(text_value) <> '' AND year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company ORDER BY year DESC, id DESC) = 1")
def latest_subsector(spark, sf):
    return winners.latest_subsector(declared(spark, sf))


@query(f"WITH {SUBSECTORS} SELECT subsector, count(*) AS companies FROM subsectors GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def subsector_counts(spark, sf):
    """A top-twelve report: the limit is the feature."""
    return summary.subsector_counts(winners.subsector_winner(declared(spark, sf)))


@query(f"WITH {SUBSECTORS} SELECT count(DISTINCT company) AS undeclared FROM told WHERE company NOT IN (SELECT company FROM subsectors)")
def undeclared_subsectors(spark, sf):
    rows = declared(spark, sf)
    return summary.undeclared_subsectors(rows, winners.subsector_winner(rows))


@query(f"""WITH {WINNERS}, {SUBSECTORS}, g AS (SELECT DISTINCT w.company, w.year FROM winners w JOIN winners p ON p.company = w.company AND p.year = w.year AND p.field = 'F' AND p.value > 0),
    c AS (SELECT coalesce(subsector, 'none') AS value, count(*) AS n FROM g LEFT JOIN subsectors USING (company) GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'Banks', 0""")
def subsector_facet(spark, sf):
    """Over the profitable rows of the grid, with one selected subsector that no row has and one that some have in another case."""
    w = won(spark, sf)
    rows = grid.profit_filter(w.select("company", "year").distinct(), w, ["company", "year"], "laba", "F")
    return grid.subsector_facet(grid.with_subsector(rows, declared(spark, sf)), ["Banks", "urgent", "none"])


@query(f"""WITH {WINNERS}, {SUBSECTORS} SELECT company, year, field, subsector FROM winners LEFT JOIN subsectors USING (company) WHERE subsector IS NULL OR lower(subsector) = 'high'""")
def subsector_filter(spark, sf):
    rows = grid.with_subsector(won(spark, sf), declared(spark, sf))
    return rows.where(grid.in_subsectors(F.col("subsector"), ["HIGH", "none"])).select(*KEYS, "subsector")


@query(f"""WITH {READINGS}, c AS (SELECT coalesce(currency, 'none') AS value, count(*) AS n FROM readings WHERE field IN ('F', 'O') GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'EUR', 0""")
def currency_facet(spark, sf):
    return grid.currency_facet(readings(spark, sf), ["F", "O"], "eur")


@query(f"""WITH {READINGS}, {DOCS}, {CHECKS}, k AS (SELECT r.*, CASE id % 8 WHEN 0 THEN 'IMPLAUSIBLE' WHEN 1 THEN NULL ELSE 'OK' END AS st FROM readings r WHERE id % 3 > 0),
    t AS (SELECT company, count(DISTINCT id) AS documents_with_values, count(*) AS figures, count(DISTINCT year) AS years, count(DISTINCT field) AS fields, array_to_string(list_sort(list(DISTINCT currency) FILTER (currency IS NOT NULL)), ',') AS currencies FROM k GROUP BY 1),
    c AS (SELECT company, year, field, arg_min(struct_pack(st := st, cur := currency), struct_pack(c := -confidence, id := id)) AS w, coalesce(CASE WHEN count(value) >= 2 AND max(value) > 0 THEN (max(value) - min(value)) / max(value) > 0.5 END, false) AS disputed FROM k GROUP BY ALL),
    q AS (SELECT company, count(*) FILTER (disputed) AS disputed_cells, count(*) FILTER (w.st <> 'OK') AS flagged_cells, count(*) FILTER (w.cur IS NULL) AS cells_without_currency FROM c GROUP BY 1),
    f AS (SELECT n.company, count(DISTINCT check_name) AS failed_checks FROM named n LEFT JOIN t USING (company) WHERE n.status IN ('ERROR', 'WARNING') AND (n.year IS NULL OR coalesce(t.years, 0) = 0 OR EXISTS (SELECT 1 FROM k WHERE k.company = n.company AND k.year = n.year)) GROUP BY 1)
    SELECT d.company, d.documents, coalesce(documents_with_values, 0) AS documents_with_values, coalesce(figures, 0) AS figures, coalesce(years, 0) AS years, coalesce(fields, 0) AS fields, coalesce(currencies, '') AS currencies,
        coalesce(disputed_cells, 0) AS disputed_cells, coalesce(flagged_cells, 0) AS flagged_cells, coalesce(cells_without_currency, 0) AS cells_without_currency, coalesce(failed_checks, 0) AS failed_checks
    FROM (SELECT company, count(*) AS documents FROM docs GROUP BY 1) d LEFT JOIN t USING (company) LEFT JOIN q USING (company) LEFT JOIN f USING (company)""")
def company_profile(spark, sf):
    """Two thirds of the documents have values, each one its own reading."""
    k = F.col("id") % 8
    values = readings(spark, sf).where("id % 3 > 0").withColumn("document_id", F.col("id")).withColumn("status", F.when(k == 0, "IMPLAUSIBLE").when(k > 1, "OK"))
    out = grid.company_profile(values, documents(spark, sf), named_checks(spark, sf))
    return out.withColumn("currencies", F.array_join("currencies", ","))


@query(f"""WITH {READINGS}, {DOCS}, {CHECKS} SELECT count(DISTINCT company) AS companies, count(*) AS documents, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages, count(*) FILTER (ocr_used) AS ocr_documents, count(*) FILTER (pdf_type = 'TEXT') AS text_documents,
    round(avg(avg_confidence), 4) AS average_confidence, (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM docs GROUP BY 1)) AS status_counts, (SELECT count(*) FROM readings) AS extracted_values, (SELECT count(*) FROM named) AS validation_checks FROM docs""")
def run_summary(spark, sf):
    out = summary.run_summary(documents(spark, sf), readings(spark, sf), named_checks(spark, sf))
    return out.withColumn("status_counts", F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(f"""WITH {READINGS}, {DOCS}, {CHECKS} SELECT 'document_status' AS section, status AS name, NULL AS status, count(*) AS n FROM docs GROUP BY 2 UNION ALL SELECT 'extraction_status', extraction_status, NULL, count(*) FROM docs WHERE extraction_status <> '' GROUP BY 2
    UNION ALL SELECT 'validation_status', validation_status, NULL, count(*) FROM docs WHERE validation_status IS NOT NULL GROUP BY 2 UNION ALL SELECT 'check_status', status, NULL, count(*) FROM named GROUP BY 2 UNION ALL SELECT 'check_name', check_name, status, count(*) FROM named GROUP BY 2, 3
    UNION ALL SELECT 'check_category', category, NULL, count(*) FROM named GROUP BY 2 UNION ALL SELECT 'values', 'low_confidence', NULL, count(*) FILTER (confidence < 0.8) FROM readings""")
def dashboard_counts(spark, sf):
    return summary.dashboard_counts(documents(spark, sf), readings(spark, sf), named_checks(spark, sf))


_READ = """r AS (SELECT d.*, o_orderpriority LIKE '1%' AS has FROM docs d JOIN orders ON o_orderkey = id)"""


def urgent_values(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("document_id"))


@query(f"""WITH {DOCS}, {_READ}, c AS (SELECT company, count(*) AS n, count(*) FILTER (has) AS k FROM r GROUP BY 1) SELECT count(*) AS companies_discovered, count(*) FILTER (k > 0) AS companies_with_values, count(*) FILTER (k = 0) AS companies_without_values, CAST(sum(n) AS BIGINT) AS documents_total, CAST(sum(k) AS BIGINT) AS documents_with_values FROM c""")
def coverage_totals(spark, sf):
    return summary.coverage(documents(spark, sf), urgent_values(spark, sf))


@query(f"WITH {DOCS}, {_READ} SELECT company, status, count(*) AS n FROM r WHERE company NOT IN (SELECT company FROM r WHERE has) GROUP BY ALL")
def unread_documents(spark, sf):
    return summary.unread_documents(documents(spark, sf), urgent_values(spark, sf))


@query(f"WITH {DOCS}, {_READ} SELECT status, count(*) AS n FROM r WHERE company NOT IN (SELECT company FROM r WHERE has) GROUP BY ALL")
def unread_by_status(spark, sf):
    return summary.unread_by_status(documents(spark, sf), urgent_values(spark, sf))


@query("""WITH reg AS (SELECT 'S' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) AS code, s_name AS name, make_date(CAST(1980 + s_suppkey % 40 AS INTEGER), 1, 1) AS listed_on FROM supplier),
    k AS (SELECT name AS nm, lower(code || ' ' || regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')) AS f, lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')) AS n, listed_on FROM reg),
    c AS (SELECT c_custkey, c_custkey % 4 AS kind, lower(regexp_replace('Supplier#' || split_part(c_name, '#', 2), '[^A-Za-z0-9]+', ' ', 'g')) AS n, 's' || chr(CAST(97 + c_custkey % 26 AS INTEGER)) AS code FROM customer)
    SELECT c_custkey, CASE WHEN kind < 3 THEN (SELECT min(listed_on) FROM k WHERE CASE kind WHEN 0 THEN k.f = c.code || ' ' || c.n ELSE k.n = c.n END OR (kind = 0 AND k.n = c.n)) END AS listed_on FROM c""")
def listing_cascade(spark, sf):
    """Companies by code and name, by name with legal words, by name behind an unknown ticker, and behind what is no ticker."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    letter = lambda k: F.chr(F.lit(65) + k % 26)
    register = table(spark, sf, "supplier").select(F.concat(F.lit("S"), letter(s)).alias("code"), F.col("s_name").alias("name"), F.make_date((F.lit(1980) + s % 40).cast("int"), F.lit(1), F.lit(1)).alias("listed_on"))
    name = F.concat(F.lit("Supplier#"), F.element_at(F.split("c_name", "#"), 2))
    kind = c % 4
    company = F.when(kind == 0, F.concat(F.lit("S"), letter(c), F.lit(" "), name)).when(kind == 1, F.concat(F.lit("PT "), name, F.lit(" (Persero) Tbk."))).when(kind == 2, F.concat(F.lit("QQQQ "), name)).otherwise(F.concat(F.lit("Other "), name))
    return grid.listing_dates(table(spark, sf, "customer").select("c_custkey", company.alias("company")), register).select("c_custkey", "listed_on")


@query(f"WITH {DOCS} SELECT id, company, file_path FROM docs WHERE status = 'COMPLETED' AND validation_status = 'VALID' AND contains(lower(company), 'c1') AND contains(lower(concat_ws(' ', company, filename, file_path)), 'f12')")
def documents_list(spark, sf):
    return grid.documents_list(documents(spark, sf), "F12", "c1", status="COMPLETED", validation_status="VALID").select("id", "company", "file_path")


@query(f"WITH {CHECKS} SELECT id, company, year, check_name FROM named WHERE status = 'ERROR' AND category = 'accounting_mismatch' AND year = 1995 AND contains(lower(company), 'c2') AND contains(check_name, 'profit')")
def checks_list(spark, sf):
    return grid.checks_list(named_checks(spark, sf), "PROFIT", "C2", status="ERROR", category="accounting_mismatch", year=1995).select("id", "company", "year", "check_name")


@query(f"WITH {WINNERS}, g AS (SELECT DISTINCT company, year FROM winners) SELECT count(*) AS total, 3 AS page, 50 AS page_size, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM g")
def grid_pagination(spark, sf):
    return grid.pagination(won(spark, sf).select("company", "year").distinct(), 3, 50)


@query("SELECT doc_id, lang, length(coalesce(text, '')) AS text_length FROM documents")
def pages_list(spark, sf):
    return grid.pages_list(table(spark, sf, "documents").select("doc_id", "lang", "text"))


@query(f"""WITH {READINGS} SELECT company, year, field FROM readings WHERE contains(lower(company), 'c12') AND year = 1996""")
def company_year_scope(spark, sf):
    return grid.scope(readings(spark, sf), " C12", 1996).select(*KEYS)


@query(f"""WITH {READINGS}, r AS (SELECT id, company, CASE WHEN id % 4 > 0 THEN year END AS year, field, value, confidence FROM readings),
    w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY company, year, field ORDER BY confidence DESC, id) = 1), p AS (SELECT company, year FROM w WHERE field = 'F' AND value > 0)
    SELECT w.company, w.year, w.field, w.value FROM w JOIN p ON p.company = w.company AND p.year IS NOT DISTINCT FROM w.year""")
def undated_profit_filter(spark, sf):
    """A quarter of the readings has no year; it is a key like any other."""
    w = winners.cell_winner(readings(spark, sf).withColumn("year", F.when(F.col("id") % 4 > 0, F.col("year"))), KEYS)
    return grid.profit_filter(w, w, ["company", "year"], "laba", "F").select(*KEYS, "value")


@query("""WITH d AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN -2 WHEN l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'A' THEN 2 ELSE 1 END AS rank FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank FROM d WHERE rank > -2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY rank DESC, l_discount DESC, l_partkey, l_suppkey, l_extendedprice) = 1""")
def validation_winner(spark, sf):
    rank = winners.extraction_rank(F.col("l_returnflag") == "R", F.lit(False), F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")
    rows = table(spark, sf, "lineitem").withColumn("rank", rank)
    return winners.validation_winner(rows, ["l_orderkey", "l_linenumber"], "rank", "l_discount", ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank")


@query("""WITH p AS (SELECT doc_id % 50 AS filing, doc_id AS page_number, CASE doc_id % 7 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'notes' WHEN 2 THEN 'equity' END AS section, n_chars AS score FROM documents)
    SELECT filing, page_number, section FROM p QUALIFY row_number() OVER (PARTITION BY filing ORDER BY CASE WHEN section IN ('balance_sheet', 'equity') THEN 0 ELSE 1 END, score DESC, page_number) <= 6""")
def capped_pages(spark, sf):
    """At most six pages a filing, statement pages first: the cap is the feature."""
    k = F.col("doc_id") % 7
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("filing"), F.col("doc_id").alias("page_number"), F.when(k == 0, "balance_sheet").when(k == 1, "notes").when(k == 2, "equity").alias("section"), F.col("n_chars").alias("score"))
    return winners.capped_pages(rows, ["filing"], 6).select("filing", "page_number", "section")


@query("""WITH y AS (SELECT doc_id, '20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') AS a, '20' || lpad(CAST(doc_id % 11 AS VARCHAR), 2, '0') AS b FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(a AS INTEGER) WHEN 1 THEN CAST(a AS INTEGER) WHEN 2 THEN CASE WHEN CAST(b AS INTEGER) >= 2005 THEN CAST(b AS INTEGER) WHEN CAST(a AS INTEGER) >= 2005 THEN CAST(a AS INTEGER) END END AS year FROM y""")
def year_in_text(spark, sf):
    """Texts with a phrase, a date, only years (the second twice), or none, before each document's letters."""
    k = F.col("doc_id")
    two = lambda n: F.concat(F.lit("20"), F.lpad((k % n).cast("string"), 2, "0"))
    letters = F.regexp_replace("text", "[^a-z ]", "")
    said = F.when(k % 4 == 0, F.concat(F.lit(" tahun buku: "), two(30))).when(k % 4 == 1, F.concat(F.lit(" 31 Desember "), two(30))).when(k % 4 == 2, F.concat(two(11), F.lit(" "), two(30), F.lit(" "), two(11))).otherwise("none")
    return table(spark, sf, "documents").select("doc_id", names.year_in_text(F.concat(said, F.lit(" "), letters)).alias("year"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey > 0 THEN '(' || format('{:,.2f}', o_orderkey / 4.0) || ')' ELSE format('{:,.2f}', o_orderkey / 4.0) END AS shown, CASE WHEN o_orderkey = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'paid' ELSE 'refund' END AS direction FROM orders""")
def accounting_form(spark, sf):
    v = F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_orderkey") / 4).otherwise(F.col("o_orderkey") / 4)
    return table(spark, sf, "orders").select("o_orderkey", names.signed(v).alias("shown"), names.tax_direction(v).alias("direction"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Kas' ELSE upper(left(replace(p_type, ' ', '_'), 1)) || lower(substr(p_type, 2)) END AS title FROM part""")
def field_titles(spark, sf):
    field = F.when(F.col("p_partkey") % 3 == 0, "cash").otherwise(F.replace("p_type", F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", names.field_title(field, {"cash": "Kas"}).alias("title"))


@query(f"""WITH {READINGS} SELECT id % 100 AS document_id, round(avg(confidence), 3) AS avg_confidence, count(*) FILTER (confidence < 0.8) AS low_confidence FROM readings GROUP BY 1""")
def document_confidence(spark, sf):
    return extract.document_confidence(readings(spark, sf).withColumn("document_id", F.col("id") % 100))


@query("""SELECT doc_id % 20 AS filing, count(*) AS pages, count(*) FILTER (lang <> 'en') AS text_pages, count(*) FILTER (lang = 'en') AS ocr_pages, count(*) FILTER (n_chars > 500) AS financial_pages FROM documents GROUP BY 1""")
def page_counters(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("filing"), F.when(F.col("lang") == "en", "ocr").otherwise("text").alias("page_type"), (F.col("n_chars") > 500).alias("is_relevant"))
    return pages.page_counters(rows, ["filing"])


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN true END AS parent FROM conversations WHERE NOT (role = 'user' AND conv_id % 3 = 0)""")
def consolidated_pages(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("is_parent_only", F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), True))
    return pages.drop_parent_only(rows, ["conv_id"]).select("conv_id", "turn", F.col("is_parent_only").alias("parent"))


@query("""WITH n AS (SELECT conv_id, coalesce(text, '') AS t, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS INTEGER) AS w FROM conversations) SELECT conv_id, w AS "window", count(*) AS n_pages FROM n GROUP BY conv_id, w HAVING conv_id % 2 > 0""")
def uncached_windows(spark, sf):
    windows = pages.page_windows(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", 2, "m")
    return pages.missing_windows(windows, windows.where("conv_id % 2 = 0")).select("conv_id", "window", "n_pages")


@query(f"""WITH {READINGS} SELECT company, year, 'balance_sheet' AS section, field, value AS normalized_value, '' AS text_value, currency, 'f' || id || '.html' AS source_file, CASE WHEN value < 1e3 AND value > 0 THEN 'IMPLAUSIBLE_SCALE' ELSE '' END AS data_flags FROM readings""")
def report_columns(spark, sf):
    values = readings(spark, sf).withColumn("document_id", F.col("id")).withColumns({"statement": F.lit("balance_sheet"), "normalized_value": F.col("value"), "unit": F.lit(None).cast("string"), "page": F.lit(1)})
    report = exports.report_columns(exports.financial_report(values, documents(spark, sf), ["balance_sheet"], ["O", "F"]))
    return report.select("company", "year", "section", "field", "normalized_value", "text_value", "currency", "source_file", "data_flags")


@query(f"""WITH {WINNERS} SELECT company, year, max(value) FILTER (field = 'F') AS "F", max(value) FILTER (field = 'O') AS "O", max(value) FILTER (field = 'P') AS "P" FROM winners GROUP BY ALL""")
def summary_sheet(spark, sf):
    return exports.summary_sheet(readings(spark, sf), FIELDS)


@query(f"""WITH {READINGS} SELECT company, year, field, currency, confidence, 'f' || id || '.html' AS source_file FROM readings""")
def raw_data_sheet(spark, sf):
    return exports.raw_data(readings(spark, sf).withColumn("document_id", F.col("id")), documents(spark, sf))


@query(f"WITH {CHECKS} SELECT company, year, check_name, status, category FROM named")
def validation_sheet(spark, sf):
    return exports.validation_sheet(named_checks(spark, sf)).select("company", "year", "check_name", "status", "category")


@query(f"""WITH {WINNERS}, {CHECKS}, g AS (SELECT company, year, max(value) FILTER (field = 'F') AS "F", max(value) FILTER (field = 'O') AS "O", max(value) FILTER (field = 'P') AS "P", string_agg(DISTINCT document_id::VARCHAR, ', ' ORDER BY document_id::VARCHAR) AS source_documents FROM winners GROUP BY ALL),
    f AS (SELECT company, year, string_agg(DISTINCT check_name, ', ' ORDER BY check_name) AS failed FROM named WHERE status IN ('ERROR', 'WARNING') GROUP BY ALL) SELECT g.*, f.failed FROM g LEFT JOIN f USING (company, year)""")
def export_grid(spark, sf):
    w = won(spark, sf).withColumn("statement", F.lit("balance_sheet"))
    rows = grid.results(w, FIELDS, named_checks(spark, sf)).drop("currency")
    return grid.export_rows(rows, grid.contributing_documents(w))


@query(f"WITH {WINNERS}, g AS (SELECT DISTINCT company, year FROM winners) SELECT 'currency' AS note, 'IDR' AS value UNION ALL SELECT 'year', '1996' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM g")
def export_notes(spark, sf):
    return grid.export_notes(won(spark, sf).select("company", "year").distinct(), {"currency": "IDR", "year": "1996"})


@query(f"WITH {DOCS} SELECT company, file_path AS file, status, pdf_type, page_count AS pages, ocr_used, avg_confidence, extraction_status, validation_status FROM docs")
def processing_report(spark, sf):
    rows = documents(spark, sf).withColumns({"reporting_year": F.lit(None).cast("int"), "processing_time": F.lit(None).cast("double"), "error_message": F.lit(None).cast("string")})
    return exports.processing_report(rows).drop("reporting_year", "processing_time", "error")


@query(f"""WITH {DOCS}, f AS (SELECT company, 'document' AS kind, 'x' AS message FROM docs WHERE status = 'FAILED'), {CHECKS} SELECT kind, company, count(*) AS n FROM (SELECT company, kind FROM f UNION ALL SELECT company, 'check' FROM named WHERE status = 'ERROR') GROUP BY ALL""")
def errors_sheet(spark, sf):
    docs = documents(spark, sf).withColumn("error_message", F.lit("x"))
    return exports.errors_sheet(docs, named_checks(spark, sf)).groupBy("kind", "company").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHECKS}, {DOCS}, s AS (SELECT company, arg_min(status, id) AS company_status FROM docs GROUP BY 1) SELECT n.id, n.company, n.check_name, d.file_path, s.company_status FROM named n JOIN docs d USING (id) JOIN s ON s.company = n.company""")
def diagnostics(spark, sf):
    checks = named_checks(spark, sf).withColumnRenamed("id", "document_id")
    return exports.diagnostics(checks, documents(spark, sf)).select(F.col("document_id").alias("id"), "company", "check_name", "file_path", "company_status")


@query("""SELECT event_id AS document_id, 'K' || event_id AS company, CASE WHEN event_id % 2 = 0 THEN 'cash' ELSE 'other' END AS field, CASE WHEN event_id % 2 = 0 THEN 'cash_flow' ELSE 'balance_sheet' END AS statement, value,
    CASE WHEN event_id % 7 = 0 THEN 'EUR' WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 3 > 0 THEN 'USD' ELSE 'IDR' END END AS currency, 'manual' AS extraction_method, 'OK' AS status FROM events""")
def added_figures(spark, sf):
    """A figure for every event's document, some with a currency of their own; every fourth document has none."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    new = e.select(n.alias("document_id"), F.when(n % 2 == 0, "cash").otherwise("other").alias("field"), "value", F.when(n % 7 == 0, " eur").alias("currency"))
    code = F.when(n % 4 > 0, F.when(n % 3 > 0, "USD").otherwise("IDR"))
    seen = e.select(n.alias("document_id"), F.inline(F.array(F.struct(code.alias("currency")), F.struct(code.alias("currency")), F.struct(F.when(n % 4 > 0, "ZZZ").alias("currency")))))
    docs = e.select(n.alias("id"), F.concat(F.lit("K"), "event_id").alias("company"))
    home = spark.createDataFrame([("cash_flow", 2, "cash")], "statement string, stmt_ord int, field string")
    return edits.complete_new(new, seen, docs, home).select("document_id", "company", "field", "statement", "value", "currency", "extraction_method", "status")


@query(f"""WITH {DOCS} SELECT id, CASE WHEN id % 2 = 0 AND status = 'FAILED' THEN 'DISCOVERED' ELSE status END AS status, CASE WHEN id % 2 = 0 AND status = 'FAILED' THEN NULL ELSE avg_confidence END AS avg_confidence FROM docs""")
def reset_documents(spark, sf):
    docs = documents(spark, sf)
    return registry.reset_for_retry(docs, docs.where("id % 2 = 0 AND status = 'FAILED'")).select("id", "status", "avg_confidence")


@query(f"""WITH {DOCS} SELECT id, 'DISCOVERED' AS status FROM docs WHERE status = 'FAILED'""")
def selected_for_retry(spark, sf):
    return registry.select_for_run(documents(spark, sf), retry_failed=True).select("id", "status")


@query(f"""WITH {READINGS} SELECT id, company, value FROM readings WHERE id % 100 >= 10 UNION ALL SELECT o_orderkey, 'new', 1.0 FROM orders WHERE o_orderkey % 100 < 10 AND o_orderkey % 2 = 0 UNION ALL SELECT id, company, value FROM readings WHERE id % 100 < 10 AND id % 2 > 0""")
def replaced_documents(spark, sf):
    old = readings(spark, sf).select("id", "company", "value")
    new = old.where("id % 100 < 10 AND id % 2 = 0").select("id", F.lit("new").alias("company"), F.lit(1.0).alias("value"))
    return registry.replace_documents(old, new, "id")


@query(f"""WITH {READINGS} SELECT company, year, value FROM readings WHERE field = 'O' AND year = 1997""")
def value_at(spark, sf):
    return grid.value_at(readings(spark, sf), "O", 1997).select("company", "year", "value")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1000000 WHEN 1 THEN 1000 WHEN 2 THEN 1 WHEN 3 THEN 1000000000 WHEN 4 THEN 1 ELSE 1 END AS multiplier,
    CASE o_orderkey % 6 WHEN 0 THEN 'IDR' WHEN 1 THEN 'USD' WHEN 2 THEN 'IDR' WHEN 3 THEN NULL WHEN 4 THEN 'EUR' END AS currency,
    CASE o_orderkey % 6 WHEN 0 THEN 'juta' WHEN 1 THEN 'ribuan' WHEN 3 THEN 'miliar' END AS unit, CASE o_orderkey % 6 WHEN 0 THEN 0.85 WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM orders""")
def detected_units(spark, sf):
    said = F.element_at(F.array(*map(F.lit, ["Disajikan dalam jutaan Rupiah", "expressed in thousands of US$", "dalam Rupiah", "in billion", "EUR juta 12", "nothing"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", units.detect_unit(said).alias("u")).select("o_orderkey", "u.multiplier", "u.currency", "u.unit", "u.confidence")


@query("""WITH p AS (SELECT o_orderkey AS k, o_orderkey % 5 AS c FROM orders) SELECT k AS document_id, CASE c WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 1000000 END AS multiplier, CASE c WHEN 0 THEN 'ribuan' WHEN 1 THEN 'juta' WHEN 4 THEN 'juta' END AS unit FROM p""")
def page_units(spark, sf):
    """Documents in millions: pages that state thousands, nothing, figures too large for any unit, a median that no unit fits, and the same unit."""
    said = F.element_at(F.array(*map(F.lit, ["(dalam ribuan Rupiah) 1.234 2.345", "1.234 2.345", "99.999.999.999 88.888.888.888", "2.000.000.000 1.999.999.999", "(juta) 500 600"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("page_number"), said.alias("text"))
    unit = rows.select("document_id", F.lit("IDR").alias("currency"), F.lit("juta").alias("unit"), F.lit(1_000_000).cast("long").alias("multiplier"))
    return extract.page_units(rows, unit).select("document_id", "multiplier", "unit")


@query("""SELECT o_orderkey AS document_id, CASE o_orderkey % 5 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 WHEN 3 THEN 1 ELSE 1000 END AS multiplier, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'IDR' WHEN 3 THEN 'IDR' END AS currency FROM orders""")
def document_units(spark, sf):
    """A declared scale; a phrase on a statement page behind notes that say otherwise; a relevant page; base units; the first pages alone."""
    k = F.col("o_orderkey") % 5
    notes, deep = "notes in thousands of US$", "x" * 2600 + " dalam ribuan"
    page = lambda n, section, relevant, text: F.struct(F.lit(n).alias("page_number"), F.lit(section).cast("string").alias("section"), F.lit(relevant).alias("is_relevant"), F.lit(text).alias("text"))
    kinds = [
        F.array(page(1, "balance_sheet", True, "dalam jutaan Rupiah")), F.array(page(1, "notes", True, notes), page(2, "balance_sheet", True, deep), page(3, "equity", True, "(dalam jutaan Rupiah)")),
        F.array(page(1, None, False, "in thousands"), page(2, None, True, "in billion")), F.array(page(1, "cash_flow", True, "Rp 5")), F.array(page(1, None, False, "cover"), page(4, None, False, "expressed in thousands"), page(5, None, False, "in trillion")),
    ]
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.inline(F.element_at(F.array(*kinds), (k + 1).cast("int"))))
    told = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit(1000).cast("long").alias("multiplier"), F.lit("USD").alias("currency"))
    return extract.resolve_units(rows, told).select("document_id", "multiplier", "currency")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE n WHEN 0 THEN '2023:1|2022:2' WHEN 1 THEN 'null:1|null:2' ELSE '2022:1|2023:2' END AS pairs FROM r""")
def zipped_years(spark, sf):
    """Values beside two header years, beside one, and beside two in another order of preference."""
    n = F.col("l_linenumber") % 3
    years = F.when(n == 1, F.array(F.lit(2023))).otherwise(F.array(F.lit(2022), F.lit(2023)))
    years = F.when(n == 0, cells.preferred_first(years, F.lit(2023))).otherwise(years)
    pairs = F.transform(cells.zip_years(F.array(F.lit("1"), F.lit("2")), years), lambda p: F.concat_ws(":", F.coalesce(p["year"].cast("string"), F.lit("null")), p["raw"]))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(pairs, "|").alias("pairs"))
