"""Registered queries that read whole texts and pages, and the SQL each must agree with.

A document's text stands for a page, four documents for a filing, a text's lines for rows of a table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalog import query, table
from tallyspark.operators import cells, extract

_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x85]+|[\s\p{{Z}}\x85]+$', '', 'g')"
_WORD = r"(^|[^\p{{L}}\p{{N}}_])({})($|[^\p{{L}}\p{{N}}_])"
_VALUE = r"^[(\-–—]?\s*(Rp\.?\s*)?[0-9.,]+\s*(%|saham|lembar|shares?)?\s*\)?$"
_KIND = rf"""CASE WHEN NOT regexp_matches(x, '[0-9]') THEN 0 WHEN regexp_matches(x, '^(19|20)[0-9]{{2}}$') THEN 1
    WHEN regexp_matches(x, '^\(?[0-9.,]+\)?$') OR (regexp_matches(x, '(?i){_VALUE}') AND NOT regexp_matches(x, '20[0-2][0-9]')) THEN 2 ELSE 1 END"""


@query(rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT doc_id, line_no, list_append(list_transform(regexp_split_to_array(line, '[|,;]'), lambda y: {_STRIP.format("y")}), format('{{:,}}', length(line) * 1234)) AS c FROM l),
    k AS (SELECT *, list_position(list_transform(c, lambda x: {_KIND}), 2) AS p FROM c),
    r AS (SELECT doc_id, line_no, array_to_string(list_filter(c[1:p - 1], lambda x: x <> ''), ' ') AS label, array_to_string(list_filter(c[p:], lambda x: regexp_matches(x, '[0-9]')), '/') AS figures FROM k WHERE p > 1),
    s AS (SELECT *, regexp_replace(label, '[\s\p{{Z}}\x85]+', ' ', 'g') AS l FROM r WHERE label <> '')
    SELECT doc_id, line_no, label, figures FROM s WHERE len(string_split(l, ' ')) <= {cells.PROSE_WORDS} AND NOT regexp_matches(l, '[.!?]\s+\S')
        AND NOT regexp_matches(l, '(?i){_WORD.format(cells.VERBS + "|" + cells.CONNECTIVES)}') AND NOT regexp_matches(l, '(?i)^({cells.CLAUSES})($|[^\p{{L}}\p{{N}}_])')""")
def text_row_split(spark, sf):
    """Every line of every text as a row: cells by separators, and a figure of the line's own at the end."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    figure = F.format_number((F.length("line") * 1234).cast("double"), 0)
    rows = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.concat(F.split("line", "[|,;]"), F.array(figure)).alias("cells"))
    return cells.split_rows(rows).select("doc_id", "line_no", "label", F.array_join("values", "/").alias("figures"))


_SAID = {0: "(Dalam jutaan Rupiah) ", 1: "Expressed in thousands of US$ ", 2: "dalam Rupiah. ", 3: "EUR ", 4: "disajikan dalam miliar "}


def _units(text: str) -> str:
    """Unit, currency and confidence of a text."""
    has = lambda p: rf"regexp_matches({text}, '(?i){p}')"
    unit = rf"CASE WHEN {has(r'(dalam|in)\s')} THEN CASE WHEN {has(r'\btriliun(an)?\b|\btrillions?\b')} THEN 1000000000000 WHEN {has(r'\bmiliar(an)?\b|\bbillions?\b')} THEN 1000000000 WHEN {has(r'\bjuta(an)?\b|\bmillions?\b|\bjt\b')} THEN 1000000 WHEN {has(r'\bribu(an)?\b|\bthousands?\b|\brb\b')} THEN 1000 END END"
    currency = rf"CASE WHEN {has(r'\bUSD\b|\bUS\$|\bDolar\s*(AS|Amerika)\b|\$|^US\b')} THEN 'USD' WHEN {has(r'\bEUR\b|\bEuro\b')} THEN 'EUR' WHEN {has(r'\bSGD\b')} THEN 'SGD' WHEN {has(r'\bJPY\b|\bYen\b')} THEN 'JPY' WHEN {has(r'\bRp\b|\bRupiahs?\b')} THEN 'IDR' END"
    return f"struct_pack(m := {unit}, c := {currency})"


_PHRASE = r"(dalam|in|disajikan\s+dalam|expressed\s+in)\s+(\(?\s*)?(ribu|juta|miliar|triliun|thousand|million|billion|trillion)[a-z]*(\s+(rupiah|usd?|dollars?))?(\s*\))?"


@query(rf"""WITH p AS (SELECT doc_id // 4 AS document_id, doc_id % 4 AS page_number, CASE doc_id % 7 WHEN 0 THEN 0 WHEN 2 THEN 0 ELSE CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END END AS tier,
        left(CASE doc_id % 9 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _SAID.items())} ELSE '' END || coalesce(text, ''), 2500) AS head FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS place FROM (SELECT * FROM p QUALIFY tier = min(tier) OVER (PARTITION BY document_id))),
    u AS (SELECT document_id, place, head, regexp_extract(head, '(?i){_PHRASE}') AS said FROM b),
    d AS (SELECT *, {_units("said")} AS s, {_units("head")} AS h FROM u),
    e AS (SELECT document_id, place, CASE WHEN s.m IS NOT NULL OR s.c IS NOT NULL THEN s WHEN h.m IS NOT NULL THEN h END AS sure FROM d),
    f AS (SELECT document_id, arg_min(sure, place) FILTER (sure IS NOT NULL) AS sure FROM e GROUP BY 1),
    j AS (SELECT document_id, left(string_agg(head, ' ' ORDER BY place) FILTER (place <= 2), 2500) AS t FROM b GROUP BY 1), g AS (SELECT document_id, {_units("t")} AS j FROM j)
    SELECT document_id, coalesce(coalesce(sure, j).m, 1) AS multiplier, coalesce(sure, j).c AS currency FROM f JOIN g USING (document_id)""")
def text_units(spark, sf):
    """Filings of four texts each; half of the texts begin with a phrase about units."""
    n = F.col("doc_id")
    said = F.lit("")
    for k, phrase in _SAID.items():
        said = F.when(n % 9 == k, phrase).otherwise(said)
    section = F.when(n % 7 == 0, "balance_sheet").when(n % 7 == 1, "notes").when(n % 7 == 2, "equity")
    pages = table(spark, sf, "documents").select(F.floor(n / 4).alias("document_id"), (n % 4).alias("page_number"), section.alias("section"), (n % 3 == 0).alias("is_relevant"), F.concat(said, F.coalesce("text", F.lit(""))).alias("text"))
    nothing = pages.limit(0).select("document_id", F.lit(1).cast("long").alias("multiplier"), F.lit("").alias("currency"))
    return extract.resolve_units(pages, nothing).select("document_id", "multiplier", "currency")
