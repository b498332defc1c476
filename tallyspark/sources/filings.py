"""Sources: trees of filing pages, flat corpora, cover attributes, registers and external observations."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.amounts import strip
from tallyspark.functions.names import company_key, listing_date
from tallyspark.functions.once import let

COVER = "1000000.html"
#: Cover labels, rounding scales and currency words of the declared attributes.
ROUNDING_LABEL = r"(?iU)^(?:level of rounding used in financial statements|pembulatan yang digunakan dalam penyajian jumlah dalam laporan keuangan)$"
ROUNDING = ((r"jutaan|in\s+million", "juta", 1_000_000), (r"ribuan|in\s+thousand", "ribuan", 1_000), (r"miliaran|in\s+billion", "miliar", 1_000_000_000), (r"triliun|triliunan|in\s+trillion", "triliun", 1_000_000_000_000), (r"satuan\s+penuh|full\s+amount", None, 1))
CURRENCY_LABEL = r"(?iU)^(?:description of presentation currency|mata uang pelaporan)$"
CURRENCY_WORDS = (
    ("rupiah", "IDR"), (r"us\s*dollar|usd|amerika\s+serat", "USD"), ("singapore", "SGD"), ("euro", "EUR"), ("yuan|renminbi|china", "CNY"), ("yen|jepang", "JPY"), ("pound|sterling|inggris", "GBP"),
    ("won|korea", "KRW"), ("ringgit|malaysia", "MYR"), ("baht|thailand", "THB"), (r"hong\s*kong", "HKD"), ("taiwan", "TWD"), ("australia|aussie", "AUD"), ("swiss|franc", "CHF"),
)
EXTERNAL = "array<struct<field:string,label:string,value:string,year:int,currency:string,unit:string,page:int,confidence:double>>"


def _folders(root: str, companies: Sequence[str] | None, years: Sequence[int] | None) -> list[str]:
    """Path patterns that list no other companies' folders and no other years'."""
    plain = lambda name: re.sub(r"([\\{}\[\]*?^,])", r"\\\1", name)
    return [f"{root.rstrip('/')}/{c}/{y}" for c in (map(plain, companies) if companies is not None else ["*"]) for y in ([f"*{y}*" for y in years] if years is not None else ["*"])]


def read_filing_tree(spark: SparkSession, root: str, glob: str = "*.htm*", limit: int | None = None, companies: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """Pages of ``<company>/<year folder>/<name>``: company, year, filename, path, name, sha256, text; folders without a year are left out.

    ``companies`` and ``years`` decide which folders are listed at all. A company's folder of that name must be there.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if companies is None and years is None:
        files = reader.option("recursiveFileLookup", True).load(root)
    else:
        files = reader.load(_folders(root, companies, years))
    rows = _pages_of(files)
    if years is not None:
        rows = rows.where(F.col("year").isin(*years))
    if limit:
        keep = rows.select("company", "folder", "year").distinct().orderBy("company", "year", "folder").limit(limit)
        rows = rows.join(F.broadcast(keep.select("company", "folder")), ["company", "folder"], "left_semi")
    return rows


def stream_filing_tree(spark: SparkSession, root: str, glob: str = "*.htm*", files_a_batch: int = 10_000) -> DataFrame:
    """A stream of the pages that come into the tree: each file once, under the stream's checkpoint; columns as ``read_filing_tree``'s."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob)
    return _pages_of(files.option("maxFilesPerTrigger", files_a_batch).load(f"{root.rstrip('/')}/*/*"))


def _pages_of(files: DataFrame) -> DataFrame:
    part = F.split("path", "/")
    rows = files.select("path", F.element_at(part, -1).alias("name"), F.element_at(part, -2).alias("folder"), F.element_at(part, -3).alias("company"), F.sha2("content", 256).alias("file_hash"), F.decode("content", "UTF-8").alias("html"))
    year = F.regexp_extract("folder", r"(20\d{2})", 1)
    return rows.withColumn("year", F.when(year != "", year.cast("int"))).where("year IS NOT NULL").withColumn("filename", F.concat_ws(" ", "company", "year"))


def filings_of(pages: DataFrame) -> DataFrame:
    """One row a folder; its anchor is the cover if there is one, else the first name."""
    first = F.min_by(F.struct("path", "file_hash"), F.struct((F.col("name") != COVER).alias("other"), F.col("name")))
    return pages.groupBy("company", "folder", "year", "filename").agg(first.alias("a"), F.count(F.lit(1)).alias("page_count")).select("company", "year", "filename", F.col("a.path").alias("file_path"), F.col("a.file_hash").alias("file_hash"), "page_count")


def read_flat_corpus(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """One file, one document: company is the first folder under the root, else the root's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.split(F.element_at(F.split("path", f"/{root.rstrip('/').rpartition('/')[2]}/", 2), 2), "/")
    name = F.element_at(below, -1)
    year = F.regexp_extract(name, r"(20\d{2})", 1)
    company = F.when(F.size(below) > 1, below[0]).otherwise(F.lit(root.rstrip("/").rpartition("/")[2]))
    return files.select(F.col("path").alias("file_path"), company.alias("company"), name.alias("filename"), F.when(year != "", year.cast("int")).alias("year"), F.sha2("content", 256).alias("file_hash"))


def number_pages(pages: DataFrame, filing: list[str], max_pages: int = 1000) -> DataFrame:
    """``page_number`` by cover first and name, capped, then pages without text dropped."""
    order = W.partitionBy(*filing).orderBy(F.col("name") != COVER, "name")
    return pages.withColumn("page_number", F.row_number().over(order)).where(F.col("page_number") <= max_pages).where(strip(F.col("text")) != "")


#: What stands where a number names no character of its own: Windows' letters from 128 to 159.
_WINDOWS = {0x80 + i: chr(0x80 + i) if c == "\ufffd" else c for i, c in enumerate(bytes(range(0x80, 0xA0)).decode("cp1252", "replace"))} | {0: "\ufffd", 0x0D: "\r"}


def unescape(text: Column, only: Sequence[str] | None = None) -> Column:
    """Named and numeric entities of HTML 5, with and without a semicolon, each once; what names nothing stays as it is.

    A name without a semicolon is the longest known one that the letters begin with, and what follows it
    stays. Numbers as browsers read them: surrogates, 0 and those beyond all characters are the
    replacement character, those of control characters without a use are dropped. ``only``: the entities
    that count, as they are written behind the ``&``; all others stay.
    """
    entity = f"&({'|'.join(only)})" if only else r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    names = F.str_to_map(F.lit("\x02".join(f"{name}\x01{letters}" for name, letters in html5.items())), F.lit("\x02"), F.lit("\x01"))  # a constant
    windows = F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair])
    longest = max(len(n) for n in html5 if not n.endswith(";"))

    def prefix(e: Column) -> Column:
        found = F.filter(F.transform(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda k: F.when(k <= F.length(e), F.left(e, k))), lambda p: F.try_element_at(names, p).isNotNull())
        return let(F.get(found, 0), lambda p: F.concat(F.try_element_at(names, p), F.substr(e, F.length(p) + 1)))

    def number(e: Column) -> Column:
        digits = F.rtrim(e, F.lit(";"))
        hexadecimal = F.lower(F.substr(digits, F.lit(2), F.lit(1))) == "x"
        plain = F.ltrim(F.when(hexadecimal, F.substr(digits, F.lit(3))).otherwise(F.substr(digits, F.lit(2))), F.lit("0"))
        code = F.when(F.length(plain) > 8, F.lit(0x110000)).when(plain == "", 0).when(hexadecimal, F.conv(plain, 16, 10).cast("long")).otherwise(plain.try_cast("long"))
        letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        unused = lambda n: n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        return let(code.cast("long"), lambda n: F.coalesce(F.try_element_at(windows, n.cast("int")), F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(unused(n), "").otherwise(letter(n))))

    plain = lambda e: F.when(e.startswith("#"), number(e)).otherwise(F.coalesce(F.try_element_at(names, e), prefix(e), F.concat(F.lit("&"), e)))
    pieces = lambda t: F.zip_with(F.split(t, entity, -1), F.transform(F.regexp_extract_all(t, F.lit(entity), F.lit(1)), plain), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces(text), "")).otherwise(text)


def visible_lines(page: Column, line_end: str = "t[dh]", only: Sequence[str] | None = None) -> Column:
    """A page's lines: scripts, styles and head dropped, cell ends and breaks are line ends, other tags spaces, blanks gone. ``only`` as in ``unescape``."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|head)\b.*?</\1>", "")
    cut = F.regexp_replace(bare, rf"(?i)</(?:{line_end})>|<br\s*/?>|</p>|</div>|</tr>", "\n")
    lines = F.split(unescape(F.regexp_replace(cut, "(?s)<[^>]+>", " "), only), "\n")
    return F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def cell_grid(pages: DataFrame, page_col: str, keys: list[str], table: str = "table", row: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """Long cells ``keys, table_idx, row_idx, cell_idx, raw``; rows without any text and empty tables are left out."""
    block = lambda tag: f"(?is)<{tag}\\b[^>]*>.*?</{tag}>"
    tables = pages.select(*keys, F.posexplode(F.regexp_extract_all(page_col, F.lit(block(table)), F.lit(0))).alias("table_idx", "__t"))
    rows = tables.select(*keys, "table_idx", F.posexplode(F.regexp_extract_all("__t", F.lit(block(row)), F.lit(0))).alias("row_idx", "__r"))
    texts = F.transform(F.regexp_extract_all("__r", F.lit(f"(?is)<(?:{cell})\\b[^>]*>(.*?)</(?:{cell})>"), F.lit(1)), lambda c: strip(F.regexp_replace(unescape(F.regexp_replace(c, "(?s)<[^>]+>", " ")), r"(?U)\s+", " ")))
    rows = rows.withColumn("__c", texts).where(F.exists("__c", lambda c: c != ""))
    return rows.select(*keys, "table_idx", "row_idx", F.posexplode("__c").alias("cell_idx", "raw"))


def _choice(text: Column, choices: tuple, pick: int) -> Column:
    out = F.when(text.rlike(f"(?iU){choices[0][0]}"), F.lit(choices[0][pick]))
    for c in choices[1:]:
        out = out.when(text.rlike(f"(?iU){c[0]}"), F.lit(c[pick]))
    return out


def cover_attributes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Declared scale, currency and subsector of each page, from its numbered lines ``keys, line_no, line``.

    A value stands one or two lines above its label (the nearer first), a subsector between the two
    labels of its first mention. First match by line wins.
    """
    w = W.partitionBy(*keys).orderBy("line_no")
    near = lines.withColumn("up1", F.lag("line", 1).over(w)).withColumn("up2", F.lag("line", 2).over(w)).withColumn("down1", F.lead("line", 1).over(w)).withColumn("down2", F.lead("line", 2).over(w))
    label, money = F.col("line").rlike(ROUNDING_LABEL), F.col("line").rlike(CURRENCY_LABEL)
    scale = lambda c: _choice(c, tuple((p, str(m)) for p, _, m in ROUNDING), 1).cast("long")
    iso = lambda c: F.nullif(F.regexp_extract(c, r"\b([A-Z]{3})\b", 1), F.lit(""))
    currency = lambda c: F.coalesce(iso(c), _choice(c, CURRENCY_WORDS, 1))
    near = near.select(
        *keys, "line_no",
        F.when(label, F.coalesce(scale(F.col("up1")), scale(F.col("up2")))).alias("multiplier"),
        F.when(money, F.coalesce(currency(F.col("up1")), currency(F.col("up2")))).alias("currency"),
        F.when(F.lower("line") == "subsektor", F.struct(F.when(F.lower("down2") == "subsector", F.col("down1")).alias("v"))).alias("sub"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return near.groupBy(*keys).agg(first("multiplier").alias("multiplier"), first("currency").alias("currency"), first("sub").alias("s")).select(*keys, "multiplier", "currency", F.col("s.v").alias("sub_sector"))


def document_attributes(pages: DataFrame, filing: list[str], columns: list[str]) -> DataFrame:
    """Each attribute from the first page that declares one."""
    return pages.groupBy(*filing).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page_number"))).alias(c) for c in columns])


def free_text_rows(pages: DataFrame, text_col: str, keys: list[str], preferred_year: int | None = None) -> DataFrame:
    """Rows ``keys, line_no, label, year, raw`` of lines that end in a run of numbers; years only if their number fits.

    Labels whose last word has three letters in a row are prose and left out.
    """
    run = r"(?:\s*+[-–(]?\s*+(?:Rp\s*+)?[\d.,]++\s*+\)?)+"
    years = F.array_distinct(F.transform(F.regexp_extract_all(F.substring(text_col, 1, 800), F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    if preferred_year:
        years = F.when(F.array_contains(years, preferred_year), F.concat(F.array(F.lit(preferred_year)), F.array_remove(years, preferred_year))).otherwise(years)
    lines = pages.select(*keys, years.alias("__y"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "__l")).withColumn("__l", strip(F.col("__l"))).where("length(__l) >= 4")
    row = rf"^(.*?)[\s.…]+({run})\s*+$"
    # A line is matched once: a mark that no line holds parts its label from its numbers.
    parts = lambda line: F.split(F.regexp_replace(F.translate(line, "\x01", " "), row, "$1\x01$2"), "\x01")
    tokens = lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"[-–(]?\s*(?:Rp\s*)?\d[\d.,]*\)?"), F.lit(0)), strip)
    told = let(parts(F.col("__l")), lambda p: F.when(F.size(p) == 2, F.struct(F.regexp_replace(F.get(p, 0), r"^[ .:|-]+|[ .:|-]+$", "").alias("label"), tokens(F.get(p, 1)).alias("tokens"))))
    kept = F.filter(F.array(told), lambda r: r.isNotNull() & (r["label"] != "") & ~F.element_at(F.split(r["label"], r"\s+"), -1).rlike("[A-Za-z]{3,}") & (F.size(r["tokens"]) > 0))
    lines = lines.select(*keys, "line_no", "__y", F.inline(kept))
    fits = (F.size("__y") > 0) & (F.size("__y") == F.size("tokens"))
    pairs = F.transform("tokens", lambda t, i: F.struct(F.when(fits, F.try_element_at("__y", i + 1)).alias("year"), t.alias("raw")))
    return lines.select(*keys, "line_no", "label", F.posexplode(pairs).alias("value_idx", "__p")).select(*keys, "line_no", "label", "value_idx", "__p.year", "__p.raw")


def listing_register(table: DataFrame, row_no: Column | None = None) -> DataFrame:
    """``code, name, listed_on`` of every row whose third or a later column is a date: the two cells left of the first one.

    Rows without a code or a name are left out; an error if no row is left. Where ``row_no`` is given, it is
    a further column: the row's place in the file (``F.monotonically_increasing_id()`` right behind the
    reader of one file), by which ``grid.listing_dates`` tells rows of equal keys.
    """
    place = F.lit(None) if row_no is None else row_no
    columns = [F.col(c).cast("string") for c in table.columns]
    dated = table.select(F.array(*columns).alias("c"), F.array(*[listing_date(c) for c in columns]).alias("d"), place.alias("row_no"))
    found = F.filter(F.sequence(F.lit(2), F.lit(max(2, len(columns) - 1))), lambda i: F.get("d", i).isNotNull())
    rows = dated.withColumn("i", F.get(found, 0)).where("i IS NOT NULL")
    rows = rows.select(F.get("c", F.col("i") - 2).alias("code"), F.get("c", F.col("i") - 1).alias("name"), F.get("d", F.col("i")).alias("listed_on"), "row_no")
    rows = rows.where(F.col("code").isNotNull() & F.col("name").isNotNull() & (company_key(F.col("name")) != ""))
    if rows.isEmpty():
        raise ValueError("the register has no row with a listing date")
    return rows.drop("row_no") if row_no is None else rows


def company_list(spark: SparkSession, path: str) -> DataFrame:
    """Codes and names of a CSV whose headers are spelled in one of the known ways."""
    raw = spark.read.csv(path, header=True)
    by = {c.lower().strip(): c for c in raw.columns}
    pick = lambda *names: F.coalesce(*[F.col(f"`{by[n]}`") for n in names if n in by], F.lit(None).cast("string"))
    return raw.select(pick("kode", "code", "ticker", "symbol").alias("code"), pick("nama perusahaan", "company name", "name", "nama").alias("name")).where("code IS NOT NULL")


def external_observations(rows: DataFrame, json_col: str, keys: list[str], schema: str = EXTERNAL) -> tuple[DataFrame, DataFrame]:
    """Observations of model replies, and the replies that don't parse (``keys`` and the reply, for review).

    Code fences and chatter are cut to the outermost braces; the schema is strict. One parse a reply.
    """
    statements = ("balance_sheet", "income_statement", "cash_flow", "equity")
    inner = F.regexp_extract(json_col, r"(?s)(\{.*\})", 1)
    whole = ", ".join(f"{s} {schema}" for s in statements)
    parsed = F.from_json(inner, f"{whole}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.select(*keys, F.col(json_col).alias("__reply"), parsed.alias("p")).withColumn("__bad", F.coalesce(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), F.lit(True)))
    one = lambda s: F.transform(F.coalesce(F.col(f"p.{s}"), F.array().cast(schema)), lambda o: F.struct(F.lit(s).alias("statement"), o.alias("o")))
    long = rows.where("NOT __bad").select(*keys, F.inline(F.concat(*map(one, statements)))).select(*keys, "statement", "o.*")
    return long, rows.where("__bad").select(*keys, F.col("__reply").alias(json_col))
