"""Pages: section, relevance, parent-only pages, text lines from word boxes, windows of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.amounts import strip
from tallyspark.functions.once import let

#: Titles and words that tell a page's section and relevance, in order.
SECTIONS = (
    ("balance_sheet", r"laporan\s+posisi\s+keuangan|neraca|statement\s+of\s+financial\s+position|balance\s+sheet"),
    ("income_statement", r"laporan\s+laba\s+rugi|laporan\s+labarugi|perhitungan\s+hasil\s+usaha|statement\s+of\s+profit\s+or\s+loss|income\s+statement|profit\s+and\s+loss"),
    ("cash_flow", r"laporan\s+arus\s+kas|statement\s+of\s+cash\s+flows?|cash\s+flow\s+statement"),
    ("equity", r"laporan\s+perubahan\s+ekuitas|statement\s+of\s+changes?\s+in\s+equity"),
    ("notes", r"catatan\s+atas\s+laporan\s+keuangan|notes\s+to\s+(?:the\s+)?financial\s+statements?"),
    ("comprehensive_income", r"laporan\s+penghasilan\s+komprehensif|statement\s+of\s+comprehensive\s+income"),
)
TITLE = (
    r"laporan\s+(?:posisi\s+keuangan|laba\s+rugi|arus\s+kas|perubahan\s+ekuitas|penghasilan\s+komprehensif)|neraca|catatan\s+atas\s+laporan\s+keuangan|"
    r"statement\s+of\s+(?:financial\s+position|profit\s+or\s+loss|cash\s+flows?|changes\s+in\s+equity|comprehensive\s+income)|balance\s+sheet|income\s+statement|notes\s+to\s+(?:the\s+)?financial\s+statements?"
)
STRONG = ("laporan posisi keuangan", "laporan laba rugi", "laporan arus kas", "laporan perubahan ekuitas", "neraca", "catatan atas laporan keuangan", "statement of financial position", "income statement", "cash flows", "statement of changes in equity")
MEDIUM = ("pendapatan", "laba", "aset", "liabilitas", "ekuitas", "kas", "modal", "saham", "saham treasuri", "revenue", "equity", "capital", "treasury shares")
RELEVANT = ("aset", "liabilitas", "ekuitas", "pendapatan", "laba", "beban", "kas", "arus kas", "total", "assets", "liabilities", "equity", "revenue", "profit", "expenses", "cash", "retained earnings", "saldo awal", "saldo akhir")
PARENT = r"^\(?\s*(?:entitas\s+induk|parent\s+only|parent\s+entity)\s*\)?$"
CONSOLIDATED = r"^\(?\s*(?:dan\s+entitas\s+anak(?:nya)?|and\s+(?:its\s+)?subsidiaries|konsolidasian|consolidated)\s*\)?$"
SUPPLEMENTARY = r"informasi\s+keuangan\s+tambahan|supplementary\s+financial\s+information"


def section(text: Column, within: int = 1200, sections: tuple = SECTIONS) -> Column:
    """The first section whose pattern occurs in the first ``within`` characters, or null."""
    every = "|".join(f"(?:{pattern})" for _, pattern in sections)

    def told(head: Column) -> Column:
        # Pages without any title, most of them, are read once.
        out = F.when(~head.rlike(f"(?iU){every}"), None)
        for name, pattern in sections:
            out = out.when(head.rlike(f"(?iU){pattern}"), name)
        return out

    return let(F.substring(text, 1, within), told)


def score(text: Column, strong: tuple = STRONG, medium: tuple = MEDIUM) -> Column:
    """3 for each strong phrase, 1 for each medium one, 1 or 2 for more than 50 or 200 digits; 20 at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for word, points in [(w, 3) for w in strong] + [(w, 1) for w in medium]:
        total = total + F.when(low.contains(word), points).otherwise(0)
    digits = F.length(F.regexp_replace(low, "[^0-9]", ""))
    return F.least(F.lit(20), total + F.when(digits > 200, 2).when(digits > 50, 1).otherwise(0))


def title(text: Column) -> Column:
    found = F.regexp_extract(F.substring(text, 1, 1500), f"(?iU)({TITLE})", 1)
    return F.nullif(found, F.lit(""))


def is_relevant(text: Column, hits: int = 3) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    total = sum((low.contains(w).cast("int") for w in RELEVANT[1:]), low.contains(RELEVANT[0]).cast("int"))
    return (total >= hits) | low.rlike(f"(?iU){TITLE}")


def is_parent_only(text: Column) -> Column:
    """A supplementary header, or a parent marker within five lines above the first title that has a marker of either kind; a consolidated one wins."""
    kept = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != ""), 1, 40)
    # Each line is told once: whether it has a title, and its marker (0 consolidated, 1 parent).
    told = lambda lines: F.transform(lines, lambda x: F.struct(x.rlike(f"(?iU){TITLE}").alias("title"), F.when(x.rlike(f"(?iU){CONSOLIDATED}"), 0).when(x.rlike(f"(?iU){PARENT}"), 1).alias("marker")))
    above = lambda kinds: F.transform(kinds, lambda x, i: F.when(x["title"], F.array_min(F.transform(F.slice(kinds, F.greatest(F.lit(1), i - 4), F.least(i, F.lit(5))), lambda y: y["marker"]))))
    decided = lambda kinds: F.coalesce(F.get(F.array_compact(above(kinds)), 0) == 1, F.lit(False))
    return let(kept, lambda lines: F.substring(F.array_join(lines, "\n"), 1, 1500).rlike(f"(?iU){SUPPLEMENTARY}") | let(told(lines), decided))


def classify(pages: DataFrame, text_col: str = "text", threshold: int = 3) -> DataFrame:
    t = F.col(text_col)
    out = pages.withColumns({"section": section(t), "score": score(t), "title": title(t), "is_parent_only": is_parent_only(t)})
    return out.withColumn("is_relevant", (F.col("score") >= threshold) | F.col("section").isNotNull())


def lines_from_words(words: DataFrame, page: list[str]) -> DataFrame:
    """``page, block, line, text``: a line's words in order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*page, "block", "line").agg(joined.alias("text"))


def page_windows(pages: DataFrame, filing: list[str], order: str, text_col: str = "text", size: int = 6, model: str = "", head: list[str] | None = None) -> DataFrame:
    """Texts of ``size`` pages each and a cache key over the model, ``head`` (company, then file name) and the first 100,000 bytes of the text."""
    w = W.partitionBy(*filing).orderBy(order)
    numbered = pages.withColumn("window", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text_col, F.lit("")).alias("t")))), lambda p: p["t"]), "\n\n")
    out = numbered.groupBy(*filing, "window").agg(text.alias("content"), F.count(F.lit(1)).alias("n_pages"))
    key = F.concat(F.lit(model), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in head or filing], F.lit(""))
    key = F.concat(F.encode(key, "UTF-8"), F.substring(F.encode("content", "UTF-8"), 1, 100_000))  # bytes: the cut may be inside a character
    return out.withColumn("cache_key", F.sha2(key, 256))


def drop_parent_only(pages: DataFrame, filing: list[str]) -> DataFrame:
    """Consolidated pages; of a filing that has none, no pages."""
    return pages.where(~F.coalesce("is_parent_only", F.lit(False)))


def page_counters(pages: DataFrame, filing: list[str]) -> DataFrame:
    """``filing, pages, text_pages, ocr_pages, financial_pages``."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ocr = F.col("page_type") == "ocr"
    return pages.groupBy(*filing).agg(F.count(F.lit(1)).alias("pages"), n(~ocr).alias("text_pages"), n(ocr).alias("ocr_pages"), n(F.col("is_relevant")).alias("financial_pages"))


def missing_windows(windows: DataFrame, cache: DataFrame) -> DataFrame:
    """Windows whose key no earlier answer has."""
    return windows.join(cache.select("cache_key"), "cache_key", "left_anti")
