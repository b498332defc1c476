"""Table rows: value cells, prose labels, label and values of a row, fragments of numbers, header years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.amounts import strip
from tallyspark.functions.once import let

#: Shapes of value cells and what tells prose.
VALUE = r"\s*[(\-–—]?\s*(?:Rp\.?\s*)?[\d.,]+\s*(?:%|saham|lembar|shares?)?\s*\)?\s*"
NOT_VALUE = r"No\.?\s*|20[0-2]\d|\d{2,}/\d{2,}|[A-Za-z]{3,}\s*\d|\d\s+(?!saham\b|lembar\b|shares?\b)[A-Za-z]{3,}"
PROSE_WORDS = 14
VERBS = "penurunan|kenaikan|peningkatan|meningkat|menurun|sebesar|terjadi|disebabkan|berasal|merupakan|menjadi|adalah|terdiri|dicatat|mencatat|menyalami|pernah|diperkirakan|hingga|sekitar"
CONNECTIVES = "terhadap|menjadi|karena|sehingga|however|although|whereas|dibanding|dibandingkan|compared|than|due|because|including"
CLAUSES = "laba ditahan|adalah|merupakan|dapat|telah|sudah|akan|kami|perseroan|perusahaan|selama|untuk tahun|during|there|these|the company|amounting|berjumlah|sebesar|dengan|ketika|when"
YEAR = r"^(?:19|20)\d{2}$"


#: One expression tells a value cell: digits and separators alone, or the whole shape without what a value hasn't.
_VALUE_CELL = rf"(?iUs)^(?=.*[0-9])(?:\(?[0-9.,]+\)?|(?!.*(?:{NOT_VALUE})){VALUE})$"
_PROSE = rf"(?iU)[.!?]\s+\S|\b(?:{VERBS}|{CONNECTIVES})\b|^(?:{CLAUSES})\b"
#: Kinds of cells.
TEXT, DIGITS, FIGURE = 0, 1, 2


def is_value_cell(cell: Column, stripped: bool = False) -> Column:
    """Whether a cell has the form of a figure; ``stripped``: it has no space at its ends."""
    return F.coalesce((cell if stripped else strip(cell)).rlike(_VALUE_CELL), F.lit(False))


def is_prose(label: Column) -> Column:
    single = strip(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", " "))
    return let(single, lambda s: (s == "") | (F.size(F.split(s, " ")) > PROSE_WORDS) | s.rlike(_PROSE))


def kinds(cells: Column) -> Column:
    """``array<struct(cell, kind)>``: cells stripped and on one line; without a digit, with digits (also a year alone), of a figure's form."""
    plain = F.transform(cells, lambda c: strip(F.translate(F.coalesce(c, F.lit("")), "\n", " ")))
    kind = lambda c: F.when(~c.rlike("[0-9]"), TEXT).when((F.length(c) == 4) & c.rlike(YEAR), DIGITS).when(is_value_cell(c, stripped=True), FIGURE).otherwise(DIGITS)
    return F.transform(plain, lambda c: F.struct(c.alias("cell"), kind(c).alias("kind")))


def split_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Adds ``label`` and ``values`` of rows of cells; rows without either or with a prose label are left out.

    The first value cell begins the values; years alone and other cells with digits belong to the
    label. From there on all cells count that have a digit. Each cell is told once, and the row leaves
    through one generator, so no filter copies what made it.
    """
    text = lambda some: F.transform(some, lambda x: x["cell"])

    def parted(t: Column) -> Column:
        at = F.array_position(F.transform(t, lambda x: x["kind"]), FIGURE).cast("int")
        return let(at, lambda k: F.struct(
            F.array_join(text(F.filter(F.slice(t, F.lit(1), F.greatest(k - 1, F.lit(0))), lambda x: x["cell"] != "")), " ").alias("label"),
            text(F.filter(F.slice(t, F.greatest(k, F.lit(1)), F.when(k > 0, F.size(t)).otherwise(0)), lambda x: x["kind"] != TEXT)).alias("values"),
        ))

    row = let(kinds(F.col(cells)), parted)
    kept = F.filter(F.array(row), lambda r: (F.size(r["values"]) > 0) & (r["label"] != "") & ~is_prose(r["label"]))
    return rows.select(*[c for c in rows.columns if c not in ("label", "values")], F.inline(kept))


def _score(cell: Column) -> Column:
    """2 for a complete number, 1 for a fragment of one, 0 for anything else."""
    t = strip(cell)
    complete = t.rlike(r"^\(?-?(?:Rp\.?\s*)?\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?\)?$") & (t.startswith("(") == t.endswith(")"))
    return F.when(complete, 2).when(t.rlike(r"^[(\-–—]?[\d.,]+\)?$") | (t == "(") | (t == ")"), 1).otherwise(0)


def merge_fragments(cells: Column) -> Column:
    """Numbers that a table cut across cells, put together by one left fold.

    One to three bare digits and a next cell that begins with a separator join over blanks. A
    fragment takes up further pieces until the whole is complete; a cell that is no piece ends it.
    """
    texts = lambda *items: F.array(*items).cast("array<string>")
    state = lambda out, frag, head, blanks: F.struct(out.cast("array<string>").alias("out"), frag.cast("string").alias("frag"), head.cast("string").alias("head"), blanks.cast("int").alias("blanks"))
    none, zero = F.lit(None).cast("string"), F.lit(0)

    def fresh(out: Column, cell: Column) -> Column:
        c = F.coalesce(cell, F.lit(""))
        return (
            F.when(c.rlike(r"^\d{1,3}$"), state(out, none, c, zero))
            .when(_score(c) == 1, state(out, c, none, zero))
            .otherwise(state(F.concat(out, texts(cell)), none, none, zero))
        )

    def with_head(s: Column, cell: Column) -> Column:
        blanks = F.array_repeat(F.lit(""), s["blanks"])
        c = F.coalesce(cell, F.lit("x"))
        return (
            F.when(cell == "", state(s["out"], none, s["head"], s["blanks"] + 1))
            .when(c.rlike(r"^[.,]\d[\d.,]*$"), state(F.concat(s["out"], texts(F.concat(s["head"], c))), none, none, zero))
            .otherwise(fresh(F.concat(s["out"], texts(s["head"]), blanks), cell))
        )

    def with_frag(s: Column, cell: Column) -> Column:
        both = F.concat(s["frag"], F.coalesce(cell, F.lit("")))
        end = fresh(F.concat(s["out"], texts(s["frag"])), cell)
        return (
            F.when(cell.isNull() | (_score(cell) == 0), end)
            .when(_score(both) == 2, state(F.concat(s["out"], texts(both)), none, none, zero))
            .when(s["frag"].rlike(r"^[(\-–—]?[\d.,]+$") | (s["frag"] == "("), state(s["out"], both, none, zero))
            .otherwise(end)
        )

    step = lambda s, c: F.when(s["head"].isNotNull(), with_head(s, c)).when(s["frag"].isNotNull(), with_frag(s, c)).otherwise(fresh(s["out"], c))
    end = lambda s: F.concat(s["out"], F.when(s["head"].isNotNull(), F.concat(texts(s["head"]), F.array_repeat(F.lit(""), s["blanks"]))).when(s["frag"].isNotNull(), texts(s["frag"])).otherwise(F.array().cast("array<string>")))
    return F.aggregate(cells, state(F.array().cast("array<string>"), none, none, zero), step, end)


def header_years(rows: Column, first: int = 4, deeper: int = 12) -> Column:
    """Distinct years in order, of the first rows of a table (array of arrays of cells), else of the first twelve."""
    of = lambda n: F.array_distinct(F.flatten(F.transform(F.flatten(F.slice(rows, 1, n)), lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))))
    return F.when(F.size(of(first)) > 0, of(first)).otherwise(of(deeper))


def preferred_first(years: Column, preferred: Column) -> Column:
    rest = F.filter(years, lambda y: y != preferred)
    return F.when(F.array_contains(years, preferred), F.concat(F.array(preferred), rest)).otherwise(years)


def zip_years(values: Column, years: Column) -> Column:
    """``array<struct(year, raw)>``; years only if there are as many as values."""
    fits = (F.size(years) > 0) & (F.size(years) == F.size(values))
    return F.transform(values, lambda v, i: F.struct(F.when(fits, F.try_element_at(years, i + 1)).alias("year"), v.alias("raw")))
