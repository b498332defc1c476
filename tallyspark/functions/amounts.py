"""Amounts, shares and percentages out of cell texts, as steps of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.once import let

#: Tokens that say "no value", currency prefixes, share words, confusable characters.
NO_VALUE = ("n/a", "na", "nil", "-,-")
CURRENCY_PREFIX = r"(?:Rp|IDR|USD|EUR|US\$|\$)"
SHARE_WORDS = r"\b(?:saham|lembar|shares?|stocks?)\b"
CONFUSABLE, REPAIRED = "OolISB", "001158"

_DASHES = "^[-–—]+$"
_SHAPED = r"^\s*[(\-–—]?\s*(?:Rp\s*)?[0-9OolISB][0-9OolISB.,\s]*(?:\s*\))?\s*$"
_PERCENT = r"^\s*[(\-–—]?\s*(?:Rp\s*)?\d+(?:[.,]\d+)*\s*(?:%\s*\)?|\)\s*%)\s*$"
DECIMAL = "decimal(38,6)"


#: Every character that counts as white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def looks_like_number(c: Column) -> Column:
    return F.coalesce(c.rlike("[0-9]") & ~strip(c).rlike(_DASHES), F.lit(False))


def is_share_quantity(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?i){SHARE_WORDS}") & c.rlike("[0-9]"), F.lit(False))


def is_percentage(c: Column) -> Column:
    return F.coalesce(c.rlike(_PERCENT), F.lit(False))


def parsed(raw: Column) -> Column:
    """``struct(value decimal(38,6), is_error)`` of an amount's text; see ``parse_amounts``. Each step is worked out once."""

    def read(r: Column) -> Column:
        body = strip(F.regexp_replace(r, r"^[()]+|[()]+$", ""))
        none = r.isNull() | (r == "") | r.rlike(_DASHES) | F.lower(r).isin(*NO_VALUE) | (r.rlike(r"\d") & body.rlike(r"^[^.,]*[.,]$"))
        repaired = F.when(r.rlike(_SHAPED), F.translate(r, CONFUSABLE, REPAIRED)).otherwise(r)
        return let(F.struct(none.alias("none"), F.regexp_replace(repaired, r"[\s\xa0\u202f]", "").alias("s")), unwrapped)

    def unwrapped(t: Column) -> Column:
        s = t["s"]
        closed = s.startswith("(") & s.endswith(")")
        open_only = s.startswith("(") & (F.length(F.regexp_replace(s, r"[^(]", "")) == 1)
        inner = F.when(closed, F.regexp_replace(s, r"^\(|\)$", "")).when(open_only, F.regexp_replace(s, r"^\(", "")).otherwise(s)
        return let(F.struct(t["none"].alias("none"), (closed | open_only).alias("paren"), inner.alias("s")), unsigned)

    def unsigned(t: Column) -> Column:
        number = F.regexp_replace(F.regexp_replace(F.regexp_replace(t["s"], "^[-–—]", ""), f"(?i)^{CURRENCY_PREFIX}", ""), "[.,;:]+$", "")
        return let(F.struct(t["none"].alias("none"), (t["paren"] | t["s"].rlike("^[-–—]")).alias("negative"), number.alias("n")), valued)

    def valued(t: Column) -> Column:
        n = t["n"]
        dot, comma = n.contains("."), n.contains(",")
        plain = (
            F.when(dot & comma, F.when(n.rlike(r"^[\d.]*,\d*$"), F.translate(F.translate(n, ".", ""), ",", ".")).when(n.rlike(r"^[\d,]*\.\d*$"), F.translate(n, ",", "")))
            .when(comma, F.when(n.rlike(r"^\d{1,3}(?:,\d{3})+$"), F.translate(n, ",", "")).when(n.rlike(r"^\d+,\d+$"), F.translate(n, ",", ".")))
            .when(dot, F.when(n.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.translate(n, ".", "")).when(n.rlike(r"^\d+\.\d+$"), n))
            .when(n.rlike(r"^\d+$"), n)
        )
        amount = let(F.when(~t["none"], plain.try_cast(DECIMAL)), lambda a: F.when(t["negative"], -a).otherwise(a))
        return let(amount, lambda a: F.struct(a.alias("value"), (~t["none"] & a.isNull()).alias("is_error")))

    return let(strip(raw), read)


def parse_amounts(df: DataFrame, raw: str, value: str = "value", error: str = "is_error") -> DataFrame:
    """Adds the exact amount (``decimal(38,6)``) and whether the text has digits that make no number.

    Null with no error: absent, dashes, a "no value" token, or one group of digits cut off after its
    separator. The later of ``.`` and ``,`` is the decimal sign; alone, a sign that groups thousands
    groups them. Parentheses, also an open one, and dashes negate.
    """
    return df.withColumn("__parsed", parsed(F.col(raw))).withColumns({value: F.col("__parsed.value"), error: F.col("__parsed.is_error")}).drop("__parsed")


def parse_shares(df: DataFrame, raw: str, value: str = "shares") -> DataFrame:
    """Adds the number of shares of a text that names shares, else null."""
    named = F.when(is_share_quantity(F.col(raw)), F.regexp_replace(raw, f"(?i){SHARE_WORDS}", " "))
    return parse_amounts(df.withColumn("__named", named), "__named", value, "__bad").drop("__named", "__bad")


def parse_percentages(df: DataFrame, raw: str, value: str = "percent") -> DataFrame:
    """Adds the percentage in percent, never scaled, else null."""
    bare = strip(F.translate(F.col(raw), "%", ""))
    closed = F.when(bare.endswith(")") & ~bare.contains("("), F.concat(F.lit("("), bare)).otherwise(bare)
    return parse_amounts(df.withColumn("__bare", F.when(is_percentage(F.col(raw)), closed)), "__bare", value, "__bad").drop("__bare", "__bad")
