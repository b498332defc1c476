"""Labels to canonical fields: a cascade of broadcast lookups in a dictionary that the caller gives.

A dictionary is a DataFrame ``statement, stmt_ord, field, label, label_ord``. Exact phrases come first,
then cleaned labels, then labels without spaces; within a tier the row's own statement, then the
statements in order, then the labels in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.amounts import is_share_quantity

#: Fields whose labels alone don't tell them apart.
TREASURY = ("treasury_shares_quantity", "treasury_shares_carrying_value")


def phrase(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), r"(?U)\s+", " "))


def normalized(label: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"(?U)[^\w]", " "), r"(?U)\s+", " "))


def cleaned(label: Column) -> Column:
    """Without parentheses' contents and a leading number, then normalized."""
    return normalized(F.regexp_replace(F.regexp_replace(label, r"\([^)]*\)", " "), r"^\s*\d+[.)]\s*", ""))


def collapsed(label: Column) -> Column:
    return F.replace(cleaned(label), F.lit(" "), F.lit(""))


def dictionary_keys(dictionary: DataFrame) -> DataFrame:
    tiers = F.array(F.struct(F.lit(1).alias("tier"), phrase(F.col("label")).alias("key")), F.struct(F.lit(2).alias("tier"), normalized(F.col("label")).alias("key")), F.struct(F.lit(3).alias("tier"), F.replace(normalized(F.col("label")), F.lit(" "), F.lit("")).alias("key")))
    return dictionary.select("statement", "stmt_ord", "field", "label_ord", F.inline(tiers)).where("key <> ''")


def looked_up(dictionary: DataFrame) -> DataFrame:
    """``tier, key, own, any``: of each key the field by statement, and the one of the first statement and label."""
    keys = dictionary_keys(dictionary)
    order = F.struct("stmt_ord", "label_ord")
    per = keys.groupBy("tier", "key", "statement").agg(F.min_by("field", order).alias("field"), F.min(order).alias("order"))
    own = F.map_from_entries(F.collect_list(F.when(F.col("statement").isNotNull(), F.struct("statement", "field"))))
    return per.groupBy("tier", "key").agg(own.alias("own"), F.min_by("field", "order").alias("any"))


def map_labels(rows: DataFrame, dictionary: DataFrame, key: str, label: str = "label", statement: str = "section", broadcast_rows: int = 100_000) -> DataFrame:
    """Adds ``field`` and ``tier`` (null where unmapped) to rows that ``key`` tells apart.

    Each tier is a lookup by its own key, so the rows stay where they are; a dictionary of more than
    ``broadcast_rows`` keys, which is counted, is joined by shuffles instead.
    """
    known = looked_up(dictionary)
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    keys = {1: phrase(F.col(label)), 2: cleaned(F.col(label)), 3: collapsed(F.col(label))}
    out = rows.withColumns({f"__k{t}": k for t, k in keys.items()})
    for t in keys:
        side = known.where(F.col("tier") == t).select(F.col("key").alias(f"__k{t}"), F.col("own").alias(f"__own{t}"), F.col("any").alias(f"__any{t}"))
        out = out.join(F.broadcast(side) if small else side, f"__k{t}", "left")
    found = {t: F.coalesce(F.try_element_at(f"__own{t}", F.col(statement)), F.col(f"__any{t}")) for t in keys}
    tier = F.coalesce(*[F.when(f.isNotNull(), F.lit(t)) for t, f in found.items()])
    return out.select(*[c for c in rows.columns if c not in ("field", "tier")], F.coalesce(*found.values()).alias("field"), tier.alias("tier"))


def treasury_field(field: Column, first_value: Column) -> Column:
    """Treasury shares by what the row's first value names: a percentage, a number of shares, else an amount."""
    named = field.isin(*TREASURY)
    percent = F.coalesce(first_value.rlike("(?i)%|persen|percent"), F.lit(False))
    return F.when(named & percent, "treasury_shares_percentage").when(named & is_share_quantity(first_value), "treasury_shares_quantity").when(named, "treasury_shares_carrying_value").otherwise(field)


def split_unmapped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("field IS NOT NULL"), rows.where("field IS NULL").withColumn("status", F.lit("UNMAPPED_FIELD"))
