"""Manual corrections as an append-only log, added values, and remapping of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.amounts import parse_amounts
from tallyspark.functions.names import field_title

LARGEST = 2**53 - 1
KEY = ["document_id", "statement", "field", "year"]


def admit(edits: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Edits whose text is a plain number of exact size (with ``new_value``), and the others."""
    parsed = parse_amounts(edits, raw, "new_value", "__bad")
    good = F.coalesce(F.col(raw).rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?$") & F.col("new_value").isNotNull() & (F.abs("new_value") <= LARGEST), F.lit(False))
    return parsed.where(good).drop("__bad"), parsed.where(~good).select(*edits.columns)


def fold(log: DataFrame, keys: list[str], time: str, value: str, original: str, revert: Column) -> DataFrame:
    """The log's current state: first original and last value of each key; keys whose last entry reverts are gone."""
    order = F.struct(time, "id")
    state = log.groupBy(*keys).agg(F.min_by(original, order).alias("original_value"), F.max_by(F.struct(F.col(value).alias("v"), revert.alias("r"), F.col(time).alias("t")), order).alias("last"), F.count(F.lit(1)).alias("edits"))
    return state.where(~F.col("last.r")).select(*keys, "original_value", F.col("last.v").alias("value"), F.col("last.t").alias("edited_at"), "edits")


def overlay(values: DataFrame, edits: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Extracted values with the edits laid over: matched rows take the edit's value, edits without a value stay as rows.

    Keys compare null-safely. ``method`` and ``status`` of an edited row are manual and OK.
    """
    e = edits.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__value"), F.lit(True).alias("__edited"))
    same = F.lit(True)
    for k in keys:
        same = same & values[k].eqNullSafe(e[f"__{k}"])
    out = values.join(e, same, "full_outer")
    edited = F.coalesce("__edited", F.lit(False))
    fixed = {k: F.when(edited, F.col(f"__{k}")).otherwise(F.col(k)) for k in keys}
    fixed |= {"original_value": F.when(edited, F.col(value)), value: F.when(edited, F.col("__value")).otherwise(F.col(value))}
    for name, manual in (("method", "manual"), ("status", "OK")):
        if name in values.columns:
            fixed[name] = F.when(edited, F.lit(manual)).otherwise(F.col(name))
    return out.withColumns(fixed).drop(*[f"__{k}" for k in keys], "__value", "__edited")


def add_missing(values: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """New values whose key is free (null-safe), and those that clash."""
    named = new.withColumns({f"__{k}": F.col(k) for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"__{k}").eqNullSafe(values[k])
    drop = [f"__{k}" for k in keys]
    return named.join(values, same, "left_anti").drop(*drop), named.join(values, same, "left_semi").drop(*drop)


def remap_plan(rows: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Moves from one field to another that find their key free, one a target (lowest id); ``id, keys, old, new``."""
    wanted = rows.where(F.col(new).isNotNull() & (F.col(old) != F.col(new)))
    taken = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(old).alias("__f"))
    free = F.col(new) == F.col("__f")
    for k in keys:
        free = free & F.col(k).eqNullSafe(F.col(f"__{k}"))
    moves = wanted.join(taken, free, "left_anti")
    return moves.groupBy(*keys, new).agg(F.min_by(F.struct("id", old), "id").alias("m")).select("m.id", *keys, F.col(f"m.{old}").alias(old), new)


def remap_summary(plan: DataFrame, rows: DataFrame, old: str, new: str, label: str) -> DataFrame:
    """Moves by pair of fields with a sample label (of the lowest id), most first."""
    joined = plan.join(rows.select("id", label), "id")
    return joined.groupBy(old, new).agg(F.count(F.lit(1)).alias("n"), F.min_by(label, "id").alias("sample")).orderBy(F.desc("n"), old, new)


def apply_remap(rows: DataFrame, keys: list[str], old: str, new: str, table) -> DataFrame:
    """All moves, in rounds: a key that a move vacates is free in the next one. ``table`` writes each round's rows and reads them back."""
    while True:
        plan = table(remap_plan(rows, keys, old, new).select("id", F.col(new).alias("__to")))
        if not plan.limit(1).count():
            return rows
        rows = table(rows.join(plan, "id", "left").withColumn(old, F.coalesce("__to", old)).drop("__to"))


def complete_new(new: DataFrame, values: DataFrame, documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Added figures (``document_id, field, year, value``, currency or null, note) as full rows.

    The statement is the field's own; a currency that isn't given is the document's most frequent
    (of equals the smallest); method manual, confidence 1.0, status OK.
    """
    home = dictionary.groupBy("field").agg(F.min_by("statement", "stmt_ord").alias("__home"))
    seen = values.where("currency IS NOT NULL").groupBy("document_id", "currency").agg(F.count(F.lit(1)).alias("n"))
    mode = seen.groupBy("document_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("currency").alias("c")))["c"].alias("__mode"))
    rows = new.join(home, "field", "left").join(mode, "document_id", "left").join(documents.select(F.col("id").alias("document_id"), "company"), "document_id")
    return rows.withColumns({
        "statement": F.coalesce("__home", F.lit("balance_sheet")), "currency": F.coalesce(F.upper(F.trim("currency")), F.col("__mode")), "raw_label": field_title(F.col("field")), "raw_value": F.lit(None).cast("string"),
        "extraction_method": F.lit("manual"), "confidence": F.lit(1.0), "status": F.lit("OK"), "original_value": F.lit(None).cast("double"),
    }).drop("__home", "__mode")
