"""Reconciliation: measures against sums of parts, with an absolute and a relative tolerance.

Identities are data: rows that say which field goes to which side of which check with which sign
(``IDENTITIES``), and a line a check that says when it is told that fields are missing (``CHECKS``). A
key's values meet them once: one aggregation lays the fields that the rules name side by side and keeps
as bits which are there; whether a check can be made, is impossible or isn't due are comparisons of
bits. Sums, status, message and evidence follow behind the explode, as columns that are left out where
nobody reads them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.units import scale_hint

ABSOLUTE, RELATIVE = 1000.0, 0.001
EXPECTED, ACTUAL = "expected", "actual"
EVIDENCE = "struct<absolute_difference:double,relative_difference:double,absolute_tolerance:double,relative_tolerance:double,unit_scale:double,missing_fields:array<string>,reason:string,values_used:map<string,double>,top_line:string>"
#: Categories of findings, and the identities as rows: check, statement, side, sign, field (with its own
#: statement before a dot where that is another one), alternative (fields under one number stand for each other, the first
#: present one counts). Signs: 1, -1, or 0 for less the size. Then the messages.
MATCH, ROUNDING, MISSING, INCOMPLETE, LOW = "accounting_mismatch", "rounding_difference", "missing_fields", "incomplete_statement", "low_confidence"
IDENTITIES = (
    ("assets_equals_liabilities_plus_equity", "balance_sheet", EXPECTED, 1, "total_assets", 0),
    ("assets_equals_liabilities_plus_equity", "balance_sheet", ACTUAL, 1, "total_liabilities", 1),
    ("assets_equals_liabilities_plus_equity", "balance_sheet", ACTUAL, 1, "total_equity", 2),
    ("assets_split", "balance_sheet", EXPECTED, 1, "total_assets", 0),
    ("assets_split", "balance_sheet", ACTUAL, 1, "current_assets", 1),
    ("assets_split", "balance_sheet", ACTUAL, 1, "non_current_assets", 2),
    ("liabilities_split", "balance_sheet", EXPECTED, 1, "total_liabilities", 0),
    ("liabilities_split", "balance_sheet", ACTUAL, 1, "current_liabilities", 1),
    ("liabilities_split", "balance_sheet", ACTUAL, 1, "non_current_liabilities", 2),
    ("gross_profit_identity", "income_statement", EXPECTED, 1, "sales", 0),
    ("gross_profit_identity", "income_statement", EXPECTED, 1, "sales_and_revenue", 0),
    ("gross_profit_identity", "income_statement", EXPECTED, 0, "cost_of_revenue", 1),
    ("gross_profit_identity", "income_statement", ACTUAL, 1, "gross_profit", 2),
    ("cash_flow_reconciliation", "cash_flow", EXPECTED, 1, "ending_cash_balance", 0),
    ("cash_flow_reconciliation", "cash_flow", ACTUAL, 1, "beginning_cash_balance", 1),
    ("cash_flow_reconciliation", "cash_flow", ACTUAL, 1, "cash_flow_operating", 2),
    ("cash_flow_reconciliation", "cash_flow", ACTUAL, 1, "cash_flow_investing", 3),
    ("cash_flow_reconciliation", "cash_flow", ACTUAL, 1, "cash_flow_financing", 4),
    ("cash_change_reconciliation", "cash_flow", EXPECTED, 1, "ending_cash_balance", 0),
    ("cash_change_reconciliation", "cash_flow", ACTUAL, 1, "beginning_cash_balance", 1),
    ("cash_change_reconciliation", "cash_flow", ACTUAL, 1, "net_change_in_cash", 2),
    ("cash_matches_balance_sheet", "cash_flow", EXPECTED, 1, "ending_cash_balance", 0),
    ("cash_matches_balance_sheet", "cash_flow", ACTUAL, 1, "balance_sheet.cash_and_cash_equivalents", 1),
    ("treasury_shares_positive_value", "equity", ACTUAL, 1, "treasury_shares_carrying_value", 0),
)
NOTHING = "no_checks_possible"
TOLD = {
    "VALID": "Difference %s within tolerance (abs<=%s or rel<=%s)", "WARNING": "Rounding difference %s (%s) slightly above tolerance", "ERROR": "Difference %s (%s) exceeds tolerance",
    "treasury_shares_positive_value": "Treasury shares carrying value is positive; usually presented as a deduction (negative). Verify column interpretation.",
    NOTHING: "Not enough statement fields extracted to run any validation",
}
INSUFFICIENT = "Insufficient data"


def compare(expected: Column, actual: Column, scale: Column, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> Column:
    """VALID within ``absolute * scale`` or ``relative``; WARNING within ten times that or 1 %; else ERROR."""
    diff = F.abs(actual - expected)
    rel = diff / F.greatest(F.abs(expected), F.lit(1.0))
    return F.when((diff <= F.lit(absolute) * scale) | (rel <= relative), "VALID").when(rel <= max(10 * relative, 0.01), "WARNING").otherwise("ERROR")


def severity(status: Column) -> Column:
    return F.when(status.isin("ERROR", "WARNING"), status).otherwise("INFO")


def reconcile(df: DataFrame, keys: list[str], expected: str, parts: list[str], scale: Column | None = None) -> DataFrame:
    """``expected`` against the sum of ``parts``: actual, difference, status, severity."""
    actual = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    scale = F.lit(1.0) if scale is None else scale
    out = df.select(*keys, F.col(expected).alias("expected"), actual.alias("actual"), scale.alias("scale")).withColumn("difference", F.col("actual") - F.col("expected"))
    out = out.withColumn("status", compare(F.col("expected"), F.col("actual"), F.col("scale"))).drop("scale")
    return out.withColumn("severity", severity(F.col("status")))


@dataclass(frozen=True)
class Check:
    """When a check that lacks fields is told as impossible, and what is told of it.

    ``due``: fields that must be there for that; empty: any value of its statement; None: never told.
    ``lacks``: the fields told as missing, by default all of the check's that are. ``instead_of``: the check
    whose place this one takes where that one can't be made; ``unless``: fields that keep it from being told.
    ``sign_only``: a finding where the value is positive, not a comparison. ``shown``: its values are evidence.
    """

    name: str
    due: tuple[str, ...] | None = ()
    lacks: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    instead_of: str | None = None
    sign_only: bool = False
    shown: bool = False


CHECKS = (
    Check("assets_equals_liabilities_plus_equity", due=("total_assets",), shown=True),
    Check("assets_split"),
    Check("liabilities_split"),
    Check("gross_profit_identity"),
    Check("cash_flow_reconciliation", due=("beginning_cash_balance", "ending_cash_balance"), lacks=("net_change_in_cash",), unless=("net_change_in_cash",)),
    Check("cash_change_reconciliation", due=None, instead_of="cash_flow_reconciliation"),
    Check("cash_matches_balance_sheet", due=None),
    Check("treasury_shares_positive_value", due=None, sign_only=True, shown=True),
)

Identity = tuple[str, str, str, int, str, int]
_RULE = (
    "struct<name:string,statement:string,need:bigint,block:bigint,due:bigint,unless:bigint,due_any:bigint,told:boolean,sign_only:boolean,shown:boolean,"
    "choices:array<bigint>,lacks:array<struct<at:int,bits:bigint>>,terms:array<struct<expected:boolean,sign:int,fields:array<int>>>>"
)


class Rules:
    """Identities and checks compiled to places and bits: the fields' places are those of ``fields``, then come the statements'."""

    def __init__(self, identities: Sequence[Identity] = IDENTITIES, checks: Sequence[Check] = CHECKS) -> None:
        self.fields: list[tuple[str, str]] = []
        by_check: dict[str, list[Identity]] = {}
        for row in identities:
            by_check.setdefault(row[0], []).append(row)
            self._place(row[1], row[4])
        for c in checks:
            for f in (*(c.due or ()), *c.lacks, *c.unless):
                self._place(by_check[c.name][0][1], f)
        self.statements = list(dict.fromkeys(s for s, _ in self.fields))
        if len(self.fields) + len(self.statements) > 62:
            raise ValueError("the rules name more fields than a row of bits holds")
        self.rules = [self._rule(c, by_check[c.name], by_check) for c in checks]

    def _place(self, statement: str, field: str) -> int:
        key = tuple(field.split(".")) if "." in field else (statement, field)
        if key not in self.fields:
            self.fields.append(key)
        return self.fields.index(key)

    def _bits(self, statement: str, fields: Sequence[str]) -> int:
        return sum(1 << self._place(statement, f) for f in dict.fromkeys(fields))

    def _rule(self, check: Check, rows: list[Identity], by_check: dict[str, list[Identity]]) -> tuple:
        statement = rows[0][1]
        terms: dict[tuple, list[int]] = {}
        for _, s, side, sign, field, alternative in rows:
            terms.setdefault((alternative, side == EXPECTED, sign), []).append(self._place(s, field))
        single = [f[0] for f in terms.values() if len(f) == 1]
        block = sum(1 << self._place(r[1], r[4]) for r in by_check[check.instead_of]) if check.instead_of else 0
        any_of = 1 << (len(self.fields) + self.statements.index(statement)) if check.due == () else 0
        lacks = [(p, 1 << p) for p in (self._place(statement, f) for f in check.lacks)] or [(p, sum(1 << q for q in f)) for f in terms.values() for p in f]
        return (
            check.name, statement, sum(1 << p for p in single), block, self._bits(statement, check.due or ()), self._bits(statement, check.unless), any_of, check.due is not None, check.sign_only, check.shown,
            [sum(1 << p for p in f) for f in terms.values() if len(f) > 1], lacks, [(expected, sign, places) for (_, expected, sign), places in terms.items()],
        )

    def column(self) -> Column:
        """All rules as one constant."""
        text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"array({', '.join(map(text, v))})" if isinstance(v, list) else f"struct({', '.join(map(text, v))})" if isinstance(v, tuple) else str(v)
        return F.expr(f"cast({text(self.rules)} AS array<{_RULE}>)")


def wide_figures(values: DataFrame, keys: list[str], rules: Rules, value: str = "normalized_value") -> DataFrame:
    """One row a key: ``v`` (the rules' fields side by side), ``present`` (their bits, then the statements') and ``largest``, the largest size of all values.

    One aggregation, combined before the shuffle. Of several rows of one field the largest value counts;
    winners have one each.
    """
    v = F.col(value).cast("double")
    figures = [F.max(F.when((F.col("statement") == s) & (F.col("field") == f), v)).alias(f"f{i}") for i, (s, f) in enumerate(rules.fields)]
    held = [F.count(F.when(F.col("statement") == s, v)).alias(f"n{i}") for i, s in enumerate(rules.statements)]
    wide = values.groupBy(*keys).agg(*figures, *held, F.max(F.abs(v)).alias("largest"))
    bits = [F.when(F.col(f"f{i}").isNotNull(), F.lit(1 << i)).otherwise(0) for i in range(len(figures))]
    bits += [F.when(F.col(f"n{i}") > 0, F.lit(1 << (len(figures) + i))).otherwise(0) for i in range(len(held))]
    present = bits[0].cast("long")
    for b in bits[1:]:
        present = present + b
    return wide.select(*keys, F.array(*[F.col(f"f{i}") for i in range(len(figures))]).alias("v"), present.alias("present"), F.coalesce("largest", F.lit(0.0)).alias("largest"))


def _holds(present: Column, bits: Column) -> Column:
    return present.bitwiseAND(bits) == bits


def identity_checks(values: DataFrame, keys: list[str], value: str = "normalized_value", rules: Rules | None = None, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """All statement identities of each key (a filing's year) from its winning values ``keys, statement, field, value``.

    A statement that has no value at all gives no rows; a key without any check gives ``no_checks_possible``.
    """
    rules = rules or Rules()
    wide = wide_figures(values, keys, rules, value)
    p = F.col("present")
    full = lambda r: _holds(p, r["need"]) & F.forall(r["choices"], lambda c: p.bitwiseAND(c) != 0)
    positive = lambda r: ~r["sign_only"] | (F.get("v", r["terms"][0]["fields"][0]) > 0)
    made = lambda r: full(r) & ((r["block"] == 0) | ~_holds(p, r["block"])) & positive(r)
    told = lambda r: r["told"] & ~full(r) & _holds(p, r["due"]) & (p.bitwiseAND(r["unless"]) == 0) & ((r["due_any"] == 0) | (p.bitwiseAND(r["due_any"]) != 0))
    met = F.filter(rules.column(), lambda r: made(r) | told(r))
    rows = wide.select(*keys, "v", "present", "largest", F.explode_outer(met).alias("r"))

    # One value a term: the first alternative that is there.
    number = lambda t: F.get("v", F.coalesce(F.get(F.filter(t["fields"], lambda f: F.get("v", f).isNotNull()), 0), F.lit(-1)))
    signed = lambda t: F.when(t["sign"] == 0, -F.abs(number(t))).otherwise(number(t) * t["sign"])
    side = lambda expected: F.aggregate(F.filter("r.terms", lambda t: t["expected"] == expected), F.lit(None).cast("double"), lambda total, t: F.when(total.isNull(), signed(t)).otherwise(total + signed(t)))
    sign_only, complete = F.col("r.sign_only"), F.coalesce(full(F.col("r")), F.lit(False))
    rows = rows.withColumns({"expected": F.when(complete & ~sign_only, side(True)), "actual": F.when(complete, side(False)), "scale": scale_hint(F.col("largest"))})
    name, none = F.coalesce("r.name", F.lit(NOTHING)), F.col("r").isNull()
    compared = complete & ~sign_only
    # Behind the explode, what is worked out once stands as columns; those that nobody reads go.
    rows = rows.withColumns({"name": name, "statement": F.col("r.statement"), "difference": F.col("actual") - F.col("expected"), "__compared": compared})
    expected, diff, scale = F.col("expected"), F.abs("difference"), F.col("scale")
    rel = diff / F.greatest(F.abs("expected"), F.lit(1.0))
    status = F.when(F.col("__compared"), compare(expected, F.col("actual"), scale, absolute, relative)).when(F.coalesce(sign_only, F.lit(False)), "WARNING").otherwise("NOT_APPLICABLE")
    lacking = F.transform(F.filter("r.lacks", lambda f: p.bitwiseAND(f["bits"]) == 0), lambda f: F.get(F.array(*[F.lit(field) for _, field in rules.fields]), f["at"]))
    missing = F.when(~F.col("__compared") & ~none & ~F.coalesce(sign_only, F.lit(False)), lacking)
    rows = rows.withColumns({"status": status, "__missing": missing})
    category = F.when(none, INCOMPLETE).when(F.coalesce(sign_only, F.lit(False)), LOW).when(F.col("status") == "NOT_APPLICABLE", MISSING).when(F.col("status") == "WARNING", ROUNDING).otherwise(MATCH)
    percent = lambda c: F.format_string("%.4f%%", c * 100)
    amount = F.format_number(diff, 2)
    message = (
        F.when(F.col("status") == "NOT_APPLICABLE", F.when(none, TOLD[NOTHING]).otherwise(F.concat(F.lit(f"{INSUFFICIENT}: missing "), F.array_join("__missing", ", "))))
        .when(F.coalesce(sign_only, F.lit(False)), TOLD["treasury_shares_positive_value"])
        .when(F.col("status") == "VALID", F.format_string(TOLD["VALID"], amount, F.format_number(F.lit(absolute) * scale, 0), percent(F.lit(relative))))
        .when(F.col("status") == "WARNING", F.format_string(TOLD["WARNING"], amount, percent(rel)))
        .otherwise(F.format_string(TOLD["ERROR"], amount, percent(rel)))
    )
    shown = F.map_from_entries(F.transform(F.flatten(F.transform("r.terms", lambda t: t["fields"])), lambda f: F.struct(F.get(F.array(*[F.lit(field) for _, field in rules.fields]), f), F.get("v", f))))
    chosen = F.get(F.filter(F.flatten(F.transform(F.filter("r.terms", lambda t: F.size(t["fields"]) > 1), lambda t: t["fields"])), lambda f: F.get("v", f).isNotNull()), 0)
    on = lambda c: F.when(F.col("__compared"), c)
    evidence = F.struct(
        on(diff), on(F.round(rel, 8)), on(F.lit(absolute) * scale), on(F.lit(relative)), on(scale), F.col("__missing"), F.when(F.col("__missing").isNotNull(), INSUFFICIENT),
        F.when((F.col("__compared") | sign_only) & F.col("r.shown"), shown), on(F.get(F.array(*[F.lit(field) for _, field in rules.fields]), chosen)),
    ).cast(EVIDENCE)
    columns = {"message": message, "category": category, "evidence": evidence, "severity": severity(F.col("status"))}
    return rows.select(*keys, "name", "statement", "status", "expected", "actual", "difference", *[c.alias(n) for n, c in columns.items()])
