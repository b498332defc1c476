"""Personal data by regular expressions, checksum validators and context words; DataFrame functions only.

Expressions propose spans, leftmost and without overlap within a kind. Validators confirm them: parts
of addresses, Luhn for cards, mod-97 for IBANs, digit counts for phones. A span starts from its
kind's score, and a context word that begins a word among the 40 characters before or behind it raises that; spans of a
kind that follow each other at less than 40 characters are a list, in which the word counts from there on. The base kinds
(email, ip, card, phone) stay whatever their score; the kinds that the method adds (iban, local
phone, ssn) stay from a score of 0.6 on.

An IBAN has the length of its country (``IBAN_LENGTHS``), so what follows it in running text is not
taken for a part of it; codes without a known length take the longest run of 15 to 34 characters that
ends at a word's end. Every head (two capitals, two digits) proposes one, so a head that the checksum
refuses hides none behind it; of overlapping confirmed ones the first stays.

The expressions are possessive where that changes no match, and begin at the start of a run of
their characters, so long runs take linear time and no stack. Places are sums over blocks of matches
and context is cut from the pieces around a match, so a text's time is linear in its matches; so is
that of ``redact``, which cuts what lies between spans from short pieces of the text.

Defined results: null text counts as empty and has no spans; equal or null ids keep their rows;
extra columns are ignored by ``find_pii`` and passed on by ``redact``. Positions are code points, end
exclusive, of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
CONTEXT = 40
#: How far behind a match its piece is looked at: a span that was matched by its head alone goes on for 34 characters at most, with spaces 67.
REACH = CONTEXT + 67
BONUS = 0.35
#: Matches a block of running sums, and characters a piece that ``redact`` cuts from.
SUMMED, PIECE = 256, 4096


@dataclass(frozen=True)
class Kind:
    """name; a cheap condition that a text with a match meets; expression; score without context; context words; base or added."""

    name: str
    gate: str
    regex: str
    score: float
    context: str
    base: bool
    ahead: bool = False  # the expression takes a span's head only and has the span as its group 1, looked ahead


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_regex() -> str:
    one = r"(?:\x20?[A-Z0-9])"
    known = "|".join(rf"(?:{codes.replace(' ', '|')}){one}{{{n - 2}}}" for n, codes in IBAN_LENGTHS.items())
    other = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}{one}{{13,32}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{known}|{other})(?![A-Za-z0-9])))[A-Z]{{2}}"


_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++", 0.9, "e-?mail|mailto|contact|correo|courriel", True),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "address|server|host|adresse|ip(?![a-z])", True),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9]){11,}+", 0.7, "card|visa|mastercard|credit|kredit|debit|tarjeta|karte|carte", True),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|call|tel|fax|mobile|handy|llame", True),
    Kind("iban", "", _iban_regex(), 0.8, "iban|bank|account|konto|cuenta|compte", False, True),
    Kind("local_phone", "", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])(?<!\+[0-9\x20().-]{13,54})", 0.3, "phone|call|tel|fax|mobile", False),
    Kind("ssn", "", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security", False),
)
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,score:double>>"


def _mod97(match: Column) -> Column:
    """Whether the letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 on division by 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.instr(F.lit(_ALNUM), c) - 1
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), _mod97(match)).otherwise(F.lit(False))
    return F.lit(True)


def _apart(spans: Column) -> Column:
    """Of overlapping spans, in order, the first."""
    last = lambda kept: F.coalesce(F.get(kept, F.size(kept) - 1)["stop"], F.lit(0))
    return F.aggregate(spans, F.array().cast(_SPAN), lambda kept, s: F.when(s["start"] >= last(kept), F.concat(kept, F.array(s))).otherwise(kept))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(sizes: Column) -> Column:
    """The sum of the sizes before each one: within blocks of ``SUMMED``, on top of the blocks' own sums."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / SUMMED).cast("int")), lambda k: total(F.slice(sizes, k * SUMMED + 1, F.lit(SUMMED))))
    running = F.aggregate(blocks, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))
    inside = lambda i: total(F.slice(sizes, i - i % SUMMED + 1, i % SUMMED))
    return _let(running, lambda before: F.transform(sizes, lambda _, i: F.get(before, F.floor(i / SUMMED).cast("int")) + inside(i)))


def _until(stops: Column) -> Column:
    """The largest one before each: within blocks of ``SUMMED``, beside the blocks' own."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(stops) / SUMMED).cast("int")), lambda k: F.coalesce(F.array_max(F.slice(stops, k * SUMMED + 1, F.lit(SUMMED))), F.lit(0)))
    running = F.aggregate(blocks, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.greatest(F.element_at(out, -1), x))))
    inside = lambda i: F.coalesce(F.array_max(F.slice(stops, i - i % SUMMED + 1, i % SUMMED)), F.lit(0))
    return _let(running, lambda before: F.transform(stops, lambda _, i: F.greatest(F.get(before, F.floor(i / SUMMED).cast("int")), inside(i))))


def _kind_spans(text: Column, rank: int, kind: Kind) -> Column:
    """The confirmed spans of one kind: pieces between the matches and the matches give their places."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)).alias("heads"),
        F.regexp_extract_all(text, F.lit(kind.regex), F.lit(1 if kind.ahead else 0)).alias("matches"),
        F.split(text, kind.regex, -1).alias("between"),
    )

    def placed(f: Column) -> Column:
        pieces = F.zip_with(f["between"], f["heads"], lambda b, m: F.struct(F.length(b).alias("gap"), (F.length(b) + F.coalesce(F.length(m), F.lit(0))).alias("size"), F.right(b, F.lit(CONTEXT)).alias("tail"), F.concat(F.right(b, F.lit(CONTEXT)), F.coalesce(m, F.lit(""))).alias("end"), F.concat(F.left(b, F.lit(REACH)), F.coalesce(m, F.lit(""))).alias("lead")))
        return _let(F.struct(pieces.alias("p"), _let(F.transform(pieces, lambda p: p["size"]), _starts).alias("starts"), f["matches"].alias("matches")), confirmed)

    def confirmed(f: Column) -> Column:
        rows = F.transform(f["matches"], lambda m, i: F.struct(m.alias("m"), (F.get(f["starts"], i) + F.get(f["p"], i)["gap"]).alias("start"), i.alias("i")))
        return _let(F.filter(rows, lambda s: _valid(kind.name, s["m"])), lambda valid: listed(f, valid))

    def listed(f: Column, valid: Column) -> Column:
        # The text before a match: the ends of at most CONTEXT / 2 pieces, as no match (or head) has fewer than two characters.
        few = CONTEXT // 2
        near = lambda i: F.right(F.concat(F.array_join(F.transform(F.slice(f["p"], F.greatest(i - few, F.lit(0)) + 1, F.least(i, F.lit(few))), lambda p: p["end"]), ""), F.get(f["p"], i)["tail"]), F.lit(CONTEXT))
        # Behind it: the beginnings of as many pieces, less the rest of a span whose head alone was matched.
        behind = lambda s: F.substr(F.array_join(F.transform(F.slice(f["p"], s["i"] + 2, F.lit(few + 1)), lambda p: p["lead"]), ""), (F.length(s["m"]) - F.lit(2) if kind.ahead else F.lit(0)) + 1, F.lit(CONTEXT))
        around = lambda s: F.lower(F.concat(near(s["i"]), F.lit("\n"), behind(s)))
        told = F.transform(valid, lambda s, i: F.struct(
            s["m"].alias("m"), s["start"].alias("start"), F.when(around(s).rlike(rf"(?<![a-z])(?:{kind.context})"), i + 1).otherwise(0).alias("word"),
            F.when((i > 0) & (s["start"] - F.get(valid, i - 1)["start"] - F.length(F.get(valid, i - 1)["m"]) < CONTEXT), 0).otherwise(i + 1).alias("first"),
        ))
        return _let(told, scored)

    def scored(told: Column) -> Column:
        # A span has its list's word: the last one met so far isn't before the list's first span.
        last = lambda name: _until(F.transform(told, lambda t: t[name]))

        def spans(before: Column) -> Column:
            listed = lambda t, i: F.greatest(F.get(before["word"], i), t["word"]) >= F.greatest(F.get(before["first"], i), t["first"])
            score = lambda t, i: F.least(F.lit(1.0), F.lit(kind.score) + F.when(listed(t, i), F.lit(BONUS)).otherwise(F.lit(0.0)))
            out = F.transform(told, lambda t, i: F.struct(t["start"].cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (t["start"] + F.length(t["m"])).cast("int").alias("stop"), score(t, i).alias("score"))).cast(_SPAN)
            return out if kind.base else F.filter(out, lambda s: s["score"] >= THRESHOLD)

        return _let(F.struct(last("word").alias("word"), last("first").alias("first")), spans)

    spans = _let(found, placed)
    if kind.ahead:
        spans = _apart(spans)
    may = text.contains(kind.gate) if kind.gate else F.lit(True)
    digits = {"card": r"[0-9](?:[\x20-]?[0-9]){11}", "ip": r"\.[0-9]+\.[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "local_phone": r"[0-9]{3}[.-][0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-"}.get(kind.name)
    if digits:
        may = may & text.rlike(digits)
    return F.when(may, spans).otherwise(F.array().cast(_SPAN))


def spans_column(text: Column) -> Column:
    """All spans of a text by start, then kind in the order of ``KINDS``."""
    return F.array_sort(F.concat(*[_kind_spans(text, i, k) for i, k in enumerate(KINDS)]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` of every row: one pass over the rows, no shuffle."""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select(id_col, spans_column(F.col("__text")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with its spans, in order, replaced by ``[KIND]``; spans that overlap go together under the first one's name."""

    def cut(f: Column) -> Column:
        pieces, until = f["pieces"], f["until"]
        of = lambda a, n: F.substr(F.array_join(F.slice(pieces, F.floor(a / PIECE).cast("int") + 1, F.floor((a + n) / PIECE).cast("int") - F.floor(a / PIECE).cast("int") + 1), ""), a % PIECE + 1, n)
        heads = F.filter(F.zip_with(f["spans"], until, lambda s, u: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), u.alias("until"))), lambda h: h["start"] >= h["until"])
        body = F.transform(heads, lambda h: F.concat(of(h["until"], h["start"] - h["until"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        end = F.array_max(F.transform(f["spans"], lambda s: s["stop"]))
        return F.concat(F.array_join(body, ""), of(end, f["length"] - end))

    def prepared(f: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor(f["length"] / PIECE).cast("int")), lambda k: F.substr(f["text"], k * PIECE + 1, F.lit(PIECE)))
        full = F.struct(f["spans"].alias("spans"), f["length"].alias("length"), pieces.alias("pieces"), _let(F.transform(f["spans"], lambda s: s["stop"]), _until).alias("until"))
        return F.when(F.size(f["spans"]) > 0, _let(full, cut)).otherwise(f["text"])

    return _let(F.struct(text.alias("text"), F.length(text).alias("length"), spans.alias("spans")), prepared)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with its spans replaced by ``[KIND]``; a null text stays null."""
    text = F.col(text_col)
    return docs.withColumn(text_col, F.when(text.isNotNull(), redacted(text, spans_column(text))))


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digest of the base spans, all spans as text, and the added kinds' count."""
    base = [k.name for k in KINDS if k.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs, id_col, text_col).select(
        F.col(id_col), *map(count, base), F.sha2(joined(of), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(of)).cast("long").alias("n_added"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
