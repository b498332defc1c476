"""Units, scales and currencies that a page states, and whether its figures bear them out.

A text is read once: one expression finds all words that say anything about units, from whatever place
they begin at, and what is decided is decided on these few words.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.once import let, starts

#: Unit words with their name and multiplier, largest first; currency words; what introduces a unit, states base units or a page's own.
UNITS = (
    (r"\btriliun(?:an)?\b|\btrillions?\b", "triliun", 1_000_000_000_000),
    (r"\bmiliar(?:an)?\b|\bbillions?\b", "miliar", 1_000_000_000),
    (r"\bjuta(?:an)?\b|\bmillions?\b|\bjt\b", "juta", 1_000_000),
    (r"\bribu(?:an)?\b|\bthousands?\b|\brb\b", "ribuan", 1_000),
)
CURRENCIES = (
    (r"\bUSD\b|\bUS\$|\bDolar\s*(?:AS|Amerika)\b|\$|^US\b", "USD"),
    (r"\bEUR\b|\bEuro\b", "EUR"),
    (r"\bSGD\b", "SGD"),
    (r"\bJPY\b|\bYen\b", "JPY"),
    (r"\bRp\b|\bRupiahs?\b", "IDR"),
)
INTRODUCED = r"(?:dalam|disajikan\s+dalam|expressed\s+in|in)\s"
BASE = r"(?-i:[Dd]alam\s+(?:jumlah\s+)?[Rr]upiah(?!\s*\w))"
STATED = r"(?:dalam|in|disajikan\s+dalam|expressed\s+in)\s+(?:\(?\s*)?(?:ribu|juta|miliar|triliun|thousand|million|billion|trillion)[a-z]*(?:\s+(?:rupiah|usd?|dollars?))?(?:\s*\)?)"
PAGE_UNIT = r"\(\s*(?:Rp\.?\s*)?(?:ribu|juta|miliar|triliun|thousand|million|billion|trillion)[a-z]*(?:\s+(?:rupiah|usd?|dollars?))?\s*\)|(?:dalam|in)\s+(?:ribu|juta|miliar|triliun|thousand|million|billion|trillion)[a-z]*(?:\s+(?:rupiah|usd?|dollars?))?"
#: Medians of at least this are base units already; scaled medians above the second are none.
ALREADY_BASE, MOST_SCALED = 10_000_000_000, 1e15

#: What a word says, by how its first letters are spelled: a multiplier, the place of a currency among ``CURRENCIES``, or that it introduces a unit.
_MULTIPLIERS = {"tril": 1_000_000_000_000, "mili": 1_000_000_000, "bill": 1_000_000_000, "juta": 1_000_000, "mill": 1_000_000, "jt": 1_000_000, "ribu": 1_000, "thou": 1_000, "rb": 1_000}
_PLACES = {"usd": 0, "us$": 0, "dola": 0, "$": 0, "us": 0, "eur": 1, "euro": 1, "sgd": 2, "jpy": 3, "yen": 3, "rp": 4, "rupi": 4}
_WORDS = "(?iU:" + "|".join([BASE, INTRODUCED, *(u[0] for u in UNITS), *(c[0] for c in CURRENCIES)]) + ")"
_STATED_OR_WORDS = f"(?iU:{STATED})|{_WORDS}"
#: The first two letters of every such word. Letters that another case turns into i or s are these as well, but a text without any is searched many times faster.
_TWO = {"b": "i", "d": "aio", "e": "xu", "i": "n", "j": "tup", "m": "i", "r": "ibpu", "s": "g", "t": "rh", "u": "s", "y": "e"}
_FOLDED = {"i": "\u0130\u0131", "s": "\u017f"}
#: Stands before each word of a text's words about units; no word has it.
_MARK = "\u0001"


def _begun(pattern: str, folded: dict[str, str]) -> str:
    cases = lambda letters: "[" + "".join(c + c.upper() + folded.get(c, "") for c in letters) + "]"
    return starts(pattern, f"{cases(_TWO)[:-1]}$]", rf"\$|{'|'.join(cases(a) + cases(b) for a, b in _TWO.items())}")


_STEM = r"\b(triliun|trillions?|miliar|billions?|juta|millions?|jt|ribu|thousands?|rb)\b"


def _words(text: Column, pattern: str) -> Column:
    """The text's words of a pattern as one text, a mark before each."""

    def found(t: Column) -> Column:
        folded = (F.octet_length(t) > F.length(t)) & reduce(or_, [t.contains(c) for c in "".join(_FOLDED.values())])
        words = F.regexp_extract_all(t, F.when(folded, _begun(pattern, _FOLDED)).otherwise(_begun(pattern, {})), F.lit(1))
        return F.concat(F.lit(_MARK), F.array_join(words, _MARK))

    return let(text, found)


def _told(words: Column, of: dict[str, int], order: list[int]) -> Column:
    """What the first of ``order`` that any word says is."""
    out = F.lit(None)
    for said in reversed(order):
        out = F.when(_any(words, *(head for head, says in of.items() if says == said)), said).otherwise(out)
    return out


def _any(words: Column, *heads: str) -> Column:
    return reduce(or_, [words.contains(_MARK + h) for h in heads])


def _map(of: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def _head(word: Column) -> Column:
    return F.left(F.lower(word), F.lit(4))


def _decided(words: Column) -> Column:
    """``struct(currency, unit, multiplier, confidence)`` from a text's words about units."""
    currencies = F.array(*[F.lit(code) for _, code in CURRENCIES])

    def numbers(w: Column) -> Column:
        base = w.rlike(f"{_MARK}dalam[^{_MARK}]*rupiah({_MARK}|$)")
        multiplier = _told(w, _MULTIPLIERS, [size for *_, size in UNITS]).cast("long")
        return F.struct(multiplier.alias("multiplier"), _told(w, _PLACES, list(range(len(CURRENCIES)))).cast("int").alias("place"), _any(w, "in", "dala", "disa", "expr").alias("introduced"), base.alias("base"))

    def told(n: Column) -> Column:
        multiplier = F.when(n["introduced"], n["multiplier"])
        confidence = F.when(multiplier.isNull() & n["base"], 0.9).when(multiplier.isNotNull(), 0.85).when(n["place"].isNotNull(), 0.7).otherwise(0.0)
        return F.struct(F.get(currencies, n["place"]).alias("currency"), unit_name(multiplier).alias("unit"), F.coalesce(multiplier, F.lit(1)).cast("long").alias("multiplier"), confidence.alias("confidence"))

    return let(let(F.lower(words), numbers), told)


def detect_unit(text: Column) -> Column:
    """``struct(currency, unit, multiplier, confidence)``; a unit word counts only where an introducing word stands."""
    return _decided(_words(text, _WORDS))


def stated_unit(text: Column, sure: float = 0.85) -> Column:
    """What a text says surely about units, as ``detect_unit`` has it: by its first phrase that states a unit or, if that says nothing, by the words of the whole text; else null."""

    def told(words: Column) -> Column:
        phrase = F.regexp_extract(words, f"(?iU){_MARK}({STATED})", 1)
        plain = let(_decided(words), lambda u: F.when(u["unit"].isNotNull() & (u["confidence"] >= sure), u))
        said = let(detect_unit(phrase), lambda u: F.when(u["unit"].isNotNull() | u["currency"].isNotNull(), u).otherwise(plain))
        return F.when(words != _MARK, F.when(phrase != "", said).otherwise(plain))

    return let(_words(text, _STATED_OR_WORDS), told)


def page_unit(text: Column) -> Column:
    """The page's own unit phrase in the first 3,000 characters: beside a currency before others, then the largest multiplier (1 without one)."""
    found = F.transform(F.regexp_extract_all(F.substring(text, 1, 3000), F.lit(f"(?iU){PAGE_UNIT}"), F.lit(0)), F.lower)
    stem = lambda m: _head(F.regexp_extract(F.regexp_replace(m, "(ribu|juta|miliar|triliun)an?", "$1"), _STEM, 1))
    money = lambda m: m.contains("rupiah") | m.contains("usd") | m.contains("dollar")
    scaled = F.transform(found, lambda m: F.struct(F.when(money(m), 2).otherwise(1).alias("priority"), F.coalesce(F.try_element_at(_map(_MULTIPLIERS), stem(m)), F.lit(1)).cast("long").alias("multiplier")))
    return F.coalesce(F.array_max(scaled)["multiplier"], F.lit(1).cast("long"))


def unit_name(multiplier: Column) -> Column:
    """The name of a multiplier, null for 1."""
    out = F.lit(None).cast("string")
    for _, name, size in UNITS:
        out = F.when(multiplier == size, name).otherwise(out)
    return out


def page_magnitudes(text: Column) -> Column:
    """The page's figures of 100 and more, without separators."""
    digits = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9][0-9.,]*"), F.lit(0)), lambda m: F.translate(m, ".,", "").try_cast("double"))
    return F.filter(digits, lambda v: v >= 100)


def upper_median(values: Column) -> Column:
    """The element at half the size of the sorted array (the upper one of two), null for none."""
    return let(F.array_sort(values), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")))


def checked_multiplier(text: Column, multiplier: Column) -> Column:
    """1 where the page's own figures contradict the stated unit."""
    wrong = let(upper_median(page_magnitudes(text)), lambda m: F.coalesce((m >= ALREADY_BASE) | (m * multiplier > MOST_SCALED), F.lit(False)))
    return F.when((multiplier > 1) & wrong, F.lit(1).cast("long")).otherwise(multiplier)


def scale_hint(largest: Column) -> Column:
    """The tolerance scale of a statement by its largest figure."""
    return F.when(largest >= 1e12, 1e6).when(largest >= 1e9, 1e3).otherwise(1.0)
