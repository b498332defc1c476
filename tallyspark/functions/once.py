"""Values that an expression names several times, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``: however often the body names the value, the optimizer copies none of what makes it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(pattern: str, letter: str = ".", first: str = "") -> str:
    """The expression, for ``regexp_extract_all`` (group 1), of all tokens of a pattern in one pass, also overlapping ones: what it matches from each place on, in order.

    ``letter``: what character a token begins with, tried by itself before anything else; ``first``: a cheap
    pattern that holds wherever a token begins. The token's own is tried only where both hold.
    """
    return f"(?s){letter}(?<={first and f'(?={first})'}(?=({pattern})).)"
