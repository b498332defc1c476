"""Chat formatting with a grammar round trip.

    conversation := BOS turn*
    turn         := "[INST] " text " [/INST]"          user
                  | " " text " </s>"                   assistant
                  | "<<SYS>> " text " <</SYS>>"        system
                  | "<|turn|> " role "\\n" text " <|end|>"   any other role
The marks are control strings; no mark holds a space and every text stands between spaces, so a text
and its surroundings never form a mark together. A turn is rendered, reparsed by the grammar and
compared with its source; where they differ (a text holds a mark, or something that reads as an
escaped one) its content is escaped, one backslash after the first character of each mark (one more
where backslashes are there already), and compared again, until they are identical.

Turns are rendered row by row, so one conversation may hold any share of the rows; only the readers'
digests run along a conversation, in sorted order with constant memory.

Defined results: null text is empty; a null role is the empty role; rows with one conversation and
turn are ordered by role and text; a null conversation id is a conversation of its own; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import parts

BOS = "<s>"
OPEN = {"user": "[INST] ", "assistant": " ", "system": "<<SYS>> "}
CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
OTHER = ("<|turn|> ", " <|end|>")
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>")
_ANY = "|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in MARKS)
_TURN = re.compile("(?P<user>\\[INST\\] )|(?P<system><<SYS>> )|(?P<other><\\|turn\\|> )|(?P<assistant> )")


def escape(text: str) -> str:
    return re.sub(_ANY, lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(_ANY, lambda m: m[0][0] + m[0][1:].removeprefix("\\"), text)


def _put(role: str, text: str) -> str:
    if role in OPEN:
        return OPEN[role] + text + CLOSE[role]
    return OTHER[0] + role + "\n" + text + OTHER[1]


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int] | None:
    """The role, the text and the end of the turn that begins at ``at``, or None if none does."""
    begin = _TURN.match(rendered, at)
    if not begin:
        return None
    kind = begin.lastgroup
    close = OTHER[1] if kind == "other" else CLOSE[kind]
    stop = rendered.find(close, begin.end())
    inside = rendered[begin.end() : stop]
    if stop < 0 or any(m in inside for m in MARKS):
        return None
    if kind == "other":
        role, line, inside = inside.partition("\n")
        if not line:
            return None
        return unescape(role).replace("\\n", "\n").replace("\\b", "\\"), unescape(inside), stop + len(close)
    return kind, unescape(inside), stop + len(close)


def render(role: str | None, text: str | None) -> str:
    """One turn; its reparse is the source."""
    role, text = role or "", text or ""
    name = role if role in OPEN else role.replace("\\", "\\b").replace("\n", "\\n")
    for form in (lambda t: t, escape):
        out = _put(form(name) if role not in OPEN else name, form(text))
        if parse_turn(out) == (role, text, len(out)):
            return out
    raise ValueError(f"no rendering of this turn comes back: {role!r}")


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a whole rendered conversation."""
    if not rendered.startswith(BOS):
        raise ValueError("a conversation begins with " + BOS)
    at, turns = len(BOS), []
    while at < len(rendered):
        found = parse_turn(rendered, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append(found[:2])
        at = found[2]
    return turns


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, rendered, loss_start, loss_stop``: each turn's part of the formatted text.

    A conversation's text is ``<s>`` and its parts in order. The loss mask covers ``[loss_start,
    loss_stop)`` of a part: an assistant's (escaped) text, nothing for other roles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["rendered"] = [render(r, t) for r, t in zip(b["role"], b["text"], strict=True)]
            lost = (b["role"] == "assistant").astype("int64")
            b["loss_start"] = lost * len(OPEN["assistant"])
            b["loss_stop"] = lost * (b["rendered"].str.len() - len(CLOSE["assistant"]))
            yield b[["conv_id", "turn", "role", "rendered", "loss_start", "loss_stop"]]

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "conv_id long, turn long, role string, rendered string, loss_start long, loss_stop long")


def _source_text() -> Column:
    """The unescaped text of ``rendered`` behind what turns of one role begin with: the order of turns that agree in all else."""
    close = F.lit(len(OTHER[1]))
    for role, mark in CLOSE.items():
        close = F.when(F.col("role") == role, len(mark)).otherwise(close)
    text = F.left("rendered", F.length("rendered") - close)
    for first in {m[0] for m in MARKS}:
        rest = "|".join(re.escape(m[1:]) for m in MARKS if m[0] == first)
        text = F.regexp_replace(text, rf"{re.escape(first)}\\(\\*(?:{rest}))", f"{first}$1")
    return text


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation from the formatted parts alone: counts and digests of what a parser recovers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []

        def close() -> None:
            if state:
                out.append((None if now is pd.NA else now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, rendered, start, stop in zip(b["conv_id"].astype("Int64"), b["rendered"], b["loss_start"], b["loss_stop"], strict=True):
                if state is None or (conv is not now if conv is pd.NA or now is pd.NA else conv != now):
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), len(BOS)]
                role, text, end = parse_turn(rendered) or ("", "", -1)
                if end != len(rendered):
                    raise ValueError(f"conversation {conv} doesn't parse")
                lost = unescape(rendered[start:stop])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                state[2] += len(lost)
                state[3].update(lost.encode("utf-8", "replace"))
                state[4] += len(rendered)
            yield table_of(out)
            out.clear()
        close()
        yield table_of(out)

    def table_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    n = parts(formatted.sparkSession)
    rows = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", _source_text())
    return rows.select("conv_id", "rendered", "loss_start", "loss_stop").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
