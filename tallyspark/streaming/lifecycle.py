"""The state machine of documents over a stream of events.

Each document has a state: its status, since when, and events that can't be applied yet. States are kept
by key in blocks of ``BLOCK`` neighbouring ids, as a call costs far more than a document's events do.
Events come in any order and more than once; they are applied in order of their time (then number) once
the watermark has passed them, each number once. A document that stays in flight for longer than
``limit`` goes back to be found anew, by an event-time timer, whether or not anything else happens to it.
The result doesn't depend on how events are dealt over batches, as long as none is later than ``delay``;
later ones are left out, as the watermark has it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.registry import IN_FLIGHT

NEW, LOST = "DISCOVERED", "timeout"
#: Which event leads from which status to which; any other event of a status changes nothing.
MOVES = {
    (NEW, "start"): "PROCESSING", ("PROCESSING", "extract"): "EXTRACTING", ("EXTRACTING", "validate"): "VALIDATING", ("VALIDATING", "finish"): "COMPLETED", ("VALIDATING", "doubt"): "REVIEW_REQUIRED",
    (NEW, "repeat"): "DUPLICATE", ("REVIEW_REQUIRED", "accept"): "COMPLETED", ("REVIEW_REQUIRED", "retry"): NEW, ("FAILED", "retry"): NEW, **{(s, "fail"): "FAILED" for s in IN_FLIGHT},
}
CHANGES = "document_id long, at_ms long, event string, status string"
#: Documents a block: as bits of the id. Ids far apart have blocks of their own.
BLOCK = 4
_STATE = "documents string"


def advance(status: str, since: int, events: list[tuple[int, int, str]], upto: int, limit: int) -> tuple[str, int, list[tuple[int, str, str]]]:
    """Status and since when after ``events`` (time, number, event; in order, none after ``upto``), and the changes on the way."""
    changes = []
    for at, _, event in [*events, (upto, 0, "")]:
        if status in IN_FLIGHT and at >= since + limit:
            status, since = NEW, since + limit
            changes.append((since, LOST, status))
        to = MOVES.get((status, event))
        if to:
            status, since = to, at
            changes.append((at, event, to))
    return status, since, changes


def lifecycle(events: DataFrame, delay: str = "1 hour", limit_ms: int = 3_600_000) -> DataFrame:
    """``document_id, at_ms, event, status`` of every change, from a stream ``document_id, event_id, ts, event``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {}  # document: status, since, and the waiting events by number
        if state.exists:
            for doc, status, since, waiting in json.loads(state.get[0]):
                held[doc] = status, since, {n: (at, n, e) for at, n, e in waiting}
        if not state.hasTimedOut:
            for b in batches:
                docs = [None] * len(b) if pd.isna(key[0]) else b["document_id"].tolist()
                for doc, n, at, e in zip(docs, b["event_id"].tolist(), b["at_ms"].tolist(), b["event"].tolist(), strict=True):
                    if doc not in held:
                        held[doc] = NEW, 0, {}
                    held[doc][2].setdefault(int(n), (int(at), int(n), e))
        now = state.getCurrentWatermarkMs()
        kept, timers, changes = [], [], []
        for doc, (status, since, waiting) in held.items():
            events = sorted(waiting.values())
            due = bisect_right(events, now, key=lambda x: x[0])
            rest = events[due:]
            status, since, own = advance(status, since, events[:due], now, limit_ms)
            kept.append((doc, status, since, rest))
            changes.extend((doc, *c) for c in own)
            if rest:
                timers.append(rest[0][0])
            if status in IN_FLIGHT:
                timers.append(since + limit_ms)
        state.update((json.dumps(kept, separators=(",", ":")),))
        if timers:
            state.setTimeoutTimestamp(max(now + 1, min(timers)))
        if changes:
            yield pd.DataFrame({n: pd.Series(c, dtype=t) for n, t, c in zip(("document_id", "at_ms", "event", "status"), ("Int64", "int64", "object", "object"), zip(*changes, strict=True), strict=True)})

    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.shiftright(F.col("document_id").cast("long"), BLOCK).alias("block"), "document_id", "event_id", ts.alias("ts"), F.unix_millis(ts).alias("at_ms"), "event")
    return rows.withWatermark("ts", delay).groupBy("block").applyInPandasWithState(run, CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
