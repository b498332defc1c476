import datetime
import random

from tallyspark.streaming import lifecycle as life

LIMIT, DELAY = 600_000, 300  # ms and s


def fold(events, upto):
    """Every change by a plain walk over each document's events, once each, in order."""
    out = []
    for doc in {e[0] for e in events}:
        own = sorted({(at, n, e) for d, n, at, e in events if d == doc})
        status, since = life.NEW, 0
        for at, _, e in [x for x in own if x[0] <= upto] + [(upto, 0, "")]:
            if status in life.IN_FLIGHT and at - since >= LIMIT:
                since += LIMIT
                status = life.NEW
                out.append((doc, since, life.LOST, status))
            if (status, e) in life.MOVES:
                status, since = life.MOVES[status, e], at
                out.append((doc, at, e, status))
    return sorted(out)


def test_changes_equal_a_plain_fold(spark, tmp_path):
    rng = random.Random(9)
    names = sorted({e for _, e in life.MOVES})
    steps, events = ("start", "extract", "validate", "finish"), []
    for n in range(900):
        at = n * 11 + rng.randrange(11)
        events.append((rng.randrange(40), n, at * 1000, rng.choice(steps) if rng.random() < 0.7 else rng.choice(names)))
    late = 10_000_000
    # Out of order by less than the delay, and many of them twice.
    arriving = sorted(events, key=lambda e: e[2] + rng.randrange(DELAY * 900))
    arriving = [e for k, e in enumerate(arriving) for _ in range(1 + (k % 5 == 0))] + [(99, 9999, late + DELAY * 1000, "none")]
    schema, source = "document_id long, event_id long, ts timestamp, event string", str(tmp_path / "in")
    row = lambda e: (e[0], e[1], datetime.datetime.fromtimestamp(e[2] / 1000, datetime.UTC), e[3])
    parts = [arriving[k : k + 300] for k in range(0, len(arriving), 300)]
    found, stream = [], None
    for part in parts:
        spark.createDataFrame([row(e) for e in part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        changes = life.lifecycle(stream, f"{DELAY} seconds", LIMIT)
        query = changes.writeStream.foreachBatch(lambda batch, _: found.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    want = fold(events, late)
    assert sorted(found) == want and len(want) > 100 and sum(c[2] == life.LOST for c in want) > 5


def test_neighbouring_documents_share_a_state(spark, tmp_path):
    """Few states for many documents (a call each was what F4's time went to), and the fold's changes for null, negative and far ids."""
    rng = random.Random(4)
    steps, names = ("start", "extract", "validate", "finish"), sorted({e for _, e in life.MOVES})
    far = [None, -1, -2, -17, 2**60 + 1, 2**60 + 2, -(2**62) - 1]
    docs = [*range(640), *far]
    rows = [(docs[n % len(docs)], n, n * 400 + rng.randrange(400), rng.choice(steps) if rng.random() < 0.8 else rng.choice(names)) for n in range(len(docs) * 8)]
    late = rows[-1][2] + 10_000_000
    end = [(639, 10**6, late + DELAY * 1000, "none")]
    schema, source = "document_id long, event_id long, ts timestamp, event string", str(tmp_path / "in")
    found, states = [], 0
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :] + rows[-40:] + end):
        times = [(d, n, datetime.datetime.fromtimestamp(at / 1000, datetime.UTC), e) for d, n, at, e in part]
        spark.createDataFrame(times, schema).coalesce(1).write.mode("append").parquet(source)
        changes = life.lifecycle(spark.readStream.schema(schema).parquet(source), f"{DELAY} seconds", LIMIT)
        query = changes.writeStream.foreachBatch(lambda batch, _: found.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        states = max(states, *(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    assert states <= 640 // 16 + len(far)
    number = lambda rows: sorted((10**19 if r[0] is None else r[0], *r[1:]) for r in rows)
    want = number(fold([(10**19 if d is None else d, n, at, e) for d, n, at, e in rows], late))
    assert number(found) == want and len({c[0] for c in want} & {10**19, -1, -17, 2**60 + 1, -(2**62) - 1}) > 2
