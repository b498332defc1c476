import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import hardnegatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score double"


def brute(rows, anchors):
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 2**14 for x in v)]
    lengths = [len(v) for _, _, v in kept]
    usual = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    kept = [r for r in kept if len(r[2]) == usual]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in kept if anchors(i)}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in kept]
        positives = sorted((s, j) for s, j, other in scored if other == label and j != i)[:5]
        for ps, p in positives:
            near = sorted((s, j) for s, j, other in scored if other != label and 80 * -ps <= 100 * -s <= 100 * -ps)[:5]
            out += [(i, p, rank, n, -ps, -s) for rank, (s, n) in enumerate(near, 1)]
    return sorted(out)


def check(spark, rows, every=10):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in hardnegatives.mine(df, F.col("id") % every == 0).collect())
    assert got == brute(rows, lambda i: i % every == 0)
    return got


def made(n, seed, width=8, spread=0.25):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centre)], rng.choice([0, 0, 1, 2])) for i in range(n)]


def test_rows_are_those_of_brute_force(spark):
    assert len(check(spark, made(900, 1))) > 500


def test_blocks_stretches_and_shards(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK", 8 * 3)
    monkeypatch.setattr(hardnegatives, "SHARD", 8 * 40)
    monkeypatch.setattr(hardnegatives, "STRETCH", 7)
    check(spark, made(400, 2))


def test_ties_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.5]) for _ in range(4)], rng.choice([0, 1])) for i in range(200)]
    rows += rows[:12] + [(20, [0.25] * 4, 1), (30, [0.0] * 4, 0), (31, [0.0] * 4, 1), (32, [0.0] * 4, 0)]
    rows += [(40, None, 1), (50, [], 1), (60, [None] * 4, 1), (70, [float("nan")] * 4, 0), (80, [float("-inf")] * 4, 0), (90, [1e20] * 4, 0), (100, [0.5] * 3, 0), (None, [0.5] * 4, 0), (110, [0.5] * 4, None)]
    check(spark, rows)


def test_large_components_are_exact(spark):
    rows = [(i, [float((i * 37 + k * 11) % 16000) + 0.5 for k in range(4)], i % 2) for i in range(60)]
    check(spark, rows)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hardnegatives.mine(empty, F.col("id") % 10 == 0).collect() == []
    check(spark, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 1)])  # no anchor
    check(spark, [(0, [0.5, 0.5], 0), (2, [0.5, 0.5], 1)])  # no positive


def test_a_walk_ends_early():
    rng = np.random.default_rng(3)
    rows = np.concatenate([np.floor(rng.normal(0, 5, (200, 16)) + 100), np.floor(rng.normal(0, 5, (20_000, 16)) - 100)])
    members = np.floor(rng.normal(0, 3, (4, 16)) + 100)
    walked = []
    tops = [hardnegatives._Top(5) for _ in members]

    def take(m, at, scores):
        walked.append(len(at))
        tops[m].add(at, scores)
        return tops[m].least

    hardnegatives.SharedList(members, rows, np.sqrt((rows**2).sum(axis=1))).walk(members, rows, take)
    assert sum(walked) < 4 * 3000
    for m, top in zip(members, tops, strict=True):
        assert sorted(top.scores) == sorted(np.sort(rows @ m)[-5:])
