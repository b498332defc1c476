import hashlib
import math
import random

import numpy as np
import pytest

from tallyspark.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, error string, codes string"


def brute(rows, parts=16, entries=64, rounds=2):
    """``(id, code, error)`` of every kept row and the final books, one part at a time in plain Python."""
    sound = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in r[1])]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(sound[0][1]) // parts
    kept = [(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]], r[2]) for r in sound if len(r[1]) == len(sound[0][1])]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[nearest(v, p)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, chosen[p], strict=True) if c == j]
                if own:
                    books[p][j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = []
    for i, v, label in kept:
        best = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label))
    return out, ",".join(str(x) for b in books for e in b for x in e)


def check(spark, rows):
    got = vectorcodes.report(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    want, books = brute(rows)
    total = {}
    for _, _, error, label in want:
        total[label] = total.get(label, 0) + error
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=key) == sorted(((i, c, e, total[label]) for i, c, e, label in want), key=key)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(books.encode()).hexdigest()}


def test_codes_are_those_of_brute_force(spark):
    rng = random.Random(3)
    centre = [[rng.gauss(0, 0.4) for _ in range(32)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centre)], rng.choice([0, 1, 1, 1, None])) for i in range(700)]
    check(spark, rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(16)], i % 3) for i in range(90)]  # many ties, equal parts
    rows += [(7, rows[0][1], 1), (7, rows[1][1], None), (None, rows[2][1], None), (None, [0.1] * 16, 2)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] * 16, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] * 16, 1), (205, [1e30] * 16, 1), (206, [0.5] * 15, 1)]
    check(spark, rows)


def test_few_rows_and_none(spark):
    check(spark, [(5, [float(k) for k in range(48)], None)])
    assert vectorcodes.report(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.report(spark.createDataFrame([(1, [0.5] * 17, 1, "", "")], SCHEMA))


def test_cells_keep_what_can_be_nearest_and_little_else():
    rng = np.random.default_rng(1)
    entries = rng.integers(-120, 120, (64, 4))
    points = rng.integers(-130, 130, (20_000, 4))
    cells = vectorcodes.Cells(entries)
    code, error = cells.nearest(points)
    far = ((points[:, None, :] - entries) ** 2).sum(axis=2)
    assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    assert cells.size.mean() < 40  # of 64
    again = cells.nearest(points[::-1])
    assert (again[0][::-1] == code).all()


def test_cells_beyond_what_is_remembered(monkeypatch):
    monkeypatch.setattr(vectorcodes, "CELLS", 16)
    rng = np.random.default_rng(2)
    entries, points = rng.integers(-900, 900, (10, 3)), rng.integers(-900, 900, (500, 3))
    cells = vectorcodes.Cells(entries)
    for part in np.array_split(points, 7):
        far = ((part[:, None, :] - entries) ** 2).sum(axis=2)
        assert (cells.nearest(part)[0] == far.argmin(axis=1)).all()


def test_restored_vectors_are_the_entries(spark):
    rows = [(i, [i / 100 + k / 10 for k in range(16)], 0) for i in range(40)]
    codes, books = vectorcodes.compress(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    for r in vectorcodes.restore(codes, books).collect():
        assert r["vector"] == [int(books[p, c].item()) for p, c in enumerate(r["codes"])]
