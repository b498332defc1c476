import random
import zlib

import numpy as np

from tallyspark.llm import toxicity as tox


def corpus(n, seed=3):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "it", "was"]
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(rng.randint(5, 260))]
        bad = int(rng.random() < 0.3)
        if bad:
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = rng.choice(["zorkface", "quibwad"]) + rng.choice(["", "ish", "er"])
        rows.append((i, " ".join(words), bad))
    return rows


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = tox.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    features, codes = rng.normal(size=(6, tox.FEATURES)), rng.integers(0, 5, (3, 7))
    mask = (np.arange(7) < np.array([7, 4, 0])[:, None]).astype(np.float64)
    slope = rng.normal(size=3)
    keep = {}
    net.forward(net.project(features), codes, mask, keep)
    grads = net.backward(features, codes, mask, keep, slope)
    for k, g in grads.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            old, d = net.p[k][at], 1e-4
            net.p[k][at] = old + d
            up = net.forward(net.project(features), codes, mask) @ slope
            net.p[k][at] = old - d
            down = net.forward(net.project(features), codes, mask) @ slope
            net.p[k][at] = old
            assert abs((up - down) / (2 * d) - g[at]) < 2e-3 * max(1, abs(g[at])), k


def test_windows_overlap_and_cover_every_word():
    for n in [0, 1, 48, 63, 64, 65, 112, 113, 1000]:
        win = tox.windows([n])
        assert set().union(*(range(s, s + k) for _, s, k in win)) == set(range(n)) and all(k <= tox.WINDOW for *_, k in win)
        assert all(a[1] + a[2] > b[1] for a, b in zip(win, win[1:]))


def test_held_out_accuracy_and_edge_rows(spark):
    rows = corpus(400)
    extra = [(1000, None), (1001, ""), (1002, "clean " * 3000 + "zorkface quibwad zorkfaceish quibwader"), (1003, "x" * 50_000), (None, "the of and")]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, "s") for i, t in extra] + [(5, rows[5][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, rows[5][2]), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = tox.judge(docs, labels).collect()
    assert len(out) == len(rows) + len(extra) + 1
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r for r in out}
    held = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.93 and by[1002].predicted == 1 and by[1001].predicted == 0


def test_labels_of_held_out_rows_and_one_label(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _, _ in rows], "doc_id long, toxic int")
    assert tox.fit(docs, labels) is None and {r.score for r in tox.judge(docs, labels).collect()} == {0.0}
    assert tox.keep_clean(docs, labels).columns == ["doc_id", "text"] and tox.keep_clean(docs, labels).count() == 60
    none = docs.limit(0)
    assert tox.judge(none, labels.limit(0)).count() == 0


def test_chunks_score_like_single_texts():
    rows = corpus(120)
    model = tox.train([t for _, t, _ in rows], [y for *_, y in rows])
    texts = [t for _, t, _ in rows][:30] + [None, ""]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-5)


def test_long_runs_count_whole():
    rng = random.Random(5)
    for n in [1, 60, 61, 79, 80, 81, 100, 101, 1000]:
        run = "".join(rng.choice("abcdefghij") for _ in range(n))
        pieces = tox.words_of(f"x {run} y")[1:-1]
        assert all(len(p) <= tox.PIECE for p in pieces) if n > tox.PIECE else pieces == [run]
        assert all(any(run[i : i + tox.SHARED] in p for p in pieces) for i in range(max(1, n - tox.SHARED + 1)))
    cut, whole = (set(tox._ngrams([w])[1]) for w in ("ab" * 30, "ab" * 30 + "cdefghi"))
    assert len(whole) > len(cut)


def test_toxic_part_beyond_character_60():
    rows = corpus(400)
    model = tox.train([t for _, t, _ in rows], [y for *_, y in rows])
    rng = random.Random(8)
    filler, around = "".join(rng.choice("aeioulnrst") for _ in range(400)), "the of and to in it was " * 3
    for n in (60, 75, 90):
        for tail in ("", filler[:30]):
            clean, bad = model.scores([f"{around}{filler[:n]}{part}{tail} {around}" for part in ("", "zorkfacequibwadzorkfaceishquibwader")])
            assert clean < 0.01 and bad > clean + 0.05


def test_columns_of_clashing_names_stay(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t, i, 0.5, "v", "w") for i, t, _ in rows], "doc_id long, text string, n_chars long, score double, __text string, __score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = tox.keep_clean(docs, labels)
    assert out.columns == docs.columns and {(r.score, r["__text"], r["__score"]) for r in out.collect()} == {(0.5, "v", "w")}


def test_one_rule_for_runs_of_all_lengths():
    for n in (1, 8, 12, 13, 16, 17, 59, 60, 61, 62, 500):
        run = "".join(chr(97 + k % 26) for k in range(n))
        pieces = tox.words_of(run)
        assert max(map(len, pieces)) <= tox.PIECE and pieces[0] + "".join(p[tox.SHARED :] for p in pieces[1:]) == run
