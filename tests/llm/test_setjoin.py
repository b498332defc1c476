import random
import re

import numpy as np

from tallyspark.llm import minhash, setjoin


def sets_of(rows):
    out = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split("[ \t-\r]+", lower) if x]
        out.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    return out


def brute(rows):
    """Component and set size of every row by all pairs of different texts."""
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, node string, key int").repartition(3)
    assert sorted((tuple(r) for r in setjoin.similar_documents(docs).collect()), key=str) == brute(rows)


def edited(words, rng, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(70)]
    rows, at = [], 0
    for size in [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 25, 40, 60, 90, 150, 400]:
        base = [rng.choice(words) for _ in range(size)]
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1):
            rows.append((at, " ".join(edited(base, rng, share) if share else base)))
            rows.append((at + 1, " ".join(base + [rng.choice(words) for _ in range(int(size * share * 2))])))
            at += 2
        rows.append((at, " ".join(base + passage)))
        at += 1
    return rows


def test_components_are_those_of_brute_force(spark):
    rows = corpus()
    rng = random.Random(2)
    rows += [(9000, None), (9001, ""), (9002, " \t\r\n\x0b"), (9003, "A b"), (9004, "a  B\n"), (None, "a b"), (None, None), (9003, rows[200][1]), (9005, "à é"), (9006, "À é")]
    rows += [(9100, " ".join(f"x{rng.randrange(50)}" for _ in range(6000)))]
    check(spark, rows)


def test_a_large_group_and_blocks(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HOT_BLOCKS", 4)
    base = [f"w{i}" for i in range(70)]
    rows = [(i, " ".join(edited(base, rng, 0.03))) for i in range(150)]
    check(spark, rows)


def test_everything_hot_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_BLOCKS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    check(spark, corpus(5))


def test_empty_table(spark):
    assert setjoin.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_linked_sets_share_a_key():
    """Pairs of all sizes just at the threshold, with the differences dealt in every way."""
    rng = np.random.default_rng(3)
    some = 0
    for _ in range(3000):
        both = int(np.exp(rng.uniform(np.log(5), np.log(700))))
        apart = int(both * 100 // 85) - both  # the most differences that leave a link
        left = int(rng.integers(0, apart + 1))
        items = np.unique(rng.integers(0, 1 << 63, both + apart, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        a, b = np.sort(np.r_[items[:both], items[both : both + left]]), np.sort(np.r_[items[:both], items[both + left :]])
        if np.array_equal(a, b):
            continue
        x, y = setjoin.keys_of([a, b])
        assert len(np.intersect1d(x, y)), (len(a), len(b), both)
        assert setjoin.may_link(*(np.frombuffer(setjoin.parities(s), "<u8")[None] for s in (a, b)), np.array([len(a)]), np.array([len(b)]))[0]
        some += 1
    assert some > 2500


def test_sets_with_a_passage_in_common_share_few_keys():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[passage, rng.integers(0, 1 << 63, 200, dtype=np.uint64)]) for _ in range(200)]
    keys = setjoin.keys_of(sets)
    assert sum(map(len, keys)) < 0.6 * sum(map(len, sets))  # fewer keys than items
    met = np.unique(np.concatenate([np.unique(k) for k in keys]), return_counts=True)[1]
    assert (met * (met - 1) // 2).sum() < 0.1 * len(sets) ** 2 / 2


def test_ranges_settle_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "SETTLED", 50)
    monkeypatch.setattr(setjoin, "RANGE", 300)
    rng = random.Random(6)
    hot = [rng.randrange(1 << 64) for _ in range(4)]
    nodes = {n: sorted({rng.randrange(1 << 64) for _ in range(20)} | {hot[0], rng.choice(hot[1:])}) for n in range(400)}
    rows = [(n, bytearray(np.array(k, np.uint64).tobytes())) for n, k in nodes.items()] * 2
    rng.shuffle(rows)
    got = setjoin.shared_keys(spark.createDataFrame(rows, "__node long, __keys binary").repartition(5)).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, set()).add(r.node)
    want = {}
    for n, keys in nodes.items():
        for k in keys:
            want.setdefault(k, set()).add(n)
    assert sorted(map(sorted, by_key.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert len(got) == sum(map(len, by_key.values()))
