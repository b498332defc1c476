import random
import re

import numpy as np

from tallyspark.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        comp = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), comp, comp == doc))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 9, 30, 80, 300]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) + rng.choice(["", " ", "\n"]))
    common = [word() for _ in range(60)]
    rows += [" ".join(common + [word() for _ in range(rng.randint(0, 60))]) for _ in range(60)]
    rows += [None, "", " \t\n", "one", "ONE", "one two three four", "One  two\tthree four", "one two three four five", "x " * 20_000, "y" * 30_000, "a\xa0b c d e"]
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return out + [(3, rows[3]), (4, "another text under the id four here"), (None, rows[7]), (None, "only null ids have this one text")]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, size int, node string").repartition(3)
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_blocks_of_large_buckets_lose_nothing(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        copy = list(base)
        for k in rng.sample(range(40), 2):
            copy[k] = f"z{i}x{k}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_rare_shingles_lose_nothing(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "HOT_BLOCKS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "ROUNDS", ())  # all links are found by rare shingles
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_texts_that_share_a_passage_only_do_not_meet_by_rare_shingles(spark):
    sets, rng = [], np.random.default_rng(4)
    passage = rng.integers(0, 1 << 62, 60).astype("<i8")
    for _ in range(300):
        sets.append(np.r_[passage, rng.integers(0, 1 << 62, 40).astype("<i8")])
    sets.append(np.r_[sets[7][:-10], rng.integers(0, 1 << 62, 10).astype("<i8")])
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, items binary")
    met = minhash.shared_rows(minhash.rare_buckets(frame.select("node"), frame)).collect()
    assert {r.node for r in met} == {7, 300} and len({r.key for r in met}) == 16  # 26 rarest ones, 10 of them in one set alone


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for n, share in [(2000, 0.9), (2000, 0.75), (500, 0.5), (40, 0.75)]:
        errors = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64) * 2
            a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64) * 2]) for _ in "ab")
            r = minhash.registers([a, b])
            errors.append(minhash.estimate(r[0], r[1], len(a), len(b)) - len(both) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.04


def test_deduplicate_and_empty_table(spark):
    text = "a b c d e f g h i j k l m n o p q r s t"
    docs = spark.createDataFrame([(2, text, "x"), (1, text + " u", "y"), (3, None, "z"), (None, text, "n"), (4, "other words", "w")], "doc_id long, text string, kept string")
    assert sorted(r.kept for r in minhash.deduplicate(docs).collect()) == ["w", "y", "z"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicate_with_repeated_and_null_ids(spark):
    text, far = "a b c d e f g h i j k l m n o p q r s t", "quite other words that are like nothing else in here"
    rows = [(3, text, "first"), (7, far, "unique"), (7, text + " u", "near"), (3, text, "repeated"), (None, "null ids " + far + " x y z w v", "one null"), (None, "null ids " + far + " x y z w v q", "two null")]
    got = sorted(r.tag for r in minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect())
    assert len(got) == 4 and {"first", "repeated", "unique"} < set(got)


def test_star_tries_few_pairs_of_a_large_group(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        copy = list(base)
        for k in rng.sample(range(120), 2):
            copy[k] = f"z{i}x{k}"
        rows.append((i, " ".join(copy)))
    counts, plain = [], minhash._hopeful
    monkeypatch.setattr(minhash, "_hopeful", lambda pairs, nodes: counts.append(pairs.count()) or plain(pairs, nodes))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0} and sum(counts) < 6 * len(rows)


def test_blocks_go_by_the_components_after_the_hot_stage(spark, monkeypatch):
    """A hot bucket joins an ordinary bucket's largest component to one with a smaller name; its classes still are the largest there."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "HOT_BLOCKS", 3)
    new = lambda: np.sort(rng.integers(0, 1 << 62, 60).astype("<i8"))
    sets = {n: new() for n in [*range(1, 20), *range(100, 143)]}
    sets[1] = np.sort(np.r_[sets[100][:58], new()[:2]])  # links 1 and 100
    nodes = spark.createDataFrame([(n, None, 0, len(s), bytes(256), b"") for n, s in sets.items()], "node long, class_id long, hash long, n long, regs binary, small binary")
    frame = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, items binary")
    ordinary, hot = [(7, n) for n in range(100, 143)], [(8, n) for n in [*range(1, 20), 100]]
    shared = spark.createDataFrame(ordinary + hot, "key long, node long")
    grouping = minhash.Grouping(nodes, frame, lambda pairs: pairs)
    grouping.labels = spark.createDataFrame([(n, 100 if 100 <= n < 140 else n) for n in sets], "node long, comp long")
    met, plain = [], minhash.across
    monkeypatch.setattr(minhash, "across", lambda rows, labels, nodes, mixed, of, nearest: met.append(mixed.collect()) or plain(rows, labels, nodes, mixed, of, nearest))
    near = lambda rows: lambda i, j, key: (np.arange(len(i)), i + j)
    labels = {r.node: r.comp for r in grouping.finish(shared, near, near).collect()}
    assert labels[120] == labels[1] == 1 and labels[141] == 141
    last = {r.key: r for r in met[-1]}
    assert set(last) == {7} and (last[7].main, last[7].others, last[7].mains) == (1, 1, 10)
