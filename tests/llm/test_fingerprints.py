import hashlib
import random

import numpy as np

from tallyspark.llm import fingerprints as fp
from tallyspark.llm.common import mix64


def names_of(text):
    """All names of levels one and up of one text."""
    names, out = mix64(np.array([ord(c) for c in text], np.uint64) + fp._STEP), set()
    while not out or len(names) > 1:
        names, _ = fp.parse_level(names, np.zeros(len(names), np.int32))
        out |= set(names.tolist())
    return out


def pairs():
    """Texts of 40 to 160 characters with one character changed, added or cut."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(40))[: rng.randint(40, 160)]
        at = rng.randrange(len(text))
        yield text, rng.choice([text[:at] + "#" + text[at + 1 :], text + "x", text[:-1]])


def test_short_texts_are_like_their_edits():
    a, b = zip(*pairs())
    got = fp.likeness(fp.sketches(list(a)), fp.sketches(list(b)))
    want = np.array([len(x & y) / len(x | y) for x, y in ((names_of(p), names_of(q)) for p, q in zip(a, b))])
    assert abs(got - want).max() < 0.2 and abs(np.mean(got - want)) < 0.01 and np.mean(got) > 0.6 and got.min() > 0.2


def test_sketch_depends_on_its_text_alone():
    texts = ["", "a", "aaaa", "ab", "short one", "somewhat longer than that one", "long " * 30 + "and other words", "".join(map(str, range(3000)))]
    assert (fp.sketches(texts) == np.concatenate([fp.sketches([t]) for t in texts])).all()
    assert (fp.likeness(fp.sketches(texts), fp.sketches(texts[:5] + texts[:3])) == 1).tolist()[:5] == [True] * 5


def brute_parse(text):
    """All phrase names of one text, symbol by symbol, as the docstring tells it."""
    m64 = (1 << 64) - 1
    mix = lambda x: int(mix64(np.array([x & m64], np.uint64))[0])
    step, run_, level = int(fp._STEP), int(fp._RUN), int(fp._LEVEL)
    names, found = [mix(ord(c) + step) for c in text], set()
    while names:
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix(x ^ (n * run_ & m64)) for x, n in runs]
        labels = names
        for _ in range(3):
            out = []
            for i, x in enumerate(labels):
                d = (x ^ labels[i - 1]) if i else 0
                d = d or 1
                z = (d & -d).bit_length() - 1
                out.append(2 * z + (x >> z & 1))
            labels = out
        n = len(labels)
        cuts = [i for i in range(n) if i == 0 or (labels[i] > labels[i - 1] and i + 1 < n and labels[i] > labels[i + 1])]
        phrases = [names[a:b] for a, b in zip(cuts, [*cuts[1:], n])]
        names = [mix(sum(mix(x + (k + 1) * step) for k, x in enumerate(p)) + len(p) * level) for p in phrases]
        found |= set(names)
        if len(names) == 1:
            break
    return sorted({mix(x ^ level) >> 32 for x in found})


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    least = sorted(set(a[:64]) | set(b[:64]))[:64]
    return len([x for x in least if x in a[:64] and x in b[:64]]) / len(least)


def test_query_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 12)))
    texts = [None, "", "a", "ab", "aaaa" * 9, "日本" * 30, "x y", "".join(word() for _ in range(700))] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[20], texts[21], ""]
    rows = [(10 * i - 5, t, 1, "k") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, fingerprint string").repartition(3)
    got = {r.doc_id: r for r in fp.edit_likeness(docs).collect()}
    order = sorted(((i, t or "") for i, t, _, _ in rows), reverse=True)
    assert set(got) == {i for i, _ in order} and len(order) == len(rows)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        a, b, c, r = brute_parse(t), brute_parse(changed), brute_parse(after), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in a[:64]) and r.edited_fingerprint == "".join(f"{x:08x}" for x in b[:64])
        assert abs(r.near_edited - brute_likeness(a, b)) < 1e-9 and abs(r.near_next - brute_likeness(a, c)) < 1e-9


def test_shared_substring_shares_names_at_any_offset():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = text(3000)
    a, b = set(brute_parse(text(17) + common)), set(brute_parse(text(400) + common))
    assert len(a & b) > 0.8 * len(a)


def test_odd_rows(spark):
    rows = [(None, "null id", "x"), (1, "one", "y"), (1, "two", "z"), (1, "one", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next string")
    assert sorted((r.doc_id is None, r.n_chars) for r in fp.edit_likeness(docs).collect()) == [(False, 3)] * 3 + [(True, 7)]
    single = fp.edit_likeness(docs.where("doc_id IS NULL")).first()
    assert single.near_next == 1.0 and fp.edit_likeness(docs.limit(0)).count() == 0
