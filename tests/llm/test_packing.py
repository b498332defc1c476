from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import packing


def brute(items, capacity):
    bins, out = [], []
    for size, s, c in items:
        fits = [b for b in bins if b["room"] >= size and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        b = min(fits, key=lambda b: (b["room"], b["since"]), default=None)
        if b is None:
            b = {"n": len(bins), "room": capacity, "s": set(), "c": set()}
            bins.append(b)
        out.append((b["n"], capacity - b["room"]))
        b["room"] -= size
        b["s"].add(s)
        b["c"].add(c)
        b["since"] = len(out)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(-1, 3), st.integers(-1, 6)), max_size=60))
def test_tightest_compatible_bin(items):
    items = sorted(items, reverse=True)
    where, offset = packing.best_fit(*([x[i] for x in items] for i in range(3)), capacity=20)
    assert list(zip(where, offset)) == brute(items, 20)


def check(rows, docs, capacity):
    bins, pieces = defaultdict(list), defaultdict(list)
    texts = {i: (t or "", s) for i, t, s in docs}
    for r in rows:
        bins[r.shard, r.bin].append(r)
        pieces[r.doc_id].append(r)
    for b in bins.values():
        b.sort(key=lambda r: (r.offset, r.n_words))
        assert sum(r.n_words for r in b) <= capacity
        assert all(x.offset + x.n_words == y.offset for x, y in zip(b, b[1:]))
        sources = [texts[r.doc_id][1] for r in b if texts[r.doc_id][1] is not None]
        assert len(sources) == len(set(sources)) and len({texts[r.doc_id][0] for r in b}) == len(b)
    assert set(pieces) == set(texts)
    for i, p in pieces.items():
        p.sort(key=lambda r: r.piece)
        assert [r.start_word for r in p] == [k * capacity for k in range(len(p))]
        assert sum(r.n_words for r in p) == len(texts[i][0].split())


def test_every_word_once_and_no_conflicts(spark):
    docs = [(i, " ".join(["w"] * (i * 37 % 90)) + f" {i % 25}" * (i % 3), f"s{i % 4}" if i % 5 else None) for i in range(300)]
    docs += [(1000, None, "s1"), (1001, "", None), (1002, "x " * 500, "hot"), (1003, "x " * 500, "hot"), (None, "null id", "s2"), (1004, "a " * 40, "s3")]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, shard int")
    check(packing.pack(frame, capacity=40, shard_rows=100).collect(), docs, 40)


def test_hot_source_and_copies(spark):
    docs = [(i, "same text", "hot") for i in range(200)] + [(200 + i, f"other {i}", f"s{i}") for i in range(100)]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), capacity=16, shard_rows=150).collect(), docs, 16)


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b", "x")] * 3, "doc_id long, text string, source string")
    assert len({(r.shard, r.bin) for r in packing.pack(frame).collect()}) == 3
    assert packing.pack(frame.limit(0)).count() == 0
