import hashlib

import pytest

from tallyspark.llm import exactdedup

ROWS = [(5, "a"), (1, "a"), (2, "b"), (3, None), (4, ""), (9, "a "), (None, "a"), (None, "q"), (7, "é" * 5000), (8, "é" * 5000), (2, "b")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), keep == i, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, "substring(sha2(__text, 256), 1, 1)", "'x'"])
@pytest.mark.parametrize("files", [None, 1])
def test_matches_brute_force_even_with_collisions(spark, digest, files):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, keep_id int, __n string").repartition(3)
    got = sorted((tuple(r) for r in exactdedup.classify(docs, digest=digest, batches=files or 2).collect()), key=str)
    assert got == brute(ROWS)


@pytest.mark.parametrize("digest", [None, "substring(sha2(__text, 256), 1, 1)", "'x'"])
def test_later_calls_meet_the_state_of_earlier_ones(spark, tmp_path, digest):
    # Rows of earlier calls with larger and with smaller ids, collisions found in one call and met in the next.
    calls = [[(5, "a"), (1, "b"), (2, None)], [], [(9, "a"), (3, "b"), (4, "c"), (None, "c")], [(6, ""), (7, "a"), (8, "d"), (9, "a")]]
    seen = []
    for rows in calls:
        seen += rows
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((tuple(r) for r in exactdedup.classify(docs, digest=digest, state_dir=str(tmp_path / "state")).collect()), key=str)
        so_far = brute(seen)
        want = [next(r for r in so_far if r[0] == i and r[4] == hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
        assert got == sorted(want, key=str)


def test_a_failed_call_is_repeated(spark, tmp_path, monkeypatch):
    state, schema = str(tmp_path / "state"), "doc_id long, text string"
    exactdedup.classify(spark.createDataFrame([(1, "a")], schema), state_dir=state)
    again = spark.createDataFrame([(2, "a"), (3, "b")], schema)
    with monkeypatch.context() as broken:
        broken.setattr(exactdedup, "written", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            exactdedup.classify(again, state_dir=state)
    got = exactdedup.classify(again, state_dir=state).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got] == [(2, 2, 2), (3, 3, 1)]


def test_large_group_is_salted_whole(spark):
    rows = [(i, "same") for i in range(12_000)] + [(20_000 + i, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exactdedup.classify(docs)
    assert out.where("group_size = 12000 AND keep_id = 11999").count() == 12_000 and out.where("kept").count() == 51


def test_deduplicate_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "doc_id long, text string, kept string")
    assert sorted(tuple(r) for r in exactdedup.deduplicate(docs).collect()) == [(2, "a", "y"), (3, None, "z")]


def test_empty_table(spark):
    assert exactdedup.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_later_call_opens_only_files_that_hold_hits(spark, tmp_path, monkeypatch):
    folder, opened, plain = str(tmp_path / "state"), [], exactdedup._contents
    schema = "doc_id long, text string"
    for call in range(3):
        exactdedup.classify(spark.createDataFrame([(call * 100 + i, f"text {call} {i}") for i in range(40)], schema).repartition(4), state_dir=folder).collect()

    def counted(spark, folder, met):
        out = plain(spark, folder, met)
        opened.append(sorted(f.rpartition("/content/")[2] for f in out.inputFiles() if "/content/" in f))
        return out

    monkeypatch.setattr(exactdedup, "_contents", counted)
    got = exactdedup.classify(spark.createDataFrame([(900, "text 1 7"), (901, "new"), (902, "text 1 7")], schema), state_dir=folder).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(900, 902, 3, False), (901, 901, 1, True), (902, 902, 3, True)}
    assert len(opened) == 1 and len(opened[0]) == 1 and opened[0][0].startswith("call-1/part-")  # one of twelve files
