import random

import corpus_pipeline
import test_minhash
import test_pii
import test_toxicity
from tallyspark.llm import toxicity


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage's rows follow from its predecessor's by plain Python; toxicity by the scores of single texts."""
    rng = random.Random(2)
    rows = [(i, t, y) for i, t, y in test_toxicity.corpus(240)]
    clean = [t for _, t, y in rows if not y]
    texts = [t for _, t, _ in rows] + [clean[i % 9] for i in range(20)] + [clean[i] + " more" for i in range(8)] + [None, "", clean[3] + " mail a@b.c now", "card 4929348385146306 " + "w " * 5000]
    docs = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, frame = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    seen = [{r.doc_id: r for r in frame.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf)
        if name == "packing":
            packed = out.collect()
            break
        assert out.columns == frame.columns, name
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in frame.collect()})
    start, calm, single, far, bare = seen
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(calm) == {i for i, r in start.items() if model.scores([r.text])[0] < 0.7} and len(calm) < len(start)
    last = {}
    for i, r in calm.items():
        last[r.text or ""] = max(i, last.get(r.text or "", -1))
    assert set(single) == set(last.values()) and len(single) < len(calm)
    assert set(far) == {i for i, _, _, kept in test_minhash.brute([(i, r.text) for i, r in sorted(single.items())]) if kept} and len(far) < len(single)
    assert set(bare) == set(far)
    for i, r in bare.items():
        assert r.n_chars == (None if r.text is None else len(r.text)) and not test_pii.brute(r.text)
        assert test_pii.brute(far[i].text) or r.text == far[i].text
    words = {}
    for p in packed:
        words[p.doc_id] = words.get(p.doc_id, 0) + p.n_words
    assert words == {i: len((r.text or "").split()) for i, r in bare.items()}


def test_stages_take_odd_rows_and_columns(spark, tmp_path):
    """Repeated and null ids, null and empty texts, columns that clash, and tables without rows."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " more", "b"), (None, "null id", None), (None, None, None), (4, "", "c"), (5, "mail a@b.cd", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id string, __text string, __spans string, score double, node string, key string, kept string"
    full = lambda rows: spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z", 0.5, "n", "k", "q") for i, t, s in rows], schema)
    for name, own in (("odd", rows), ("empty", [])):
        sf = str(tmp_path / name)
        full(own).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        frame = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, frame, sf)
            if stage == "packing":
                packed = out.collect()
                break
            assert out.columns == frame.columns, stage
            out.write.parquet(f"{sf}/{k}")
            frame = spark.read.parquet(f"{sf}/{k}")
        left = sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
        if name == "empty":
            assert left == [] and packed == []
        else:
            assert {(r["__id"], r["__text"], r["__spans"], r.score, r.node, r.key, r.kept) for r in frame.collect()} == {("x", "y", "z", 0.5, "n", "k", "q")}
            assert left == sorted([(1, text), (1, text), (None, "null id"), (4, ""), (5, "mail [EMAIL]")], key=str)
