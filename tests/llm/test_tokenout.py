import heapq
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import tokenout

FILE = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aB's'llÉéßçÿ×÷İΣς́ \n\t\x0b\x1c\x1f\x85\xa0 　1²½.,'<|>x-中日"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_words_encode_like_the_library(texts):
    words = test_words_encode_like_the_library.__dict__.setdefault("words", tokenout._Words(FILE))
    whole = words.encode
    ids, sizes = words.ids(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=2, max_size=60))
def test_code_is_complete_and_best(counts):
    counts = np.array(counts)
    wide = tokenout.code_lengths(counts, 40)
    if (counts > 0).sum() > 1:
        assert (counts * wide).sum() == huffman_cost(counts)
    tight = tokenout.code_lengths(counts, 6)
    used = tight[tight > 0]
    assert used.max(initial=0) <= 6 and (len(used) < 2 or sum(2.0 ** -used.astype(float)) == 1) and ((tight > 0) == (counts > 0)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=200), min_size=1, max_size=8))
def test_block_round_trip(docs):
    ids = np.concatenate([np.array(d) for d in docs])
    lengths = tokenout.code_lengths(np.bincount(ids), 16)
    payload = tokenout.encode_block(np.arange(len(docs)), np.ones(len(docs)), np.array([len(d) for d in docs]), ids, lengths, tokenout.canonical_codes(lengths))
    got = tokenout.Decoder(lengths).block(payload)
    assert got[3].tolist() == ids.tolist() and got[2].tolist() == [len(d) for d in docs]


def test_files_match_the_library(spark):
    texts = ["The Quick, brown fox's 123", "", None, "été Straße <|endoftext|> x", "z" * 5000, "word " * 30_000, "The Quick, brown fox's 123"]
    rows = [(7 * i % 5, t, 1) for i, t in enumerate(texts)] + [(None, "null", 1)]
    got = tokenout.write_and_check(spark.createDataFrame(rows, "doc_id long, text string, start int"), FILE, 2).collect()
    want = sorted((i is None, i or 0, len(library(t)), zlib.crc32(np.array(library(t), "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got if r.doc_id is not None)) + [None]


def test_empty_table(spark):
    assert tokenout.write_and_check(spark.createDataFrame([], "doc_id long, text string"), FILE, 2).count() == 0


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>The<|endoftext|><|endoftext|>", "<|EndOfText|> x", "<| endoftext |>", "<|endoftext|", "中 <|endoftext|>", "é<|endoftext|>é", "plain words"]


def test_added_tokens_encode_like_the_unchanged_library():
    whole, words = Tokenizer.from_file(FILE), tokenout._Words(FILE, special=True)
    ids, sizes = words.ids(SPECIAL)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    assert 49407 in ids and 49406 in ids


def test_query_answers_like_the_unchanged_library(spark, tmp_path):
    from tallyspark.llm import queries

    spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(FILE)
    want = [whole.encode(t, add_special_tokens=False).ids + [2] for t in SPECIAL]
    starts = np.cumsum([0, *map(len, want)]).tolist()
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_ids(spark, str(tmp_path)).collect())
    assert got == [(i, starts[i], len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)]
