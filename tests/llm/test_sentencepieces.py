import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import sentencepieces as sp

FILE = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("abcdeointhrs  \n.,'▁éü中😀\x00\t-_()"), max_size=40), st.text(st.characters(exclude_categories=["Cs"]), max_size=12)), max_size=6))
def test_encodes_and_decodes_like_the_library(texts):
    known = sp.pieces(FILE)
    ids, sizes = known.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]) if texts else []):
        assert own.tolist() == LIBRARY.encode(text), text
        assert known.decode(own.tolist()) == LIBRARY.decode(own.tolist()) == text.replace(sp.MARK, " ")


def test_unigram_search_is_best():
    model = sp.Pieces(FILE)
    model.bpe = False
    model.ids = {"a": 300, "b": 301, "ab": 302, "aba": 303, "▁": 304, "▁a": 305}
    model.score = {300: -2.0, 301: -2.5, 302: -3.0, 303: -3.9, 304: -1.0, 305: -2.2}
    model.longest = 3
    words = sorted({"▁" + "".join(w) for n in range(7) for w in __import__("itertools").product("ab", repeat=n)})
    model.learn(words)

    def best(word):
        return max(((model.score[model.ids[word[:k]]] + best(word[k:])[0], [model.ids[word[:k]], *best(word[k:])[1]]) for k in range(1, 4) if word[:k] in model.ids and len(word) >= k), default=(0.0, [])) if word else (0.0, [])

    for w in words:
        k = model.number[w]
        got = model.pool[model.starts[k] : model.starts[k + 1]]
        assert abs(sum(model.score[i] for i in got) - best(w)[0]) < 1e-9


def test_rows(spark):
    texts = [None, "", "Hello  world\n", " lead", "é中😀", "x" * 20_000, "word " * 20_000, "Hello  world\n", "a▁b"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 1)], "doc_id long, text string, ids int")
    encoded = sp.encode(docs, FILE)
    out = {r.doc_id: r for r in sp.round_trips(encoded, FILE).collect()}
    for i, t in enumerate(texts):
        want = LIBRARY.encode(t or "")
        assert (out[i].n_tokens, out[i].ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert out[i].round_trip == ("▁" not in (t or ""))
    assert {r.doc_id: r.decoded for r in sp.decode(encoded, FILE).collect()}[2] == texts[2] and None in out
    assert sp.round_trips(sp.encode(docs.limit(0), FILE), FILE).count() == 0
