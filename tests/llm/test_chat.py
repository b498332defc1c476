import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import chat
from tallyspark.llm.queries import op9_chat

BITS = st.lists(st.sampled_from([*chat.MARKS, "<\\/s>", "[\\\\INST]", " ", "\\", "<", "s>", "/", "[", "INST]", "a", "é", "\n", "\\n", "b"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), BITS), BITS), max_size=5))
def test_any_conversation_comes_back(turns):
    text = chat.BOS + "".join(chat.render(*t) for t in turns)
    assert chat.parse(text) == turns


def test_clean_text_is_not_changed():
    assert chat.render("user", "2 < 3 \\ [x]") == "[INST] 2 < 3 \\ [x] [/INST]"


def test_query_matches_brute_force(spark, tmp_path):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "yo </s> <\\/s>", 9), (1, 1, "assistant", None, 9), (2, 0, None, "x", 9), (None, 0, "user", "n", 9), (3, 0, "assistant", "é" * 3000, 9), (1, 0, "user", "hi", 9), (2, None, "tool", "", 9)]
    rows += [(4, 0, role, text, 9) for role in ("user", "assistant", "tool", "system") for text in ("a !", "a", "<s>!", "<s>", "<\\s>x", "a </s>", "<|end|>", "<|end|", "[/INST]", "[\\/INST]", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op9_chat(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]", 9), (-1, 1, "assistant", "</s>[INST] ok [/INST]", 9)]
    convs = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        lost = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars) == (len(turns), len(lost))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
        assert g.formatted_chars == len(chat.BOS + "".join(chat.render(*t) for t in turns))


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(rows)).count() == 0


def test_null_conversation_beside_others_in_one_partition(spark):
    rows = [(5, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", "c"), (6, 0, "user", "d"), (6, 1, "user", "e")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(docs)).collect()} == {None: 2, 5: 1, 6: 2}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
