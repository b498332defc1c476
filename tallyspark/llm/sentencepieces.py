"""SentencePiece encoding and decoding by a Viterbi search that shares work between common prefixes.

A text is marked (``▁`` before it and for every space) and cut before each run of marks: no piece goes
on from another character into a mark, so marked words are encoded apart. Where no piece of the
vocabulary has letters and other characters together, words are cut between those as well. A batch's distinct words
are sorted, which is their trie in depth-first order: forward states of the prefix that a word shares
with the one before stay on the stack, and only its own rest is searched.

Unigram models: a prefix's state is the best sum of scores and the last piece of that path. BPE models
(merges in order of score) are searched exactly as well: a path is the model's output if and only if
each two neighbours are what the merges make of the two pieces' text, so a transition scores 0 where
that holds and minus infinity where not, and just one path survives for every prefix. Whether two
pieces may stand together is found by merging their text once and then remembered.

Characters without a piece become byte pieces (or the unknown piece). Words met before in a task are
looked up; what is remembered is bounded. A map over the rows: no shuffle.

Defined results: null and empty texts have no ids and decode to the empty text; a literal ``▁`` is a
space, as in the format itself; repeated rows and null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import spans_of

MARK = "▁"
KEPT_WORDS = 700_000
KEPT_PAIRS = 700_000
CHARS = 4_000_000
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Finer cuts, between letters and anything else, for vocabularies in which no piece has both.
_UNITS = regex.compile(rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+")


class Pieces:
    """A model's vocabulary with what encoding has found out so far."""

    def __init__(self, file: str, kind: str = "bpe") -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.bpe = kind == "bpe"
        self.unknown = model.unk_id()
        self.text = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.score = [model.get_score(i) for i in range(model.vocab_size())]
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.ids), default=1)
        self.cut = _UNITS if all(_UNITS.fullmatch(p) for p in self.ids) else _WORDS
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(model.vocab_size()) if model.is_byte(i)}
        of_byte = {i: b for b, i in self.bytes.items()}
        self.shown = [chr(of_byte[i]) if of_byte.get(i, 128) < 128 else "" if model.is_control(i) else " ⁇ " if model.is_unknown(i) else t.replace(MARK, " ") for i, t in enumerate(self.text)]
        self.high = {i: bytes([b]) for i, b in of_byte.items() if b >= 128}
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, tuple | None] = {}
        self.begin()

    def begin(self) -> None:
        self.number: dict[str, int] = {}
        self.pool: list[int] = []
        self.starts: list[int] = [0]
        self.arrays = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merges(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """The merges of a piece's own text, best score first and leftmost among equals: their scores, and the
        outermost symbols on the left and on the right before each and after the last; None if they don't make the piece."""
        if piece not in self.steps:
            parts, scores = list(self.text[piece]), []
            lefts, rights = [parts[0]], [parts[-1]]
            while True:
                best, at = -np.inf, -1
                for i in range(len(parts) - 1):
                    found = self.ids.get(parts[i] + parts[i + 1])
                    if found is not None and self.score[found] > best:
                        best, at = self.score[found], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                lefts.append(parts[0])
                rights.append(parts[-1])
            self.steps[piece] = (scores, lefts, rights) if len(parts) == 1 else None
        return self.steps[piece]

    def together(self, left: int, right: int) -> bool:
        """Whether the merges of two neighbours' text leave both as they are: none across the border comes first."""
        key = left << 24 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(self.merges(left), self.merges(right))
        return found

    def _apart(self, a: tuple | None, b: tuple | None) -> bool:
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            across = self.ids.get(a[2][i] + b[1][j])
            inner_a = a[0][i] if i < len(a[0]) else None
            inner_b = b[0][j] if j < len(b[0]) else None
            if across is not None:
                score = self.score[across]
                if (inner_a is None or score > inner_a) and (inner_b is None or score >= inner_b):
                    return False
            if inner_a is None and inner_b is None:
                return True
            if inner_b is None or (inner_a is not None and inner_a >= inner_b):
                i += 1
            else:
                j += 1

    def learn(self, words: list[str]) -> None:
        """Encodes words in sorted order; the stack holds a state for every prefix of the word before.

        A state is (start of the last piece, its id or -1 for a character without one, score).
        """
        stack: list[tuple[int, int, float]] = [(0, -2, 0.0)]
        before, ids, longest = "", self.ids, self.longest
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del stack[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best = None
                for start in range(max(0, end - longest), end):
                    piece = ids.get(word[start:end])
                    if piece is None:
                        continue
                    last = stack[start]
                    if self.bpe:
                        if last[1] < 0 or self.together(last[1], piece):
                            best = (start, piece, 0.0)
                            break
                    elif best is None or last[2] + self.score[piece] > best[2]:
                        best = (start, piece, last[2] + self.score[piece])
                if best is None or (not self.bpe and word[end - 1] not in ids and stack[end - 1][2] - 1e6 > best[2]):
                    best = (end - 1, -1, stack[end - 1][2] - 1e6)
                stack.append(best)
            before = word
            path, end = [], len(word)
            while end > 0:
                start, piece, _ = stack[end]
                if piece >= 0:
                    path.append(piece)
                elif self.bytes:
                    path += [self.bytes[b] for b in reversed(word[start:end].encode("utf-8", "replace"))]
                elif not path or path[-1] != self.unknown:
                    path.append(self.unknown)
                end = start
            self.pool += reversed(path)
            self.number[word] = len(self.starts) - 1
            self.starts.append(len(self.pool))
        old, at = self.arrays
        self.arrays = np.concatenate([old, np.array(self.pool[len(old) :], np.int32)]), np.concatenate([at, np.array(self.starts[len(at) :], np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and how many each text has."""
        if len(self.number) > KEPT_WORDS:
            self.begin()
        split = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        flat = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(flat < 0)
        if len(new):
            unknown = [words[k] for k in new]
            self.learn(sorted(set(unknown)))
            flat[new] = [self.number[w] for w in unknown]
        pool, starts = self.arrays
        size = starts[flat + 1] - starts[flat]
        ends = np.cumsum(size)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[flat] - ends + size, size)]
        upto = np.r_[0, ends][np.cumsum([len(own) for own in split], dtype=np.int64)]
        return ids, np.diff(np.r_[0, upto])

    def decode(self, ids: list[int]) -> str:
        shown, high = self.shown, self.high
        if high.keys().isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
        else:
            out, run = [], b""
            for i in ids:
                if i in high:
                    run += high[i]
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = b""
                out.append(shown[i])
            text = "".join([*out, run.decode("utf-8", "replace")])
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(file: str, kind: str = "bpe") -> Pieces:
    """One model a worker process, with what it has learnt from earlier tasks."""
    return Pieces(file, kind)


def encode(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, ids`` of every row; ``ids`` is an array of int, ``text`` the text that was encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model, kind)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in spans_of([len(t) for t in texts], CHARS):
                ids, sizes = known.encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=[id_col, "text", "ids"])

    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, text string, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` of every row; null ids count as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pieces(model)
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "decoded": [known.decode(list(ids)) if ids is not None else "" for ids in batch["__ids"]]})

    rows = encoded.select(F.col(id_col).alias(id_col), F.col(ids_col).alias("__ids"))
    return rows.mapInPandas(run, f"{id_col} {dict(rows.dtypes)[id_col]}, decoded string")


def round_trips(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids_crc32, decoded_chars, round_trip`` of every row that ``encode`` gave: ids decoded and held against the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in batches:
            lists, out = batch.column(2), []
            values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            for text, a, b in zip(batch.column(1).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                text_again = known.decode(values[a:b].tolist())
                out.append((int(b - a), zlib.crc32(values[a:b].astype("<u4").tobytes()), len(text_again), text_again == text))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_tokens", "ids_crc32", "decoded_chars", "round_trip"])

    return encoded.select(id_col, "text", "ids").mapInArrow(run, f"{id_col} {dict(encoded.dtypes)[id_col]}, n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")
