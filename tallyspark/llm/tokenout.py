"""Token ids as binary blocks under one canonical length-limited Huffman code.

1. Texts become ids (tokenizers library) and an end id each. Words that come again are
   encoded once: a plain text splits into the pieces of the tokenizer's own pre-tokenization, and
   the library encodes every distinct piece; texts with other than ASCII and Latin-1 letters go to
   the library whole. With ``special`` (as registered) the library's own setting stands: an added
   token's content in a text, like ``<|endoftext|>``, is that token's id, and such texts go to the
   library whole too. Without it they are text like any other.
2. The ids are sorted by ascending document id (range partitions) and cut into blocks of whole
   documents, about 65,536 ids each.
3. Counts over all ids (one number an id of the vocabulary) give code lengths of ``limit`` bits at
   most by package-merge, and canonical codes.
4. Every block is coded by itself. Its file record has the places of all documents and a bit offset
   every 64 ids, so a table-driven decoder starts anywhere and decodes all stretches side by side.

Files: ``<path>/code`` has the code lengths, ``<path>/blocks/part=P`` the blocks of the P-th range of
ids in order (Parquet as a container; the ``payload`` is the format below, little-endian):
``TKH1``, u32 documents, u32 ids, u32 ids between checkpoints, i64 document ids, u8 known flags,
u32 lengths, u64 bit offsets, code bits.

Defined results: null and empty texts have the end id only; rows with a null id come last; equal ids
keep their rows, ordered by their texts' hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import HashTable, id_bounds, mix64, parts, powers, range_of, shared_dir, spans_of, written

LIMIT = 16
BLOCK_IDS = 1 << 16
EVERY = 64
#: Characters that a task encodes at a time, and pieces that a worker remembers at most (the table has room for twice as many).
SPAN = 1_000_000
KEPT_PIECES = 2_000_000
#: Pieces of more characters are looked up by themselves instead of by their hashes.
LONG_PIECE = 64
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
#: Kinds of Latin-1 characters: 0 white space, 1 letter, 2 digit (a piece of its own), 3 other (runs).
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[c for c in range(256) if re.match(f"[{_LETTERS}]", chr(c))]] = 1
_KIND[48:58] = 2
_BASE = 0xA0761D6478BD642F
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pre-tokenizer's pieces in lower-case plain text (Latin-1 bytes).

    A run of letters, one digit, a run of other characters; an apostrophe that begins a piece takes
    s, t, m, d, re, ve or ll with it, and what letters follow are the next piece.
    """
    kind = np.r_[np.uint8(0), _KIND[data], np.zeros(4, np.uint8)]
    text = np.r_[np.uint8(0), data, np.zeros(4, np.uint8)]
    first = (kind != 0) & (kind == 2)
    first[1:] |= (kind[1:] != 0) & (kind[1:] != kind[:-1])
    at = np.flatnonzero(first & (text == ord("'")))
    at = at[kind[at + 1] == 1]
    one, two = text[at + 1], text[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    longer = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    for own, size in ((at[short], 2), (at[longer], 3)):
        first[own + 1] = False
        after = own + size
        first[after[kind[after] == 1]] = True
    begin = np.flatnonzero(first)
    over = (kind != 0) & np.r_[first[1:] | (kind[1:] == 0), True]
    return begin - 1, np.flatnonzero(over)


class _Words:
    """Numbers of pieces of text; the ids of number ``k`` are ``pool[starts[k] : starts[k + 1]]``.

    Pieces are told apart by 64-bit hashes (two of a million agree with probability 3e-8), long ones
    by themselves.
    """

    def __init__(self, tokenizer: str, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(tokenizer)
        added = [re.escape(t.content) for t in self.encode.get_added_tokens_decoder().values()] if special else []
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None  # any case: some match after normalization
        if not special:
            self.encode.encode_special_tokens = True
        vocabulary = self.encode.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.power, self.inverse = powers(SPAN + 1, _BASE)
        self.begin()

    def begin(self) -> None:
        self.known, self.long = HashTable(KEPT_PIECES), {}
        self.pool, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.encode.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Encodes new pieces, many in one call: the id that ends a piece says so. Their numbers."""
        ids = [self.library(" ".join(pieces[i : i + 4000])) for i in range(0, len(pieces), 4000)]
        flat = np.concatenate(ids)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer cuts words in another way")
        numbers = len(self.starts) - 1 + np.arange(len(pieces))
        self.starts = np.concatenate([self.starts, len(self.pool) + ends])
        self.pool = np.concatenate([self.pool, flat])
        return numbers

    def numbers(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Begins of the pieces of lower-case plain text, and their numbers."""
        data = np.frombuffer(text.encode("latin-1"), np.uint8)
        begin, end = pieces_of(data)
        if len(data) >= len(self.power):
            self.power, self.inverse = powers(len(data) + 1, _BASE)
        size = end - begin
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * self.power[: len(data)], dtype=np.uint64)])
            hashes = mix64((total[end] - total[begin]) * self.inverse[begin] + size.astype(np.uint64))
        hashes[hashes == 0] = 1
        out = self.known.find(hashes)
        longer = size > LONG_PIECE
        new = np.flatnonzero((out < 0) & ~longer)
        if len(new):
            fresh, at, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            own = self.learn([text[begin[i] : end[i]] for i in new[at]])
            self.known.add(fresh, own)
            out[new] = own[back]
        for i in np.flatnonzero(longer):
            piece = text[begin[i] : end[i]]
            if piece not in self.long:
                self.long[piece] = int(self.learn([piece])[0])
            out[i] = self.long[piece]
        return begin, out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if self.known.size + len(self.long) > KEPT_PIECES // 2:
            self.begin()
        odd = {i: self.library(t) for i, t in enumerate(texts) if not (t.isascii() or _PLAIN.fullmatch(t)) or (self.added and self.added.search(t))}
        plain = ["" if i in odd else t for i, t in enumerate(texts)]
        begin, flat = self.numbers(" ".join(plain).lower())
        size = self.starts[flat + 1] - self.starts[flat]
        ends = np.cumsum(size)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[flat] - ends + size, size)]
        pieces = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in plain]))
        upto = np.r_[0, ends][pieces]
        sizes = np.diff(np.r_[0, upto])
        if odd:
            cut = np.split(ids, upto[:-1])
            ids = np.concatenate([odd.get(i, own) for i, own in enumerate(cut)])
            sizes[list(odd)] = [len(x) for x in odd.values()]
        return ids, sizes


@lru_cache(maxsize=2)
def _words(tokenizer: str, special: bool) -> _Words:
    """One a worker process, with what it has met in earlier tasks."""
    return _Words(tokenizer, special)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """``__id, __hash, __low, __high``: each row's ids with the end id, as the little-endian 16-bit halves (``__high`` empty where it is all 0); no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(tokenizer, special)
        for batch in batches:
            texts = batch["__text"].tolist()
            for i, j in spans_of([len(t) for t in texts], SPAN):
                ids, sizes = words.ids(texts[i:j])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                low, high = (ids & np.uint32(0xFFFF)).astype("<u2").tobytes(), (ids >> np.uint32(16)).astype("<u2")
                upto = (2 * np.cumsum(sizes + 1)).tolist()
                cuts = list(zip([0, *upto], upto, strict=False))
                halves = [high.tobytes()[a:b] for a, b in cuts] if high.any() else [b""] * (j - i)
                yield pd.DataFrame({"__id": batch["__id"].iloc[i:j].astype("Int64"), "__hash": batch["__hash"].iloc[i:j], "__low": [low[a:b] for a, b in cuts], "__high": halves})

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    return rows.mapInPandas(run, "__id long, __hash long, __low binary, __high binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The best code's length for each id (0 for ids that don't occur) among codes of ``limit`` bits at most: package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf, merged = [np.ones(len(weights), bool)], weights
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        leaf.append(at < len(weights))
    take, found = 2 * len(weights) - 2, np.zeros(len(weights) + 1, np.int64)
    for level in reversed(leaf):
        leaves = int(level[:take].sum())
        found[leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(found[::-1])[::-1][1:]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length and then id, each left-aligned in 32 bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = np.uint64(1) << (np.uint64(32) - lengths[order].astype(np.uint64))
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (np.cumsum(width) - width).astype(np.uint32)
    return codes


def encode_block(docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    # Codes are left-aligned; shifted to their place in two 32-bit words, whose bits never meet, they add up.
    begin = ends - width
    placed = codes[ids].astype(np.uint64) << np.uint64(32) >> (begin & 31).astype(np.uint64)
    word = begin >> 5
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(ids) else np.zeros(0, np.int64)
    pairs = np.add.reduceat(placed, first) if len(ids) else np.zeros(0, np.uint64)
    stream = np.zeros(len(pairs) + 1, np.uint32)
    stream[:-1] = pairs >> np.uint64(32)
    stream[1:] |= (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    stream = stream.astype(">u4").view(np.uint8)[: -(-int(ends[-1]) // 8) if len(ids) else 0]
    head = np.array([len(docs), len(ids), EVERY], "<u4").tobytes()
    return b"".join([b"TKH1", head, docs.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), (ends - width)[::EVERY].astype("<u8").tobytes(), stream.tobytes()])


class Decoder:
    """A table with one entry for every bit string as long as the longest code."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.limit = int(max(1, lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        reach = np.left_shift(1, self.limit - lengths[order].astype(np.int64))
        self.ids, self.lengths = (np.concatenate([np.repeat(x, reach), np.zeros((1 << self.limit) - reach.sum(), np.int64)]) for x in (order, lengths[order].astype(np.int64)))

    def block(self, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, known flags, lengths and all ids of one block."""
        if payload[:4] != b"TKH1":
            raise ValueError("not a block of token ids")
        n_docs, n_ids, every = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
        at, out = 16, []
        for kind, n in (("<i8", n_docs), ("<u1", n_docs), ("<u4", n_docs), ("<u8", -(-n_ids // every))):
            out.append(np.frombuffer(payload, kind, n, at))
            at += n * np.dtype(kind).itemsize
        docs, known, sizes, checkpoints = out
        data = np.frombuffer(payload + b"\0\0\0\0", np.uint8, offset=at).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        ids = np.zeros((len(checkpoints), every), np.int64)
        place, last = checkpoints.astype(np.int64), len(window) - 1
        for step in range(min(every, n_ids)):
            peek = (window[np.minimum(place >> 3, last)] >> (32 - self.limit - (place & 7)).astype(np.uint32)) & np.uint32((1 << self.limit) - 1)
            ids[:, step] = self.ids[peek]
            place += self.lengths[peek]
        return docs, known.astype(bool), sizes, ids.ravel()[:n_ids]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> None:
    """Writes all texts' ids under ``path``."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        part, block, start, inside = -1, 0, 0, 0
        for batch in batches:
            known = batch["__id"].notna()
            for own, doc, has, low, high in zip(batch["__range"], batch["__id"].fillna(0), known, batch["__low"], batch["__high"], strict=True):
                n = len(low) // 2
                if held and (own != part or inside + n > BLOCK_IDS):
                    yield raw(part, block, start, inside, held)
                    start, block, held, inside = start + inside, block + 1, [], 0
                if own != part:
                    part, block, start = own, 0, 0
                held.append((doc, has, n, low, high))
                inside += n
        if held:
            yield raw(part, block, start, inside, held)

    def raw(part: int, block: int, start: int, n: int, held: list[tuple]) -> pd.DataFrame:
        docs, known, sizes, low, high = zip(*held, strict=True)
        upper = b"".join(h or bytes(2 * k) for k, h in zip(sizes, high, strict=True)) if any(high) else b""
        return pd.DataFrame([(part, block, start, n, np.array(docs, "<i8").tobytes(), bytes(known), np.array(sizes, "<u4").tobytes(), b"".join(low), upper)], columns=list(_RAW))

    # Ranges of the ids by their quantiles: a range partitioner would tokenize everything once more to draw its sample.
    n = parts(spark)
    bounds = id_bounds(docs, id_col, n)
    rows = tokenize(docs, tokenizer, end_id, id_col, text_col, special).withColumn("__range", range_of(F.col("__id"), bounds))
    rows = rows.repartitionById(n, "__range").sortWithinPartitions("__range", F.col("__id").asc_nulls_last(), "__hash").select("__range", "__id", "__low", "__high")
    blocks = written(rows.mapInPandas(cut, ", ".join(f"{k} {v}" for k, v in _RAW.items())), "tokens")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for low, high in zip(batch["low"], batch["high"], strict=True):
                more = np.bincount(_ids(low, high), minlength=len(total))
                more[: len(total)] += total
                total = more
        yield pd.DataFrame({"id": np.flatnonzero(total), "n": total[total > 0]})

    counts = blocks.select("low", "high").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row an id of the vocabulary at most
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    lengths = code_lengths(total, max(limit, int(np.ceil(np.log2(max(2, len(counts)))))))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{path}/code")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = _ids(row.low, row.high)
                payload = encode_block(np.frombuffer(row.docs, "<i8"), np.frombuffer(row.known, np.uint8), np.frombuffer(row.sizes, "<u4"), ids, lengths, codes)
                yield pd.DataFrame([(row.part, row.block, row.start, row.n, payload)], columns=["part", "block", "start", "n", "payload"])

    coded = blocks.mapInPandas(encode, "part int, block int, start long, n long, payload binary")
    coded.sortWithinPartitions("part", "block").write.option("compression", "uncompressed").partitionBy("part").parquet(f"{path}/blocks")


_RAW = {"part": "int", "block": "int", "start": "long", "n": "long", "docs": "binary", "known": "binary", "sizes": "binary", "low": "binary", "high": "binary"}


def _ids(low: bytes, high: bytes) -> np.ndarray:
    ids = np.frombuffer(low, "<u2").astype(np.int64)
    return ids | (np.frombuffer(high, "<u2").astype(np.int64) << 16) if high else ids


def read_tokens(spark: SparkSession, path: str, each: Callable[[np.ndarray], object], kind: str) -> DataFrame:
    """``doc_id, start, n_tokens, value``: for each document of the files, ``value = each(ids)`` of SQL type ``kind``.

    ``start`` counts the ids of all documents before: those of earlier ranges (one number a range,
    broadcast), of earlier blocks (in the record) and of the block.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()[0], np.uint8)
    blocks = spark.read.schema("block int, start long, n long, payload binary, part int").parquet(f"{path}/blocks")
    totals = [(r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()]
    before, bases = 0, []
    for part, n in totals:
        bases.append((part, before))
        before += n
    rows = blocks.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select((F.col("base") + F.col("start")).alias("at"), "payload")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(lengths)
        for batch in batches:
            for at, payload in zip(batch["at"], batch["payload"], strict=True):
                docs, known, sizes, ids = decoder.block(payload)
                ends = np.cumsum(sizes.astype(np.int64))
                values = [each(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="Int64").where(known), "start": at + ends - sizes, "n_tokens": sizes.astype(np.int64), "value": values})

    return rows.mapInPandas(decode, f"doc_id long, start long, n_tokens long, value {kind}")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_and_check(docs: DataFrame, tokenizer: str, end_id: int, special: bool = False) -> DataFrame:
    """Writes ``docs`` to the shared folder and answers from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    path = shared_dir(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id, special=special)
    return read_tokens(docs.sparkSession, path, crc32, "long").withColumnRenamed("value", "ids_crc32")
