"""N-gram Jaccard join by partitions of the universe.

1. A text's set: the distinct runs of four lower-cased words, as 64-bit hashes. Texts with equal sets
   form one class; everything after works on one set a class.
2. Size bands: a band's sizes reach from its first to 4/3 of it. A pair belongs to the band of its
   smaller set; a set takes part in its own band and, if it is small enough to be the larger one of a
   pair there, in the band below. Linked sets of a band differ in at most ``h`` items (of both), by the
   band's largest sizes.
3. Each band cuts the universe of items by hash into ``h + 1`` segments. The differences of a linked
   pair lie in some of them, so there is a segment from which on, going round, the first ``k``
   segments hold less than ``k`` differences, for every ``k`` (the pigeonhole principle's chain form):
   in it the sets have the same subset, and in the next one subsets that differ by one item at most.
4. What is indexed, by cost: a segment's subset of two and more items is a key by itself. One of fewer
   items would be shared by many unrelated sets, which costs more pairs than keys: it goes together
   with the next segment's subset and its one-deletion neighbourhood (the subset without each of its
   items in turn). Both sets of a pair see the same subset, so they choose alike, and no link is lost.
5. Keys are put together by ranges, as packed arrays, in one shuffle; a range keeps keys of one set in
   memory and sends on those of several (also a key of very many sets, which isn't held).
6. Within a key's bucket one class of each component meets a leader (a star, no pairs); what still
   holds several components is compared in blocks, buckets of very many components after they are
   dealt anew by the rarest items of full sets (``minhash.Grouping``). Before a pair is verified, it
   must pass exact bounds: sizes, and the number of differing bits of 1,024 parities (each item flips
   one), which no pair exceeds by more than it has differences.
7. Every link is verified on full sets: 100 * |intersection| >= 85 * |union|.

Nothing here is drawn or estimated: all links between sets are found, but for 64-bit hashes of items
and sets that collide. Defined results: null, empty or white-space texts have an empty set and are
linked with nothing; fewer than four words are one item; rows with equal ids are nodes of their own by
text; a null id never is a component's smallest unless all of its ids are null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import mix64, parts, spans_of, written
from tallyspark.llm.minhash import Grouping, best_row, full_sets, member_rows, set_name, shingle_sets

WORDS, SIMILAR = 4, 85
#: A band's largest size is this many times its smallest (numerator, denominator).
WIDE = (4, 3)
PARITIES = 1024
#: Subsets of fewer items go together with the next segment.
ALONE = 2
CHARS = 1_000_000
#: Keys a range has on average, and that are settled at a time.
RANGE, SETTLED = 1_000_000, 4_000_000
#: A range's own bits of a key.
_BITS = 40


def first_sizes(most: int) -> np.ndarray:
    """The bands' smallest sizes, up to the one that holds ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * WIDE[0] // WIDE[1] + 1)
    return np.array(out, np.int64)


def bands_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each set's own band and segments there, then whether it takes part in the band below and the segments there."""
    first = first_sizes(int(sizes.max(initial=1)))
    largest = first[1:] - 1  # of the smaller set of a pair
    partner = largest * 100 // SIMILAR  # of the larger one
    segments = (100 - SIMILAR) * (largest + partner) // (100 + SIMILAR) + 1
    own = np.searchsorted(first, sizes, side="right") - 1
    below = np.maximum(own - 1, 0)
    return own, segments[own], (own > 0) & (sizes <= partner[below]), segments[below]


def _subset(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The name of a subset from the sum of its items' hashes and their number."""
    return mix64(mix64(total) + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _band_keys(items: np.ndarray, owner: np.ndarray, band: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets in one band each, and the set that each key is of; ``owner`` numbers the sets of ``items`` from 0 on."""
    base = np.cumsum(segments) - segments
    m = segments.astype(np.uint64)
    salt = mix64(band.astype(np.uint64) + np.uint64(0x51ED270B))
    place = mix64(items ^ salt[owner]) >> np.uint64(32)
    at = base[owner] + ((place * m[owner]) >> np.uint64(32)).astype(np.int64)
    own = mix64(items + np.uint64(0xD6E8FEB86659FD93))
    n = int(segments.sum())
    low, high = (np.bincount(at, part.astype(np.float64), n).astype(np.uint64) for part in (own & np.uint64(0xFFFFFFFF), own >> np.uint64(32)))
    total = (high << np.uint64(32)) + low
    count = np.bincount(at, minlength=n)
    of = np.repeat(np.arange(len(segments)), segments)
    number = np.arange(n) - base[of]
    key = mix64(_subset(total, count) + mix64(salt[of] + number.astype(np.uint64)))
    alone = count >= ALONE
    few = np.flatnonzero(~alone)
    after = base[of[few]] + (number[few] + 1) % segments[of[few]]
    beside = lambda k, name: mix64(key[k] * np.uint64(31) + name)
    # The next segments' items, in the order of their segments.
    asked = np.zeros(n, bool)
    asked[after] = True
    some = np.flatnonzero(asked[at])
    some = some[np.argsort(at[some], kind="stable")]
    begin = np.searchsorted(at[some], after)
    size = count[after]
    each = np.repeat(np.arange(len(few)), size)
    item = some[begin[each] + np.arange(len(each)) - (np.cumsum(size) - size)[each]]
    without = _subset(total[after[each]] - own[item], size[each] - 1)
    keys = np.concatenate([key[alone], beside(few, _subset(total[after], size)), beside(few[each], without)])
    return keys, np.concatenate([of[alone], of[few], of[few[each]]])


def keys_of(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Each set's keys in the bands that it takes part in. Bands without a difference hold no link between two sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own, segments, lower, segments_below = bands_of(sizes)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    with np.errstate(over="ignore"):
        for pick, band, m in ((segments > 1, own, segments), (lower & (segments_below > 1), own - 1, segments_below)):
            some = np.flatnonzero(pick & (sizes > 0))
            if len(some):
                keys, of = _band_keys(np.concatenate([sets[k] for k in some]), np.repeat(np.arange(len(some)), sizes[some]), band[some], m[some])
                found.append((keys, some[of]))
    keys, of = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return np.split(keys[order], np.cumsum(np.bincount(of, minlength=len(sets)))[:-1])


def parities(items: np.ndarray) -> bytes:
    at = (mix64(items ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(PARITIES - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=PARITIES) & 1).tobytes()


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __hash, __n, __node, __keys, __bits``: text hash, set size, the set's 64-bit name, its keys and parities; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["__text"].tolist()
            for i, j in spans_of([len(t) for t in texts], CHARS):
                sets = shingle_sets(texts[i:j], WORDS)
                yield pd.DataFrame({"__id": batch["__id"].iloc[i:j].astype("Int64"), "__hash": batch["__hash"].iloc[i:j], "__n": [len(s) for s in sets], "__node": [set_name(s) for s in sets], "__keys": [k.tobytes() for k in keys_of(sets)], "__bits": [parities(s) for s in sets]})

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.withColumn("__hash", F.xxhash64("__text")).mapInPandas(run, "__id long, __hash long, __n long, __node long, __keys binary, __bits binary")


def _packed(ranges: int):
    """Packs nodes' keys by range: the range's own bits of the keys, the nodes and how many of the keys each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            node, first = np.unique(node, return_index=True)  # a batch's copies give their keys once
            blobs = batch.column(1).take(pa.array(first)).to_pylist()
            keys = np.frombuffer(b"".join(blobs), "<u8")
            owner = np.repeat(np.arange(len(node)), [len(b) // 8 for b in blobs])
            place = (((keys >> np.uint64(_BITS)) * np.uint64(ranges)) >> np.uint64(64 - _BITS)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            place, keys, owner = place[order], keys[order], owner[order]
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, np.int64)
            many, who = np.diff(np.r_[new, len(keys)]).astype("<u4"), node[owner[new]].astype("<i8")
            own = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : _BITS // 8]
            cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(keys) else np.zeros(0, np.int64)
            edge, piece = np.r_[cut, len(keys)], np.searchsorted(new, np.r_[cut, len(keys)])
            slices = [(own[i:j].tobytes(), who[p:q].tobytes(), many[p:q].tobytes()) for i, j, p, q in zip(edge[:-1], edge[1:], piece[:-1], piece[1:], strict=True)]
            columns = [pa.array(place[cut], pa.int32()), *(pa.array([s[k] for s in slices], pa.binary()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "keys", "nodes", "many"])

    return run


class _Range:
    """One range's keys as they come in; those of one node so far are held."""

    def __init__(self) -> None:
        self.keys, self.nodes, self.several = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        self.waiting.append((keys, nodes))
        self.size += len(keys)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of keys that have several nodes; each row once, unless it came in again later."""
        keys, nodes = (np.concatenate([own, *x]) for own, x in zip((self.keys, self.nodes), zip(*self.waiting, strict=True), strict=True)) if self.waiting else (self.keys, self.nodes)
        self.waiting, self.size = [], 0
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        once = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])] if len(keys) else np.zeros(0, bool)
        keys, nodes = keys[once], nodes[once]
        same = keys[1:] == keys[:-1]
        shared = (np.r_[False, same] | np.r_[same, False]) if len(keys) else np.zeros(0, bool)
        new = np.unique(keys[shared])
        shared |= np.isin(keys, self.several)
        self.several = np.union1d(self.several, new)
        self.keys, self.nodes = keys[~shared], nodes[~shared]
        return keys[shared], nodes[shared]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, node`` of the keys that several nodes have; rows come in by range."""
    now, held = None, _Range()

    def rows() -> pa.RecordBatch:
        keys, nodes = held.settle()
        named = keys + (np.uint64(now) << np.uint64(_BITS))
        return pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array(nodes)], names=["key", "node"])

    for batch in batches:
        for place, keys, nodes, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != now:
                if now is not None:
                    yield rows()
                now, held = place, _Range()
            wide = np.zeros((len(keys) // (_BITS // 8), 8), np.uint8)
            wide[:, : _BITS // 8] = np.frombuffer(keys, np.uint8).reshape(-1, _BITS // 8)
            held.add(wide.view(np.uint64).ravel(), np.repeat(np.frombuffer(nodes, "<i8"), np.frombuffer(many, "<u4")))
            if held.size >= SETTLED:
                yield rows()
    if now is not None:
        yield rows()


def shared_keys(sketches: DataFrame) -> DataFrame:
    """``key, node`` of all keys that several nodes have."""
    total = sketches.agg((F.sum(F.length("__keys")) / 8).cast("long").alias("n")).head()["n"] or 0
    n = parts(sketches.sparkSession)
    ranges = min(1 << 22, max(n, -(-total // RANGE)))
    packed = sketches.where("length(__keys) > 0").select("__node", "__keys").mapInArrow(_packed(ranges), "range int, keys binary, nodes binary, many binary")
    return packed.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_unpacked, "key long, node long").distinct()


def _bits(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u8").reshape(len(column), -1)


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False only for pairs whose sizes or parities show that the threshold isn't met."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m)) & ((100 + SIMILAR) * differ <= (100 - SIMILAR) * (n + m))


def _hopeful(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and parities don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[may_link(_bits(batch["x"]), _bits(batch["y"]), batch["n"].to_numpy(), batch["m"].to_numpy()), ["a", "b", "ca", "cb"]]

    left = nodes.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    near = pairs.join(left, "a").join(right, "b").where(f"100 * least(n, m) >= {SIMILAR} * greatest(n, m)")
    return near.select("a", "b", "ca", "cb", "n", "m", "x", "y").mapInPandas(run, "a long, b long, ca long, cb long")


def _near(rows: pd.DataFrame):
    bits, n = _bits(rows["bits"]), rows["n"].to_numpy()

    def near(i: np.ndarray, j: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(may_link(bits[i], bits[j], n[i], n[j]))
        return left, np.bitwise_count(bits[i[left]] ^ bits[j[left]]).sum(axis=1, dtype=np.int64)

    return near


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __hash, __n, best`` of every row; ``best`` is its component's smallest id with that text's hash."""
    sketches = written(sketch(docs, id_col, text_col), "setjoin-sketches")
    some = sketches.where("__n > 0")
    classes = some.groupBy(F.col("__node").alias("node")).agg(best_row().alias("best"), F.count(F.lit(1)).alias("size"), F.max("__n").alias("n"), F.first("__bits").alias("bits"))
    classes = written(classes, "setjoin-classes")
    shared = written(shared_keys(sketches), "setjoin-shared")
    nodes = classes.join(shared.select("node").distinct(), "node", "left_semi")
    nodes = written(nodes.select("node", F.col("best.id").alias("class_id"), F.col("best.hash").alias("hash"), "n", "bits"), "setjoin-nodes")
    sets = full_sets(nodes, docs, id_col, text_col, WORDS)
    grouping = Grouping(nodes, sets, lambda pairs: _hopeful(pairs, nodes), SIMILAR)
    # A share of the buckets joins most of what belongs together; the others then meet few components.
    few = F.pmod("key", F.lit(8)) == 0
    grouping.star(shared.where(few))
    grouping.star(shared.where(~few))
    return member_rows(sketches, classes, grouping.finish(shared, _near, _near))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row."""
    component = F.when(F.col("__n") > 0, F.col("best.id")).otherwise(F.col("__id"))
    return _grouped(docs, id_col, text_col).select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), component.alias("component_id"))
