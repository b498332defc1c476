"""Hard-negative mining by anchor-clustered shared lists.

Vectors become whole numbers, ``floor(256 * x)``; a row's score for an anchor is the inner product.

1. Anchors are clustered around at most ``CLUSTERS`` centres (spherical k-means over at most ``SAMPLE``
   anchors, picked by hash of the id; which centres they are changes the work, never the result).
   Clusters are put together into blocks of a bounded size; a larger one is split.
2. All rows are dealt over shards by hash. Every block meets every shard in a task of its own: anchors
   are copied once a shard, rows once a block.
3. In a task each cluster sorts the shard's rows once by an upper bound of what any member can score:
   with ``a`` the widest angle between the centre and a member and ``t`` that between the centre and a
   row, no score is above ``|anchor| |row| cos(max(0, t - a))``. Every member walks that one list, a
   stretch at a time, and stops as soon as the bound of the next row shows that no later row can
   count. Bounds have room for rounding, so what ends a walk is certain; scores are exact.
4. The first walk finds each anchor's best rows of its own label, the second one, from these, the best
   rows of other labels whose score lies within the margin below each positive's. What the shards
   found is merged by one window over at most ``keep`` rows a shard.

Defined results: rows with a null id, label or vector, an empty vector, or null, non-finite or huge
(2**14 and more) components take no part, nor do vectors of another length than most have. Equal rows
take places one by one; rows under an anchor's id are never its own positives, equal anchor rows
answer once. An anchor without another row of its label, or without a row in the margin, gives no
rows; a negative or zero positive's margin is empty or holds only zero scores. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import parts, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Percent of the positive's score that a negative has at least.
MARGIN = 80
CLUSTERS, SAMPLE, STRETCH = 64, 2048, 1024
#: Components of a block of anchors and of a shard of rows: what a task holds.
BLOCK, SHARD = 1 << 18, 1 << 22
_LIMIT = float(1 << 14)
#: Room for rounding in bounds, as a share of the product of two lengths.
_SLACK = 1e-7


def _whole(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where all sums stay below 2**53."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((v**2).sum(axis=1))
    return v / np.maximum(size, 1e-300)[:, None], size


def centres(vectors: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """At most ``k`` unit vectors by spherical k-means, begun from the first ones."""
    unit = _unit(vectors)[0]
    out = unit[: max(1, min(k, len(unit) // 4))].copy()
    for _ in range(rounds):
        own = (unit @ out.T).argmax(axis=1)
        for j in range(len(out)):
            if (own == j).any():
                out[j] = _unit(unit[own == j].sum(axis=0, keepdims=True))[0][0]
    return out


class SharedList:
    """A cluster's list of a shard's rows, sorted by what any of its members can score at most."""

    def __init__(self, members: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> None:
        unit, self.length = _unit(members)
        middle = _unit(unit.sum(axis=0, keepdims=True))[0][0]
        widest = np.arccos(np.clip((unit @ middle).min(), -1, 1)) if middle.any() else np.pi
        angle = np.arccos(np.clip((rows @ middle) / np.maximum(sizes, 1e-300), -1, 1))
        # Rounding in an angle's cosine near 1 moves the angle by up to 1e-7.
        bound = sizes * (np.cos(np.maximum(0, angle - widest - 1e-6)) + _SLACK)
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]

    def walk(self, members: np.ndarray, rows: np.ndarray, take: Callable[[int, np.ndarray, np.ndarray], float]) -> None:
        """Gives every member the list stretch by stretch: ``take(member, rows' numbers, scores)`` says what a later row must reach to count."""
        least = np.full(len(members), -np.inf)
        for i in range(0, len(self.order), STRETCH):
            best = self.bound[i] * self.length
            on = np.flatnonzero(best >= least)
            if not len(on):
                return
            at = self.order[i : i + STRETCH]
            for m, scores in zip(on, _products(members[on], rows[at]), strict=True):
                least[m] = take(m, at, scores)


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class _Top:
    """The best rows met so far: ids and scores."""

    def __init__(self, n: int) -> None:
        self.n, self.ids, self.scores = n, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """What another row must reach; a tie may still win by its id."""
        return float(self.scores[-1]) if len(self.scores) == self.n else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.scores) == self.n:
            near = scores >= self.scores[-1]
            ids, scores = ids[near], scores[near]
        if len(ids):
            ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
            at = _best(ids, scores, self.n)
            self.ids, self.scores = ids[at], scores[at]


def sound(vector: str) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < _LIMIT, F.lit(False)))


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, shards: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over every block of anchors with every shard of rows, one task group each: anchors come first in a group."""
    spark = rows.sparkSession
    grid = lambda df, own, n, other: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # noqa: E731, ARG005
    a = grid(anchors, "block", shards, "shard").withColumn("is_row", F.lit(0))
    b = grid(rows, "shard", blocks, "block").withColumn("is_row", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.select("block", "shard", "is_row", *[c for c in both.columns if c not in ("block", "shard", "is_row")])
    n = max(parts(spark), min(blocks * shards, 100_000))
    return both.repartition(n, "block", "shard").sortWithinPartitions("block", "shard", "is_row").mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (block, shard): a block of anchors and a shard of rows at most, both bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != tuple(key[i].tolist()):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _walked(group: pa.Table, collect: Callable) -> tuple[np.ndarray, list]:
    """Runs each cluster's walk over a group: the anchors' names and what each keeps, which ``collect`` makes from an anchor's row."""
    split = int(np.searchsorted(group.column("is_row").to_numpy(), 1))
    anchors, rows = group.slice(0, split), group.slice(split)
    if not len(anchors) or not len(rows):
        return np.zeros(0, np.int64), []
    vectors, members = (_whole(t.column("vector").combine_chunks()) for t in (rows, anchors))
    sizes = np.sqrt((vectors**2).sum(axis=1))
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    kept = [collect(r) for r in anchors.drop_columns(["vector"]).to_pylist()]
    cluster = anchors.column("cluster").to_numpy()
    for c in np.unique(cluster):
        own = np.flatnonzero(cluster == c)
        shared = SharedList(members[own], vectors, sizes)
        shared.walk(members[own], vectors, lambda m, at, scores, own=own: kept[own[m]](ids[at], labels[at], scores))
    return anchors.column("anchor").to_numpy(), kept


def _candidates(rows: DataFrame, id_col: str, vector_col: str, label_col: str, relabel: Column | None) -> DataFrame:
    vector = F.col(vector_col)
    if rows.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    label = F.col(label_col).cast("long") if relabel is None else relabel.cast("long")
    out = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.alias("vector"))
    return out.where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(sound("vector"))


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, margin: int = MARGIN) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor``: a condition on ``id_col``'s values under the name ``id``; ``relabel``: the label to use, from the columns of ``rows``.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kept = _candidates(rows, id_col, vector_col, label_col, relabel)
    lengths = kept.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    length, rows_in_all = lengths[0]
    kept = kept.where(F.size("vector") == length)
    chosen = kept.where(is_anchor).dropDuplicates(["id", "label", "vector"])
    sample = chosen.orderBy(F.xxhash64("id"), "id", "label", "vector").limit(SAMPLE).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    middle = spark.sparkContext.broadcast(centres(np.floor(np.array([r["vector"] for r in sample], np.float64) * SCALE), CLUSTERS))

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (_whole(batch.column(2)) @ middle.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "label", "vector", "cluster"])

    kind = kept.schema["vector"].dataType.simpleString()
    chosen = chosen.select("id", "label", "vector").mapInArrow(cluster, f"id long, label long, vector {kind}, cluster int")
    anchors = written(chosen.withColumn("anchor", F.xxhash64("id", "label", "vector")), "hardnegatives-anchors")
    count = dict(anchors.groupBy("cluster").count().collect())  # one row a cluster, CLUSTERS at most
    base, pieces, block, held = {}, {}, 0, 0
    most = max(1, BLOCK // length)
    for c, n in sorted(count.items()):
        need = -(-n // most)
        if need > 1 or held + n > most:
            block, held = block + (held > 0), 0
        base[c], pieces[c] = block, need
        block, held = (block + need, 0) if need > 1 else (block, held + n)
    blocks = block + (held > 0)
    of = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("cluster"))
    anchors = anchors.withColumn("block", (of(base) + F.pmod(F.col("anchor"), of(pieces))).cast("int"))
    shards = max(parts(spark), -(-rows_in_all // max(1, SHARD // length)))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))

    class Same:
        """An anchor's best rows of its own label."""

        def __init__(self, label: int, own: int) -> None:
            self.label, self.own, self.top = label, own, _Top(positives)

        def __call__(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> float:
            some = (labels == self.label) & (ids != self.own)
            self.top.add(ids[some], scores[some])
            return self.top.least

    class Other:
        """For each positive, the best rows of other labels within the margin below its score."""

        def __init__(self, label: int, high: list[int]) -> None:
            self.label, self.high = label, np.array(high, np.int64)
            self.tops = [_Top(negatives) for _ in high]
            self.floor, self.ceiling = margin * self.high.min() / 100, self.high.max()

        def __call__(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> float:
            some = np.flatnonzero((labels != self.label) & (scores >= self.floor) & (scores <= self.ceiling))
            if len(some):
                ids, scores = ids[some], scores[some]
                for high, top in zip(self.high, self.tops, strict=True):
                    fits = (scores <= high) & (100 * scores >= margin * high)
                    top.add(ids[fits], scores[fits])
            return min(max(top.least, margin * high / 100) for high, top in zip(self.high, self.tops, strict=True))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            names, kept = _walked(group, lambda a: Same(a["label"], a["id"]))
            size = [len(k.top.ids) for k in kept]
            yield _batch({"anchor": np.repeat(names, size), "id": _joined([k.top.ids for k in kept]), "score": _joined([k.top.scores for k in kept])})

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            names, kept = _walked(group, lambda a: Other(a["label"], a["high"]))
            tops = [(name, place, top) for name, k in zip(names, kept, strict=True) for place, top in enumerate(k.tops)]
            size = [len(t.ids) for _, _, t in tops]
            name, place = (np.repeat(np.array([t[i] for t in tops], np.int64), size) for i in (0, 1))
            yield _batch({"anchor": name, "place": place, "id": _joined([t.ids for _, _, t in tops]), "score": _joined([t.scores for _, _, t in tops])})

    columns = ["id", "label", "vector", "shard"]
    found = _met(anchors.select("anchor", "id", "label", "vector", "cluster", "block"), dealt.select(*columns), blocks, shards, same, "anchor long, id long, score long")
    best = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    found = written(found.withColumn("place", best - 1).where(F.col("place") < positives), "hardnegatives-positives")
    high = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("high"))  # ``positives`` at most
    asked = anchors.join(high, "anchor").select("anchor", "label", "vector", "cluster", "block", "high", "id")
    near = _met(asked, dealt.select(*columns), blocks, shards, other, "anchor long, place long, id long, score long")
    best = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    near = near.withColumn("rank", best).where(F.col("rank") <= negatives)
    near = near.select("anchor", F.col("place").cast("int").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = found.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = near.join(told, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame({k: v.astype(np.int64) for k, v in columns.items()}), preserve_index=False)
