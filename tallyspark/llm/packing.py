"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

A document longer than a sequence is cut: whole sequences stand in bins of their own, the rest is
packed like a short document. Rests go, longest first, to the open bin with the least room left that
holds neither a document of the same source nor one of the same duplicate cluster (equal texts).
Bins stand in order of their room; each carries a bitmap of its sources and one of its clusters, and
the successor search goes on to the next larger room until a bin is compatible.

Rows are dealt to shards by hash, so that sources, clusters and lengths are spread and a shard holds
about 4,000 rests whatever the input; each shard is packed by itself, without texts.

Defined results: null and empty texts have no words and one empty piece, which takes no room; a null
source conflicts with none; repeated rows are copies of each other; null ids are packed like others;
equal lengths go in order of id (null last), then of cluster; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 4000


def best_fit(sizes: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """Each item's bin and its offset there; items in the order given, sources and clusters as small numbers, -1 for none.

    ``rooms`` has the open bins by their room, ``held`` a bit for every room that has a bin. Per room
    the intersections of the bitmaps are kept too: a room whose bins all hold the source or the
    cluster is passed over at once.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    common: list[tuple[int, int]] = [(-1, -1)] * (capacity + 1)
    held = 0
    room_of: list[int] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    where, offset = [], []

    def leave(room: int, place: int) -> None:
        nonlocal held
        bins = rooms[room]
        bins.pop(place)
        if not bins:
            held &= ~(1 << room)
        a = c = -1
        for b in bins:
            a &= source_bits[b]
            c &= cluster_bits[b]
            if not a and not c:
                break
        common[room] = (a, c)

    def enter(room: int, b: int) -> None:
        nonlocal held
        rooms[room].append(b)
        held |= 1 << room
        a, c = common[room]
        common[room] = (a & source_bits[b], c & cluster_bits[b])

    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        found = -1
        above = held >> size
        room = size
        while above:
            step = (above & -above).bit_length() - 1
            room += step
            above >>= step
            if not (common[room][0] & s or common[room][1] & c):
                for place, b in enumerate(rooms[room]):
                    if not (source_bits[b] & s or cluster_bits[b] & c):
                        found = b
                        leave(room, place)
                        break
            if found >= 0:
                break
            room += 1
            above >>= 1
        if found < 0:
            found = len(room_of)
            room_of.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
        where.append(found)
        offset.append(capacity - room_of[found])
        source_bits[found] |= s
        cluster_bits[found] |= c
        room_of[found] -= size
        enter(room_of[found], found)
    return where, offset


def _shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["rest", "id", "cluster"], ascending=[False, True, True], na_position="last", kind="stable", ignore_index=True)
    sources = pd.factorize(rows["source"])[0]
    clusters = pd.factorize(rows["cluster"])[0]
    where, offset = best_fit(rows["rest"].tolist(), sources.tolist(), clusters.tolist(), capacity)
    packed = pd.DataFrame({"id": rows["id"], "piece": rows["full"], "start_word": rows["full"] * capacity, "n_words": rows["rest"], "bin": where, "offset": offset})
    packed = packed[(rows["rest"] > 0) | (rows["full"] == 0)]
    at = np.repeat(np.arange(len(rows)), rows["full"])
    piece = np.arange(len(at)) - np.repeat(np.cumsum(rows["full"]) - rows["full"], rows["full"]).to_numpy()
    whole = pd.DataFrame({"id": rows["id"].iloc[at].to_numpy(), "piece": piece, "start_word": piece * capacity, "n_words": capacity, "bin": max(where, default=-1) + 1 + np.arange(len(at)), "offset": 0})
    out = pd.concat([packed, whole.astype(packed.dtypes.to_dict())], ignore_index=True)
    out["shard"] = rows["shard"].iloc[0]
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``id_col, piece, start_word, n_words, shard, bin, offset``: a row for each piece of each document.

    Pieces cut a text by its words (runs of other than white space); ``shard, bin`` names a sequence.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    shards = max(1, round(docs.count() / shard_rows))
    words = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("cluster"), words.alias("n"))
    # Copies differ in their ids, rows that agree in everything in nothing: they meet in a shard and conflict there.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "cluster"), F.lit(shards)).cast("int"))
    rows = rows.select("id", "source", "cluster", F.floor(F.col("n") / capacity).cast("long").alias("full"), (F.col("n") % capacity).alias("rest"), "shard")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _shard(group.astype({"id": "Int64"}), capacity)

    out = rows.groupBy("shard").applyInPandas(run, "id long, piece long, start_word long, n_words long, bin long, offset long, shard int")
    return out.select(F.col("id").alias(id_col), "piece", "start_word", "n_words", "shard", "bin", "offset")
