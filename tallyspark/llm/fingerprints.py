"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On every level, runs of one name collapse, deterministic coin tossing
turns each name into a label of a few bits that depends on its left neighbours only, local maxima of
the labels cut the sequence into phrases, and a phrase's content gives its name on the next level.
Where two texts share a substring, all but a bounded margin of it is cut and named alike in both,
whatever its offset. The fingerprint is the 64 smallest hashes of the distinct phrase names of levels
one and up, of texts of any size alike, up to the level that has one name; likeness is the Jaccard
estimate on them. It depends on the text alone, not on those parsed beside it.

Defined results: null text counts as empty; an empty text has the fingerprint ``''``, is fully like
another empty one (1.0) and unlike any other (0.0). Rows with equal or null ids are kept, ordered by
id (null last) and then by text hash; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import id_bounds, mix64, parts, range_of, spans_of

SIZE = 64
CHARS = 1_000_000
_NONE = np.uint64(1 << 32)
_STEP, _RUN, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _coin(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the place of the lowest bit that differs from the left one's, plus that bit."""
    differs = np.empty_like(labels)
    differs[0] = 0
    np.bitwise_xor(labels[1:], labels[:-1], out=differs[1:])
    differs[first | (differs == 0)] = 1
    zeros = np.bitwise_count((differs & (~differs + labels.dtype.type(1))) - labels.dtype.type(1))
    return (2 * zeros + ((labels >> zeros.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def parse_level(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and their documents; every document that has names keeps one at least."""
    with np.errstate(over="ignore"):
        first = np.r_[True, docs[1:] != docs[:-1]]
        starts = np.flatnonzero(first | np.r_[True, names[1:] != names[:-1]])
        run = np.diff(np.r_[starts, len(names)])
        names, docs, first = names[starts], docs[starts], first[starts]
        long = run > 1
        names = names.copy()
        names[long] = mix64(names[long] ^ (run[long].astype(np.uint64) * _RUN))
        labels = _coin(names, first)
        for _ in range(2):
            labels = _coin(labels, first)
        left = np.r_[np.uint8(255), labels[:-1]]
        right = np.r_[labels[1:], np.uint8(255)]
        right[:-1][first[1:]] = 255
        cuts = np.flatnonzero(first | ((labels > left) & (labels > right)))
        length = np.diff(np.r_[cuts, len(names)])
        place = np.arange(len(names), dtype=np.uint64) - np.repeat(cuts, length).astype(np.uint64)
        total = np.add.reduceat(mix64(names + (place + np.uint64(1)) * _STEP), cuts)
        return mix64(total + length.astype(np.uint64) * _LEVEL), docs[cuts]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of up to ``SIZE`` ascending 32-bit hashes for each text, filled up with ``2**32``."""
    out = np.full((len(texts), SIZE), _NONE, dtype=np.uint64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return out
    docs = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    names = mix64(points.astype(np.uint64) + _STEP)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(names):
        names, docs = parse_level(names, docs)
        found.append((names, docs))
        more = np.bincount(docs)[docs] > 1
        names, docs = names[more], docs[more]
    hashes = mix64(np.concatenate([n for n, _ in found]) ^ _LEVEL) >> np.uint64(32)
    key = np.unique((np.concatenate([d for _, d in found]).astype(np.uint64) << np.uint64(32)) | hashes)
    docs = (key >> np.uint64(32)).astype(np.int64)
    rank = np.arange(len(key)) - np.searchsorted(docs, docs)
    keep = rank < SIZE
    out[docs[keep], rank[keep]] = key[keep] & np.uint64(0xFFFFFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard estimate of each row of one sketch table with the same row of another."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both < _NONE
    new = real & np.concatenate([np.ones((len(a), 1), bool), both[:, 1:] != both[:, :-1]], axis=1)
    within = np.cumsum(new, axis=1) <= SIZE
    twice = np.zeros_like(new)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    size = np.minimum(new.sum(axis=1), SIZE)
    return np.where(size == 0, 1.0, (twice & within).sum(axis=1) / np.maximum(size, 1))


def as_text(sketch: np.ndarray) -> list[str]:
    """Each row's hashes as eight hex digits each."""
    return [row[row < _NONE].astype(">u4").tobytes().hex() for row in sketch]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, fingerprint`` of every row: a map over the rows without any shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["__text"]]
            for i, j in spans_of([len(t) for t in texts], CHARS):
                yield pd.DataFrame({id_col: batch[id_col].iloc[i:j], "n_chars": [len(t) for t in texts[i:j]], "fingerprint": as_text(sketches(texts[i:j]))})

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    return rows.mapInPandas(run, f"{id_col} {dict(rows.dtypes)[id_col]}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much from the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def in_descending_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__bucket, __guest, __id, __text`` in sorted streams: a row's follower by descending id is the next row.

    Ranges of the id, about as many as there are shuffle partitions, are the buckets. The first row
    of each range also goes to the end of the range before (a guest), the very first one to the
    very last range. What comes to the driver is one bound and one largest id for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    n = parts(spark)
    bounds = id_bounds(rows, "__id", n)
    rows = rows.withColumn("__bucket", F.when(F.col("__id").isNull(), F.lit(len(bounds))).otherwise(F.lit(len(bounds)) - range_of(F.col("__id"), bounds)))
    heads = sorted(((r["__bucket"], r["top"]) for r in rows.groupBy("__bucket").agg(F.max("__id").alias("top")).collect()))
    guests = [(b, top, heads[i - 1][0]) for i, (b, top) in enumerate(heads)]
    small = F.broadcast(spark.createDataFrame(guests or [(0, 0, 0)], "__bucket int, __top long, __to int"))
    place = lambda bucket, guest: F.struct(F.col(bucket).cast("int").alias("b"), F.lit(guest).alias("g"))
    places = F.when(F.col("__id").eqNullSafe(F.col("__top")), F.array(place("__bucket", False), place("__to", True))).otherwise(F.array(place("__bucket", False)))
    rows = rows.join(small, "__bucket").select(F.inline(places).alias("__bucket", "__guest"), "__id", "__text")
    return rows.repartitionById(n, "__bucket").sortWithinPartitions("__bucket", "__guest", F.col("__id").desc_nulls_last(), F.xxhash64("__text"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside those of its edited form and of its follower by descending id.

    One shuffle of the texts (ranges of the id); a task holds one bounded stretch of rows at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = rows.iloc[-1:]
            for i, j in spans_of([len(t) for t in rows["__text"][:-1]], CHARS):
                yield answer(rows.iloc[i : j + 1])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, guest = rows["__bucket"].to_numpy(), rows["__guest"].to_numpy()
        own = ~guest[:-1] & (bucket[:-1] == bucket[1:])
        texts = rows["__text"].tolist()
        changed = [edited(a, b) if mine else "" for a, b, mine in zip(texts, texts[1:], own, strict=False)]
        plain, after = sketches(texts), sketches(changed)
        out = pd.DataFrame({"doc_id": rows["__id"].iloc[:-1].astype("Int64"), "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], "fingerprint": as_text(plain[:-1]), "edited_fingerprint": as_text(after), "near_edited": likeness(plain[:-1], after), "near_next": likeness(plain[:-1], plain[1:])})
        return out[own]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(docs, id_col, text_col).mapInPandas(run, schema)
