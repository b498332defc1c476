"""Vector code compression (product codes) with memoised grid cells.

Vectors become whole numbers, ``floor(256 * x)``, and are cut into equal consecutive parts. Each part's
position has a codebook of at most 64 entries; a part's code is its nearest entry.

Grid: the space of a part is cut into cells of ``CELL`` units a side. For a cell's box every entry has
a least and a greatest distance; an entry whose least distance is above another one's greatest is
dominated across the whole box and nearest to none of its points. What is left (ties included) is
remembered under the cell's hash, once a worker and codebook, and only these entries are compared
exactly with the parts that fall into the cell. The hash only finds the cell: its coordinates are
compared too, and parts of a cell that clashes with another one meet all entries.

Codebooks begin as the parts of the smallest ids. A round assigns all vectors and replaces entries by
their parts' componentwise ``floor(sum / count)``: tasks send sums by part and entry (at most 1,024
rows each), so what meets on the driver is a codebook's size, whatever the number of vectors.

Defined results: rows whose vector is null or empty or holds null or non-finite components are left
out, as are components of 2**19 and more, whose squares would not fit, and vectors of another length
than the first one's; a length that the number of parts doesn't divide is an error. Null ids
come after all others; equal ids are rows of their own, in the order of their vectors. With fewer than 64 vectors a codebook has as many entries; an empty table gives no rows. A null
label is a label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import HashTable, mix64, salted_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A cell's side as a power of two, and the cells that a worker remembers of a codebook.
CELL, CELLS = 4, 1 << 14
#: Distances that are worked out side by side.
WIDE = 1 << 20
_LIMIT = float(1 << 19)


def sound(vector: str) -> Column:
    """Whether a vector has components and all of them are numbers of a size that can be squared."""
    return (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < _LIMIT, F.lit(False)))


def whole(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1)


class Cells:
    """One codebook's entries (``k`` rows) with the undominated ones of every cell met so far."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.forget()

    def forget(self) -> None:
        self.table, self.at = HashTable(CELLS), np.zeros((0, self.entries.shape[1]), np.int64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Cells by entries: those whose least distance to the box isn't above the least of all greatest ones."""
        out = []
        for i in range(0, len(cells), step := max(1, WIDE // self.entries.size)):
            low = (cells[i : i + step] << CELL)[:, None, :]
            high = low + (1 << CELL) - 1
            outside = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
            across = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
            least, greatest = (outside**2).sum(axis=2), (across**2).sum(axis=2)
            out.append(least <= greatest.min(axis=1, keepdims=True))
        return np.concatenate(out)

    def _remember(self, hashes: np.ndarray, cells: np.ndarray) -> None:
        if self.table.size + len(hashes) > CELLS:
            self.forget()
        hashes, cells = hashes[:CELLS], cells[:CELLS]
        cell, entry = np.nonzero(self.undominated(cells))
        size = np.bincount(cell, minlength=len(cells))
        self.table.add(hashes, np.arange(len(self.at), len(self.at) + len(cells), dtype=np.int64))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.at, self.size, self.flat = np.concatenate([self.at, cells]), np.concatenate([self.size, size]), np.concatenate([self.flat, entry])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry, of equals the first, and its squared distance."""
        cell = points >> CELL
        hashed = np.zeros(len(points), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(points.shape[1]):
                hashed = mix64(hashed * np.uint64(31) + cell[:, k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        hashed |= np.uint64(1)
        names, first, own = np.unique(hashed, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.table.find(names) < 0)
        if len(new):
            self._remember(names[new], cell[first[new]])
        slot = self.table.find(names)[own]
        met = (slot >= 0) & (self.at[slot] == cell).all(axis=1)
        code, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        rows = np.flatnonzero(met)
        size = self.size[slot[rows]]
        # Rows side by side as far as their candidates fit.
        edges = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), max(1, WIDE // points.shape[1])))
        for i, j in zip(edges, [*edges[1:], len(rows)], strict=True):
            self._least(points, rows[i:j], size[i:j], self.begin[slot[rows[i:j]]], self.flat, code, error)
        rest = np.flatnonzero(~met)  # a hash of two cells, or more cells in a batch than are remembered
        k = len(self.entries)
        for i in range(0, len(rest), step := max(1, WIDE // self.entries.size)):
            few = rest[i : i + step]
            self._least(points, few, np.full(len(few), k), np.zeros(len(few), np.int64), np.arange(k), code, error)
        return code, error

    def _least(self, points: np.ndarray, rows: np.ndarray, size: np.ndarray, begin: np.ndarray, flat: np.ndarray, code: np.ndarray, error: np.ndarray) -> None:
        if not len(rows):
            return
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(rows)), size)
        entry = flat[np.arange(len(owner)) - start[owner] + begin[owner]]
        far = ((points[rows[owner]] - self.entries[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(far, start)
        hit = np.flatnonzero(far == least[owner])
        hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]  # entries ascend, so the first is the lowest
        code[rows], error[rows] = entry[hit], least


class Coder:
    """Codebooks of all parts: an array parts by entries by components."""

    def __init__(self, books: np.ndarray) -> None:
        self.books, self.cells = books, None

    def __getstate__(self) -> dict:
        return {"books": self.books, "cells": None}  # what is remembered stays in its worker

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by parts: codes and squared distances."""
        self.cells = self.cells or [Cells(b) for b in self.books]
        cut = vectors.reshape(len(vectors), len(self.books), -1)
        both = [c.nearest(np.ascontiguousarray(cut[:, p])) for p, c in enumerate(self.cells)]
        return np.stack([b[0] for b in both], axis=1), np.stack([b[1] for b in both], axis=1)


def _kept(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vector = F.col(vector_col)
    if rows.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    out = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.col(label_col).alias("label"))
    return out.where(sound("vector"))


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids, or None without vectors."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    length = len(first[0][0])
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    vectors = np.floor(np.array([r[0] for r in first if len(r[0]) == length], np.float64) * SCALE).astype(np.int64)
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def _next_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books whose entries are the floored means of the parts assigned to them; unused ones stay."""
    parts, entries, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(Coder(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = whole(batch.column(0))
            place = (sent.value.codes(vectors)[0] + np.arange(parts) * entries).ravel()
            points = vectors.reshape(-1, width)
            counts += np.bincount(place, minlength=len(counts))
            for k in range(width):
                np.add.at(sums[:, k], place, points[:, k])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["place", "n", "sums"])

    partial = kept.select("vector").mapInArrow(run, "place long, n long, sums array<long>")
    rows = partial.select("place", "n", F.posexplode("sums").alias("at", "sum")).groupBy("place", "at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    out = books.reshape(parts * entries, width).copy()
    for r in rows.collect():  # parts * entries * width rows at most
        out[r["place"], r["at"]] = r["sum"] // r["n"]
    return out.reshape(books.shape)


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """``id, label, codes (binary, a byte a part), error`` of every kept row, and the final codebooks."""
    kept = _kept(rows, id_col, vector_col, label_col)
    books = first_books(kept, parts, entries)
    if books is None:
        return kept.select("id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), None
    kept = kept.where(F.size("vector") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = _next_books(kept, books)
    sent = rows.sparkSession.sparkContext.broadcast(Coder(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors = sent.value.codes(whole(batch.column(2)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(errors.sum(axis=1))], names=["id", "label", "codes", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("id", "label", "vector").mapInArrow(run, f"id long, label {label}, codes binary, error long"), books


def restore(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``vector``, the entries that the codes name as whole numbers: what is left of a vector."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    names = [c for c in codes.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(names.index("codes")).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            vectors = sent.value[np.arange(at.shape[1]), at].reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(vectors), pa.list_(pa.int64()))], names=[*names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema if f.name != "vector")
    return codes.select(*names).mapInArrow(run, f"{fields}, vector array<long>")


def report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every kept row."""
    coded, books = compress(rows, id_col, vector_col, label_col)
    name = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = written(coded.select("id", name.alias("__label"), F.lower(F.hex("codes")).alias("code"), "error"), "vectorcodes")
    sums = coded.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest() if books is not None else None
    full = salted_join(coded, sums, "__label", "__n", "code")
    return full.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
