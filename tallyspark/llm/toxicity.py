"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of each word are a word part and a character part: how much more often the word itself, and
its character n-grams (3 to 6, with the word's ends marked), occur in toxic than in clean training
documents (shrunken log-odds by hashed place), the n-grams as largest, mean and smallest. Two gated
recurrent units read a window of 64 words in both directions, attention pools their states, and a
logistic unit gives the window's logit. Windows overlap (one begins every 48 words) and cover the
whole text; the document's score is that of its most toxic window.

Training takes at most ``SAMPLE`` labelled documents (half of them toxic if there are so many),
picked by hash of the id. The log-odds that the network sees in training come from the other half of
the sample, so that it learns how far to trust them on unseen texts. Training is multiple-instance:
of a document's windows the most toxic one takes the gradient.

Scoring is a map over the rows: no shuffle; the model (about 1 MB, fixed size) goes with the tasks.

Defined results: null and empty texts have one window without words and the score of that; without
toxic or without clean training rows every score is 0; repeated rows and ids are scored one by one;
extra columns are ignored; an empty table gives no rows. Words are runs of letters, digits and ``'``,
cut into pieces of at most ``PIECE`` characters, about as long as common words, that are words of their
own and overlap by ``SHARED`` characters, so every n-gram of a run is in one of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import fresh, mix64, spans_of

SAMPLE = 3000
WINDOW, STRIDE = 64, 48
PLACES = 1 << 17
SHRINK = 5
HIDDEN, POOL = 8, 8
FEATURES = 5
THRESHOLD = 0.7
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Characters that a task works on at a time.
CHARS = 800_000
#: Words whose features a worker remembers.
WORDS = 200_000
PIECE, SHARED = 12, 8
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_GRAMS = (3, 4, 5, 6)


def words_of(text: str | None) -> list[str]:
    return [w[i : i + PIECE] for w in _WORD.findall((text or "").lower()) for i in range(0, max(1, len(w) - SHARED), PIECE - SHARED)]


def _ngrams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's place, all n-grams' places, and the word each n-gram is of."""
    marked = [f"^{w}$" for w in vocabulary]
    size = np.array([len(m) for m in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), size)
    with np.errstate(over="ignore"):
        letters = mix64(points + np.uint64(0x9E3779B97F4A7C15))
        place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
        whole = np.add.reduceat(mix64(letters + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.cumsum(size) - size) if len(marked) else np.zeros(0, np.uint64)
        grams, owners = [], []
        for n in _GRAMS:
            if len(points) < n:
                continue
            rolled = np.zeros(len(points) - n + 1, np.uint64)
            for k in range(n):
                rolled = mix64(rolled * np.uint64(31) + letters[k : len(points) - n + 1 + k])
            inside = owner[: len(rolled)] == owner[n - 1 :]
            grams.append(rolled[inside])
            owners.append(owner[: len(rolled)][inside])
    none = np.zeros(0, np.uint64)
    gram, own = np.concatenate([none, *grams]), np.concatenate([none.astype(np.int64), *owners])
    return (whole % np.uint64(PLACES)).astype(np.int64), (mix64(gram) % np.uint64(PLACES)).astype(np.int64), own


@dataclass
class Tables:
    """Shrunken log-odds of toxic against clean documents by place, for words and for n-grams."""

    word: np.ndarray
    gram: np.ndarray

    def features(self, vocabulary: list[str]) -> np.ndarray:
        """A row a word: its own log-odds, the n-grams' largest, mean and smallest, and 1."""
        place, gram, owner = _ngrams(vocabulary)
        out = np.zeros((len(vocabulary), FEATURES), np.float32)
        out[:, 0] = self.word[place]
        odds = self.gram[gram]
        top, low = np.full(len(vocabulary), -9, np.float32), np.full(len(vocabulary), 9, np.float32)
        np.maximum.at(top, owner, odds)
        np.minimum.at(low, owner, odds)
        n = np.maximum(np.bincount(owner, minlength=len(vocabulary)), 1)
        out[:, 1], out[:, 2], out[:, 3], out[:, 4] = top, np.bincount(owner, odds, len(vocabulary)) / n, low, 1
        return out


def fit_tables(texts: list[list[str]], toxic: np.ndarray) -> Tables:
    counts = np.zeros((2, 2, PLACES), np.float64)
    for words, label in zip(texts, toxic, strict=True):
        place, gram, _ = _ngrams(sorted(set(words)))
        counts[0, int(label), np.unique(place)] += 1
        counts[1, int(label), np.unique(gram)] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], np.float64)
    rate = (counts + 0.5) / (n + 1)[None, :, None]
    seen = counts.sum(axis=1)
    odds = (np.log(rate[:, 1]) - np.log(rate[:, 0])) * (seen / (seen + SHRINK))
    return Tables(*odds.astype(np.float32))


def windows(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(document, first word, number of words) of all windows: overlapping, over every word; one at least a document."""
    out = []
    for d, n in enumerate(lengths):
        for start in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE):
            out.append((d, start, min(WINDOW, n - start)))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Network:
    """Weights: for each direction W (features to gates), U (state to gates), b; attention A, a; output o, o0."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {f"{k}{d}": rng.normal(0, 0.3, s).astype(np.float32) for d in "fb" for k, s in (("W", (FEATURES, 3 * h)), ("U", (h, 3 * h)), ("b", (3 * h,)))}
        self.p |= {"A": rng.normal(0, 0.3, (2 * h, POOL)).astype(np.float32), "a": rng.normal(0, 0.3, POOL).astype(np.float32), "o": rng.normal(0, 0.3, 2 * h).astype(np.float32), "o0": np.zeros(1, np.float32)}

    def project(self, features: np.ndarray) -> dict[str, np.ndarray]:
        """What each word gives to the gates of either direction."""
        return {d: features @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def _gru(self, d: str, table: np.ndarray, codes: np.ndarray, mask: np.ndarray | None, states: np.ndarray, keep: list | None) -> None:
        """Fills ``states`` [steps, windows, h]; a masked step leaves the state as it is. ``table``: projected inputs by code."""
        h, u = HIDDEN, self.p[f"U{d}"]
        gates, candidate = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        steps, n = codes.shape
        s = np.zeros((n, h), np.float32)
        x = np.empty((n, 3 * h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(table, codes[t], axis=0, out=x, mode="clip")
            zr = s @ gates
            zr += x[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            c = (r * s) @ candidate
            c += x[:, 2 * h :]
            np.tanh(c, out=c)
            step = c - s
            step *= z
            if mask is not None:
                step *= mask[t][:, None]
            if keep is not None:
                keep.append((t, s, z, r, c))
            s = s + step
            states[t] = s

    def forward(self, projected: dict[str, np.ndarray], codes: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows (rows of ``codes``); ``projected`` by code, the last row is for padding. Inside, steps come before windows."""
        p, h = self.p, HIDDEN
        codes, mask = np.ascontiguousarray(codes.T), np.ascontiguousarray(mask.T)
        some = None if mask.all() else mask
        both = np.empty((*codes.shape, 2 * h), np.float32)
        for d, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            steps = [] if keep is not None else None
            self._gru(d, projected[d], codes, some, both[:, :, at], steps)
            if keep is not None:
                keep[d] = steps
        hid = np.tanh(both @ p["A"])
        weight = np.exp(np.clip(hid @ p["a"], -30, 30))
        if some is not None:
            weight *= mask
        share = weight / (weight.sum(axis=0) + 1e-6)
        pooled = np.einsum("tn,tnh->nh", share, both)
        if keep is not None:
            keep |= {"both": both, "hid": hid, "share": share, "pooled": pooled}
        return pooled @ p["o"] + p["o0"][0]

    def backward(self, features: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        g = {"o": keep["pooled"].T @ slope, "o0": slope.sum(keepdims=True)}
        pooled = slope[:, None] * p["o"]
        both, share, hid = keep["both"], keep["share"], keep["hid"]
        along = (both * pooled).sum(axis=2)
        score = share * (along - (share * along).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", score, hid)
        inner = score[:, :, None] * p["a"] * (1 - hid**2)
        g["A"] = both.reshape(-1, 2 * h).T @ inner.reshape(-1, POOL)
        states = share[:, :, None] * pooled + inner @ p["A"].T
        for d, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = p[f"U{d}"]
            gw, gu, gb = np.zeros_like(p[f"W{d}"]), np.zeros_like(u), np.zeros(3 * h, np.float32)
            later = np.zeros((len(codes), h), np.float32)
            for t, s, z, r, c in reversed(keep[d]):
                later = later + states[t, :, at]
                m = mask[:, t, None]
                dz, dc = later * m * (c - s) * z * (1 - z), later * m * z * (1 - c**2)
                reset = dc @ u[:, 2 * h :].T
                dr = reset * s * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                x = features[codes[:, t]]
                gw += x.T @ gates
                gb += gates.sum(axis=0)
                gu[:, : 2 * h] += s.T @ gates[:, : 2 * h]
                gu[:, 2 * h :] += (r * s).T @ dc
                later = later * (1 - m * z) + reset * r + gates[:, : 2 * h] @ u[:, : 2 * h].T
            g |= {f"W{d}": gw, f"U{d}": gu, f"b{d}": gb}
        return g


class Remembered:
    """Features of the words that a worker has met, at most ``WORDS`` at a time."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, FEATURES), np.float32)

    def features(self, vocabulary: list[str]) -> np.ndarray:
        if len(self.place) > WORDS:
            self.forget()
        at = np.fromiter(map(self.place.get, vocabulary, repeat(-1)), np.int64, len(vocabulary))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [vocabulary[i] for i in new]
            at[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.rows = np.concatenate([self.rows, self.tables.features(fresh)])
            self.place.update(zip(fresh, at[new].tolist(), strict=True))
        return self.rows[at]


def _coded(texts: list[list[str]], tables: Tables | Remembered) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features by code, then each window's codes, mask and document."""
    flat = list(chain.from_iterable(texts))
    code, vocabulary = pd.factorize(np.array(flat, dtype=object))
    features = np.concatenate([tables.features(list(vocabulary)), np.zeros((1, FEATURES), np.float32)])
    base = np.cumsum([0, *map(len, texts)])
    win = np.array(windows([len(t) for t in texts]), np.int64)
    steps = max(1, int(win[:, 2].max()))
    at = base[win[:, 0]][:, None] + win[:, 1][:, None] + np.arange(steps)
    mask = np.arange(steps) < win[:, 2][:, None]
    codes = np.append(code, len(vocabulary))[np.where(mask, at, len(code))]
    return features, codes, mask.astype(np.float32), win[:, 0]


@dataclass
class Model:
    tables: Tables
    network: Network
    remembered: Remembered | None = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        self.remembered = self.remembered or Remembered(self.tables)
        best = np.full(len(texts), -np.inf)
        for i, j in spans_of([len(t or "") + 6 * WINDOW for t in texts], CHARS):
            features, codes, mask, doc = _coded([words_of(t) for t in texts[i:j]], self.remembered)
            projected = self.network.project(features)
            logits = np.zeros(len(doc))
            size = mask.sum(axis=1)
            order = np.argsort(size, kind="stable")  # short windows with short windows: no steps for padding only
            for k in range(0, len(order), 1024):
                own = order[k : k + 1024]
                steps = max(1, int(size[own[-1]]))
                logits[own] = self.network.forward(projected, codes[own, :steps], mask[own, :steps])
            np.maximum.at(best, doc + i, logits)
        return _sigmoid(best)


def train(texts: list[str], toxic: list[int]) -> Model | None:
    """The model for labelled texts, or None if they don't hold both labels."""
    label = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return None
    one: dict[str, str] = {}  # a word is held once, however often it occurs
    words = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    fold = np.zeros(len(words), np.int64)
    for value in (0, 1):
        own = np.flatnonzero(label == value)
        fold[own] = np.arange(len(own)) % 2
    parts = []
    for k in (0, 1):
        other, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(other) and len(own):
            parts.append((own, _coded([words[i] for i in own], fit_tables([words[i] for i in other], label[other]))))
    network, rng = Network(), np.random.default_rng(11)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    tick = 0
    rounds = max(EPOCHS, min(30, 30_000 // len(words)))
    for _ in range(rounds):
        for own, (features, codes, mask, doc) in parts:
            projected = network.project(features)
            logits = np.concatenate([network.forward(projected, codes[i : i + 2048], mask[i : i + 2048]) for i in range(0, len(codes), 2048)])
            order = np.lexsort((-logits, doc))
            top = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]  # each document's most toxic window
            y = label[own].astype(np.float32)
            weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
            for idx in np.array_split(rng.permutation(len(own)), max(1, len(own) // BATCH)):
                keep: dict = {}
                w = top[idx]
                out = _sigmoid(network.forward(network.project(features), codes[w], mask[w], keep))
                slope = ((out - y[idx]) * weight[idx] / len(idx)).astype(np.float32)
                tick += 1
                for k, g in network.backward(features, codes[w], mask[w], keep, slope).items():
                    g = np.clip(g, -1, 1)
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    network.p[k] = (network.p[k] - RATE * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)).astype(np.float32)
    return Model(fit_tables(words, label), network)


def held_out(id_col: str):
    """Rows that never train: the CRC-32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled documents outside the held-out third."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    pick = lambda y, n: known.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = F.broadcast(pick(1, sample // 2).unionByName(pick(0, sample // 2)))  # ``sample`` rows at most
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(chosen, id_col).groupBy(id_col, "__y").agg(F.max("__text").alias("__text")).orderBy(id_col).collect()
    return train([r["__text"] for r in rows], [r["__y"] for r in rows])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, column: str = "score", below: float | None = None) -> DataFrame:
    """Every row with its columns in ``keep`` (all by default) and its score; with ``below``, only rows that score less."""
    names = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*names, F.lit(0.0).alias(column))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            for i, j in spans_of(sizes, CHARS):
                part = batch.slice(i, j - i)
                values = sent.value.scores(part.column(part.num_columns - 1).to_pylist())
                out = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values, pa.float64())], names=[*names, column])
                yield out if below is None else out.filter(pa.array(values < below))

    rows = docs.select(*names, F.col(text_col).alias(fresh(docs, "__text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, `{column}` double")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    names = docs.columns
    return score(docs, fit(docs, labels, id_col, text_col), text_col, column=fresh(docs, "__score"), below=THRESHOLD).select(*names)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row of ``docs``."""
    out = score(docs, fit(docs, labels, id_col, text_col), text_col, keep=[id_col])
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
