"""MinHash near-deduplication by HyperMinHash registers.

1. A text's set: the distinct runs of five lower-cased words, as 64-bit hashes. Texts with equal sets
   form one class; everything after works on one text a class.
2. HyperMinHash: hashes fall into 128 buckets by their first bits; of each bucket's least hash a
   register keeps the number of leading zeros (6 bits) and ten bits after the leading one. Empty
   buckets borrow from others in a fixed random order (the same for all texts).
3. Candidates: 32 bands of four registers. Classes that share no band with another one are done.
4. The others meet in rounds, over 1, 2, 5 and 24 bands. In a band's bucket one class of each component
   so far meets one leader drawn at random (a star, no pairs), another one in each band; a pair that
   has been tried isn't tried again.
5. The share of equal registers, corrected for chance collisions, estimates the similarity; pairs
   far below the threshold (four standard errors) go no further.
6. The rest is confirmed on full sets: 100 * |intersection| >= 75 * |union|. Confirmed links join
   components (label passing on distributed tables, over components, not classes).
7. What a star can't see: in buckets that still hold several components, all pairs across them, with
   none left out. The largest component's classes meet the others', not each other. Both are cut into
   blocks of 256 classes; each pair of blocks compares its registers, and small sets' 32-bit hashes, in
   one task, which sends on only pairs that pass, each from the first bucket that the two share.
   Then 6 again.
8. A bucket of very many components (a passage that many texts share) isn't compared as such: before
   7, its classes are dealt anew by the rarest shingles of their full sets. Linked sets of n have
   n - ceil(0.75 n) + 1 rarest ones that can't all be missing in the other (prefix filtering, one
   order for all), so no link is lost, and texts with nothing in common but the passage don't meet.
   These buckets go through a star and blocks as well.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6, and its estimate lies four
standard errors below with about 3e-5: it is missed with 4e-5 at most, a pair above the threshold more rarely.

Defined results: null, empty or white-space texts have an empty set and are linked with nothing;
fewer than five words are one shingle; rows with equal ids are nodes of their own by text; a null id
never is a component's smallest unless all of its ids are null; an empty table gives no rows; other
columns are ignored. ``deduplicate`` keeps of each component the text of the smallest id (of several
under it, and where all ids are null, the one of the smallest hash), and every row of that id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import bucketed, mix64, parts, powers, salted_join, small_or_shuffled, spans_of, written

WORDS, SIMILAR = 5, 75
REGISTERS, BANDS = 128, 32
ROUNDS = (range(0, 1), range(1, 3), range(3, 8), range(8, 32))
MANTISSA = 10
SLACK = 4.0
BLOCK = 256
#: Buckets with more blocks than this outside their largest component are dealt anew by rare shingles; links are the same.
HOT_BLOCKS = 8
#: Sets up to this size go along as 32-bit hashes where pairs are compared in blocks.
SMALL_SET = 256
CHARS = 1_000_000

#: Groups up to this size are compared side by side, so many pairs at a time.
FEW, PAIRS = 48, 100_000
#: Makes from rows what tells, of pairs of them by number and their buckets, which may link and how much these differ.
Near = Callable[[pd.DataFrame], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct hashes of ``words`` words in a row, ascending: whole batches by array operations on their bytes."""
    data = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = _LOWER[np.frombuffer(b"".join(data), np.uint8)]
    space = _SPACE[raw]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    with np.errstate(over="ignore"):
        power, inverse = powers(len(raw) + 1, _BASE)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * power[:-1], dtype=np.uint64)])
        word = mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        limits = np.searchsorted(begin, np.cumsum([len(d) for d in data]))
        out, start = [], 0
        for stop in limits:
            n = stop - start
            if n <= 0:
                out.append(np.zeros(0, np.uint64))
            else:
                k = min(words, n)
                rolled = np.full(n - k + 1, k, np.uint64)
                for i in range(k):
                    rolled = mix64(rolled * np.uint64(31) + word[start + i : start + i + n - k + 1])
                out.append(np.unique(rolled))
            start = stop
    return out


def set_name(items: np.ndarray) -> np.int64:
    """A set's 64-bit name."""
    with np.errstate(over="ignore"):
        return mix64(np.array([items.sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix64(items ^ np.uint64(_BASE))) * np.uint64(31) + np.uint64(len(items))], np.uint64)).view(np.int64)[0]


_ROUNDS = 256


def _borrow() -> np.ndarray:
    """Where an empty bucket looks, try by try; the last tries go round all buckets."""
    rng = np.random.default_rng(20240)
    tries = rng.integers(0, REGISTERS, (_ROUNDS, REGISTERS))
    around = (np.arange(REGISTERS)[None, :] + np.arange(REGISTERS)[:, None]) % REGISTERS
    return np.concatenate([tries, around])


_TRIES = _borrow()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 128 16-bit registers for each set; sets without elements get zeros."""
    shift = np.uint64(64 - REGISTERS.bit_length() + 1)
    edges = (np.arange(REGISTERS, dtype=np.uint64) << shift).astype(np.uint64)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for row, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        has = np.diff(np.r_[at, len(s)]) > 0
        full[row] = has
        least[row, has] = s[at[has]]
    rest = least & ((np.uint64(1) << shift) - np.uint64(1))
    mantissa, exponent = np.frexp(rest.astype(np.float64) + 1)
    zeros = np.clip(int(shift) - exponent + 1, 0, 63).astype(np.uint16)
    bits = ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
    out = (zeros << np.uint16(MANTISSA)) | bits
    alive = full.any(axis=1)
    todo_row, todo_col = np.nonzero(~full & alive[:, None])
    for attempt in range(len(_TRIES)):
        if not len(todo_row):
            break
        source = _TRIES[attempt][todo_col]
        hit = full[todo_row, source]
        out[todo_row[hit], todo_col[hit]] = out[todo_row[hit], source[hit]]
        todo_row, todo_col = todo_row[~hit], todo_col[~hit]
    out[~alive] = 0
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Each row's 32 band hashes: four registers and the band's number."""
    four = np.ascontiguousarray(regs.astype("<u2")).view("<u8")
    with np.errstate(over="ignore"):
        return mix64(mix64(four.astype(np.uint64)) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal registers, less the share that collides by chance (after the HyperMinHash paper)."""
    share = (a == b).mean(axis=-1)
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    chance = 0.169919487159739 * (4 * ratio / (1 + ratio) ** 2) / (1 << MANTISSA)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Not below the threshold by more than four standard errors, and of sizes that allow a link."""
    j = SIMILAR / 100
    # Small sets fill few buckets, so fewer registers are independent.
    own = np.minimum(REGISTERS, np.maximum(1, np.minimum(n, m)))
    return (estimate(a, b, n, m) >= j - SLACK * np.sqrt(j * (1 - j) / own)) & (100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m))


def _small_link(a: np.ndarray | None, b: np.ndarray | None) -> bool:
    """False only if 32-bit hashes of both sets show that the threshold isn't met (one chance collision allowed for)."""
    if a is None or b is None:
        return True
    both = len(np.intersect1d(a, b, assume_unique=True)) + 1
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __hash, __n, __node, __regs, __small``: text hash, set size, the set's 64-bit name, registers and, of a small set, 32-bit hashes; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["__text"].tolist()
            for i, j in spans_of([len(t) for t in texts], CHARS):
                sets = shingle_sets(texts[i:j])
                node = [set_name(s) for s in sets]
                yield pd.DataFrame({"__id": batch["__id"].iloc[i:j].astype("Int64"), "__hash": batch["__hash"].iloc[i:j], "__n": [len(s) for s in sets], "__node": node, "__regs": [r.tobytes() for r in registers(sets)], "__small": [np.unique(s.astype(np.uint32)).tobytes() if len(s) <= SMALL_SET else b"" for s in sets]})

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.withColumn("__hash", F.xxhash64("__text")).mapInPandas(run, "__id long, __hash long, __n long, __node long, __regs binary, __small binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """``band, key, node``: 32 rows a class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = band_keys(np.frombuffer(b"".join(batch["regs"]), "<u2").reshape(len(batch), REGISTERS))
                yield pd.DataFrame({"band": np.tile(np.arange(BANDS, dtype=np.int32), len(batch)), "key": keys.ravel(), "node": np.repeat(batch["node"].to_numpy(), BANDS)})

    return classes.select("node", "regs").mapInPandas(run, "band int, key long, node long")


def shared_rows(buckets: DataFrame) -> DataFrame:
    """The rows of buckets with two classes and more."""
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    return buckets.join(several, "key")


def star_pairs(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b, ca, cb``: in each bucket, one class of every component with the bucket's leader, and their components.

    Leader and classes are those whose names, crossed with the bucket's, are least: others in each bucket.
    """
    rank = F.col("node").bitwiseXOR(F.col("key"))
    one = shared.join(labels, "node").groupBy("key", "comp").agg(F.min(rank).alias("rank"))
    lead = one.groupBy("key").agg(F.min(F.struct("rank", "comp")).alias("lead"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", "lead")
    pair = one.join(lead, "key").where("comp <> lead.comp")
    end = lambda rank, comp: F.struct(F.col(rank).bitwiseXOR(F.col("key")).alias("node"), F.col(comp).alias("comp"))
    pair = pair.select(end("rank", "comp").alias("x"), end("lead.rank", "lead.comp").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return pair.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct()


_PAIR = "a long, b long, ca long, cb long"


def _hopeful(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that the registers don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(len(batch), REGISTERS) for c in ("x", "y"))
                yield batch.loc[may_link(x, y, batch["n"].to_numpy(), batch["m"].to_numpy()), ["a", "b", "ca", "cb"]]

    left = nodes.select(F.col("node").alias("a"), F.col("n"), F.col("regs").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("regs").alias("y"))
    near = pairs.join(left, "a").join(right, "b").where(f"100 * least(n, m) >= {SIMILAR} * greatest(n, m)")
    return near.select("a", "b", "ca", "cb", "n", "m", "x", "y").mapInPandas(run, _PAIR)


def full_sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``node, items``: the full sets of ``nodes``, one text each; no others are made. A table in buckets by node: pairs go to it, not it to them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["__text"].tolist()
            for i, j in spans_of([len(t) for t in texts], CHARS):
                yield pd.DataFrame({"node": batch["__node"].iloc[i:j], "items": [s.tobytes() for s in shingle_sets(texts[i:j], words)]})

    needed = small_or_shuffled(nodes.select(F.col("node").alias("__node"), "class_id", "hash"))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    chosen = rows.join(needed, rows["__id"].eqNullSafe(needed["class_id"]) & (F.xxhash64("__text") == needed["hash"]))
    one = chosen.select("__node", "__text").repartition(parts(docs.sparkSession), "__node").dropDuplicates(["__node"])
    return bucketed(one.mapInPandas(run, "node long, items binary"), "minhash-sets", "node")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= similar * (len(p) + len(q) - both))
            yield batch.loc[keep, ["a", "b", "ca", "cb"]]

    asked = small_or_shuffled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    some = sets.join(asked, "node", "left_semi")
    full = pairs.join(some.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return full.select("a", "b", "ca", "cb", "x", "y").mapInPandas(compare, _PAIR)


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node in some link: the least node that it reaches. Label passing with jumps, a table a round."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = written(links.select(F.inline(both)).distinct(), "links")
    labels = written(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = ways.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        nearer = written(nearer.join(jump, "comp").select("node", F.least("comp", "beyond").alias("comp"), (F.least("comp", "beyond") < F.col("old")).alias("moved")), "labels")
        labels = nearer.select("node", "comp")
        if not nearer.where("moved").limit(1).count():
            return labels


def mixed_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, main, others, mains``: buckets that still hold several components, the largest of these, and the blocks outside and inside it."""
    parts_of = shared.join(labels, "node").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "comp"))
    several = parts_of.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"), largest.alias("main")).where("comps > 1 AND size > 2")  # of two classes one is the leader
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    return several.select("key", F.col("main.comp").alias("main"), blocks(F.col("size") - F.col("main.n")).alias("others"), blocks(F.col("main.n")).alias("mains"))


def rare_buckets(some: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """``key, node``: the rarest shingles among ``some`` nodes of each one's set, so many that sets similar enough share one.

    Shingles of one set alone are rarest of all and lead to no other; of those that several sets have,
    what is left of the number goes on, and a set with more of the former than that has no link here.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["items"].str.len().to_numpy() // 8
            for i, j in spans_of(sizes.tolist(), CHARS):
                yield pd.DataFrame({"key": np.frombuffer(b"".join(batch["items"].iloc[i:j]), "<i8"), "node": np.repeat(batch["node"].to_numpy()[i:j], sizes[i:j]), "size": np.repeat(sizes[i:j], sizes[i:j])})

    items = written(sets.join(some, "node", "left_semi").mapInPandas(spread, "key long, node long, size long"), "minhash-items")
    often = written(items.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "minhash-often")
    met = salted_join(items, often, "key", "uses", "node", per=50_000).where("uses IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("uses", "key"))
    ranked = met.select("key", "node", "size", rank.alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("common"))
    return ranked.where(f"rank <= common - (size * {similar} + 99) div 100 + 1").select("key", "node")


def near_registers(banded: bool) -> Near:
    """By registers and small sets; of bands' buckets, each pair from the first bucket that the two share."""

    def of(rows: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        regs, n = np.frombuffer(b"".join(rows["regs"]), "<u2").reshape(len(rows), REGISTERS), rows["n"].to_numpy()
        small = [np.frombuffer(x, "<u4") if x else None for x in rows["small"]]
        keys = band_keys(regs)

        def near(i: np.ndarray, j: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            left = np.arange(len(i))
            if banded:
                first = np.argmax(keys[i] == keys[j], axis=1)
                left = left[keys[i, first] == key]
            left = left[may_link(regs[i[left]], regs[j[left]], n[i[left]], n[j[left]])]
            left = left[[_small_link(small[i[k]], small[j[k]]) for k in left]] if len(left) else left
            return left, (regs[i[left]] != regs[j[left]]).sum(axis=1)

        return near

    return of


def across(shared: DataFrame, labels: DataFrame, nodes: DataFrame, mixed: DataFrame, of: Near, nearest: bool = False) -> DataFrame:
    """Hopeful pairs of different components within the ``mixed`` buckets; ``of`` tells which pairs of a block's rows may link.

    ``nearest``: of a block, for each class and component only the pair that differs least.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            one = rows[["key", "lo", "hi"]].to_numpy()
            group = np.cumsum(np.r_[False, (one[1:] != one[:-1]).any(axis=1)])
            whole = int(np.searchsorted(group, group[-1]))
            yield pairs(rows.iloc[:whole], group[:whole])
            held = rows.iloc[whole:]
        if held is not None:
            yield pairs(held, np.zeros(len(held), np.int64))

    def pairs(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """All pairs of whole groups: small groups side by side, by their rows' distance; large ones piece by piece."""
        found = [np.zeros((0, 5), np.int64)]
        if len(rows):
            size = np.bincount(group)[group]
            few = size <= FEW
            found += by_distance(rows[few], group[few])
            for g in np.unique(group[~few]):
                found += by_pieces(rows[group == g])
        out = np.concatenate(found)
        return pd.DataFrame(out[:, :4], columns=["a", "b", "ca", "cb"])

    def picked(rows: pd.DataFrame):
        """What keeps, of pairs of rows by number, those that may link."""
        near, key, comp, node = of(rows), *(rows[c].to_numpy() for c in ("key", "comp", "node"))

        def keep(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            pick = comp[i] != comp[j]
            i, j = i[pick], j[pick]
            left, far = near(i, j, key[i])
            i, j = i[left], j[left]
            if nearest:
                order = np.lexsort((far, comp[j], node[i], key[i]))
                i, j, far = i[order], j[order], far[order]
                best = np.r_[True, (key[i][1:] != key[i][:-1]) | (node[i][1:] != node[i][:-1]) | (comp[j][1:] != comp[j][:-1])][: len(i)]
                i, j, far = i[best], j[best], far[best]
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            return np.stack([node[i], node[j], comp[i], comp[j], far], axis=1)

        return keep

    def by_distance(rows: pd.DataFrame, group: np.ndarray) -> list[np.ndarray]:
        if not len(rows):
            return []
        keep, place, alone = picked(rows), rows["block"].to_numpy(), (rows["lo"] == rows["hi"]).to_numpy()
        firsts, seconds = [], []
        for d in range(1, FEW):
            i = np.flatnonzero(group[:-d] == group[d:])
            if not len(i):
                break
            i = i[alone[i] | (place[i] != place[i + d])]
            firsts.append(i)
            seconds.append(i + d)
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (firsts, seconds))
        order = np.argsort(group[i], kind="stable")  # a group's pairs together
        i, j = i[order], j[order]
        return [keep(i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]

    def by_pieces(rows: pd.DataFrame) -> list[np.ndarray]:
        keep, place, (lo, hi) = picked(rows), rows["block"].to_numpy(), rows[["lo", "hi"]].iloc[0]
        one, two = np.flatnonzero(place == lo), np.flatnonzero(place == hi)
        out = []
        for start in range(0, len(one), 64):
            i, j = (v.ravel() for v in np.meshgrid(one[start : start + 64], two, indexing="ij"))
            if lo == hi:
                i, j = i[i < j], j[i < j]
            out.append(keep(i, j))
        return out

    rows = shared.select("key", "node").join(mixed, "key").join(labels, "node").join(nodes.drop("class_id", "hash"), "node")
    # Blocks of the others come first, those of the largest component last; its blocks meet others' blocks only.
    place, is_main = F.xxhash64("node"), F.col("comp") == F.col("main")
    rows = rows.withColumn("block", F.when(is_main, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(is_main, 0).otherwise(F.col("mains")))))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    rows = rows.select("key", "lo", "hi", "block", "node", "comp", *[c for c in nodes.columns if c not in ("node", "class_id", "hash")])
    return rows.repartition(parts(shared.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(run, _PAIR)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the components that ``links`` join are one."""
    moved = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    return written(labels.join(small_or_shuffled(moved), "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")), "minhash-labels")


class Grouping:
    """Labels of nodes (``node, comp``), joined by links that stars and blocks find and full sets confirm."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, hopeful: Callable[[DataFrame], DataFrame], similar: int = SIMILAR) -> None:
        self.nodes, self.sets, self.hopeful, self.similar = nodes, sets, hopeful, similar
        self.labels = small_or_shuffled(written(nodes.select("node", F.col("node").alias("comp")), "minhash-labels"))
        self.tried: DataFrame | None = None

    def _link(self, pairs: DataFrame) -> None:
        self.labels = small_or_shuffled(_joined(self.labels, confirmed(pairs, self.sets, self.similar)))

    def star(self, rows: DataFrame) -> None:
        """One class of each component of a bucket with its leader; pairs that were tried aren't again."""
        pairs = star_pairs(rows, self.labels)
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "minhash-star")
        self.tried = pairs.select("a", "b") if self.tried is None else self.tried.unionByName(pairs.select("a", "b"))
        near = written(self.hopeful(pairs), "minhash-hopeful")
        if near.limit(1).count():
            self._link(near)

    def compare(self, rows: DataFrame, mixed: DataFrame, of: Near) -> None:
        """All pairs across components in ``mixed`` buckets, in blocks.

        First each class tries the nearest one of every other component of its block, which joins most
        of what belongs together; then all pairs that are still apart and weren't tried.
        """
        for nearest in (True, False):
            pairs = across(rows, self.labels, self.nodes, mixed, of, nearest).distinct()
            pairs = written(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "minhash-across")
            if not pairs.limit(1).count():
                break
            self._link(pairs)
            if nearest:
                self.tried = pairs.select("a", "b") if self.tried is None else self.tried.unionByName(pairs.select("a", "b"))
                mixed = written(mixed_buckets(rows.join(small_or_shuffled(mixed.select("key")), "key", "left_semi"), self.labels), "minhash-mixed")

    def finish(self, shared: DataFrame, of: Near, of_rare: Near) -> DataFrame:
        """What the stars left: hot buckets dealt anew by rare items, then all other mixed ones. The labels as they are after each step count."""
        mixed = written(mixed_buckets(shared, self.labels), "minhash-mixed")
        hot = mixed.where(F.col("others") > HOT_BLOCKS)
        if hot.limit(1).count():
            hot_keys = small_or_shuffled(hot.select("key"))
            some = shared.join(hot_keys, "key", "left_semi").select("node").distinct()
            rare = written(shared_rows(rare_buckets(some, self.sets, self.similar)), "minhash-rare")
            self.star(rare)
            self.compare(rare, written(mixed_buckets(rare, self.labels), "minhash-mixed"), of_rare)
            cold = mixed.where(F.col("others") <= HOT_BLOCKS).select("key")
            mixed = written(mixed_buckets(shared.join(small_or_shuffled(cold), "key", "left_semi"), self.labels), "minhash-mixed")
        self.compare(shared, mixed, of)
        return self.labels


def member_rows(sketches: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``__id, __hash, __n, best`` of every row; ``best`` is its component's smallest id with that text's hash."""
    named = classes.join(labels, "node", "left").select("node", "size", "best", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("best").alias("best"))
    named = named.drop("best").join(least, "comp").select(F.col("node").alias("__node"), "size", "best")
    return salted_join(sketches.select("__id", "__hash", "__n", "__node"), named, "__node", "size", "__id", per=50_000)


def best_row() -> Column:
    """Aggregate: the least id of a class (a null one after all others) with its text's hash."""
    return F.min(F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__hash").alias("hash")))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __hash, __n, best`` of every row; ``best`` is its component's smallest id with that text's hash."""
    sketches = written(sketch(docs, id_col, text_col), "minhash-sketches")
    some = sketches.where("__n > 0")
    classes = some.groupBy(F.col("__node").alias("node")).agg(best_row().alias("best"), F.count(F.lit(1)).alias("size"), F.max("__n").alias("n"), F.first(F.struct("__regs", "__small")).alias("s"))
    classes = written(classes.select("node", "best", "size", "n", F.col("s.__regs").alias("regs"), F.col("s.__small").alias("small")), "minhash-classes")
    shared = written(shared_rows(bucket_rows(classes)), "minhash-shared")
    nodes = classes.join(shared.select("node").distinct(), "node", "left_semi")
    nodes = written(nodes.select("node", F.col("best.id").alias("class_id"), F.col("best.hash").alias("hash"), "n", "regs", "small"), "minhash-nodes")
    sets = full_sets(nodes, docs, id_col, text_col)
    grouping = Grouping(nodes, sets, lambda pairs: _hopeful(pairs, nodes))
    for bands in ROUNDS:
        grouping.star(shared.where(F.col("band").between(bands.start, bands.stop - 1)))
    return member_rows(sketches, classes, grouping.finish(shared, near_registers(True), near_registers(False)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row."""
    component = F.when(F.col("__n") > 0, F.col("best.id")).otherwise(F.col("__id"))
    return _grouped(docs, id_col, text_col).select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("__id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    other = ~F.col("best.id").eqNullSafe(F.col("__id")) | (F.col("best.hash") != F.col("__hash"))
    gone = _grouped(docs, id_col, text_col).where((F.col("__n") > 0) & other).select(F.col("__id").alias("__gone_id"), F.col("__hash").alias("__gone_hash")).distinct()
    gone = small_or_shuffled(written(gone, "minhash-gone"))
    same = docs[id_col].cast("long").eqNullSafe(gone["__gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["__gone_hash"])
    return docs.join(gone, same, "left_anti")
