"""Operator 8 by similarity: near-duplicates at `least` or more of common word shingles (Jaccard, as sets).

A short fingerprint of few differing bits finds copies with hardly a change; texts of similarity 0.8 differ in
one bit of seven. Here fingerprints are WIDE bits, and the distances to reference fingerprints (pivots) also
tell where to look:

1. The sums over shingles whose signs are the fingerprint's bits give the weighted Hamming distance to every
   pivot: what a bit weighs is how decided it is. The pivots of one table are the rows of a Hadamard matrix
   with random signs, so the distances to all of them come from one fast transform.
2. The nearest or farthest pivot of a table is kept by a near text far more often than by any other text. The
   choices of `tables` tables make a key; each text has `keys` keys, and texts meet in runs of one key. How
   many tables make a key follows the number of texts, so that runs stay short.
3. Within a run, pairs whose plain distances to the reference fingerprints differ by more than `bits` in any
   coordinate are discarded, survivors are compared bit by bit, and a run emits a spanning forest.
4. The forest's pairs are verified on the shingles of whole texts. Many near fingerprints are of texts that are
   less alike, so a tree that verification broke gives further pairs, in rounds: the near pairs of its next rows
   with all rows of other components, until every row had its turn. The sums themselves tell the similarity of such a pair
   to about 0.02, so pairs that seem to be SLACK or more below `least` are discarded before texts are read. What is linked in
   the end is what verifying all other near pairs of all runs would link.

Pairs are found with a probability: about 0.99 at similarity 0.8, nearer 1 above it. Defined results: as in
simhash_dedup; a text under `shingle_words` words has its whole word sequence as its one shingle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import shuffles_dropped, with_totals, written
from wayfold.llm.components import connected_components
from wayfold.llm.runs import forest, run_slices, whole_runs

WIDE = 256
SHINGLE_WORDS = 5
LEAST = 0.8
#: Keys of a text when two tables, or three, make a key.
KEYS = {2: 28, 3: 64}
#: Mean number of texts that are not alike in a run, from which on three tables make a key.
CROWD = 512
#: Bits that are compared, and the most that may differ: at similarity 0.8, 20 do, and 34 are over three deviations more.
COMPARED, BITS = 128, 34
#: Up to this length all pairs of a run are looked at in one sweep, which most runs have none to keep of.
SWEPT = 64
#: How far below `least` the similarity told by the sums may be; its error at 0.8 is about 0.02.
SLACK = 0.08
#: Rows of a broken tree that have their turn in its first round; each round takes GROWTH times as many as all before.
FIRST, GROWTH = 16, 4
#: Pairs that are handed on at once.
_PAIRS = 100_000
#: Pairs of a cell of verification, on average; texts whose shingles are kept while a cell is verified.
CELL_PAIRS, _KEPT = 1_000, 256
#: Shingles summed at once.
_CHUNK = 50_000
_SEED = 8
_DRAW = np.random.default_rng(_SEED)
_SIGNS = _DRAW.choice(np.array([-1, 1], np.float32), (max(t * n for t, n in KEYS.items()), WIDE))
_ODD = _DRAW.integers(1, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIVOTS = _DRAW.integers(-1 << 63, 1 << 63, (16, COMPARED // 64), dtype=np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_LANES = (np.arange(WIDE // 8) * 256)[None, :]


def shingles(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a word sequence, ascending."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(len(words) - shingle_words + 1, 1)
    starts = [0, *(blanks[: n - 1] + 1).tolist()]
    ends = [*blanks[shingle_words - 1 :].tolist(), len(joined)] if n > 1 else [len(joined)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[i:j], _SEED) for i, j in zip(starts, ends, strict=True)), np.uint64, n))


def sums(hashes: np.ndarray) -> np.ndarray:
    """For each of WIDE bits, the shingles that set it less those that do not."""
    seen = np.zeros(_LANES.size * 256, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK, None]
        mixed = (part ^ (part >> np.uint64(31))) * _ODD[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        seen += np.bincount((mixed.view(np.uint8).reshape(len(part), -1) + _LANES).ravel(), minlength=len(seen))
    return (2 * (seen.reshape(-1, 256) @ _BITS).ravel() - len(hashes)).astype(np.float32)


def transformed(x: np.ndarray) -> np.ndarray:
    """Products of the rows of x (..., WIDE) with every row of the Hadamard matrix."""
    shape, half = x.shape, 1
    while half < WIDE:
        pair = x.reshape(-1, WIDE // (2 * half), 2, half)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2)
        half *= 2
    return x.reshape(shape)


def nearest(vectors: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables): the pivot, twice, plus 1 if it is the farthest: a product is the total weight less twice the distance."""
    out = np.empty((len(vectors), tables), np.uint64)
    for t in range(tables):
        near = transformed(vectors * _SIGNS[t])
        at = np.abs(near).argmax(axis=1)
        out[:, t] = 2 * at + (near[np.arange(len(near)), at] < 0)
    return out


def keys_of(vectors: np.ndarray, tables: int) -> np.ndarray:
    """(rows, KEYS[tables]) long keys."""
    picks = nearest(vectors, tables * KEYS[tables]).reshape(len(vectors), KEYS[tables], tables)
    out = np.broadcast_to(np.arange(KEYS[tables], dtype=np.uint64), picks.shape[:2])
    for t in range(tables):
        out = out * np.uint64(2 * WIDE) + picks[:, :, t]
    return out.view(np.int64)


def tables_for(n: int) -> int:
    """Tables that make a key, for `n` texts."""
    return min(KEYS) if n <= CROWD * (2 * WIDE) ** min(KEYS) else max(KEYS)


def bits(vectors: np.ndarray) -> np.ndarray:
    """(rows, COMPARED / 64) longs of signs."""
    return np.packbits(vectors[:, :COMPARED] > 0, axis=1).view(np.int64)


def levels(vectors: np.ndarray) -> np.ndarray:
    """(rows, WIDE) sums in steps of a 127th of the row's largest."""
    return np.rint(vectors * (127 / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1))).astype(np.int8)


def seeming(units: np.ndarray, counts: np.ndarray, at: int, rest: np.ndarray) -> np.ndarray:
    """The similarity of row `at` with the rows `rest`, told by their sums (as unit vectors) and numbers of shingles."""
    common = units[rest] @ units[at] * np.sqrt(counts[rest] * counts[at])
    return common / np.maximum(counts[rest] + counts[at] - common, 1)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int16)


def distances(wide: np.ndarray) -> np.ndarray:
    """(rows, pivots): differing bits to the reference fingerprints."""
    return np.stack([differing(wide, p) for p in _PIVOTS], axis=1)


def near(wide: np.ndarray, table: np.ndarray, at: int, rest: np.ndarray, most: int = BITS) -> np.ndarray:
    """Which of the rows `rest` differ from row `at` in `most` bits or fewer."""
    out = (np.abs(table[rest] - table[at]) <= most).all(axis=1)
    out[out] = differing(wide[rest[out]], wide[at]) <= most
    return out


def linked(wide: np.ndarray, most: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest, as indices, of the pairs of fingerprints (rows of longs) at `most` differing bits or fewer."""
    table = distances(wide)
    return forest(len(wide), lambda at, rest: near(wide, table, at, rest, most))


def swept(k: np.ndarray, wide: np.ndarray, most: int = BITS) -> Iterator[slice]:
    """The runs of `k` that may have a near pair: those over SWEPT rows, and those in which a pair is near."""
    hit = np.zeros(len(k), bool)
    at = np.arange(len(k))
    for d in range(1, SWEPT):
        at = at[at + d < len(k)]
        at = at[k[at] == k[at + d]]
        if not len(at):
            break
        hit[at[differing(wide[at], wide[at + d]) <= most]] = True
    for run in run_slices(k):
        if run.stop - run.start > SWEPT or hit[run].any():
            yield run


_LONGS = [f"w{i}" for i in range(COMPARED // 64)]


def trees(distinct: DataFrame, most: int = BITS) -> DataFrame:
    """(tree, node, parent, size, w0..): forests of near fingerprints, run by run, over distinct texts (node, wide, keys).

    A tree of a run has all its rows: near rows of a run are in one tree. The root's parent is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_runs(batches, "k"):
            k, node, wide, rows = block["k"].to_numpy(), block["node"].to_numpy(), block[_LONGS].to_numpy(), []
            for at in swept(k, wide, most):
                root: dict[int, int] = {}
                size: dict[int, int] = {}
                up = linked(wide[at], most)
                for i, j in up:
                    r = root[j] = root.setdefault(i, i)
                    size[r] = size.get(r, 1) + 1
                parent = {j: i for i, j in up}
                for i, r in root.items():
                    above = node[at.start + parent[i]] if i in parent else None
                    rows.append((k[at.start], node[at.start + r], node[at.start + i], above, size[r], *wide[at.start + i]))
            out = pd.DataFrame(rows, columns=["k", "root", "node", "parent", "size", *_LONGS], dtype=object)
            yield out.astype({c: np.int64 for c in out if c != "parent"} | {"parent": "Int64"})

    rows = distinct.select(F.explode("keys").alias("k"), "node", *[F.get("wide", F.lit(i)).alias(w) for i, w in enumerate(_LONGS)])
    kinds = ", ".join(f"{c} bigint" for c in ("k", "root", "node", "parent", "size", *_LONGS))
    found = rows.repartition("k").sortWithinPartitions("k", "node").mapInPandas(run, kinds)
    return found.select(F.xxhash64("k", "root").alias("tree"), "node", "parent", "size", *_LONGS)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def further(broken: DataFrame, first: int, last: int, least: float = LEAST, most: int = BITS) -> DataFrame:
    """(a, b): the near pairs of the rows `first` to `last` of each tree with later rows of other components, but for those that seem too little alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_runs(batches, "tree"):
            node, component, wide = block["node"].to_numpy(), block["component"].to_numpy(), block[_LONGS].to_numpy()
            units = np.frombuffer(b"".join(block["levels"]), np.int8).reshape(len(node), WIDE).astype(np.float32)
            units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1)
            table, counts, found, n = distances(wide), block["shingles"].to_numpy(), [], 0
            for tree in run_slices(block["tree"].to_numpy()):
                for i in range(min(tree.start + first, tree.stop), min(tree.start + last, tree.stop)):
                    rest = np.arange(i + 1, tree.stop)
                    rest = rest[component[rest] != component[i]]
                    rest = rest[near(wide, table, i, rest, most)]
                    rest = rest[seeming(units, counts, i, rest) > least - SLACK]
                    found.append(pd.DataFrame({"a": np.full(len(rest), node[i]), "b": node[rest]}))
                    n += len(rest)
                    if n > _PAIRS:
                        yield pd.concat(found)
                        found, n = [], 0
            if found:
                yield pd.concat(found)

    return _ordered(broken.repartition("tree").sortWithinPartitions("tree", "node").mapInPandas(run, "a bigint, b bigint"))


def alike(distinct: DataFrame, texts: Callable[[DataFrame], DataFrame], least: float = LEAST, most: int = BITS) -> DataFrame:
    """(a, b): verified pairs that link what all verified near pairs of all runs link; texts(pairs) are the (node, text) of their ends."""
    with shuffles_dropped(distinct.sparkSession):
        return _alike(distinct, texts, least, most)


def _alike(distinct: DataFrame, texts: Callable[[DataFrame], DataFrame], least: float, most: int) -> DataFrame:
    found = written(trees(distinct, most))
    pairs = written(_ordered(found.where("parent is not null").select(F.col("parent").alias("a"), F.col("node").alias("b"))))
    good, tried = written(verified(pairs, texts(pairs), least)), pairs
    # In a tree of two rows the one pair was tried.
    rest, first, last = found.where("size > 2").select("tree", "node", *_LONGS), 0, FIRST
    told, more = distinct.select("node", "levels", "shingles"), True
    while True:
        # Where nothing more was linked, components are what they were, and trees only drop out by their length.
        if more:
            named = connected_components(good).select(F.col("node").alias("_n"), "component")
            rows = rest.join(named, rest.node == F.col("_n"), "left").select("tree", "node", F.coalesce("component", "node").alias("component"), *_LONGS)
            whole = rows.groupBy("tree").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
            broken = written(with_totals(rows, whole.where(F.col("x") != F.col("y")).where(F.col("n") > first + 1).select("tree", "n"), "tree"))
        else:
            broken = broken.where(F.col("n") > first + 1)
        longest = broken.agg(F.max("n")).first()[0]
        if longest is None:
            return good
        if more:
            rest = broken.select("tree", "node", *_LONGS)
            told = written(told.join(rest.select("node").distinct(), "node", "left_semi"))
        while True:
            pairs = written(further(broken.join(told, "node"), first, last, least, most).join(tried, ["a", "b"], "left_anti"))
            first, last = last, last * (GROWTH + 1)
            if not pairs.isEmpty():
                break
            if first >= longest - 1:
                return good
        tried = tried.unionByName(pairs)
        fresh = written(verified(pairs, texts(pairs), least))
        more = not fresh.isEmpty()
        good = good.unionByName(fresh) if more else good


def dealt(pairs: DataFrame, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """`pairs` (a, b) with their cell: cells of about so many pairs, all of a leaf's in one, and as many cells for a hub as its pairs fill.

    Of a pair's ends the leaf is the one that is in fewer pairs."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    degree = ends.groupBy("node").agg(F.count("*").alias("pairs"))
    of = lambda end: degree.select(F.col("node").alias(end), F.col("pairs").alias(f"{end}_pairs"))
    known = with_totals(with_totals(pairs, of("a"), "a"), of("b"), "b")
    leaf = F.when(F.col("a_pairs") < F.col("b_pairs"), F.col("a")).otherwise(F.col("b"))
    cells = max(1, -(-pairs.count() // cell_pairs))
    return known.select("a", "b", F.pmod(F.xxhash64(leaf), F.lit(cells)).cast("int").alias("cell"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) whose whole texts (node, text binary) have `least` or more of their shingles in common.

    Pairs are dealt out to cells as ids; each cell is sent the text of each of its nodes once. So a leaf's text moves once, and a hub's once for
    each CELL_PAIRS of its pairs."""

    def run(key: tuple, own: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(text["node"], text["text"], strict=True))
        whole = lru_cache(_KEPT)(lambda node: shingles(texts[node].lower().split(), shingle_words))
        good = []
        # By the end that has the most pairs here first, so that its shingles are at hand.
        times = pd.concat([own["a"], own["b"]]).value_counts()
        hub = np.where(own["a"].map(times) >= own["b"].map(times), own["a"], own["b"])
        own = own.iloc[np.argsort(hub, kind="stable")]
        for a, b in zip(own["a"], own["b"], strict=True):
            s, t = whole(a), whole(b)
            common = len(np.intersect1d(s, t, assume_unique=True))
            good.append(common >= least * (len(s) + len(t) - common))
        return own.loc[np.array(good, bool), ["a", "b"]]

    pairs = written(dealt(pairs))
    wanted = pairs.select(F.col("cell").alias("of"), F.col("a").alias("node")).union(pairs.select("cell", "b")).distinct()
    sent = wanted.join(texts, "node")
    return pairs.groupBy("cell").cogroup(sent.groupBy("of")).applyInPandas(run, "a bigint, b bigint")
