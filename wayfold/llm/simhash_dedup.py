"""Operator 8: SimHash near-duplicates with pivot distance tables.

1. One fingerprint a document, in Arrow batches. Documents with one fingerprint are linked without any
   pair: from here on work is on distinct fingerprints.
2. Every distinct fingerprint gets its Hamming distances to a table of reference fingerprints (pivots).
3. Two fingerprints at `max_bits` or fewer differing bits agree in at least `blocks - max_bits` of `blocks`
   blocks of bits, so they meet in a run of rows with one key (the agreeing blocks). The number of blocks
   follows the number of fingerprints, so that runs stay short; every choice is exact.
4. Within a run, pairs whose pivot distances differ by more than `max_bits` in any coordinate are
   discarded (triangle inequality), survivors are verified bit by bit, and a run emits a spanning forest
   of its links: never more rows than fingerprints, whatever the number of pairs.
5. Connected components over the forest edges; the class id is the smallest document id.

classes() links fingerprints at few differing bits. keep_one(), which removes near-duplicates from a corpus,
also links texts with 0.8 or more of their five-word shingles in common, which mostly differ in more bits
(simhash_similar has how they are found).

keep_one() tells rows apart by 128 bits of hash over id and text, and texts by 128 bits over their words.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; repeated rows share
a class; null ids take part and never name a class unless all its ids are null; an empty table gives no
rows; other columns of the input are not read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import simhash_similar as similar
from wayfold.llm.common import cut, row_key, shuffles_dropped, with_totals
from wayfold.llm.components import connected_components
from wayfold.llm.runs import forest, run_slices, whole_runs

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Reference fingerprints: the first multiples of the 64-bit golden ratio (a rule, not a list).
PIVOTS = np.array([(k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for k in range(1, 17)], dtype=np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = (np.arange(8) * 256)[None, :]


def simhash(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a UTF-8 text over XXH64 of its lower-cased word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(blanks[: len(words) - shingle_words] + 1).tolist()]
    ends = [*blanks[shingle_words - 1 :].tolist(), len(joined)]
    hashes = map(xxhash.xxh64_intdigest, [joined[i:j] for i, j in zip(starts, ends, strict=True)], repeat(SEED))
    hashes = np.fromiter(hashes, dtype=">u8", count=len(starts))
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ _BITS).ravel() * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_key long, fp long) of every row; row_key tells rows apart that share an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([simhash(x) for x in batch.pop("_text")], dtype=np.uint64)
            yield batch.assign(fp=fp.view(np.int64))

    rows = docs.select(F.col(key), row_key(key, text).alias("row_key"), F.col(text).cast("binary").alias("_text"))
    kind = dict(docs.dtypes)[key]
    return rows.mapInPandas(run, f"`{key}` {kind}, row_key bigint, fp bigint")


def n_blocks(n: int, max_bits: int = MAX_BITS) -> int:
    """The fewest blocks at which random fingerprints meet fewer than 8 others in their runs."""
    for blocks in range(max_bits + 1, 16):
        same = blocks - max_bits
        if n * comb(blocks, same) / 2 ** (64 * same / blocks) < 8:
            break
    return blocks


def masks(blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks of every choice of blocks that may agree."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    return [reduce(int.__or__, chosen) for chosen in combinations(one, blocks - max_bits)]


def linked(fps: np.ndarray, table: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints (int64), their pivot distances in `table` (int8)."""
    bits = fps.view(np.uint64)

    def near(at: int, rest: np.ndarray) -> np.ndarray:
        out = (np.abs(table[rest] - table[at]) <= max_bits).all(axis=1)
        maybe = rest[out]
        out[out] = np.bitwise_count(bits[maybe] ^ bits[at]) <= max_bits
        return out

    return [(int(fps[i]), int(fps[j])) for i, j in forest(len(fps), near)]


def links(fps: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints `fp`, run by run."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(n_blocks(n, max_bits), max_bits)]
    pivots = [int(p) for p in PIVOTS.view(np.int64)]
    distances = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots])
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    # The table travels as 16 bytes.
    packed = F.unhex(F.array_join(F.transform(distances, lambda d: F.lpad(F.hex(d), 2, "0")), ""))
    rows = fps.select("fp", packed.alias("pivots")).select(F.explode(keys).alias("k"), "fp", "pivots")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_runs(batches, "k"):
            fps = block["fp"].to_numpy()
            table = np.frombuffer(b"".join(block["pivots"]), np.int8).reshape(len(fps), len(pivots))
            edges = [e for at in run_slices(block["k"].to_numpy()) for e in linked(fps[at], table[at], max_bits)]
            yield pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return rows.repartition("k").sortWithinPartitions("k", "fp").mapInPandas(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(key, row_key, fp, component_id) of every row: component_id is the smallest key of its class."""
    marked = cut(fingerprints(docs, key, text))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("first")))
    nodes = connected_components(links(distinct, distinct.count(), max_bits))
    named = distinct.join(nodes, distinct.fp == nodes.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = with_totals(named, least, "component").select("fp", "component", "component_id")
    return marked.join(named, "fp").select(key, "row_key", "fp", "component", "component_id")


def similar_marks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_key, row_key2, fp, node, words, wide, keys, levels, shingles) of every row: node is one for texts of equal lower-cased words, words a 128-bit hash of these."""
    tables = similar.tables_for(docs.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch[i : i + 128]
                texts = [x or b"" for x in part["_text"]]
                words = [x.lower().split() for x in texts]
                sets = [similar.shingles(w) for w in words]
                vectors = np.stack([similar.sums(s) for s in sets])
                joined = [b" ".join(w) for w in words]
                node = np.array([xxhash.xxh64_intdigest(x) for x in joined], np.uint64).view(np.int64)
                fp = np.array([simhash(x) for x in texts], np.uint64).view(np.int64)
                yield part.drop(columns="_text").assign(fp=fp, node=node, words=[xxhash.xxh3_128_digest(x) for x in joined], wide=list(similar.bits(vectors)), keys=list(similar.keys_of(vectors, tables)),
                                                          levels=[x.tobytes() for x in similar.levels(vectors)], shingles=[len(s) for s in sets])

    rows = docs.select(F.col(key), row_key(key, text).alias("row_key"), F.xxhash64(F.lit(2), F.col(key), F.col(text)).alias("row_key2"), F.col(text).cast("binary").alias("_text"))
    kind = dict(docs.dtypes)[key]
    return rows.mapInPandas(run, f"`{key}` {kind}, row_key bigint, row_key2 bigint, fp bigint, node bigint, words binary, wide array<bigint>, keys array<bigint>, levels binary, shingles bigint")


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, least: float = similar.LEAST) -> DataFrame:
    """(key, row_key, row_key2, component, other) of every row; other is null but for the second of two texts with one hash. Two texts are linked if their fingerprints differ in `max_bits`
    bits or fewer, as in classes(), or if they have `least` or more of their five-word shingles in common."""
    marked = cut(similar_marks(docs, key, text))
    with shuffles_dropped(docs.sparkSession):
        distinct = cut(marked.groupBy("node").agg(F.min("row_key").alias("row_key"), F.min(F.struct("words", "fp", "wide", "keys", "levels", "shingles")).alias("m")).select("node", "row_key", "m.*"))
    rows = docs.select(row_key(key, text).alias("row_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def texts(pairs: DataFrame) -> DataFrame:
        """Only texts of pairs are read again."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ends = distinct.select("node", "row_key").join(ends, "node", "left_semi")
        return rows.join(ends, "row_key").groupBy("node").agg(F.any_value("text").alias("text"))

    alike = similar.alike(distinct, texts, least)
    # Fingerprints stand for the least node that has them.
    with shuffles_dropped(docs.sparkSession):
        own = cut(distinct.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    same = with_totals(distinct.select("fp", "node"), own.where("n > 1").select("fp", "head"), "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads = own.select("fp", "head")
    bits = links(heads.select("fp"), own.count(), max_bits)
    bits = bits.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    nodes = connected_components(alike.unionByName(same).unionByName(bits.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    named = nodes.select(F.col("node").alias("_n"), "component")
    marked = marked.join(named, F.col("node") == F.col("_n"), "left")
    # Should two texts have one node, the one that does not stand for it has a class of its own: it is not taken for a copy.
    chief = distinct.select(F.col("node").alias("_c"), F.col("words").alias("_w"))
    marked = marked.join(chief, F.col("node") == F.col("_c"))
    own = F.when(F.col("words") == F.col("_w"), F.lit(None).cast("binary")).otherwise(F.col("words"))
    return marked.select(key, "row_key", "row_key2", F.coalesce("component", "node").alias("component"), own.alias("other"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, least: float = similar.LEAST) -> DataFrame:
    """`docs` with one row of each of similar_classes(): the one of the smallest id (null last), then of the smallest row_key."""
    first = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("row_key").alias("r"), F.col("row_key2").alias("r2"))
    marked = similar_classes(docs, key, text, max_bits, least)
    kept = marked.groupBy("component", "other").agg(F.min(first).alias("m")).select("m.r", "m.r2")
    rows = docs.select(F.struct("*").alias("row"), row_key(key, text).alias("r"), F.xxhash64(F.lit(2), F.col(key), F.col(text)).alias("r2"))
    return rows.join(kept, ["r", "r2"], "left_semi").dropDuplicates(["r", "r2"]).select("row.*")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
