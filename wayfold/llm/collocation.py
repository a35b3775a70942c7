"""Collocations by hierarchical pair naming.

Texts are lower-cased (A-Z), split into pieces and words, and kept as blocks: the words of some texts as local codes. A block
lists each of its words once with its count; all blocks' counts meet by word, and a word in at least `min_count` places gets a
name. The blocks take the names over. Level by level, two adjacent names of phrases of k - 1 words, which share all but their outer words, are
a pair; pairs are counted and named as words were. A pair names a phrase of k words, as a phrase can only be frequent if both of its parts are.

What a block lists is dealt out by buckets, hashes of the word or the pair: one packed row for each block and bucket, with what differs in it once. So no
key is hot, and a bucket, which one task holds at a time, has about BUCKET_CHARS of text in all of the corpus. Names go back as places in those lists.
Blocks of codes move once a level and shrink as the phrases get longer. A named pair keeps its two parts, the parents. They give a phrase the counts of all
its beginnings and ends (each is a parent's, or its parent's), so the cuts need no other lookup. A phrase lies in a longer one that is as
frequent exactly if it is a parent of one, as all phrases between the two are as frequent.

Defined results: a null text is an empty one, a null language `und`. Repeated rows count each. Ties as the contract says. An empty table
gives no rows. Other columns are not read. Texts are cut at pieces; a piece is not cut, and is as much of a block as it is long."""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import Kept, shuffles_dropped, with_totals
from wayfold.llm.runs import whole_runs

#: Fixed by the result contract: words of a phrase, least count, rows for each language.
MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: A block is closed when it has so many words; characters of text for each bucket.
BLOCK_WORDS, BUCKET_CHARS = 1_500_000, 16_000_000
_PIECE = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
#: Bits of a block's number within its partition, and of a name within its bucket.
_SEQ_BITS, _NAME_BITS = 20, 36


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, which pack better."""
    wide = np.ascontiguousarray(numbers, "<i8" if numbers.dtype.itemsize == 8 else "<i4")
    return bytes([wide.itemsize]) + zlib.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, wide.itemsize).T), 1)


def _unpack(packed: bytes) -> np.ndarray:
    size = packed[0]
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(size, -1).T).view(f"<i{size}").ravel()


class _Block:
    """Words of some texts as codes; -1 ends a piece."""

    def __init__(self):
        self.codes, self.words, self.n = array("i"), {}, itertools.count()

    def add(self, lang: str, text: bytes) -> None:
        own = self.words.get(lang)
        if own is None:
            own = self.words[lang] = defaultdict(self.n.__next__)
        for piece in text.split(b"."):
            self.codes.extend(map(own.__getitem__, piece.split()))
            self.codes.append(-1)

    def rows(self, block: int, buckets: int) -> Iterator[dict]:
        """The block's own row, then a list of words for each language and bucket. starts: where in `order`, the codes by lists, each list begins."""
        codes = np.frombuffer(self.codes, np.int32)
        times = np.bincount(codes[codes >= 0], minlength=1)
        lists, orders, starts, at = [], [], [], 0
        if not any(self.words.values()):
            return
        for lang, own in self.words.items():
            if not own:
                continue
            words, code = list(own), np.fromiter(own.values(), np.int32, len(own))
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            orders.append(code[order])
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                lists.append({"block": block, "bucket": int(bucket[part[0]]), "lang": lang, "list": len(starts), "x": zlib.compress(b" ".join([words[i] for i in part]), 1), "times": _pack(times[code[part]])})
                starts.append(at)
                at += len(part)
        yield {"block": block, "codes": _pack(codes), "order": _pack(np.concatenate(orders)), "starts": _pack(np.array(starts, np.int64)), "n": {lang: int(times[list(own.values())].sum()) for lang, own in self.words.items() if own}}
        yield from lists


def _parts(text: bytes, at_most: int) -> Iterator[bytes]:
    """A long text in parts that end with a piece."""
    at = 0
    while len(text) - at > at_most:
        end = text.rfind(b".", at, at + at_most)
        end = end if end >= 0 else text.find(b".", at + at_most)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


_ENCODED = "block long, codes binary, order binary, starts binary, n map<string, long>, bucket int, lang string, list int, x binary, times binary"


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series([r.get(c.split()[0]) for r in rows], dtype=object) for c in schema.replace("map<string, long>", "map").split(", ")})


def _encode(block_words: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, seq, block = TaskContext.get().partitionId() << _SEQ_BITS, 0, _Block()
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                for part in _parts(text.encode().lower().translate(_PIECE), 1 << 24):
                    block.add(lang, part)
                    if len(block.codes) >= block_words:
                        yield _frame(list(block.rows(first + seq, buckets)), _ENCODED)
                        seq, block = seq + 1, _Block()
        if block.words:
            yield _frame(list(block.rows(first + seq, buckets)), _ENCODED)

    return run


#: What counting gives: for a list the entries that are named, and their names; for a name what it stands for.
_NAMED = "block long, bucket int, list int, at binary, names binary, name long, lang string, word string, x long, y long, f long"


def _name_words(min_count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, "bucket"):
            for bucket, own in rows.groupby("bucket", sort=False):
                lists = [zlib.decompress(x).split(b" ") for x in own["x"]]
                total: dict = defaultdict(Counter)
                for lang, words, times in zip(own["lang"], lists, own["times"]):
                    count = total[lang]
                    for w, t in zip(words, _unpack(times).tolist()):
                        count[w] += t
                out, names, base = [], {}, int(bucket) << _NAME_BITS
                for lang, count in total.items():
                    for w, f in count.items():
                        if f >= min_count:
                            names[lang, w] = name = base + len(out)
                            out.append({"name": name, "lang": lang, "word": w.decode(), "f": f})
                for block, lang, n, words in zip(own["block"], own["lang"], own["list"], lists):
                    found = [(i, names[lang, w]) for i, w in enumerate(words) if (lang, w) in names]
                    if found:
                        at, own_names = np.array(found, np.int64).T
                        out.append({"block": block, "bucket": bucket, "list": n, "at": _pack(at.astype(np.int32)), "names": _pack(own_names)})
                yield _frame(out, _NAMED)

    return run


def _pairs(codes: np.ndarray, names: np.ndarray, buckets: int) -> tuple:
    """The different pairs of adjacent codes by bucket: x, y (names), the bucket of each, where pairs are, and which one is there."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    pairs, which = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True)
    x, y = names[pairs >> 32], names[pairs & 0xFFFFFFFF]
    h = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return x[order], y[order], bucket[order], at, place[which]


_LIST = "block long, bucket int, x binary, y binary, times binary"


def _list_pairs(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, packed, names in zip(batch["block"], batch["codes"], batch["names"]):
                x, y, bucket, _, which = _pairs(_unpack(packed), _unpack(names), buckets)
                if not len(x):
                    continue
                times = np.bincount(which, minlength=len(x))
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(x)]))
                # x comes in runs: its differences pack well.
                yield _frame([{"block": block, "bucket": int(bucket[a]), "x": _pack(np.diff(x[a:b], prepend=0)), "y": _pack(y[a:b]), "times": _pack(times[a:b].astype(np.int32))} for a, b in itertools.pairwise(cuts)], _LIST)

    return run


def _name_pairs(min_count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, "bucket"):
            for bucket, own in rows.groupby("bucket", sort=False):
                xs, ys = [np.cumsum(_unpack(x)) for x in own["x"]], [_unpack(y) for y in own["y"]]
                x, y, times = np.concatenate(xs), np.concatenate(ys), np.concatenate([_unpack(t) for t in own["times"]])
                order = np.lexsort((y, x))
                first = np.flatnonzero(np.concatenate(([True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))))
                f = np.add.reduceat(times[order].astype(np.int64), first)
                named = f >= min_count
                names = np.where(named, (int(bucket) << _NAME_BITS) + np.cumsum(named) - 1, -1)
                of = np.empty(len(order), np.int64)
                of[order] = np.repeat(names, np.diff(np.append(first, len(order))))
                out = [{"name": n, "x": p, "y": q, "f": c} for n, p, q, c in zip(names[named].tolist(), x[order][first][named].tolist(), y[order][first][named].tolist(), f[named].tolist())]
                ends = np.cumsum([len(v) for v in xs])
                for block, end, n in zip(own["block"], ends, map(len, xs)):
                    mine = of[end - n : end]
                    at = np.flatnonzero(mine >= 0)
                    if len(at):
                        out.append({"block": block, "bucket": bucket, "at": _pack(at.astype(np.int32)), "names": _pack(mine[at])})
                yield _frame(out, _NAMED)

    return run


_BLOCK = "block long, codes binary, names binary"


def _take_names(buckets: int | None):
    """A block with codes of the named words, or (buckets) of the named pairs of its names, in place of its codes."""

    def run(key: tuple, blocks: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(named):
            return _frame([], _BLOCK)
        codes, at, names = _unpack(blocks["codes"].iat[0]), [_unpack(x) for x in named["at"]], np.concatenate([_unpack(x) for x in named["names"]])
        if buckets is None:
            order, starts = _unpack(blocks["order"].iat[0]), _unpack(blocks["starts"].iat[0])
            entries = order[np.concatenate([starts[n] + x for n, x in zip(named["list"], at)])]
            new = np.full(len(order) + 1, -1, np.int32)  # -1 takes the last
            new[entries] = np.arange(len(entries))
            out = new[codes]
        else:
            x, _, bucket, places, which = _pairs(codes, _unpack(blocks["names"].iat[0]), buckets)
            entries = np.concatenate([np.searchsorted(bucket, int(b)) + i for b, i in zip(named["bucket"], at)])
            new = np.full(len(x), -1, np.int32)
            new[entries] = np.arange(len(entries))
            out = np.full(len(codes), -1, np.int32)
            out[places] = new[which]
        return _frame([{"block": key[0], "codes": _pack(out), "names": _pack(names)}], _BLOCK)

    return run


def phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, block_words: int = BLOCK_WORDS, bucket_chars: int = BUCKET_CHARS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of named phrases of 1, 2, ... words, and (lang, n), the words of each language.

    Words: (name, lang, word, f). Longer ones: (name, x, y, f), x and y the names of all but the last word and of all but the first."""
    with shuffles_dropped(docs.sparkSession):
        return _phrases(docs, max_words, min_count, block_words, bucket_chars)


def _phrases(docs: DataFrame, max_words: int, min_count: int, block_words: int, bucket_chars: int) -> tuple[list[DataFrame], DataFrame]:
    texts = docs.where(F.col("`text`").isNotNull()).select(F.coalesce(F.col("`lang`"), F.lit("und")).alias("lang"), F.col("`text`").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // bucket_chars)
    encoded = Kept(texts.mapInPandas(_encode(block_words, buckets), _ENCODED))
    n = Kept(encoded.rows.where("codes is not null").select(F.explode("n").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))).rows
    by_bucket = lambda rows: rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    # What names stand for is small and is kept; where they are is only for the next blocks.
    meant = lambda named, *cols: Kept(named.rows.where("name is not null").select("name", *cols, "f")).rows
    lists = encoded.rows.where("codes is null").select("block", "bucket", "lang", "list", "x", "times")
    named = Kept(by_bucket(lists).mapInPandas(_name_words(min_count), _NAMED))
    tables, blocks = [meant(named, "lang", "word")], encoded
    for k in range(2, max_words + 1):
        own = blocks.rows.where("codes is not null").select("block", "codes", *(["order", "starts"] if k == 2 else ["names"]))
        names = named.rows.where("name is null").select("block", "bucket", "list", "at", "names")
        taken = Kept(own.groupBy("block").cogroup(names.groupBy("block")).applyInPandas(_take_names(None if k == 2 else buckets), _BLOCK))
        blocks.drop()
        named.drop()
        blocks = taken
        named = Kept(by_bucket(blocks.rows.mapInPandas(_list_pairs(buckets), _LIST)).mapInPandas(_name_pairs(min_count), _NAMED))
        tables.append(meant(named, "x", "y"))
    blocks.drop()
    named.drop()
    return tables, n


def _levels(words: DataFrame, longer: list[DataFrame]) -> Iterator[DataFrame]:
    """Each level's phrases with their words and the counts of their beginnings and of their ends, the shortest first."""
    level = words.select("name", "lang", "n", F.array("word").alias("words"), F.array("f").alias("starts"), F.array("f").alias("ends"), "f")
    yield level
    for table in longer:
        x = level.select(F.col("name").alias("x"), "lang", "n", "words", "starts")
        y = level.select(F.col("name").alias("y"), F.element_at("words", -1).alias("word"), "ends")
        level = table.join(x, "x").join(y, "y").select(
            "name", "lang", "n", F.concat("words", F.array("word")).alias("words"), F.concat("starts", F.array("f")).alias("starts"), F.concat("ends", F.array("f")).alias("ends"), "f")
        yield level


#: The lowest score of a phrase's cuts and the shortest first part that has it. Products go past 64 bits: decimals of 38 digits are exact.
_CUT = """array_min(transform(sequence(1, size(words) - 1), k -> struct(
  cast(1000 as decimal(38,0)) * f * n div (cast(starts[k - 1] as decimal(38,0)) * ends[size(words) - k - 1]) as score, k as k, starts[k - 1] as l, ends[size(words) - k - 1] as r)))"""


def mined(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, words, a, l, r, n, score, cut): the frequent phrases of two words or more that lie in no longer one that is as frequent.

    a counts the phrase, l and r the parts of its weakest cut, after word `cut`; n the words of its language."""
    tables, n = phrases(docs, max_words, min_count, block_words)
    levels = list(_levels(with_totals(tables[0], n, "lang"), tables[1:]))
    out = []
    for level, longer in zip(levels[1:], [*tables[2:], None]):
        if longer is not None:
            inside = longer.select(F.col("x").alias("p"), F.col("f").alias("g")).union(longer.select("y", "f")).groupBy("p").agg(F.max("g").alias("g"))
            level = level.join(inside, (F.col("name") == F.col("p")) & (F.col("g") >= F.col("f")), "left_anti")
        out.append(level.select("lang", "words", F.col("f").alias("a"), "n", F.expr(_CUT).alias("c")))
    every = reduce(DataFrame.union, out)
    return every.select("lang", "words", "a", "c.l", "c.r", "n", "c.score", F.col("c.k").alias("cut"))


def top(found: DataFrame, n: int = TOP) -> DataFrame:
    """Each language's first n phrases: (lang, rank, phrase, a, l, r, n, score)."""
    found = found.withColumn("phrase", F.array_join("words", " "))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
