"""Operator 5: substring dedup over prefix-partitioned suffix trees.

The suffixes of all texts, in words, form one tree; an inner node `window` words deep with two or more
leaves is a repeat. The tree is never held in one place. Its suffixes are split by prefixes of variable length into groups
that fit memory, and each group's subtree is built from the words themselves.

1. A window is looked at through the least of its prefixes of `prefixes[0]` words (by hash, the leftmost of equal ones): equal windows choose
   the same prefix at the same offset. So only the suffixes that some window chooses are dealt out, about one in
   twelve. A prefix whose suffixes all lie in one text, once, is no repeat, and its windows are done with.
2. A prefix with more than `group_rows` suffixes would not fit one task. The windows that chose it choose again, among their longer
   prefixes (`prefixes[1]` words, and so on).
3. A group is the suffixes of one prefix, with the words of the windows that chose it to the left and to the right of its start. Its subtree
   is a sorted array of suffixes with the longest common prefixes of neighbours, and a second one of the reversed
   words to the left. An interval with common prefixes of window - k words is an inner node that deep; its suffixes that also
   have k words to the left in common are the repeats of the windows that begin k words earlier.
4. Windows whose longest prefix still has too many suffixes are grouped by all their words (as SHA-256), and only counted, in an
   aggregate that is combined before its shuffle.

The other hashes only deal suffixes out and drop what cannot repeat: two windows are called equal when their words are, compared
as bytes or by SHA-256. Equal texts (by SHA-256) repeat each other as a whole: one of them stands for all in the tree, and the others
need no windows of their own.

Defined results: a null or blank text has no words and an empty kept text; texts under `window` words lose
nothing; repeated rows are texts that repeat each other; ids may repeat or be null (a row is known by a 64-bit hash of id
and text); an empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, row_key, with_totals
from wayfold.llm.runs import whole_runs

WINDOW = 35
#: Words of the prefixes that suffixes are grouped by: the next length where a group of the one before is too large.
PREFIXES = (12, 24)
#: The most suffixes of one prefix that are built into one subtree: about 300 bytes of words each.
GROUP_ROWS = 20_000
#: In place of a position: every window of the text is repeated.
WHOLE = -1
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(35).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of text hashed at once.
_CHUNK = 4_000_000


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[starts:ends], the same wherever the range lies; wraps at 64 bits."""
    n = len(values)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * _powers(base, n)[:n])))
    return _mixed((sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), n)[starts])


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    blank = np.concatenate(([True], _BLANK[np.frombuffer(data, np.uint8)], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


class Words:
    """The words of several texts in a row: bytes, hashes of `bits` bits and, for each text, its range of words."""

    def __init__(self, texts: list[bytes], bits: int = 64):
        self.data = b" ".join(texts)
        self.starts, self.ends = word_spans(self.data)
        self.hashes = _ranges(_BYTE[np.frombuffer(self.data, np.uint8)], self.starts, self.ends, _BASE) if len(self.starts) else np.zeros(0, np.uint64)
        first = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(self.starts, first)  # words before each text; the last entry is the total
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.shift = np.uint64(64 - bits)

    def nodes(self, depth: int) -> np.ndarray:
        """Hash of the `depth` words from each word on; 2^64-1 where the text ends before."""
        n = len(self.hashes)
        out = np.full(n, _TOP)
        at = np.arange(n)
        at = at[at + depth <= self.first[self.text + 1]] if n else at
        out[at] = np.minimum(_ranges(self.hashes, at, at + depth, _STEP) >> self.shift, _TOP - np.uint64(1))
        return out

    def chosen(self, depth: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix hash of each suffix; and of the window from each word on: where its least prefix is (the leftmost), whether it is one."""
        heads = self.nodes(depth)
        if len(heads) < window:
            return heads, np.zeros(0, np.int64), np.zeros(0, bool)
        least, at, done, width = heads, np.arange(len(heads)), 1, window - depth + 1
        while done < width:
            step = min(done, width - done)
            left = least[:-step] <= least[step:]
            at = np.where(left, at[:-step], at[step:])
            least = np.where(left, least[:-step], least[step:])
            done += step
        n = len(heads) - window + 1
        at = at[:n]
        return heads, at, np.arange(n) + window <= self.first[self.text[:n] + 1]


def windows_by_level(words: Words, marks: list[list], window: int, prefixes: Sequence[int]):
    """For each level with `marks`: its prefix hashes, the choices of the windows, and which windows stay at this level; then which
    windows are left for the next level.

    marks[level] are, for each text, 2p + 1 (or 2p) for the prefix at p that repeats and has too many suffixes (or has not)."""
    out, left = [], None
    for depth, found in zip(prefixes, marks, strict=False):
        heads, at, ok = words.chosen(depth, window)
        ok = ok if left is None else ok & left
        again, large = np.zeros(len(heads), bool), np.zeros(len(heads), bool)
        for first, ps in zip(words.first, found, strict=False):
            if ps is not None and len(ps):
                ps = np.asarray(ps, np.int64)
                again[first + (ps >> 1)] = True
                large[first + (ps[ps % 2 == 1] >> 1)] = True
        out.append((heads, at, ok & again[at] & ~large[at]))
        left = ok & large[at]
    return out, left


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of about _CHUNK bytes of text, whole rows."""
    for batch in batches:
        sizes = np.cumsum([len(x) if x is not None else 0 for x in batch["text"]])
        for _, part in batch.groupby(sizes // _CHUNK, sort=False):
            yield part


def _bytes(part: pd.DataFrame) -> list[bytes]:
    return [x if x is not None else b"" for x in part["text"]]


def repeated(rows: DataFrame, group_rows: int) -> DataFrame:
    """(rk, marks) from suffixes (node, rk, p, th, again): those whose prefix is in two texts (hashes th) or twice in one.

    The texts' hashes are reduced to the least and the greatest before the shuffle. A mark is 2p, or 2p + 1 where the prefix has more than
    `group_rows` suffixes. The positions of one text are bounded, as the text is."""
    by = rows.groupBy("node").agg(F.min("th").alias("x"), F.max("th").alias("y"), F.max("again").alias("again"), F.count("*").alias("n"))
    by = by.where("x <> y or again").select("node", (F.col("n") > group_rows).cast("int").alias("large"))
    met = with_totals(rows.select("node", "rk", "p"), by, "node")
    return met.groupBy("rk").agg(F.sort_array(F.collect_set(F.col("p") * 2 + F.col("large"))).alias("marks"))


def copies(docs: DataFrame) -> DataFrame:
    """(rk, first): the rows whose text another row has too; `first` marks one row of each such text."""
    hashed = docs.select("rk", F.sha2("text", 256).alias("t"))
    many = hashed.groupBy("t").agg(F.count("*").alias("n"), F.min("rk").alias("least")).where("n > 1").select("t", "least")
    return with_totals(hashed, many, "t").groupBy("rk").agg(F.max(F.col("rk") == F.col("least")).alias("first"))


def _matrix(ids: np.ndarray, at: np.ndarray, n: np.ndarray, width: int, step: int) -> np.ndarray:
    """Row i: ids[at[i]], ids[at[i] + step], ... of n[i] words; what is missing is like nothing else."""
    out = np.repeat(-2 - np.arange(len(at), dtype=np.int32)[:, None], width, axis=1)
    for k in range(width):
        has = np.flatnonzero(n > k)
        out[has, k] = ids[at[has] + step * k]
    return out


def _sorted(node: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of one array of suffixes in order, and how many words each has in common with the row before (-1: another prefix)."""
    order = np.lexsort([*words.T[::-1], node])
    differ = words[order][1:] != words[order][:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1]) if words.shape[1] else np.zeros(len(differ), int)
    return order, np.concatenate(([-1], np.where(np.diff(node[order]) != 0, -1, common)))


def _nodes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The number of each row's inner node (or leaf) `depth` words deep."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def subtree_repeats(rows: pd.DataFrame, window: int, width: int) -> pd.DataFrame:
    """(rk, a, b): the windows from word a to b that repeat, from suffixes (node, rk, lo, before, body): body is the words of the
    windows lo, lo + 1, ... that chose the prefix which begins `before` words after lo."""
    words = [x.split() for x in rows["body"]]
    sizes = np.array([len(x) for x in words], np.int64)
    ids = pd.factorize(np.array([w for x in words for w in x] + [None], object)[:-1])[0].astype(np.int32)
    node, before, lo = (rows[c].to_numpy(np.int64) for c in ("node", "before", "lo"))
    start = np.cumsum(sizes) - sizes + before
    right = _sorted(node, _matrix(ids, start, sizes - before, window, 1))
    left = _sorted(node, _matrix(ids, start - 1, before, width - 1, -1))
    least = before - (sizes - window)  # of the last window
    hit = np.zeros((len(rows), width), bool)
    for k in range(width):
        at = np.flatnonzero((least <= k) & (k <= before))
        pair = _nodes_at(*right, window - k)[at] * (len(rows) + 1) + _nodes_at(*left, k)[at]
        _, back, n = np.unique(pair, return_inverse=True, return_counts=True)
        hit[at, before[at] - k] = n[back] > 1
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return pd.DataFrame({"rk": rows["rk"].to_numpy()[i], "a": lo[i] + a, "b": lo[i] + b - 1})


def _range(a, b):
    """A range of windows as one long, and by_text() of such ranges."""
    return F.shiftleft(F.col(a).cast("long"), 32) + F.col(b).cast("long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefixes: Sequence[int] = PREFIXES, group_rows: int = GROUP_ROWS, bits: int = 64) -> DataFrame:
    """docs (doc_id, text binary, rk) with ps: the ranges of windows of each text that start elsewhere too; WHOLE among them stands for all."""

    def suffixes(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _chunks(batches):
                texts = _bytes(part)
                words = Words(texts, bits)
                _, wanted = windows_by_level(words, [part[f"m{i}"].tolist() for i in range(level)], window, prefixes)
                heads, at, ok = words.chosen(prefixes[level], window)
                at = np.unique(at[ok if wanted is None else ok & wanted])
                of = words.text[at]
                th = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)
                _, back, n = np.unique(heads[at] ^ _mixed(of.astype(np.uint64)), return_inverse=True, return_counts=True)
                yield pd.DataFrame({"node": heads[at].view(np.int64), "rk": part["rk"].to_numpy()[of], "p": (at - words.first[of]).astype(np.int32),
                                    "th": th[of], "again": n[back] > 1 if len(at) else np.zeros(0, bool)})
        return run

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(batches):
            words = Words(_bytes(part), bits)
            levels, _ = windows_by_level(words, [part[c].tolist() for c in part.columns if c[0] == "m"], window, prefixes)
            for heads, at, here in levels:
                s = np.flatnonzero(here)
                p = at[s]
                head = np.concatenate(([True], p[1:] != p[:-1])) if len(p) else np.zeros(0, bool)
                tail = np.concatenate((head[1:], [True])) if len(p) else head
                lo, hi, p = s[head], s[tail], p[head]
                of = words.text[lo]
                body = [words.data[i:j] for i, j in zip(words.starts[lo].tolist(), words.ends[hi + window - 1].tolist(), strict=True)]
                yield pd.DataFrame({"node": heads[p].view(np.int64), "rk": part["rk"].to_numpy()[of], "lo": (lo - words.first[of]).astype(np.int32),
                                    "before": (p - lo).astype(np.int32), "body": body})

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_runs(batches, "node"):
            if len(block):
                yield subtree_repeats(block, window, window - min(prefixes) + 1).astype({"a": np.int32, "b": np.int32})

    def long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(batches):
            words = Words(_bytes(part), bits)
            _, left = windows_by_level(words, [part[c].tolist() for c in part.columns if c[0] == "m"], window, prefixes)
            s = np.flatnonzero(left)
            of = words.text[s]
            every = [hashlib.sha256(b" ".join(words.data[i:j].split())).digest() for i, j in zip(words.starts[s].tolist(), words.ends[s + window - 1].tolist(), strict=True)]
            yield pd.DataFrame({"rk": part["rk"].to_numpy()[of], "a": (s - words.first[of]).astype(np.int32), "all": every})

    same = cut(copies(docs))
    kind = "node bigint, rk bigint, p int, th bigint, again boolean"
    first = repeated(docs.select("rk", "text").mapInPandas(suffixes(0), kind), group_rows)
    marks = cut(first.join(same.where("not first"), "rk", "left_anti").withColumnRenamed("marks", "m0"))
    large = "exists({}, x -> x % 2 = 1)".format
    # All readers of the texts by rk take all columns and are in one query, so that the texts are dealt out once.
    met, names = docs.join(marks, "rk"), ["m0"]
    over = not marks.where(large("m0")).isEmpty()
    for i in range(1, len(prefixes)) if over else ():
        more = met.where(large(names[-1])).select(*docs.columns, *names).mapInPandas(suffixes(i), kind)
        met = met.join(repeated(more, group_rows).withColumnRenamed("marks", f"m{i}"), "rk", "left")
        names.append(f"m{i}")
    rows = met.select(*docs.columns, *names).mapInPandas(groups, "node bigint, rk bigint, lo int, before int, body binary")
    deep = rows.repartition("node").sortWithinPartitions("node").mapInPandas(trees, "rk bigint, a int, b int")
    if over:
        every = met.where(large(names[-1])).select(*docs.columns, *names).mapInPandas(long, "rk bigint, a int, all binary")
        twice = every.groupBy("all").agg(F.count("*").alias("n")).where("n > 1").select("all")
        deep = deep.unionByName(with_totals(every, twice, "all").select("rk", "a", F.col("a").alias("b")))
    found = deep.select("rk", _range("a", "b").alias("r")).unionByName(same.select("rk", F.lit(WHOLE).cast("long").alias("r")))
    return docs.join(found.groupBy("rk").agg(F.sort_array(F.collect_set("r")).alias("ps")), "rk", "left")


def _kept(data: bytes, ps, window: int) -> tuple[int, int, bytes]:
    words = data.split()
    if ps is None or len(words) < window:
        return len(words), 0, b" ".join(words)
    if ps[0] == WHOLE:
        return len(words), len(words), b""
    ps = np.asarray(ps, np.int64)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, ps >> 32, 1)
    np.add.at(step, (ps & 0xFFFFFFFF) + window, -1)
    gone = np.cumsum(step[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefixes: Sequence[int] = PREFIXES,
          group_rows: int = GROUP_ROWS, digest: bool = False, bits: int = 64) -> DataFrame:
    """(key, n_words, n_removed, kept string) of every row; with `digest`, kept_sha256 in place of kept.

    `prefixes` ascend and are at most `window`; `bits` of the hashes are used (fewer make prefixes collide, for tests)."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), row_key(key, text).alias("rk"))
    name = "kept_sha256" if digest else "kept"

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_kept(x, ps, window) for x, ps in zip(_bytes(batch), batch["ps"], strict=True)]
            last = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode("utf-8", "replace") for x in out]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], name: last})

    found = repeated_windows(rows, window, prefixes, group_rows, bits).select("doc_id", "text", "ps")
    out = found.mapInPandas(cut_out, f"doc_id {kind}, n_words bigint, n_removed bigint, {name} string")
    return out.withColumnRenamed("doc_id", key)
