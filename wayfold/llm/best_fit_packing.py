"""Operator 3: variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted sequence length; pieces are packed into bins.
Pieces are dealt evenly (round robin, so that no key can gather them) into groups of about `group_rows`
documents, and a group of many more pieces than that, from long texts, is packed in parts; each group is packed by best fit, largest first: a piece goes to the open bin it fills best. If none
has room, a bin opens at the permitted length of least cost for a word it is going to hold, where
cost(length) = fixed + length + quadratic * length^2 (fixed work of a sequence, work for each place, and
attention). In the end each bin is cut down to the least permitted length that holds its contents. A group
holds a few numbers for each piece, never texts; one group leaves about one bin badly filled.

Defined results: a null or blank text, of 0 words, takes no place and gives no piece; texts over the largest
length are cut into several pieces, none is lost; pieces of one size go by key and piece, and of the bins that a piece fills
equally well the last one to get there takes it; repeated rows are packed each; ids may be null or repeat;
an empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import n_words

LENGTHS = (512, 1024, 2048, 4096)
FIXED = 64.0
QUADRATIC = 1.0 / 8192
GROUP_ROWS = 20_000


def cost(length: int, fixed: float = FIXED, quadratic: float = QUADRATIC) -> float:
    return fixed + length + quadratic * length * length


def best_fit(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, fixed: float = FIXED, quadratic: float = QUADRATIC):
    """Bin and place in the bin of each size, and the length of each bin."""
    lengths = sorted(lengths)
    price = {x: cost(x, fixed, quadratic) for x in lengths}
    left = int(sizes.sum())
    room: list[int] = []  # rooms of open bins, each value once, ascending
    bins: dict[int, list[int]] = {}  # room: its bins
    length: list[int] = []
    used: list[int] = []
    of, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, size)
        if at < len(room):
            have = room[at]
            b = bins[have].pop()
            if not bins[have]:
                del bins[have], room[at]
        else:
            have = min((x for x in lengths if x >= size), key=lambda x: price[x] / min(x, left))
            b = len(length)
            length.append(have)
            used.append(0)
        of[i], place[i] = b, used[b]
        used[b] += size
        left -= size
        if rest := have - size:
            if rest not in bins:
                bins[rest] = []
                insort(room, rest)
            bins[rest].append(b)
    down = [lengths[bisect_left(lengths, x)] for x in used]
    return of, place, np.array(down, np.int64)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LENGTHS[-1], size=None) -> DataFrame:
    """(key, piece, first, size): pieces of at most `longest` words; `first` is the word a piece starts at."""
    sized = docs.select(F.col(key), (n_words(text) if size is None else F.col(size).cast("long")).alias("_n"))
    cut = sized.select(key, "_n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_n") > 0, F.col("_n") - 1), F.lit(longest).cast("long"))))
    return cut.select(key, F.col("pos").alias("piece"), F.col("col").alias("first"), F.least(F.col("_n") - F.col("col"), F.lit(longest)).alias("size"))


def _gathered(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The rows in blocks of at least `least`, but for the last."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: Sequence[int] = LENGTHS, fixed: float = FIXED,
         quadratic: float = QUADRATIC, group_rows: int = GROUP_ROWS, size: str | None = None) -> DataFrame:
    """(key, piece, first, size, bin string, offset, capacity) of every piece.

    `size` names a column of token counts to pack by, in place of words."""
    kind = dict(docs.dtypes)[key]
    cut = pieces(docs, key, text, max(lengths), size)
    groups = max(1, -(-docs.count() // group_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for n, rows in enumerate(_gathered(batches, 2 * group_rows)):
            # Pieces of one size are packed in the order of key and piece, not of arrival.
            rows = rows.sort_values(["size", key, "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
            of, place, down = best_fit(rows["size"].to_numpy(np.int64), lengths, fixed, quadratic)
            yield rows.assign(bin=[f"{part}-{n}-{b}" for b in of], offset=place, capacity=down[of])

    schema = f"`{key}` {kind}, piece int, first bigint, size bigint, bin string, offset bigint, capacity bigint"
    return cut.repartition(groups).mapInPandas(run, schema)


def bins(packed: DataFrame) -> DataFrame:
    """(bin, capacity, used, pieces): one row for each bin."""
    return packed.groupBy("bin", "capacity").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"))
