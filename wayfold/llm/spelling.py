"""Spelling variants: words that differ by one inserted, deleted or replaced character, found in sorted dictionaries.

Take the words of `size` characters and those of one more. Where two of them differ by one edit, at place i of size + 1 places
(the length of their common beginning), they have all before i in common and all after it. So with i in the second half they stand together in
the dictionary sorted forwards, by their first half; with i in the first half, in the dictionary sorted backwards, by their last half. A
block is a range of such a dictionary whose words share that half. A block of more than LIMIT words is subdivided: its range [a, b) of places
is cut in two, and for either half the words must also share what lies between. A range of one place has few words: they differ in one or two
characters only. Each pair of words one edit apart has one place i, so it comes up in one block and is found once.

Blocks are counted by aggregates that are combined before their shuffle; the pairs of a block are compared in its task in chunks, and what
leaves a task is, for each word of a block, its number of near words and the best of them.

Defined results: a null text is an empty one; a null id counts as an empty one in the check sum. Repeated rows count each. Of near words with
the same count the smallest, in code-point order, is the form. A word without near words has n_near 0, no form, and is its own root. An
empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import with_totals, written
from wayfold.llm.runs import whole_runs

#: Fixed by the result contract: characters of a word; code points and occurrences from which on it counts; the share of words with a dropped
#: letter; how much more frequent a form is.
LETTERS = "[a-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, TYPO_EVERY, FORM_TIMES = 5, 3, 97, 2
#: Words of a block from which on it is subdivided.
LIMIT = 48
#: Different words that a task counts before it passes them on; pairs compared at once; the longest word compared in arrays.
_WORDS, _PAIRS, _WIDE = 400_000, 200_000, 64


def _count(typo_every: int | None, min_chars: int):
    find = re.compile(LETTERS).findall

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(find(text.encode().lower().decode())).items():
                    if typo_every and (h := zlib.crc32(word.encode(), start)) % typo_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= min_chars:
                        total[word] += n
                if len(total) >= _WORDS:
                    yield pd.DataFrame({"word": total.keys(), "n": total.values()})
                    total.clear()
        if total:
            yield pd.DataFrame({"word": total.keys(), "n": total.values()})

    return run


def word_counts(docs: DataFrame, typo_every: int | None = None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts, A-Z lower-cased, with how often each occurs.

    typo_every: of the words of a document, those whose check sum with its id this divides lose a letter."""
    texts = docs.where(F.col("`text`").isNotNull()).select(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")).alias("id"), F.col("`text`").alias("text"))
    parts = texts.mapInPandas(_count(typo_every, min_chars), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


#: What the words of a block have in common, for a range [a, b) of places: the first a characters and the last size - b. The latter backwards, so
#: that the blocks are ranges of the two sorted dictionaries.
_BLOCK = "concat_ws(' ', size, a, b, left(word, a), reverse(right(word, greatest(size - b, 0))))"


def _blocks(words: DataFrame, limit: int) -> DataFrame:
    """(block, size, a, b, word, n): the words by blocks of two or more, the large ones subdivided."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    half = F.floor((F.col("size") + 1) / 2).cast("int")
    ranges = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("size") + 1).alias("b"))))
    rows = words.select("word", "n", sizes).select("word", "n", "size", ranges.alias("r")).select("word", "n", "size", "r.a", "r.b")
    done = None
    while True:
        rows = rows.withColumn("block", F.expr(_BLOCK))
        counts = rows.groupBy("block").agg(F.count("*").alias("words")).where("words > 1")
        rows = written(with_totals(rows, counts, "block"))
        large = (F.col("words") > limit) & (F.col("b") - F.col("a") > 1)
        small = rows.where(~large).drop("words")
        done = small if done is None else done.unionByName(small)
        rows = rows.where(large)
        if rows.isEmpty():
            return done
        half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        ranges = F.explode(F.array(F.struct("a", half.alias("b")), F.struct(half.alias("a"), "b")))
        rows = rows.select("word", "n", "size", ranges.alias("r")).select("word", "n", "size", "r.a", "r.b")


def edit_place(short: str, long: str) -> int | None:
    """Where two words, the second as long or one longer, differ by one edit: the length of their common beginning. None if they do not."""
    i = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    if len(short) == len(long):
        return i if i < len(short) and short[i + 1 :] == long[i + 1 :] else None
    return i if short[i:] == long[i + 1 :] else None


def _places(x: np.ndarray, y: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """As edit_place for rows of characters; -1 for None. longer: y has one more."""
    width = x.shape[1]
    differs = x != y
    first = np.where(differs.any(1), differs.argmax(1), width)
    replaced = differs.sum(1) == 1
    moved = x[:, :-1] != y[:, 1:]
    last = np.where(moved.any(1), width - 2 - moved[:, ::-1].argmax(1), -1)
    return np.where(np.where(longer, last < first, replaced), first, -1)


def _pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows i < j < ends[i], some at a time."""
    todo = ends - starts - 1
    upto = np.cumsum(todo)
    at = 0
    while at < len(todo):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
        n = todo[at:stop]
        i = np.repeat(starts[at:stop], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def _found(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one block that are one edit apart within the block's range of places."""
    words = block["word"].to_numpy()
    size, a, b = (block[c].to_numpy() for c in ("size", "a", "b"))
    runs = block["block"].to_numpy()
    cuts = np.flatnonzero(np.concatenate((runs[1:] != runs[:-1], [True]))) + 1
    ends = cuts[np.searchsorted(cuts, np.arange(len(block)), "right")]
    length = np.fromiter(map(len, words), np.int64, len(words))
    wide = size >= _WIDE
    chars = np.array(["" if w else x for x, w in zip(words, wide)], f"U{_WIDE + 1}").view(np.uint32).reshape(len(words), -1)
    out = []
    for i, j in _pairs(np.arange(len(block)), ends):
        fits = (length[i] == size[i]) | (length[j] == size[i])
        i, j = i[fits], j[fits]
        i, j = np.where(length[i] <= length[j], i, j), np.where(length[i] <= length[j], j, i)
        place = _places(chars[i], chars[j], length[j] > length[i])
        for k in np.flatnonzero(wide[i]):
            place[k] = -1 if (p := edit_place(words[i[k]], words[j[k]])) is None else p
        near = (place >= a[i]) & (place < b[i])
        out.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word of a block its near words there: how many, and the best one."""
    for block in whole_runs(batches, "block"):
        if len(block) < 2:
            continue
        i, j = _found(block)
        i, j = np.concatenate((i, j)), np.concatenate((j, i))
        words, n = block["word"].to_numpy(), block["n"].to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[j], -n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, int)
        yield pd.DataFrame({"word": words[i[first]], "near": np.diff(np.append(first, len(i))), "best": words[j[first]], "best_n": n[j[first]]})


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: pointers are followed twice as far each time, until all point at a word without one."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("w"), F.col("root").alias("on"))
        far = written(at.join(on, at["root"] == on["w"], "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        at = far.select("word", "root")
        if far.where("moved").isEmpty():
            return at


def variants(words: DataFrame, form_times: float = FORM_TIMES, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): a word's form is its most frequent near word, if that has form_times its
    count; the root is where the forms lead."""
    words = written(words.select("word", "n"))
    blocks = _blocks(words, limit)
    sorted_out = blocks.repartitionByRange(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")
    parts = sorted_out.mapInPandas(_scan, "word string, near long, best string, best_n long")
    near = parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best"))).alias("best"))
    is_form = -F.col("best.n") >= form_times * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.best")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    out = written(out)
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
