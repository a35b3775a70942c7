"""Operator 7: language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams (1 to MAX_GRAM characters) that
both have, over the root of the product of how many each has. A Nystroem map from LANDMARKS training texts,
then one-versus-rest kernel ridge regression on at most MAX_TRAIN training texts, gives one weight vector a
language. A text enters only through which landmark n-grams it has, so landmarks and regression fold into one
matrix of n-grams by languages; a batch of texts is scored by one product of its presence matrix with it.

Training rows: least hash of the id first, per language at a rate known from counts of the whole table, so
the sample is the same in every run and no larger on a larger table; texts over MAX_TRAIN_CHARS characters are not in
it. Whole texts are read in training and in prediction; language, source and id are no inputs of a prediction.

Defined results: null texts and texts without a letter get `und` and score 0, and are not trained on; rows
without a language are not trained on; with no training row at all every text gets `und`; repeated rows get
equal answers; an empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GRAM = 4
LANDMARKS = 240
#: The most training texts, of all languages together.
MAX_TRAIN = 2400
#: The most characters of a text that is trained on; longer ones are predicted only. Bounds what the driver holds in bytes.
MAX_TRAIN_CHARS = 20_000
RIDGE = 1e-3
UNKNOWN = "und"
_TABLE_BITS = 20


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, every run of anything else as one blank, blanks at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in kinds.tolist()])[at]
    codes = np.where(letter, codes, np.uint32(32))
    return codes[letter | np.concatenate(([True], letter[:-1]))]


def grams(text: str | None) -> list[np.ndarray]:
    """Hashes of the n-grams of each length, repeats included; empty lists for a text without a letter."""
    codes = _codes(text or "").astype(np.uint64)
    if len(codes) < 2:
        return []
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + (codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
        out.append(h)
    return out


class Kernel:
    """A fitted model: the landmark n-grams, the folded matrix and the languages."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(langs))
        sets = [np.unique(np.concatenate(g)) if (g := grams(t)) else np.zeros(0, np.uint64) for t in texts]
        chosen = sets[:landmarks]
        self.vocabulary = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.uint64)
        self._index()
        # The landmarks that have an n-gram, n-gram after n-gram: as many entries as the landmarks have n-grams, not a full matrix.
        of = np.repeat(np.arange(len(chosen)), [len(s) for s in chosen])
        gram = np.searchsorted(self.vocabulary, np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        holder, first = of[order], np.searchsorted(gram[order], np.arange(len(self.vocabulary) + 1))
        root_size = np.sqrt([max(len(s), 1) for s in chosen])
        # Kernel of every training text with every landmark.
        k = np.zeros((len(sets), len(chosen)))
        for i, s in enumerate(sets):
            at = np.searchsorted(self.vocabulary, s)
            at = at[(at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == s)] if len(self.vocabulary) else at[:0]
            n = first[at + 1] - first[at]
            every = holder[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            k[i] = np.bincount(every, minlength=len(chosen)) / (root_size * np.sqrt(max(len(s), 1)))
        values, vectors = np.linalg.eigh(k[: len(chosen)] @ np.eye(len(chosen)))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.hstack([k @ root, np.ones((len(k), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        # Each language weighs the same, whatever its share of the sample.
        weight = (1 / pd.Series(langs).map(pd.Series(langs).value_counts()).to_numpy(float))[:, None]
        beta = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]), phi.T @ (y * weight))
        share = (root @ beta[:-1]) / root_size[:, None]
        self.matrix = np.zeros((len(self.vocabulary), len(self.languages)), np.float32)
        for i, s in enumerate(chosen):
            self.matrix[np.searchsorted(self.vocabulary, s)] += share[i].astype(np.float32)
        self.bias = beta[-1].astype(np.float32)

    def _index(self) -> None:
        """A table of hash slots that tells most n-grams that no landmark has."""
        self.slots = np.zeros(1 << _TABLE_BITS, bool)
        self.slots[self.vocabulary >> np.uint64(64 - _TABLE_BITS)] = True

    def present(self, text: str | None) -> tuple[np.ndarray, int]:
        """Landmark n-grams of a text, as indices, and the number of its n-grams."""
        got = grams(text)
        if not got:
            return np.zeros(0, np.int64), 0
        every = np.concatenate(got)
        near = every[self.slots[every >> np.uint64(64 - _TABLE_BITS)]]
        near = np.unique(near)
        at = np.searchsorted(self.vocabulary, near)
        at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == near] if len(near) else at
        return at, len(np.unique(every))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: one product of the sparse presence matrix with the folded one."""
        found = [self.present(t) for t in texts]
        at, n = [x[0] for x in found], np.array([x[1] for x in found], float)
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(x) for x in at])
        if sizes.sum():
            rows = self.matrix[np.concatenate(at)]
            full = np.flatnonzero(sizes)
            sums[full] = np.add.reduceat(rows, np.concatenate(([0], np.cumsum(sizes[full])[:-1])), axis=0)
        margins = sums / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        best = margins.argmax(axis=1)
        odds = np.exp(2 * (margins - margins.max(axis=1, keepdims=True)))
        score = np.where(n > 0, odds[np.arange(len(best)), best] / odds.sum(axis=1), 0.0)
        return [self.languages[b] if m else UNKNOWN for b, m in zip(best, n, strict=True)], score


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1


def training_rows(docs: DataFrame, key: str, text: str, lang: str, most: int = MAX_TRAIN) -> list:
    """At most `most` rows (text, lang) that are not held out, about as many of each language, shuffled by hash.

    The draw looks at the id's hash only; a text is taken whole."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.length(text) <= MAX_TRAIN_CHARS) & ~F.coalesce(held_out(key), F.lit(False)))
    counts = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if not counts:
        return []
    quota = max(1, most // len(counts))
    draw = F.xxhash64(F.lit(7), F.col(key)) / F.lit(2.0**64) + 0.5
    rate = reduce(lambda rest, c: F.when(F.col(lang) == c["lang"], min(1.0, 1.2 * quota / c["count"])).otherwise(rest), counts, F.lit(0.0))
    chosen = rows.where(draw < rate).select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw"))
    return chosen.orderBy(F.xxhash64(F.lit(8), F.col("text")), "draw").limit(most).select("text", "lang").collect()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", landmarks: int = LANDMARKS) -> Kernel | None:
    rows = training_rows(docs, key, text, lang)
    return Kernel([r.text for r in rows], [r.lang for r in rows], landmarks) if rows else None


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Kernel | None = None) -> DataFrame:
    """(key, held_out, lang_pred, score) of every row."""
    model = model or fit(docs, key, text, lang)
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS texts' n-grams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = shared.value
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch[i : i + 256]
                texts = [x if isinstance(x, str) else None for x in part["_t"]]
                langs, score = kernel.predict(texts) if kernel else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pd.DataFrame({key: part[key], "held_out": part["held_out"], "lang_pred": langs, "score": score})

    rows = docs.select(F.col(key), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text).alias("_t"))
    return rows.mapInPandas(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
