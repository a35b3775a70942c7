"""Operator 4: document fingerprints by a randomised edit embedding.

A walk goes over a shared tape of random bits, one bit for each tape place and character class. At each
place it writes the character it stands on and goes on to the next one if the bit is 1. Two texts that
differ by an edit write different characters for a while and then, since both read the same tape, fall into
step again: edit distance becomes Hamming distance between what is written. The fingerprint samples the
written string at every 2^level-th place, so that 64 to 128 samples cover the whole text; places of a higher
level are among those of a lower one, so fingerprints of different levels can be compared.

Near-duplicate search samples the fingerprint's bits again: a band is the samples at WIDTH places, drawn over the whole
fingerprint. How far the places reach goes in steps of an eighth or so; a fingerprint has the bands of the greatest reach that is within it and of
the LOWER next ones. A likeness of 0.8 takes lengths of which the shorter is at least 0.8 of the longer, less than two steps, so whatever can be that much
alike has bands in common. Fingerprints that agree in a band are verified by likeness; classes are connected components of the verified links.

The walk runs in C (itertools.accumulate over tables of next states), a text at a time, in Arrow batches. Documents are sorted within ranges of the key, which begin at keys
chosen by hash; the first document of a range goes to the one before too. A task reads its ranges as a stream and holds one text
more than its batch.

Defined results: a null text is an empty one, with an empty sample; equal texts have equal fingerprints; the
next document of the last is the first; ids that repeat, and null ids, which come last, go by a hash of the row; a single document
is its own next; an empty table gives no rows; other columns of the input are not read."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, row_key, with_totals
from wayfold.llm.components import connected_components
from wayfold.llm.runs import forest, run_slices, whole_runs

#: Places of the tape (it repeats), character classes.
TAPE, CLASSES = 1024, 64
#: Most samples of a fingerprint; it has more than half as many if the text has.
SAMPLES = 128
#: Documents of one range, on average. Larger only where there would be more than MOST_RANGES: the driver and each task hold
#: one key for each range, and not many more than these.
RANGE_ROWS = 5_000
MOST_RANGES = 100_000
#: Bands of one reach, the places of a band, and the steps of reach between one level and the next.
BANDS, WIDTH, STEPS = 12, 6, 6
#: Lower reaches of which a fingerprint also has the bands: as many steps as the lengths of texts of likeness LEAST can be apart.
LOWER = 2
LEAST = 0.8


def _tape(seed: int = 4) -> list[list]:
    """next[place][class] is the list of next states of the place at which the walk leaves the character."""
    bits = np.random.default_rng(seed).integers(0, 2, (TAPE, CLASSES), dtype=np.int64)
    states: list[list] = [[] for _ in range(TAPE)]
    for c in range(CLASSES):
        ones = np.flatnonzero(bits[:, c])
        leave = ones[np.searchsorted(ones, np.arange(TAPE)) % len(ones)]
        for place, x in enumerate(leave):
            states[place].append(states[(int(x) + 1) % TAPE])
    for place, state in enumerate(states):
        state.append(place)  # the last entry names the state
    return states


_STATES = _tape()
_NAME = itemgetter(-1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(codes: np.ndarray) -> bytes:
    return (((codes * np.uint32(2654435761)) >> np.uint32(26)) & np.uint32(CLASSES - 1)).astype(np.uint8).tobytes()


def walk(codes: np.ndarray, place: int = 0) -> tuple[np.ndarray, int]:
    """For each character the number of places before the walk stands on it; then the number in all.

    `place` is where on the tape the walk begins."""
    names = np.fromiter(map(_NAME, accumulate(_classes(codes), getitem, initial=_STATES[place % TAPE])), np.int64, len(codes) + 1)
    steps = (np.diff(names) - 1) % TAPE + 1
    times = np.concatenate(([0], np.cumsum(steps)))
    return times[:-1], int(times[-1])


def sample(codes: np.ndarray, times: np.ndarray, total: int) -> str:
    """The fingerprint: two hex digits of level, then two for each sampled place: a hash of the character."""
    level = 0
    while total >> level > SAMPLES:
        level += 1
    at = np.searchsorted(times, np.arange(0, total, 1 << level), "right") - 1
    marks = ((codes[at] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return f"{level:02x}" + marks.tobytes().hex()


def fingerprint(text: str | None) -> str:
    codes = _codes(text or "")
    return sample(codes, *walk(codes))


def likeness(a: str, b: str) -> float:
    """Share of equal samples at the higher of the two levels; places that only one has count as unequal."""
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = (np.frombuffer(bytes.fromhex(s[2:]), np.uint8)[:: 1 << (level - int(s[:2], 16))] for s in (a, b))
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum() / max(len(x), len(y))) if len(x) or len(y) else 1.0


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def described(text: str, following: str) -> tuple[int, str, str, str, float]:
    """Of a text and the following one: n_chars, edited_sha256, fingerprint, edited_fingerprint and their likeness."""
    codes, changed = _codes(text), edited(text, following)
    times, total = walk(codes)
    keep = len(text) - len(text) // 2
    # The edited text begins alike: its walk goes on from where the halves part.
    parted = int(times[keep]) if keep < len(times) else total
    new = _codes(changed)
    more, rest = walk(new[keep:], parted)
    own = sample(codes, times, total)
    second = sample(new, np.concatenate((times[:keep], more + parted)), parted + rest)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, own, second, likeness(own, second)


_DIGEST = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _DIGEST.split(", ")]


def _text(x) -> str:
    return x if isinstance(x, str) else ""


def ranges(rows: DataFrame, docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` (k, h, own, ...) with grp and last: documents in ranges of (k, h), null k last. A range begins at a document whose hash
    is divisible by `range_rows`; the first document of the next range (after the last, of the first) is in it too, as its `last`.

    The beginnings are those of `docs` (k, h)."""
    range_rows = max(range_rows, -(-docs.count() // MOST_RANGES))
    starts = F.pmod(F.xxhash64(F.lit(4), "k", "h"), F.lit(range_rows)) == 0
    order = F.struct(F.col("k").isNull().alias("n"), "k", "h")
    heads = docs.where(starts).select(order.alias("o")).distinct().collect() + docs.agg(F.min(order).alias("o")).collect()
    bounds = sorted({(x.o.n, 0 if x.o.n else x.o.k, x.o.h) for x in heads if x.o is not None})
    known, n = set(bounds), max(len(bounds), 1)

    @F.pandas_udf("at int, head boolean")
    def place(k: pd.Series, null: pd.Series, h: pd.Series) -> pd.DataFrame:
        own = [(x, 0 if x else y, z) for x, y, z in zip(null.tolist(), k.tolist(), h.tolist(), strict=True)]
        return pd.DataFrame({"at": np.array([max(bisect_right(bounds, x) - 1, 0) for x in own], np.int32), "head": [x in known for x in own]})

    # Null keys come as 0 (or as an empty string), so that the others keep their type in Python.
    filled = F.coalesce("k", F.lit("" if dict(docs.dtypes)["k"] == "string" else 0).cast(dict(docs.dtypes)["k"]))
    rows = rows.withColumn("p", place(filled, F.col("k").isNull(), F.col("h")))
    here = F.struct(F.col("p.at").alias("grp"), F.lit(False).alias("last"))
    before = F.struct(F.pmod(F.col("p.at") - 1, F.lit(n)).cast("int").alias("grp"), F.lit(True).alias("last"))
    return rows.select("*", F.inline(F.when(F.col("own") & F.col("p.head"), F.array(here, before)).otherwise(F.array(here)))).drop("p")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS, classes: DataFrame | None = None) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id) of every row.

    `classes` are rows (key, h, component_id) for each row of `docs`; by default those of near_classes()."""
    classes = near_classes(docs, key, text) if classes is None else classes
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), row_key(key, text).alias("h"), F.lit(True).alias("own"), F.col(text).alias("text"), F.lit(None).cast("string").alias("c"))
    # A row's class comes just before the row itself: both are dealt out in one shuffle.
    rows = rows.unionByName(classes.select(F.col(key).alias("k"), "h", F.lit(False).alias("own"), F.lit(None).cast("string").alias("text"), F.col("component_id").cast("string").alias("c")))
    rows = ranges(rows, classes.select(F.col(key).alias("k"), "h"), range_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = named = held = before = None  # the class that came last, the text before, and the row of the one before that, but for near_next
        for batch in batches:
            out = []
            for grp, last, own, k, t, c in zip(*[batch[x].tolist() for x in ("grp", "last", "own", "id", "text", "c")], strict=True):
                if grp != group:
                    group, held, before = grp, None, None
                if not own:
                    named = c
                    continue
                t = _text(t)
                if held is not None:
                    row = (held[0], *described(held[1], t), held[2])
                    if before is not None:
                        out.append((*before[:-1], likeness(before[3], row[3]), before[-1]))
                    before = row
                    if last:
                        out.append((*row[:-1], likeness(row[3], fingerprint(t)), row[-1]))
                held, before = (None, None) if last else ((k, t, named), before)
            yield pd.DataFrame(out, columns=["k", *_NAMES, "c"])

    # Ids pass as strings: pandas makes floats of whole numbers among nulls.
    rows = rows.withColumn("id", F.col("k").cast("string"))
    rows = rows.repartition("grp").sortWithinPartitions("grp", "last", F.col("k").asc_nulls_last(), "h", "own")
    out = rows.mapInPandas(run, f"k string, {_DIGEST}, c string")
    return out.select(F.col("k").cast(kind).alias(key), *_NAMES, F.col("c").cast(kind).alias("component_id"))


def plain_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, fingerprint binary) of every row, without a shuffle; h is a hash of id and text."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "h": batch["h"], "fingerprint": [bytes.fromhex(fingerprint(x)) for x in map(_text, batch["_t"])]})

    rows = docs.select(F.col(key), row_key(key, text).alias("h"), F.col(text).alias("_t"))
    return rows.mapInPandas(run, f"`{key}` {kind}, h bigint, fingerprint binary")


def reaches() -> list[int]:
    """How many samples the places of a band may reach over, ascending: a power of two in STEPS steps; the last are of a level's end."""
    down = STEPS * 3
    return [round(SAMPLES / 2 * 2 ** (j / STEPS)) for j in range(-down, STEPS)]


_REACHES = np.array(reaches())


def _places() -> list[np.ndarray]:
    """For each reach BANDS rows of places below it; a reach below a level's first one also serves the level's finer neighbour."""
    draw = np.random.default_rng(24)
    return [np.stack([np.sort(draw.choice(int(x), min(WIDTH, int(x)), replace=False)) for _ in range(BANDS)]) for x in _REACHES]


_PLACES = _places()


def bands(fingerprint: bytes) -> list[int]:
    """Keys of a fingerprint: those of the greatest reach within it and of the LOWER next ones; near a level's end also that of the next level."""
    level, marks = fingerprint[0], np.frombuffer(fingerprint, np.uint8)[1:]
    at = int(np.searchsorted(_REACHES, len(marks), "right")) - 1
    if at < 0:
        return [xxhash.xxh64_intdigest(fingerprint)]
    use = [(level, at - j, marks) for j in range(LOWER + 1) if at >= j]
    if at >= len(_REACHES) - LOWER:
        # Longer texts of the next level look for this one at up to LOWER reaches below their first.
        use.append((level + 1, at - STEPS, marks[::2]))
    return [xxhash.xxh64_intdigest(row.tobytes(), (l << 16) + (r << 8) + i) for l, r, m in use for i, row in enumerate(m[_PLACES[r]])]


class Prints:
    """Fingerprints of a run, to compare one with many at once."""

    def __init__(self, prints: list[bytes]):
        self.level = np.array([x[0] for x in prints])
        self.marks, self.coarse = self._matrix([x[1:] for x in prints]), self._matrix([x[1::2] for x in prints])

    @staticmethod
    def _matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in rows])
        out = np.full((len(rows), max(n.max(), 1)), -1, np.int16)
        out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
        return out, n

    def near(self, at: int, rest: np.ndarray, least: float) -> np.ndarray:
        """Which of `rest` have a likeness of `least` or more to the one at `at`; two levels apart none has, as half the places would be missing."""
        out = np.zeros(len(rest), bool)
        for up, mine, other in ((0, self.marks, self.marks), (1, self.coarse, self.marks), (-1, self.marks, self.coarse)):
            i = np.flatnonzero(self.level[rest] == self.level[at] + up)
            if len(i):
                (x, n), (y, m) = (mine[0][at], mine[1][at]), (other[0][rest[i]], other[1][rest[i]])
                width = min(len(x), y.shape[1])
                same = ((x[:width] == y[:, :width]) & (x[:width] >= 0)).sum(axis=1)
                out[i] = (same >= least * np.maximum(n, m)) | ((n == 0) & (m == 0))
        return out


def near_pairs(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): verified links between distinct fingerprints `prints` (node, fingerprint) that share a band.

    What is dealt out by band is (band, node). A run of a band is known by its members; equal runs of several bands count once, and only
    their members' fingerprints are fetched. A run gives a spanning forest of its verified links, never its pairs."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [bands(x) for x in batch["fingerprint"]]
            yield pd.DataFrame({"band": np.array([k for x in got for k in x], np.uint64).view(np.int64), "node": np.repeat(batch["node"].to_numpy(), [len(x) for x in got])})

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_runs(batches, "band"):
            node, out = block["node"].to_numpy(), []
            for at in run_slices(block["band"].to_numpy()):
                own = np.unique(node[at])
                if len(own) > 1:
                    out.append(pd.DataFrame({"run": np.int64(xxhash.xxh64_intdigest(own.tobytes()) >> 1), "node": own}))
            if out:
                yield pd.concat(out)

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_runs(batches, "run"):
            node, prints, found = block["node"].to_numpy(), block["fingerprint"].tolist(), []
            for at in run_slices(block["run"].to_numpy()):
                own = Prints(prints[at])
                near = lambda i, rest, own=own: own.near(i, rest, least)
                found += [(node[at.start + i], node[at.start + j]) for i, j in forest(len(own.level), near)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = prints.select("node", "fingerprint").mapInPandas(keys, "band bigint, node bigint")
    rows = rows.repartition("band").sortWithinPartitions("band").mapInPandas(runs, "run bigint, node bigint").distinct()
    rows = rows.join(prints.select("node", "fingerprint"), "node")
    return rows.repartition("run").sortWithinPartitions("run", "node").mapInPandas(verified, "a bigint, b bigint").distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, h, component_id) of every row: the smallest key that near-duplicate links lead to. Null or repeated ids are rows of their own."""
    marked = cut(plain_fingerprints(docs, key, text).withColumn("node", F.xxhash64("fingerprint")))
    prints = marked.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), F.min(key).alias("first"))
    nodes = connected_components(near_pairs(prints, least))
    named = nodes.select(F.col("node").alias("n"), "component")
    first = marked.groupBy("node").agg(F.min(key).alias("first"))
    first = first.join(named, F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least_key = first.groupBy("component").agg(F.min("first").alias("component_id"))
    first = with_totals(first, least_key, "component").select("node", "component_id")
    return cut(with_totals(marked.select(key, "h", "node"), first, "node").select(key, "h", "component_id"))
