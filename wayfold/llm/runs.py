"""Runs of rows with one key, from batches that are sorted by it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The same rows in blocks that end where a run of `key` ends. What is held is one batch and one run."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        if k[0] == k[-1] and held and held[-1][key].iat[-1] == k[0]:
            held.append(batch)  # one run goes on; it is joined once, when it ends
            continue
        block = pd.concat([*held, batch]) if held else batch
        k = block[key].to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        held = [block.iloc[last:]]
        yield block.iloc[:last]
    if held:
        yield pd.concat(held)


def run_slices(k: np.ndarray) -> Iterator[slice]:
    """Slices of the runs of two rows or more."""
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True]))) if len(k) else np.zeros(0, int)
    for i in np.flatnonzero(np.diff(cuts) > 1):
        yield slice(cuts[i], cuts[i + 1])


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among 0..n-1; near(i, rest) tells which of `rest` are linked to i."""
    edges, rest, found = [], np.arange(n), []
    while len(rest) or found:
        if not found:
            found.append(int(rest[0]))
            rest = rest[1:]
        at = found.pop()
        if len(rest):
            linked = near(at, rest)
            edges += [(at, int(x)) for x in rest[linked]]
            found += rest[linked].tolist()
            rest = rest[~linked]
    return edges
