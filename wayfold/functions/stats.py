"""Agreement and exact tests. What is one number a group is an aggregate; exact tests work on small tables of
counts, one call a group, in Arrow batches."""

from __future__ import annotations

from itertools import permutations, product
from math import comb, factorial
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kappa(a: str, b: str) -> Column:
    """Cohen's kappa of two boolean columns; null without rows or where chance agreement is 1."""
    n = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    pa, pb = F.try_divide(F.count_if(F.col(a) & F.col(b).isNotNull()), n), F.try_divide(F.count_if(F.col(b) & F.col(a).isNotNull()), n)
    seen = F.try_divide(F.count_if(F.col(a) == F.col(b)), n)
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.try_divide(seen - chance, 1 - chance)


def agreement(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, both_yes, a_only, b_only, both_no, kappa)."""
    x, y = F.col(a), F.col(b)
    return rows.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(x & y).alias("both_yes"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"),
        F.count_if(~x & ~y).alias("both_no"), F.round(kappa(a, b), 9).alias("kappa"))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: tables no likelier than the one seen."""
    rows, col, n = a + b, a + c, a + b + c + d
    weight = lambda k: comb(rows, k) * comb(n - rows, col - k)
    seen, all_k = weight(a), range(max(0, col - (n - rows)), min(rows, col) + 1)
    return sum(w for k in all_k if (w := weight(k)) <= seen) / comb(n, col)


def fisher_2x2(*counts: str) -> Column:
    """fisher() of four columns of counts."""
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)

    return F.pandas_udf(test, "double")(*counts)


def freeman_halton(table: list[tuple[int, int]], tolerance: float = 1e-9) -> float:
    """Exact p of an r x 2 table with its margins fixed: a convolution over rows of (first column, likelihood)."""
    sizes, col = [x + y for x, y in table], sum(x for x, _ in table)
    seen = 1.0
    for (x, _), n in zip(table, sizes, strict=True):
        seen *= comb(n, x)
    ways: dict[tuple[int, float], float] = {(0, 1.0): 1.0}
    for n in sizes:
        after: dict[tuple[int, float], float] = {}
        for (used, w), times in ways.items():
            for k in range(min(n, col - used) + 1):
                key = (used + k, w * comb(n, k))
                after[key] = after.get(key, 0.0) + times
        ways = after
    mass = sum(w * t for (used, w), t in ways.items() if used == col and w <= seen * (1 + tolerance))
    return mass / comb(sum(sizes), col)


def wilcoxon(differences: list[float]) -> float:
    """Exact two-sided signed-rank p over all sign patterns, zeros dropped, ties at mid ranks: by counting sums."""
    d = [x for x in differences if x]
    ordered = sorted(abs(x) for x in d)
    double = [ordered.index(abs(x)) + 1 + len(ordered) - ordered[::-1].index(abs(x)) for x in d]  # twice the mid rank
    ways = {0: 1}
    for r in double:
        after: dict[int, int] = {}
        for s, n in ways.items():
            after[s] = after.get(s, 0) + n
            after[s + r] = after.get(s + r, 0) + n
        ways = after
    seen, total = sum(r for r, x in zip(double, d, strict=True) if x > 0), sum(double)
    far = abs(2 * seen - total)
    return sum(n for s, n in ways.items() if abs(2 * s - total) >= far) / 2 ** len(d)


def rank_sum(strata: list[tuple[list[float], list[float]]]) -> float:
    """Exact two-sided p of the sum of rank sums within strata: subset sums, then a convolution over strata."""
    seen, ways = 0, {0: 1}
    for first, second in strata:
        pooled = sorted(first + second)
        double = {v: pooled.index(v) + 1 + len(pooled) - pooled[::-1].index(v) for v in set(pooled)}
        seen += sum(double[v] for v in first)
        sums = {(0, 0): 1}
        for v in pooled:
            after = dict(sums)
            for (k, s), n in sums.items():
                if k < len(first):
                    after[k + 1, s + double[v]] = after.get((k + 1, s + double[v]), 0) + n
            sums = after
        own = {s: n for (k, s), n in sums.items() if k == len(first)}
        merged: dict[int, int] = {}
        for (s, n), (x, m) in product(ways.items(), own.items()):
            merged[s + x] = merged.get(s + x, 0) + n * m
        ways = merged
    total = sum(ways.values())
    mean = sum(s * n for s, n in ways.items()) / total
    return sum(n for s, n in ways.items() if abs(s - mean) >= abs(seen - mean) - 1e-9) / total


def grouped(rows: DataFrame, by: list[str], test, name: str = "p") -> DataFrame:
    """(by, name): test(rows of a group as a pandas frame); groups are small samples by design of an exact test."""
    kinds = dict(rows.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, float(test(part))]], columns=[*by, name])

    return rows.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"{name} double"]))


def holm(p: str, by: list[str]) -> Column:
    """Step-down adjusted p within `by`."""
    order = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*by))
    i = F.row_number().over(order)
    return F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max((m - i + 1) * F.col(p)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))


def mid_rank(value: str, by: list[str]) -> Column:
    """Rank, ties at their mean."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float, name: str, parts: int = 64) -> DataFrame:
    """(by, name): the value at place bround(share * n) of a group's sorted values, the first place at the least. Nulls do not count.

    Values are counted first. Running counts go in two steps, over ranges of values and within the one range that holds the place, so that
    no task has all of a group. The ranges come from approximate quantiles; where exactly they are cut does not change the result."""
    of = F.struct(*by)  # a struct takes nulls as equal, and as a key of its own lets a hot group of the join be split
    known = rows.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_g", of)
    cuts = known.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("_cuts")).select(of.alias("_of"), "_cuts")
    placed = counts.join(cuts, F.col("_g") == F.col("_of")).withColumn("_range", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_v"))))
    placed = placed.select("_g", "_v", "_n", "_range")
    ranges = placed.groupBy("_g", "_range").agg(F.sum("_n").alias("_in"))
    ranges = ranges.withColumns({"_upto": F.sum("_in").over(Window.partitionBy("_g").orderBy("_range")), "_all": F.sum("_in").over(Window.partitionBy("_g"))})
    place = F.greatest(F.least(F.bround(share * F.col("_all")).cast("long"), F.col("_all")), F.lit(1))
    holding = ranges.withColumn("_place", place).where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_in") < F.col("_place")))
    held = holding.select(F.struct("_g", "_range").alias("_held"), (F.col("_place") - F.col("_upto") + F.col("_in")).alias("_rest"))
    inside = placed.join(held, F.struct("_g", "_range") == F.col("_held"))
    inside = inside.withColumn("_to", F.sum("_n").over(Window.partitionBy("_g").orderBy("_v")))
    return inside.where("_to >= _rest").groupBy("_g").agg(F.min("_v").alias(name)).select(*[F.col(f"_g.{c}") for c in by], name)


def p95_nearest(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): nearest-rank 95th percentile."""
    return nearest_rank(rows, by, value, 0.95, name)


def friedman(rows: DataFrame, block: str, arm: str, value: str) -> DataFrame:
    """(blocks, arms, chi2) of complete blocks, from mid ranks within blocks."""
    ranked = rows.withColumn("_r", mid_rank(value, [block]))
    per = ranked.groupBy(arm).agg(F.sum("_r").alias("s"), F.count("*").alias("n"))
    k, n = F.count("*"), F.max("n")
    return per.agg(n.alias("blocks"), k.alias("arms"), F.round(12 / (n * k * (k + 1)) * F.sum(F.col("s") * F.col("s")) - 3 * n * (k + 1), 6).alias("chi2"))


def friedman_exact(ranks: list[list[float]]) -> float:
    """P of a statistic at least this large if all orders of a block's ranks are as likely: the distribution of the arms' rank sums, one block
    after another. ranks: a list for each block, over the same arms. Ranks are doubled, so that ties are whole numbers."""
    blocks = [tuple(round(2 * r) for r in b) for b in ranks]
    arms = len(blocks[0])
    spread = lambda sums: sum(x * x for x in sums)
    seen = spread([sum(b[i] for b in blocks) for i in range(arms)])
    # The arms are alike, so sums count by their sorted form only.
    ways = {(0,) * arms: 1}
    for b in blocks:
        orders, more = list(permutations(b)), {}
        for sums, n in ways.items():
            for o in orders:
                key = tuple(sorted(map(add, sums, o)))
                more[key] = more.get(key, 0) + n
        ways = more
    return sum(n for sums, n in ways.items() if spread(sums) >= seen) / factorial(arms) ** len(blocks)


def friedman_permuted(rows: DataFrame, by: list[str], block: str, arm: str, value: str, permutations: int, seed: int = 0) -> DataFrame:
    """(by, p): seeded permutation p of Friedman's statistic, (1 + at least as large) / (1 + permutations).

    Each permutation deals the ranks of each block out anew, by hashes of seed, permutation, block and arm; the same rows give the same p, however they
    are partitioned. (by, block, arm) is unique and every block has all arms."""
    ranked = rows.withColumn("_r", mid_rank(value, [*by, block]))
    block_rows = ranked.groupBy(*by, block).agg(F.array_sort(F.collect_list(F.struct(F.col(arm).alias("a"), F.col("_r").alias("r")))).alias("_c"))
    drawn = block_rows.select(*by, block, "_c", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("_p"))
    dealt = F.array_sort(F.transform("_c", lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col("_p"), F.col(block), x["a"]).alias("h"), i.alias("i"))))
    order = F.when(F.col("_p") == 0, F.transform("_c", lambda x, i: i)).otherwise(F.transform(dealt, lambda x: x["i"]))
    each = drawn.select(*by, "_p", F.posexplode(F.transform(order, lambda i: F.get("_c", i)["r"])).alias("_arm", "_r"))
    sums = each.groupBy(*by, "_p", "_arm").agg(F.sum("_r").alias("_s")).groupBy(*by, "_p").agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    seen = sums.where("_p = 0").select(F.struct(*by).alias("_of"), F.col("_q").alias("_seen"))
    both = sums.where("_p > 0").join(seen, F.struct(*by) == F.col("_of"))
    return both.groupBy(*by).agg(((1 + F.count_if(F.col("_q") >= F.col("_seen") - 1e-9)) / (1 + F.count("*"))).alias("p"))


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, resamples: int = 2000) -> DataFrame:
    """(by, low, high): 2.5 and 97.5 percentiles of means of resamples, by Poisson counts of each row.

    A row draws its counts from a hash of its group, its value and its number among equal ones, so nothing is gathered, and the result does not depend
    on partitioning. Counts above 16 have odds under 1e-14 and are not drawn."""
    equal = rows.groupBy(*by, value).agg(F.count("*").alias("_m"))
    each = equal.select(*by, value, F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_i"))
    drawn = each.select(*by, value, F.xxhash64(*by, value, "_i").alias("_h"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b"))
    u = F.xxhash64("_h", "_b") / F.lit(2.0**64) + 0.5
    edges, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(16):
        total += term
        edges.append(total)
        term /= k + 1
    count = sum((F.when(u > e, 1).otherwise(0) for e in edges), F.lit(0))
    means = drawn.withColumn("_c", count).groupBy(*by, "_b").agg(F.try_divide(F.sum(F.col("_c") * F.col(value)), F.sum("_c")).alias("_m"))
    return means.groupBy(*by).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
