"""Line matching between two versions of a text, and what stands on it: opcodes, unified diffs, partial fixes, blame.

Common lines at both ends are matched by expressions. What is left is a set of candidate pairs (i, j) of equal lines, from an equal join, of
which the longest run that increases in both is taken. In a small middle every pair of equal lines is a candidate, and the run is a longest
common subsequence: no script has fewer edits. In a larger one the candidates are the lines that occur once on either side; the
gaps between those of the run are then small middles of their own, or are replaced whole."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.lineage import written

#: Lines of one side times lines of the other up to which all pairs of equal lines are candidates (fixed value).
EXACT = 60_000


def longest_increasing(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of a longest run of pairs that increases in i and j; the pairs are sorted by i, those of one i by falling j."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(j)
    for n, x in enumerate(j.tolist()):
        k = bisect_left(ends, x)
        ends[k : k + 1], at[k : k + 1] = [x], [n]
        before[n] = at[k - 1] if k else -1
    run, n = [], at[-1] if at else -1
    while n >= 0:
        run.append(n)
        n = before[n]
    return run[::-1]


def _whole_runs(by: list[str]) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "j"], ascending=[True, False])
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        taken = longest_increasing(i, j)
        i, j = i[taken], j[taken]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1))))
        out = rows[by].iloc[[0] * len(first)].reset_index(drop=True)
        return out.assign(i=i[first], j=j[first], n=np.diff(np.append(first, len(i))))

    return run


def _runs(pairs: DataFrame, by: list[str], only_unique: bool) -> DataFrame:
    """(by, i, j, n): the longest run of candidates of each pair of arrays x and y, as blocks of n lines, moved by i0 and j0."""
    sides = [pairs.select(*by, F.posexplode(side).alias("at", "line"), start).select(*by, "line", F.lit(side).alias("side"), (F.col("at") + F.col(start)).alias("at"))
             for side, start in (("x", "i0"), ("y", "j0"))]
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("at")))
    lines = sides[0].unionByName(sides[1].select(*by, "line", "side", "at")).groupBy(*by, "line").agg(of("x").alias("xs"), of("y").alias("ys"))
    fits = (F.size("xs") == 1) & (F.size("ys") == 1) if only_unique else (F.size("xs") > 0) & (F.size("ys") > 0)
    candidates = lines.where(fits).select(*by, F.explode("xs").alias("i"), "ys").select(*by, "i", F.explode("ys").alias("j"))
    kinds = dict(pairs.dtypes)
    return candidates.groupBy(*by).applyInPandas(_whole_runs(by), ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "i int", "j int", "n int"]))


def _trimmed(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, m, head, tail, x, y): sizes, common ends, and what is between them, from i0 = j0 = head on."""
    lines = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    common = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True) - 1  # noqa: E731  -1: no difference
    p = pairs.select(*by, lines(a).alias("a"), lines(b).alias("b")).withColumns({"n": F.size("a"), "m": F.size("b")})
    both = F.least("n", "m")
    upto = lambda c, most: F.when(c < 0, most).otherwise(F.least(c, most)).cast("int")
    p = p.withColumn("head", upto(common(F.col("a"), F.col("b")), both))
    rest = lambda c, n: F.reverse(F.slice(c, F.col("head") + 1, F.col(n) - F.col("head")))
    p = p.withColumn("tail", upto(common(rest("a", "n"), rest("b", "m")), both - F.col("head")))
    middle = lambda c, n: F.slice(c, F.col("head") + 1, F.col(n) - F.col("head") - F.col("tail"))
    return p.select(*by, "n", "m", "head", "tail", middle("a", "n").alias("x"), middle("b", "m").alias("y"), F.col("head").alias("i0"), F.col("head").alias("j0"))


def matches(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, i, j, n): blocks of n lines from line i of array `a` and j of `b` on, equal and in the same order on both sides.

    `by` names a pair and is unique, with other names than the columns that are made here; a null array is an empty one; null lines equal
    each other."""
    by = list(by)
    p = written(_trimmed(pairs, by, a, b))
    block = lambda i, j, n: F.struct(i.alias("i"), j.alias("j"), n.alias("n"))
    ends = F.array(block(F.lit(0), F.lit(0), F.col("head")), block(F.col("n") - F.col("tail"), F.col("m") - F.col("tail"), F.col("tail")))
    out = p.select(*by, F.explode(ends).alias("e")).select(*by, "e.i", "e.j", "e.n").where("n > 0")
    size = F.size("x").cast("long") * F.size("y")
    small, large = p.where((size > 0) & (size <= EXACT)), p.where(size > EXACT)
    anchors = written(_runs(large, by, only_unique=True))
    # Gaps before each block of anchors and after the last: where the block before it ended, up to where it begins.
    stops = anchors.unionByName(large.select(*by, (F.col("i0") + F.size("x")).alias("i"), (F.col("j0") + F.size("y")).alias("j"), F.lit(0).alias("n")))
    order = Window.partitionBy(*by).orderBy("i", "j")
    ended = lambda c: F.lag(F.col(c) + F.col("n")).over(order)
    gaps = stops.select(*by, F.col("i").alias("i1"), F.col("j").alias("j1"), ended("i").alias("gi"), ended("j").alias("gj"))
    gaps = gaps.join(large.select(*by, "x", "y", "i0", "j0"), by).withColumns({"gi": F.coalesce("gi", "i0"), "gj": F.coalesce("gj", "j0")})
    gaps = gaps.where("i1 > gi and j1 > gj").where((F.col("i1") - F.col("gi")).cast("long") * (F.col("j1") - F.col("gj")) <= EXACT)
    gaps = gaps.select(*by, F.slice("x", F.col("gi") - F.col("i0") + 1, F.col("i1") - F.col("gi")).alias("x"), F.slice("y", F.col("gj") - F.col("j0") + 1, F.col("j1") - F.col("gj")).alias("y"),
                       F.col("gi").alias("i0"), F.col("gj").alias("j0"), F.col("gi").alias("gap"))
    inner = _runs(gaps, [*by, "gap"], only_unique=False).drop("gap")
    return out.unionByName(_runs(small, by, only_unique=False)).unionByName(anchors).unionByName(inner)


def opcodes(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, tag, i1, i2, j1, j2): equal, replace, delete and insert ranges that turn `a` into `b`, equal and other ones in turn."""
    by = list(by)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    blocks = matches(pairs, by, a, b).unionByName(pairs.select(*by, size(a).alias("i"), size(b).alias("j"), F.lit(0).alias("n")))
    order = Window.partitionBy(*by).orderBy("i", "j", "n")
    ended = lambda c: F.coalesce(F.lag(F.col(c) + F.col("n")).over(order), F.lit(0))
    blocks = blocks.select(*by, "i", "j", "n", ended("i").alias("pi"), ended("j").alias("pj"))
    blocks = blocks.withColumn("run", F.count_if((F.col("i") > F.col("pi")) | (F.col("j") > F.col("pj"))).over(order))
    tag = F.when(F.col("i") == F.col("pi"), "insert").when(F.col("j") == F.col("pj"), "delete").otherwise("replace")
    edits = blocks.where("i > pi or j > pj").select(*by, tag.alias("tag"), F.col("pi").alias("i1"), F.col("i").alias("i2"), F.col("pj").alias("j1"), F.col("j").alias("j2"))
    equal = blocks.where("n > 0").groupBy(*by, "run").agg(F.min("i").alias("i1"), F.max(F.col("i") + F.col("n")).alias("i2"), F.min("j").alias("j1"), F.max(F.col("j") + F.col("n")).alias("j2"))
    return edits.unionByName(equal.select(*by, F.lit("equal").alias("tag"), "i1", "i2", "j1", "j2"))


def with_opcodes(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """`pairs` with `ops`, its opcodes in order as one array."""
    by = list(by)
    listed = F.array_sort(F.collect_list(F.struct("i1", "j1", "i2", "j2", "tag")))
    ops = opcodes(pairs, by, a, b).groupBy(*by).agg(listed.alias("ops"))
    same = [pairs[c].eqNullSafe(ops[c]) for c in by]
    joined = pairs.join(ops, same, "left").select(*[pairs[c] for c in pairs.columns], "ops")
    return joined.withColumn("ops", F.coalesce("ops", F.expr("cast(array() as array<struct<i1: int, j1: int, i2: int, j2: int, tag: string>>)")))


def _range(lines: str, start: Column, end: Column) -> Column:
    return F.slice(F.coalesce(F.col(lines), F.array().cast("array<string>")), start + 1, end - start)


def unified(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b", context: int = 3) -> DataFrame:
    """`pairs` with `ops` and `diff`: a unified diff of two arrays of lines without line ends; null for an array is no file.

    Two changes with at most 2 * context equal lines between them share a hunk. No change: an empty text."""
    whole = with_opcodes(pairs, by, a, b)
    # Equal ranges are cut to the context; a longer one between two changes ends one hunk and begins the next.
    last = F.size("ops") - 1
    clipped = F.transform("ops", lambda o, k: F.when(o["tag"] != "equal", F.array(o)).otherwise(F.array(
        F.when(k > 0, o.withField("i2", F.least(o["i2"], o["i1"] + context)).withField("j2", F.least(o["j2"], o["j1"] + context))),
        F.when((k < last) & ((k == 0) | (o["i2"] - o["i1"] > 2 * context)), F.struct(F.lit(0).alias("i1"), F.lit(0).alias("j1"), F.lit(0).alias("i2"), F.lit(0).alias("j2"), F.lit("cut").alias("tag"))),
        F.when(k < last, o.withField("i1", F.greatest(o["i2"] - context, F.when(o["i2"] - o["i1"] > 2 * context, o["i1"]).when(k == 0, o["i1"]).otherwise(F.least(o["i2"], o["i1"] + context))))
               .withField("j1", F.greatest(o["j2"] - context, F.when(o["i2"] - o["i1"] > 2 * context, o["j1"]).when(k == 0, o["j1"]).otherwise(F.least(o["j2"], o["j1"] + context))))),
    )))
    flat = F.filter(F.flatten(clipped), lambda o: o.isNotNull() & ((o["tag"] != "equal") | (o["i2"] > o["i1"])))
    marked = lambda lines, start, end, mark: F.transform(_range(lines, start, end), lambda x: F.concat(F.lit(mark), x))
    text = F.transform("flat", lambda o: F.when(o["tag"] == "equal", marked(a, o["i1"], o["i2"], " ")).otherwise(F.concat(marked(a, o["i1"], o["i2"], "-"), marked(b, o["j1"], o["j2"], "+"))))
    whole = whole.withColumn("flat", flat).withColumn("text", text)
    # Hunks: the pieces between cuts.
    cuts = F.filter(F.transform("flat", lambda o, k: F.when(o["tag"] == "cut", k)), lambda k: k.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda k: k + 1))
    ends = F.concat(cuts, F.array(F.size("flat")))
    hunks = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda h: h["e"] > h["s"])
    whole = whole.withColumn("hunks", hunks)
    beginning = lambda at, n: F.concat(F.when(n == 0, at).otherwise(at + 1), F.lit(","), n)

    def hunk(h: Column) -> Column:
        first, end = F.get("flat", h["s"]), F.get("flat", h["e"] - 1)
        head = F.concat(F.lit("@@ -"), beginning(first["i1"], end["i2"] - first["i1"]), F.lit(" +"), beginning(first["j1"], end["j2"] - first["j1"]), F.lit(" @@"))
        return F.concat(F.array(head), F.flatten(F.slice("text", h["s"] + 1, h["e"] - h["s"])))

    changed = F.exists("ops", lambda o: o["tag"] != "equal")
    head = F.array(F.when(F.col(a).isNull(), "--- /dev/null").otherwise("--- a"), F.when(F.col(b).isNull(), "+++ /dev/null").otherwise("+++ b"))
    body = F.concat(head, F.flatten(F.transform("hunks", hunk)))
    named = F.when(changed | (F.col(a).isNull() != F.col(b).isNull()), F.concat(F.array_join(body, "\n"), F.lit("\n"))).otherwise("")
    return whole.withColumn("diff", named).drop("flat", "text", "hunks")


def partial_fix(ops: Column, a: str, b: str, keep: Column) -> Column:
    """The lines of `a` with only those changes of `ops` applied whose number (from 0, equal ranges not counted) is in `keep`."""
    number = lambda k: F.size(F.filter(F.slice(ops, 1, k), lambda o: o["tag"] != "equal"))
    return F.flatten(F.transform(ops, lambda o, k: F.when((o["tag"] != "equal") & F.array_contains(keep, number(k)), _range(b, o["j1"], o["j2"])).otherwise(_range(a, o["i1"], o["i2"]))))


def fix_hunks(ops: Column, n_lines: Column) -> Column:
    """Array of (removed, inserted_before, added, anchors) of a fix, lines from 1: the final version's lines that it removes; for a pure
    insertion the line it goes before, and the lines on either side of it."""
    def one(o: Column) -> Column:
        pure = o["i1"] == o["i2"]
        sides = F.filter(F.array(o["i1"], o["i1"] + 1), lambda x: (x >= 1) & (x <= n_lines))
        none = F.array().cast("array<int>")
        return F.struct(F.when(pure, none).otherwise(F.sequence(o["i1"] + 1, F.greatest(o["i2"], o["i1"] + 1))).alias("removed"), F.when(pure, o["i1"] + 1).alias("inserted_before"),
                        (o["j2"] - o["j1"]).alias("added"), F.when(pure, sides).otherwise(none).alias("anchors"))

    return F.transform(F.filter(ops, lambda o: o["tag"] != "equal"), one)


def _numbered(versions: DataFrame, by: list[str], index: str) -> DataFrame:
    """(by, index, _t, _last): versions numbered from 0, and the last number. Only keys and numbers are sorted here."""
    of = Window.partitionBy(*by)
    return versions.select(*by, index).withColumns({"_t": F.row_number().over(of.orderBy(index)) - 1, "_last": F.count("*").over(of) - 1})


def blame(versions: DataFrame, by: Sequence[str], index: str = "index", lines: str = "lines") -> DataFrame:
    """(by, line_no, line, origin) of the last version of each file: the index that brought each line.

    `lines` is an array, null where the file is absent; (by, index) is unique, without nulls in `by`. Lines are compared without blanks at
    their ends. Each version is a map of its lines to the version before, or to their own index where they are new. Maps compose; two
    neighbours become one, until a file has one map. So a file of any number of versions takes as many rounds as that number has
    bits, and no task holds more of it than two versions."""
    by = list(by)
    all_versions = written(_numbered(versions, by, index).join(versions.select(*by, index, lines), [*by, index]))
    clean = F.transform(lines, lambda x: F.rtrim(x))
    now = all_versions.select(*by, "_t", clean.alias("b"))
    pairs = now.join(all_versions.select(*by, (F.col("_t") + 1).alias("_t"), clean.alias("a")), [*by, "_t"])
    kept = matches(pairs, [*by, "_t"])
    kept = kept.select(*by, "_t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x"), "i", "j").select(*by, "_t", (F.col("j") + F.col("x")).alias("j"), (F.col("i") + F.col("x")).alias("i"))
    every = all_versions.select(*by, "_t", "_last", index, F.posexplode(lines).alias("j", "line")).drop("line")
    maps = every.join(kept, [*by, "_t", "j"], "left").select(*by, "_t", "_last", "j", "i", F.when(F.col("i").isNull(), F.col(index)).alias("origin"))
    most = all_versions.agg(F.max("_last")).first()[0] or 0
    half = (F.col("_last") / 2).cast("int")
    while most:
        maps = written(maps)
        later, earlier = maps.where("_t % 2 = 1"), maps.where("_t % 2 = 0")
        through = later.where("i is not null").withColumn("_t", F.col("_t") - 1).join(earlier.select(*by, "_t", F.col("j").alias("i"), F.col("i").alias("i2"), F.col("origin").alias("o2")), [*by, "_t", "i"])
        through = through.select(*by, "_t", "_last", "j", F.col("i2").alias("i"), F.col("o2").alias("origin"))
        maps = through.unionByName(later.where("i is null")).unionByName(earlier.where("_t = _last"))
        maps = maps.withColumns({"_t": (F.col("_t") / 2).cast("int"), "_last": half})
        most //= 2
    text = all_versions.where("_t = _last").select(*by, F.posexplode(lines).alias("j", "line"))
    return text.join(maps.select(*by, "j", "origin"), [*by, "j"]).select(*by, (F.col("j") + 1).alias("line_no"), "line", "origin")


def blame_fix(ops_of_fix: DataFrame, blamed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, part, line_no, origin): the versions that brought the lines a fix removes (`removed`), or next to which it inserts (`anchor`).

    ops_of_fix: (by, ops, n_lines) of the final version against the fixed one; blamed: as from blame()."""
    by = list(by)
    hunks = ops_of_fix.select(*by, F.explode(fix_hunks(F.col("ops"), F.col("n_lines"))).alias("h"))
    of = lambda name, lines: hunks.select(*by, F.lit(name).alias("part"), F.explode(lines).alias("line_no"))
    wanted = of("removed", "h.removed").unionByName(of("anchor", "h.anchors")).distinct()
    return wanted.join(blamed.select(*by, "line_no", "origin"), [*by, "line_no"]).select(*by, "part", "line_no", "origin")
