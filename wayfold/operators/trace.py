"""One trial as documents: its calls in order with what is known of each, and the paths that its messages name.

A trial of any length is written in parts of so many events, so that no row and no task holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.joins import ancestors

#: Endings by which a bare name is taken for a file (fixed values).
EXTENSIONS = (
    "py pyi ipynb js mjs cjs ts tsx jsx json jsonl yaml yml toml ini cfg conf env md rst txt csv tsv log sh bash zsh c h cc cpp cxx hpp rs go java kt scala rb php pl lua r jl swift "
    "html htm css scss xml sql db sqlite proto lock mk cmake gradle bas cls frm vba xlsm xlsx docx pdf png jpg jpeg svg gif step stp stl dxf obj parquet npy npz pt pth bin tar gz zip").split()
#: Absolute paths, relative paths, and bare file names, not touched on the left by what could continue a path (fixed pattern).
PATH = rf"(?iU)(?<![\w/.@+:-])(?:(?:/[\w.@+-]+)+/?|[\w.@+-]+(?:/[\w.@+-]+)+/?|[\w-][\w.-]*\.(?:{'|'.join(EXTENSIONS)})\b)"
#: Paths of a message that are kept, and changed paths that are listed for one (fixed values).
MAX_MENTIONS, MAX_PATHS = 20, 5
#: Events of a part of a document.
PART = 500


def path_tokens(text: Column) -> Column:
    """Array of the paths and file names of a text, each once, in order of their first place, without punctuation at their ends."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATH), F.lit(0)), lambda t: F.regexp_replace(t, r"[.,:;!?)'\"`]+\z", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.contains("//")))


def path_names(path: Column) -> Column:
    """Array of all that names a changed path: itself and each directory above it as they are, and every run of its parts that follows a slash."""
    parts = F.split(path, "/")
    n = F.size(parts)
    starts = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/"))))
    return F.array_distinct(F.concat(F.when(F.startswith(path, F.lit("/")), ancestors(path, itself=True)).otherwise(F.array().cast("array<string>")), runs))


def tokens(messages: DataFrame, known: DataFrame, key: str, text: str, most: int = MAX_MENTIONS) -> DataFrame:
    """(trial_id, key, place, token): the first `most` paths that each message names, from 1.

    A bare name with a capital in front counts only if it is one of the trial's `known` (trial_id, name). (trial_id, key) is unique; a null text
    names none."""
    rows = messages.select("trial_id", key, F.posexplode(path_tokens(F.col(text))).alias("_at", "token"))
    doubtful = ~F.col("token").contains("/") & F.col("token").rlike(r"^\p{Lu}")
    names = known.select(F.col("trial_id").alias("_t"), F.col("name").alias("_name")).distinct()
    rows = rows.join(names, (F.col("trial_id") == F.col("_t")) & (F.when(doubtful, F.col("token")) == F.col("_name")), "left").where(~doubtful | F.col("_name").isNotNull())
    place = F.row_number().over(Window.partitionBy("trial_id", key).orderBy("_at"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("trial_id", key, "place", "token")


def token_paths(named: DataFrame, changed: DataFrame) -> DataFrame:
    """(trial_id, token, path): changed paths (trial_id, path, ..) that a token names. An absolute token names itself and all under it; another
    one each path that ends with it or has it as a directory. An equal join on all names of a path."""
    paths = changed.select("trial_id", "path").distinct().select("trial_id", "path", F.explode(path_names(F.col("path"))).alias("_name"))
    sought = named.select("trial_id", "token").distinct().withColumn("_name", F.regexp_replace("token", r"/+\z", ""))
    return sought.join(paths, ["trial_id", "_name"]).select("trial_id", "token", "path")


def mentions(messages: DataFrame, changed: DataFrame, known: DataFrame, key: str = "step_idx", text: str = "message", most: int = MAX_MENTIONS) -> DataFrame:
    """(trial_id, key, place, token, paths, more, calls): tokens() with the first MAX_PATHS of the changed paths that each names, how many
    more there are, and the number of calls (trial_id, path, call) that changed one of them. mention_calls() lists those."""
    named = tokens(messages, known, key, text, most)
    met = token_paths(named, changed)
    place = F.row_number().over(Window.partitionBy("trial_id", "token").orderBy("path"))
    first = met.withColumn("_n", place).where(F.col("_n") <= MAX_PATHS).groupBy("trial_id", "token").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    total = met.groupBy("trial_id", "token").agg(F.count("*").alias("_paths"))
    calls = mention_calls(met, changed).groupBy("trial_id", "token").agg(F.count("*").alias("_calls"))
    on = ["trial_id", "token"]
    rows = named.join(first, on, "left").join(total, on, "left").join(calls, on, "left")
    return rows.select(
        "trial_id", key, "place", "token", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"),
        F.greatest(F.coalesce("_paths", F.lit(0)) - MAX_PATHS, F.lit(0)).cast("int").alias("more"), F.coalesce("_calls", F.lit(0)).cast("long").alias("calls"))


def mention_calls(met: DataFrame, changed: DataFrame) -> DataFrame:
    """(trial_id, token, call): the calls that changed a path of token_paths(), each once."""
    return met.join(changed.select("trial_id", "path", "call").distinct(), ["trial_id", "path"]).select("trial_id", "token", "call").distinct()


def documents(trials: DataFrame, events: DataFrame, n: str = "step_idx", status: str = "status", part: int = PART) -> DataFrame:
    """(trial_id, part, document): part 0 has the trial and its counts by status, each later part up to `part` events as a list in order.

    trials: one row a trial; events: trial_id, n (from 0 or more, unique in a trial), status, and whatever else is known of an event. A trial without
    events has part 0 only, with no counts; events of no trial are left out."""
    events = events.join(trials.select("trial_id"), "trial_id", "left_semi")
    rest = [c for c in events.columns if c not in ("trial_id", n)]
    json = {"ignoreNullFields": "false"}
    listed = F.array_sort(F.collect_list(F.struct(n, F.struct(n, *rest).alias("_e"))), lambda x, y: F.when(x[n] < y[n], -1).when(x[n] > y[n], 1).otherwise(0))
    parts = events.groupBy("trial_id", (F.floor(F.col(n) / part) + 1).cast("int").alias("part")).agg(F.to_json(F.transform(listed, lambda x: x["_e"]), json).alias("document"))
    counts = events.groupBy("trial_id", F.coalesce(status, F.lit("unknown")).alias("_s")).agg(F.count("*").alias("_c"))
    counts = counts.groupBy("trial_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_s", "_c")))).alias("_counts"))
    head = trials.join(counts, "trial_id", "left").withColumn("_counts", F.coalesce("_counts", F.create_map().cast("map<string,bigint>")))
    head = head.select("trial_id", F.lit(0).alias("part"), F.to_json(F.struct(F.struct(*trials.columns).alias("trial"), F.col("_counts").alias("counts")), json).alias("document"))
    return head.unionByName(parts)
