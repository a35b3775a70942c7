"""A store: Parquet tables of one version, written by trial, read as views; its export and the check of it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import schemas
from wayfold.functions import patterns
from wayfold.plans.views import VIEWS


class StoreError(ValueError):
    pass


def views_id() -> str:
    """Names the view definitions: patterns, thresholds and column lists."""
    text = json.dumps({k: v for k, v in vars(patterns).items() if k.isupper()}, sort_keys=True, default=str) + ",".join(VIEWS)
    return f"1-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


class Store:
    """Tables below `root`: record/ and heldout/, partitioned by trial, and meta. Held-out tables are read only by name,
    never registered as views."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{'record' if name in schemas.RECORD else 'heldout'}/{name}"

    def create(self) -> None:
        """Write empty tables and the meta row; a store of the same version is left as it is."""
        try:
            self.check()
            return
        except StoreError as error:
            if "no store" not in str(error):
                raise
        for name in [*schemas.RECORD, *schemas.HELD_OUT]:
            self.spark.createDataFrame([], schemas.schema(name)).write.mode("errorifexists").parquet(f"{self.path(name)}/_empty")
        meta = [("schema_version", json.dumps(schemas.VERSION)), ("views_id", json.dumps(views_id()))]
        self.spark.createDataFrame(meta, "key string, value string").coalesce(1).write.parquet(f"{self.root}/meta")

    def meta(self) -> dict:
        try:
            return {r.key: json.loads(r.value) for r in self.spark.read.parquet(f"{self.root}/meta").collect()}
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            raise StoreError(f"no store at {self.root}") from error

    def check(self) -> None:
        meta = self.meta()
        if meta.get("schema_version") != schemas.VERSION:
            raise StoreError(f"store of version {meta.get('schema_version')}, not {schemas.VERSION}")
        if meta.get("views_id") != views_id():
            raise StoreError("the store's views are of another definition")

    def table(self, name: str, trial_id: str | None = None) -> DataFrame:
        df = self.spark.read.schema(schemas.schema(name)).option("recursiveFileLookup", True).parquet(self.path(name))
        return df if trial_id is None else df.where(F.col("trial_id") == trial_id)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schemas.RECORD}

    def stored(self) -> DataFrame:
        return self.table("trials").select("trial_id")

    def put(self, tables: dict[str, DataFrame], replace: bool = False) -> None:
        """Add trials; those already stored are left out, or replaced. The trials table is written last: a trial
        that it does not name is not there."""
        new = tables["trials"].select("trial_id").distinct()
        if not replace:
            new = new.join(self.stored(), "trial_id", "left_anti")
        for name in sorted(tables, key=lambda n: n == "trials"):
            bad = schemas.violations(schemas.conform(tables[name], name), name)
            if not bad.isEmpty():
                raise StoreError(f"{name}: {bad.select('broken').first().broken}")
            rows = schemas.conform(tables[name], name).join(new, "trial_id", "left_semi")
            # One directory a trial, so that a trial is replaced as one partition.
            part = rows.withColumn("_trial", F.col("trial_id")).repartition("_trial")
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_trial").parquet(self.path(name))

    def register(self, session: SparkSession | None = None) -> None:
        """The record tables and derived views as temporary views; nothing of the held-out tables."""
        tables = self.tables()
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        for name, build in VIEWS.items():
            build(tables).createOrReplaceTempView(name)


def as_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text with their null fields, in the order of all columns, nulls last."""
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns])
    return ordered.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("value"))


def export(tables: dict[str, DataFrame], out: str) -> None:
    """Every relation as JSON lines, verified by reading it again; nothing counts until export_differs() is empty."""
    for name, df in tables.items():
        as_lines(df).write.mode("errorifexists").text(f"{out}/{name}")


def export_differs(tables: dict[str, DataFrame], out: str) -> list[str]:
    """Names of the relations whose export does not read back as the same rows, either way round."""
    bad = []
    for name, df in tables.items():
        again = df.sparkSession.read.schema(df.schema).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("mode", "FAILFAST").json(f"{out}/{name}")
        if not df.exceptAll(again).isEmpty() or not again.exceptAll(df).isEmpty():
            bad.append(name)
    return bad


def hunk_paths(deltas: DataFrame) -> DataFrame:
    """(trial_id, step_idx, path, file) of each stored diff; unsafe paths are left out."""
    rows = deltas.where("hunk is not null").where(~F.col("path").rlike(r"(^|/)\.\.?(/|\z)|\x00"))
    return rows.select("trial_id", "step_idx", "path", F.concat(F.lit("deltas/"), "trial_id", F.lit("/"), "step_idx", "path", F.lit(".diff")).alias("file"))


def file_collisions(files: DataFrame) -> DataFrame:
    """Files that a case-blind disk takes for one, or of which one is a directory of another."""
    low = files.select(F.lower("file").alias("f"))
    same = low.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    parts = F.split("f", "/")
    above = low.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("f")).distinct()
    return same.union(low.join(above, "f", "left_semi")).distinct()


def labels_csv(rows: DataFrame) -> DataFrame:
    """Columns as CSV cells: booleans 1 or 0, arrays joined by ;, and a quote before a cell that a sheet would run."""
    out = []
    for c, kind in rows.dtypes:
        cell = F.col(c).cast("int").cast("string") if kind == "boolean" else F.array_join(c, ";") if kind.startswith("array") else F.col(c).cast("string")
        out.append(F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell).alias(c))
    return rows.select(*out)


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A pipe table of at most `limit` rows, for a report."""
    head = [rows.columns, ["---"] * len(rows.columns)]
    body = [["" if v is None else str(v) for v in r] for r in rows.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in head + body)


def catalog(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, bool]]:
    """(table, column, type, nullable) of relations, for a session to look up."""
    return [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for f in df.schema.fields]
