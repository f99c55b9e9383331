"""Writers: appending records of changing shape, reloading, dropping, files with a status."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import has_table


def from_records(spark: SparkSession, rows: Iterable[dict]) -> DataFrame | None:
    """A batch of dicts as text columns: the sorted union of all keys, missing values null; None for an empty batch."""
    rows = list(rows)
    if not rows:
        return None
    keys = sorted({k for r in rows for k in r})
    text = lambda v: None if v is None else str(v)
    return spark.createDataFrame([tuple(text(r.get(k)) for k in keys) for r in rows], T.StructType([T.StructField(k, T.StringType()) for k in keys]))


def append(rows: DataFrame | None, schema: str, name: str) -> None:
    """K1, K3 to K5: append, creating the schema and the table and adding columns as needed; nothing happens without rows.

    Columns that the batch lacks are null in it, columns that the table lacks are null in its older rows.
    """
    if rows is None or rows.isEmpty():
        return
    spark = rows.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    target = f"`{schema}`.`{name}`"
    if has_table(spark, schema, name):
        have = {c.name.lower() for c in spark.catalog.listColumns(f"{schema}.{name}")}
        new = [f for f in rows.schema.fields if f.name.lower() not in have]
        if new:
            spark.sql(f"ALTER TABLE {target} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        shape = spark.table(target).schema
        by_name = {c.lower(): c for c in rows.columns}
        rows.select(*[(F.col(f"`{by_name[f.name.lower()]}`") if f.name.lower() in by_name else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields]).write.insertInto(target)
    else:
        rows.write.saveAsTable(target)


def save(spark: SparkSession, schema: str, name: str, rows: Iterable[dict]) -> None:
    """K1, K2: append a batch of dicts."""
    append(from_records(spark, rows), schema, name)


def reload(rows: DataFrame, schema: str, name: str) -> None:
    """Replace the table's contents."""
    rows.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    rows.write.mode("overwrite").saveAsTable(f"`{schema}`.`{name}`")


def drop(spark: SparkSession, schema: str, *names: str) -> None:
    """K10."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{schema}`.`{name}`")


def widths(rows: DataFrame) -> DataFrame:
    """One row with the longest length of each column."""
    return rows.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in rows.columns])


def union_by_name(*batches: DataFrame) -> DataFrame:
    """Batches of different shapes in one frame, missing columns null."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def numbered(rows: DataFrame, name: str, *order: str, range_rows: int = 250_000, most_ranges: int = 1024) -> DataFrame:
    """Surrogate numbers from 1 in the order of columns, without bringing all rows to one task.

    As many ranges as the count of rows asks for; a sample of keys, drawn by a threshold on their hash so that no task keeps
    more than its share, gives their bounds. Each range numbers its own rows and starts after those before it. Rows equal in
    the order are numbered in either order, so give a total one. Nulls come first.
    """
    n = rows.count()
    ranges = max(1, min(most_ranges, n // range_rows))
    drawn = []
    if ranges > 1:
        below = int(2**40 * min(1.0, 20 * ranges / n))
        drawn = rows.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(2**40)) < below).distinct().orderBy(*order).collect()
    cuts = sorted({len(drawn) * k // ranges for k in range(1, ranges)}) if len(drawn) > ranges else []
    types = {f.name: f.dataType for f in rows.schema.fields}
    bounds = [F.struct(*[F.lit(drawn[k][c]).cast(types[c]).alias(c) for c in order]) for k in cuts]
    key = F.struct(*order)

    def place(lo: int, hi: int):
        """How many bounds are not above the key, by halving: a row is compared a few times, however many ranges there are."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    ranged = rows.withColumn("_range", place(0, len(bounds)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    if not bounds:
        return ranged.withColumn(name, within.cast("long")).drop("_range")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row a range, of which there are at most `most_ranges`
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + within).drop("_range", "_start")


def merged_by_key(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """K8: the rows with the columns of updates in place of their own where an update has the row's key.

    Updates hold the key, an optional column `at` by which the latest of several counts, and columns of the rows. A null in an update is
    a value. Keys that no row has are left out; a null key is updated by none.
    """
    changed = [c for c in updates.columns if c not in (key, "at")]
    by = F.col("at") if "at" in updates.columns else F.struct(*changed)
    latest = updates.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*changed), by).alias("_new"))
    joined = rows.join(latest, F.col(key) == F.col("_key"), "left")
    new = lambda f: F.when(F.col("_key").isNotNull(), F.col("_new")[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) if f.name in changed else F.col(f"`{f.name}`")
    return joined.select(*[new(f).alias(f.name) for f in rows.schema.fields])


def _replaced(rows: DataFrame, schema: str, name: str) -> None:
    """The table's contents become rows that may be read from it: written beside it, then put in its place."""
    spark, beside = rows.sparkSession, f"{name}__new"
    drop(spark, schema, beside)
    rows.write.saveAsTable(f"`{schema}`.`{beside}`")
    drop(spark, schema, name)
    spark.sql(f"ALTER TABLE `{schema}`.`{beside}` RENAME TO `{schema}`.`{name}`")


def update(spark: SparkSession, schema: str, name: str, updates: DataFrame, key: str) -> None:
    """K8: set columns of the rows that have the keys of updates."""
    _replaced(merged_by_key(spark.table(f"`{schema}`.`{name}`"), updates, key), schema, name)


def widen(spark: SparkSession, schema: str, name: str, column: str, kind: str) -> None:
    """K6: give a column another type that holds its values; an error if one would be lost."""
    rows = spark.table(f"`{schema}`.`{name}`")
    wide = F.col(f"`{column}`").try_cast(kind)
    if not rows.where(F.col(f"`{column}`").isNotNull() & wide.isNull()).isEmpty():
        raise ValueError(f"values of {column} don't fit {kind}")
    _replaced(rows.withColumn(column, wide), schema, name)


def clustered(rows: DataFrame, schema: str, name: str, *by: str, unique: bool = False) -> None:
    """Replace the table's contents by the rows ordered by columns, so that scans skip files and row groups by their bounds.

    This takes the place of an index; with `unique`, rows equal in the columns are an error, nulls apart.
    """
    if unique and not rows.dropna(subset=list(by)).groupBy(*by).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(by)} is not unique")
    reload(rows.repartitionByRange(*by).sortWithinPartitions(*by), schema, name)


def describe(spark: SparkSession, schema: str, name: str, text: str | None = None, **columns: str) -> None:
    """T5: document a table and its columns in the catalog."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if text is not None:
        spark.sql(f"COMMENT ON TABLE `{schema}`.`{name}` IS {quoted(text)}")
    for c, t in columns.items():
        spark.sql(f"ALTER TABLE `{schema}`.`{name}` ALTER COLUMN `{c}` COMMENT {quoted(t)}")


def write_files(items: DataFrame, folder: str, name_col: str = "filename", content_col: str = "content") -> DataFrame:
    """Write each item's bytes to a file of the folder and return (filename, status, error) for each.

    A failure belongs to its item alone. The folder must be one that all executors share.
    """

    def run(batches):
        for b in batches:
            status, error = [], []
            for name, content in zip(b[name_col], b[content_col], strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    os.makedirs(folder, exist_ok=True)
                    with open(os.path.join(folder, os.path.basename(name)), "wb") as f:
                        f.write(content)
                    status.append("SUCCEEDED")
                    error.append(None)
                except (OSError, ValueError, TypeError) as e:
                    status.append("FAILED")
                    error.append(str(e))
            yield b[[name_col]].assign(status=status, error=error)

    return items.select(name_col, content_col).mapInPandas(run, f"`{name_col}` string, status string, error string")
