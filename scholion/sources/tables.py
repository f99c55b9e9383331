"""Tables, seeds, folders of files, catalog checks and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data set."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A lookup table from CSV with a header; every column is text and empty cells are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def constants(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table given in place; columns as in DDL."""
    return spark.createDataFrame(rows, columns)


def pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """Rows (path, html), one for each file of the folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def binaries(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def unseen(work: DataFrame, done: DataFrame | None, *keys: str) -> DataFrame:
    """The items of which no key is done yet; without a target, all of them. A null key never counts as done."""
    return work if done is None else work.join(done.select(*keys), list(keys), "left_anti")


def not_in(rows: DataFrame, key: Column | str, values: DataFrame) -> DataFrame:
    """rows whose key isn't among the one column of values, with SQL's rules: a null among the values leaves no row, a
    null key is never known to be missing, and an empty list leaves every row.
    """
    key = F.col(key) if isinstance(key, str) else key
    v = values.select(F.col(values.columns[0]).alias("_value")).distinct()
    of = v.agg(F.struct(F.count("*").alias("n"), F.count("_value").alias("known"))).scalar()
    may = (of["n"] == 0) | (key.isNotNull() & (of["n"] == of["known"]))
    return rows.where(may).join(v.where("_value IS NOT NULL"), key == F.col("_value"), "left_anti")


def exists(rows: DataFrame) -> bool:
    """S14."""
    return not rows.isEmpty()


def has_schema(spark: SparkSession, schema: str) -> bool:
    """S15."""
    return spark.catalog.databaseExists(schema)


def has_table(spark: SparkSession, schema: str, name: str) -> bool:
    """S15."""
    return has_schema(spark, schema) and spark.catalog.tableExists(f"{schema}.{name}")


def column_info(spark: SparkSession, schema: str, name: str) -> dict[str, str]:
    """Types by column."""
    return {c.name: c.dataType for c in spark.catalog.listColumns(f"{schema}.{name}")}


def records(rows: DataFrame, most: int = 100_000) -> list[dict]:
    """Rows as dicts, for results meant for a person; an error beyond `most`."""
    out = rows.limit(most + 1).collect()
    if len(out) > most:
        raise ValueError(f"more than {most} rows: write them to a table instead")
    return [r.asDict(recursive=True) for r in out]


def settings(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a settings file; blank lines and those that start with # don't count."""
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    return {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition("=") for x in lines if x and not x.startswith("#"))}


def lookup(rows: DataFrame, column: str, part: str, most: int = 10) -> DataFrame:
    """Some rows whose column contains a text, for a person to look at."""
    return rows.where(F.col(column).contains(part)).limit(most)
