"""Checks of keys (T1 to T4): each returns the violations, so a check reports and never stops a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often; a key with a null in it is no violation if it is single."""
    d = rows.where(F.col(keys[0]).isNotNull()) if len(keys) == 1 else rows
    return d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(rows: DataFrame, column: str) -> DataFrame:
    """Rows without a value."""
    return rows.where(F.col(column).isNull())


def report(rows: DataFrame, unique: list[list[str]] = (), present: list[str] = ()) -> DataFrame:
    """One row a check: its name and how many keys or rows violate it."""
    out = None
    for keys in unique:
        one = repeated(rows, *keys).agg(F.count("*").alias("violations")).select(F.lit(f"unique({', '.join(keys)})").alias("check"), "violations")
        out = one if out is None else out.unionAll(one)
    if present:  # all in one pass over the rows
        counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
        each = counts.select(F.inline(F.array(*[F.struct(F.lit(f"not_null({c})").alias("check"), F.col(c).alias("violations")) for c in present])))
        out = each if out is None else out.unionAll(each)
    return out
