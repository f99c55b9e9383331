"""Group statistics: outliers by median absolute deviation, z-scores, shares, histograms, modes, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import count_where, least_where, median, outlier_ratio, z_score


def group_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a group with n, least, most, mean, deviation (null for one row) and median of a value."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), median(value).alias("median")
    )


def mad_outliers(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row with its group's summary, mad and ratio.

    The median of distances needs the median first; both are joined back on the group, so rows of a null key are lost as
    in any equality.
    """
    summary = group_summary(rows, keys, value)
    near = rows.join(summary.select(*keys, "median"), keys)
    mad = near.groupBy(*keys).agg(median(F.abs(F.col("median") - F.col(value))).alias("mad"))
    return rows.join(summary, keys).join(mad, keys).withColumn("ratio", outlier_ratio(value, "mad"))


def z_scores(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row with mean, deviation and z-score of its group, in one shuffle by windows."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"mean": F.avg(value).over(w), "deviation": F.stddev_samp(value).over(w)}).withColumn("z", z_score(value, "mean", "deviation"))


def shares(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Count and percentage of all rows for each group; groups are few, so their total is one more row."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def count_of_counts(rows: DataFrame, keys: list[str], per: list[str]) -> DataFrame:
    """For each of `per`, how many groups of `keys` have how many rows."""
    return rows.groupBy(*dict.fromkeys([*per, *keys])).agg(F.count("*").alias("n_rows")).groupBy(*per, "n_rows").agg(F.count("*").alias("n_groups"))


def modes(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """The most frequent value of each group, or that with the largest weight; of equals the smallest."""
    n = F.count("*") if weight is None else F.sum(weight)
    counts = rows.groupBy(*keys, value).agg(n.alias("_n"))
    # max_by over (count, value descending) without negating the value: largest count first, then the smallest value
    top = counts.groupBy(*keys).agg(F.max("_n").alias("_n"))
    return counts.join(top, [*keys, "_n"]).groupBy(*keys, "_n").agg(F.min(value).alias("mode")).withColumnRenamed("_n", "support")


def mode_of(values: Column) -> Column:
    """A25 over an array of integers: the most frequent, the smallest of equals, 0 for an empty array."""
    distinct = F.array_sort(F.array_distinct(values))
    counted = F.transform(distinct, lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.coalesce(F.array_min(counted)["x"], F.lit(0))


def pivot_least(rows: DataFrame, keys: list[str], name: str, value: str | Column, columns: dict[str, str]) -> DataFrame:
    """A5: property rows to columns {new name: property}, each the smallest of its values."""
    return rows.groupBy(*keys).agg(*[least_where(value, F.col(name) == prop).alias(c) for c, prop in columns.items()])


def event_lag(rows: DataFrame, keys: list[str], name: str, day: str | Column, start: str, end: str, counted: str) -> DataFrame:
    """How often `counted` occurs, the first days of start and end, and the days between."""
    day = F.col(day) if isinstance(day, str) else day
    out = rows.groupBy(*keys).agg(count_where(F.col(name) == counted).alias("n_counted"), least_where(day, F.col(name) == start).alias("first_start"), least_where(day, F.col(name) == end).alias("first_end"))
    return out.withColumn("lag_days", F.datediff("first_end", "first_start"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """O3: the first rows of a total order; each task keeps n rows, so nothing is sorted as a whole."""
    return rows.orderBy(*order).limit(n)
