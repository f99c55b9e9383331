"""R1 to R3 as streams: only unseen files are read, each batch is appended once, windows bound what is remembered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_files(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stream of the folder's files; schemas of streams are always given."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(folder)


def catch_up(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Handle what has arrived since the last run, batch by batch, and stop.

    A batch may be handed over again after a failure, so `each` should be repeatable for its number.
    """
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_files(stream: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append what has arrived since the last run, exactly once."""
    stream.writeStream.format(fmt).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def in_run(rows: DataFrame, run_id: int) -> DataFrame:
    """Rows of a run; write them partitioned by run_id, and read the latest by its maximum."""
    return rows.withColumn("run_id", F.lit(run_id).cast("long"))


def windowed(rows: DataFrame, time: str, size: str, keys: list[str], late: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums in tumbling windows, of a table or of a stream; with late, older rows are dropped from a stream."""
    d = rows.withWatermark(time, late) if late else rows
    return d.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("value"))


def exploded_objects(rows: DataFrame, json: str, fields: str, *keys: str) -> DataFrame:
    """A JSON text that holds one object or a list of them, as one row an object."""
    as_list = F.from_json(F.when(F.col(json).startswith("["), F.col(json)).otherwise(F.concat(F.lit("["), F.col(json), F.lit("]"))), f"array<struct<{', '.join(':'.join(f.split()) for f in fields.split(','))}>>")
    return rows.select(*keys, F.explode(as_list).alias("o")).select(*keys, "o.*")


def flattened(rows: DataFrame, json: str, *keys: str, skip: tuple[str, ...] = ("authors",)) -> DataFrame:
    """Leaves of JSON texts of unknown shape: rows (keys, path, value), parts of a path joined by underscores.

    Places in lists are parts of the path; what lies below a skipped name is left out.
    """
    import json as js

    import pandas as pd

    def leaves(x, path=""):
        if isinstance(x, dict):
            for k, v in x.items():
                if k not in skip:
                    yield from leaves(v, f"{path}_{k}" if path else k)
        elif isinstance(x, list):
            for k, v in enumerate(x):
                yield from leaves(v, f"{path}_{k}" if path else str(k))
        else:
            yield path, None if x is None else x if isinstance(x, str) else js.dumps(x)

    def run(batches):
        for b in batches:
            rows_ = [(*k, p, v) for *k, t in b.itertuples(index=False) if t is not None for p, v in leaves(js.loads(t))]
            yield pd.DataFrame(rows_, columns=[*keys, "path", "value"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, json).mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "path string", "value string"]))
