"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are range-partitioned by id before they are encoded, so each file holds an interval of ids in ascending order.
Stripes are read in parallel; a lookup of documents prunes stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bundles import estimate
from .common import pick, small, text_of, tidy
from .kernels import pieces as slices
from .tokens import SLICE, encoder, with_end

#: Settings of the files: rows between entries of the row index, bytes of a stripe, false positives of the Bloom filter.
ORC = {"orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.compress": "ZSTD"}

#: Bytes of texts that a file is made of, where the session's number of shuffle partitions would give larger ones.
FILE = 256 << 20


def encode_ordered(docs: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids) in ascending doc_id, partitions being intervals of ids.

    Null and empty texts have the end id alone. Null ids come first. Rows that repeat an id stay side by side; if they are many,
    files share them by a hash of the text. Very long texts are slices of their own. An empty table gives no rows; other columns
    are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in slices(batches, 1, SLICE):
            ids, offsets = with_end(*encode(b.column(1)), end)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), lists], schema=schema)

    d = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))
    files = estimate(docs) // FILE
    fixed = [files] if files > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []  # else adaptive execution may join small ones
    d = d.repartitionByRange(*fixed, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 1, **columns: str) -> None:
    """Write the ids of all texts to folder; see encode_ordered for nulls, repeats, long texts and empty tables."""
    with tidy(docs.sparkSession):
        encode_ordered(docs, path, end, **columns).write.options(**ORC).orc(folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with doc_ids, only theirs, other stripes and row groups being skipped."""
    files = spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(folder)
    return files if doc_ids is None else files.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    An empty folder gives an empty result. Rows that repeat an id come one after the other.
    """
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy())).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * c]) for a, c in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    files = read_tokens(spark, folder).select("*", F.col("_metadata.file_name").alias("file"))
    rows = files.select("file", "doc_id", "ids").mapInArrow(run, "file string, doc_id long, n_tokens long, ids_crc32 long")
    # One row a file; files are intervals of ids, so their order is that of their smallest ids, and of the largest where these are equal.
    totals = files.groupBy("file").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n_tokens").alias("n"), (F.count("*") - F.count("doc_id")).alias("nulls")).collect()
    before, at = [], 0
    for r in sorted(totals, key=lambda r: (not r["nulls"], r["low"] is not None, r["low"] or 0, r["high"] or 0)):
        before.append((r["file"], at))
        at += r["n"]
    inside = Window.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(small(spark, before, "file string, before long"), "file")
    return out.select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
