"""Bundles: texts gathered in compressed rows of some megabytes, stored once and bucketed by their numbers.

Operators that pass over all texts several times read the bundles, and join what other bundles answer to them by the number, so
only the answers move. A bundle is the unit of memory: a task holds one at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, forget_at_end, pick, scratch
from .kernels import pieces, release

#: Bytes of text in a bundle, from small inputs to large ones; a longer text is a bundle of its own.
BUNDLE, LARGEST = 2 << 20, 64 << 20
#: Bytes of input for a bucket at least, and buckets at most (Spark allows no more).
BUCKET, BUCKETS = 32 << 20, 100_000


def estimate(docs: DataFrame) -> int:
    """Bytes that the optimiser expects of the input; 0 where it knows nothing."""
    n = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def store(docs: DataFrame, id_col: str, text_col: str, name: str, carry: bool = False) -> DataFrame:
    """Rows (b, n_bytes, ids, texts, others); b is the number of the bundle and the bucket key.

    Bundles grow with the square root of the input, so that what one asks of one part of the key space stays worth a row. Null
    texts stay null. With carry, `others` holds the other columns of the input as structs beside the ids; else it is null.
    """
    spark = docs.sparkSession
    expected = estimate(docs)
    bundle = min(LARGEST, max(BUNDLE, math.isqrt(384 * expected)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(pieces(batches, 1, bundle)):
            whole = pa.concat_arrays([b.column(1)])
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            others = _packed(b.column(2), "others") if carry else None
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([whole.nbytes], pa.int64()), ids, pa.array([_packed(whole, "text")], pa.binary()), pa.array([others], pa.binary())], ["n", "n_bytes", "ids", "texts", "others"])

    named = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if carry:
        rest = [c for c, k in zip(columns(docs), docs.columns, strict=True) if k != text_col]
        d = docs.select(*named, F.struct(*rest).alias("others"))
    else:
        d = pick(docs, id_col, text_col).select(*named)
    rows = d.mapInArrow(run, "n long, n_bytes long, ids array<long>, texts binary, others binary")
    rows = rows.select((F.spark_partition_id().cast("long") * (1 << 32) + F.col("n")).alias("b"), "n_bytes", "ids", "texts", "others")
    buckets = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // BUCKET))
    table = f"{name}_{uuid.uuid4().hex}"
    forget_at_end(spark, table)
    rows.write.bucketBy(buckets, "b").option("path", scratch(spark, name)).option("compression", "none").saveAsTable(table)
    return spark.table(table)


def _packed(column: pa.Array, name: str) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([(name, column.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.RecordBatch.from_arrays([column], [name]))
    return sink.getvalue().to_pybytes()


def parts(stored: DataFrame) -> int:
    """In how many parts the key space is dealt: one for some megabytes of text, 12 at least."""
    n = stored.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return min(1 << 20, max(12, n // (4 * BUNDLE)))


def parts_of(keys: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts that have keys, bounds of these in the sorted keys); a part is an interval of the key space."""
    assert bits >= 32 and n <= 1 << 31
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else np.empty(0, np.int64)
    return part[cut].astype(np.int32), np.append(cut, len(keys))


def joined(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """Each bundle with its row of answers, if it has one; bundles stay in place."""
    return stored.join(answers.hint("shuffle_hash"), "b", "left")


def apply(df: DataFrame, f: Callable[[pa.RecordBatch, int], pa.RecordBatch | None], kind) -> DataFrame:
    """f(batch, place) of every bundle, one at a time: groups are sent to Python one by one, whatever rows a task has.

    The bucket key is the grouping key, so bundles aren't moved for it. f may return None for no rows.
    """
    none = _schema(kind).empty_table()

    def run(t: pa.Table) -> pa.Table:
        out = [x for b in t.combine_chunks().to_batches() for k in range(b.num_rows) if (x := f(b, k)) is not None]
        release()
        return pa.Table.from_batches(out) if out else none

    return df.groupBy("b").applyInArrow(run, kind)


def _schema(kind) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind) if isinstance(kind, str) else kind)


def _unpacked(batch: pa.RecordBatch, k: int, column: str) -> pa.Array:
    return pa.ipc.open_stream(pa.py_buffer(batch.column(column)[k].as_buffer())).read_all().column(0).combine_chunks()


def opened(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a bundle."""
    return batch.column("ids")[k].values, _unpacked(batch, k, "texts")


def carried(batch: pa.RecordBatch, k: int) -> pa.Array:
    """The other columns of a bundle's rows, as structs."""
    return _unpacked(batch, k, "others")


def own(batch: pa.RecordBatch, k: int, n: int) -> pa.Array:
    """n times the bundle's number."""
    return pa.array(np.full(n, batch.column("b")[k].as_py(), np.int64))
