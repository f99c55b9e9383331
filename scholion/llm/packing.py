"""Best-fit packing by length-histogram planning.

Only the histogram of lengths is planned on: at most as many numbers as a sequence has places, however many documents
there are. The plan is a list of segments: pieces of one length, from one rank on, go to sequences from one number on, at
one offset. Pieces then take their planned slots by joining on their rank within their length. Ranks are counted in
salted parts, as many for each length as its count asks for, so a length that a third of all pieces share is no task of its
own. Pieces as long as a sequence need no rank: each is a sequence by itself, named by the number of its row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small, text_of, written
from .kernels import pieces as slices
from .tokens import SLICE, encoder, with_end

#: Pieces whose ranks are meant to be counted in one part, and parts of a length at least.
PART_ROWS, PARTS = 500_000, 16


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: segments (length, rank, n, sequence, offset).

    Pieces number rank to rank + n - 1 of that length lie at that offset of the sequences sequence to sequence + n - 1.
    Sequences in one state are one group, so each step either ends a length or uses up a group.
    """
    open_groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    rooms: list[int] = []
    segments, sequences = [], 0

    def opened(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_groups:
                open_groups[room] = []
            open_groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length <= 0 or left <= 0:
            continue
        while left:
            rooms = sorted(r for r, g in open_groups.items() if r >= length and g)
            if rooms:
                room = rooms[0]
                first, n = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room]
                if n > left:
                    opened(room, first + left, n - left)
                    n = left
            else:  # as many new sequences as fill up with this length alone, then one for what is left over
                room, first = size, sequences
                n = max(1, left // (size // length))
                sequences += n
            segments.append((length, rank, n, first, size - room))
            opened(room - length, first, n)
            rank, left = rank + n, left - n
    return segments


def cut_texts(docs: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, ids): the ids of each text and one end id, cut into pieces of size.

    Null texts are empty and have the end id alone. Only texts longer than size are cut, however long; their last piece may be
    shorter. Rows are cut one by one, whether ids are null or repeated. An empty table gives an empty result; other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in slices(batches, 1, SLICE):
            ids, offsets = with_end(*encode(b.column(1)), end)
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            n = np.diff(offsets)
            parts = -(-n // size)
            doc = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * size
            length = np.minimum(size, n[doc] - start)
            at = offsets[doc] + start
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], schema=schema)

    d = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    return d.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, size: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with sequence_id and offset; lengths must lie between 1 and size.

    Offsets of a sequence have no gaps. Pieces of one length are ranked by `order`; rows equal in it take their places in
    either order. Null ids come first. Sequences that one piece fills have odd numbers, the others even ones. The input is read
    several times, so it should be a written table. An empty table gives an empty result. All columns of the input stay;
    those called sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep]).alias("row")
    rows = pieces.select(row, F.struct(*[f"`{c}`" for c in order]).alias("order"), F.col(f"`{length_col}`").cast("long").alias("len"))

    # At most one row for each length up to size; then at most one more for each PART_ROWS pieces.
    histogram = {r["len"]: r["n"] for r in rows.groupBy("len").agg(F.count("*").alias("n")).collect()}
    assert all(k is not None and 0 < k <= size for k in histogram), "a piece is longer than a sequence, or empty, or has no length"
    full = rows.where(F.col("len") == size).select("row.*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    histogram.pop(size, None)
    parts = small(spark, [(k, max(PARTS, -(-n // PART_ROWS))) for k, n in histogram.items()], "len long, parts int")
    part = F.pmod(F.xxhash64("order"), F.col("parts")).cast("int").alias("part")
    salted = rows.join(parts, "len").select("row", "order", "len", part)
    base, before = [], dict.fromkeys(histogram, 0)
    for r in sorted(salted.groupBy("len", "part").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["len"], r["part"])):
        base.append((r["len"], r["part"], before[r["len"]]))
        before[r["len"]] += r["n"]
    nth = F.row_number().over(Window.partitionBy("len", "part").orderBy("order")) - 1
    ranked = salted.withColumn("nth", nth).join(small(spark, base, "len long, part int, base long"), ["len", "part"]).select("row", "len", (F.col("base") + F.col("nth")).alias("rank"))
    slots = small(spark, plan(histogram, size), "l long, first long, n long, seq long, at long")
    placed = ranked.join(slots, (F.col("len") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return placed.select("row.*", (2 * (F.col("seq") + F.col("rank") - F.col("first"))).alias("sequence_id"), F.col("at").alias("offset")).unionByName(full)


def pack_texts(docs: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset) for all texts; see cut_texts and pack."""
    cut = written(cut_texts(docs, path, size, end, id_col, text_col), "pieces")
    return pack(cut, size, order=(id_col, "piece"))
