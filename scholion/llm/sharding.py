"""Sharding by sampled splitters, under the law of equal bytes.

Records have the key (hash of the text, number of the row). A sample drawn with weights in proportion to size gives the
boundaries of many fine ranges; a text that fills several ranges by itself is subdivided by row, all other texts stay
whole. Ranges are summed, and sums before each range together with running sums inside it give every record its place on
the line of all bytes; shards are equal parts of that line. Records too large to leave shards equal, of which there can
only be a bounded number, are placed first, largest first into the lightest shard, and the others get what is left of each.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small, text_of, written

#: Fine ranges for a shard, and parts of a shard's target above which a record or a group counts as large.
RANGES, PARTS = 4, 64
#: Rows that a fine range is meant to hold at most.
RANGE_ROWS = 1_000_000
#: Keys that the sample is meant to have for each range.
DRAWN = 16
#: Cells of the hash space by which ranges are looked up.
CELLS = 1024


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot), one for each input row.

    Size is the text's bytes plus 16; null texts are empty. Slots of a shard run from 0 without gaps. No shard differs from the mean
    by more than about 1/64 of it, unless one record is larger than that. Rows are told apart by a number written beside
    them, so that repeated rows and rows with null ids get places of their own, and any number of equal rows can be
    subdivided. Very long texts are placed first. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    t = text_of(text_col)
    rows = pick(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("h"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    large = max(1, total // (shards * PARTS))

    # At most shards * PARTS records are as large as this, whatever the input: they may be placed on the driver.
    giants = sorted(rows.where(F.col("size") > large).select("size", "h", "row").collect(), key=lambda r: (-r["size"], r["h"], r["row"]))
    copies: dict[tuple, list] = {}
    for r in giants:
        copies.setdefault((r["size"], r["h"]), []).append(r)
    # Copies stay together unless they make up a good part of a shard by themselves.
    units = [u for g in copies.values() for u in ([g] if sum(r["size"] for r in g) * shards * 4 <= total else [[r] for r in g])]
    loads = [(0, s) for s in range(shards)]
    placed: list[tuple] = []
    for unit in sorted(units, key=lambda u: -sum(r["size"] for r in u)):
        load, s = heapq.heappop(loads)
        placed += [(r["row"], s) for r in unit]
        heapq.heappush(loads, (load + sum(r["size"] for r in unit), s))
    ends = _quotas(total - sum(r["size"] for r in giants), loads, shards)

    others = rows.where(F.col("size") <= large)
    ranges = max(shards * RANGES, n // RANGE_ROWS)
    base = _in_ranges(others, _splitters(others, ranges, total))
    inside = Window.partitionBy("range").orderBy("h", "row")
    before = base.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
    group = Window.partitionBy("range", "h")
    before = before.withColumns({"group_size": F.sum("size").over(group), "group_upto": F.max("upto").over(group)})
    before = written(before, "shard-ranges")

    # One row a range, a number that does not depend on texts or keys.
    sums = {r["range"]: (r["size"], r["n"]) for r in before.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    starts, at, count = [], 0, 0
    for k in sorted(sums):
        starts.append((k, at, count))
        at, count = at + sums[k][0], count + sums[k][1]
    place = before.join(small(spark, starts, "range int, at long, count long"), "range")
    # A small group goes where its middle lies, so it stays whole; rows of a large group go by themselves.
    middle = F.col("at") + F.when(F.col("group_size") <= large, F.col("group_upto") - F.col("group_size") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    where = F.aggregate(F.array(*[F.lit(float(e)) for e in ends[:-1]]), F.lit(0), lambda a, e: a + F.when(e <= middle, 1).otherwise(0)) if shards > 1 else F.lit(0)
    place = place.select("id", "size", "text_crc32", where.alias("shard"), (F.col("count") + F.col("nth") - 1).alias("rank"))
    place = written(place, "shard-places")
    first = {r["shard"]: (r["rank"], r["n"]) for r in place.groupBy("shard").agg(F.min("rank").alias("rank"), F.count("*").alias("n")).collect()}
    firsts = small(spark, [(k, v[0]) for k, v in first.items()], "shard int, first long")
    small_rows = place.join(firsts, "shard").select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))

    taken = {s: first.get(s, (0, 0))[1] for s in range(shards)}
    giant_rows = []
    for row, s in placed:
        giant_rows.append((row, s, taken[s]))
        taken[s] += 1
    giant_places = small(spark, giant_rows, "row long, shard int, slot long")
    out = small_rows.unionByName(rows.where(F.col("size") > large).join(giant_places, "row").select("id", "size", "text_crc32", "shard", "slot"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


def _quotas(rest: int, loads: list[tuple[int, int]], shards: int) -> list[float]:
    """Ends of the shards' parts of the line of small records: what each needs to reach one common level."""
    load = dict.fromkeys(range(shards), 0) | {s: v for v, s in loads}
    high, low = float(rest + sum(load.values())), 0.0
    for _ in range(100):
        level = (high + low) / 2
        if sum(max(0.0, level - v) for v in load.values()) < rest:
            low = level
        else:
            high = level
    ends, at = [], 0.0
    for s in range(shards):
        at += max(0.0, high - load[s])
        ends.append(at)
    return ends


def _splitters(rows: DataFrame, ranges: int, total: int) -> list[tuple[int, int]]:
    """Quantiles of a sample drawn in proportion to size, without rand(), so that a retried task draws the same again.

    Each row draws an exponential time at the rate of its size; those before a common time are the sample. Its expected number is
    DRAWN for each range, whatever the input, and no task keeps more than its share of it.
    """
    u = (F.pmod(F.xxhash64("row", "h", F.lit(7)), F.lit(2**40)) + 1) / F.lit(float(2**40 + 2))
    drawn = rows.where(-F.log(u) / F.col("size") < DRAWN * ranges / max(1, total)).select("h", "row").collect()
    keys = sorted((r["h"], r["row"]) for r in drawn)
    chosen = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    out: list[tuple[int, int]] = []
    for h, row in chosen:
        # The first boundary in a text stands before all of its rows; only a text that meets several boundaries is cut.
        split = (h, row) if out and out[-1][0] == h else (h, -1)
        if not out or split > out[-1]:
            out.append(split)
    return out


def _in_ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """The number of the range of each row: boundaries below its cell of the hash space, and those of the cell not above it."""
    spark, width = rows.sparkSession, 2**64 // CELLS
    lows = [(c, bisect.bisect_left(splitters, (c * width - 2**63, -1))) for c in range(CELLS)]
    cuts = small(spark, [((h + 2**63) // width, h, row) for h, row in splitters], "cell int, cut_h long, cut_row long")
    table = small(spark, lows, "cell int, low int").join(cuts.groupBy("cell").agg(F.collect_list(F.struct("cut_h", "cut_row")).alias("cuts")), "cell", "left")
    cell = ((F.shiftrightunsigned("h", 54) + CELLS // 2) % CELLS).cast("int")
    not_above = lambda c: (c["cut_h"] < F.col("h")) | ((c["cut_h"] == F.col("h")) & (c["cut_row"] <= F.col("row")))
    found = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<struct<cut_h: bigint, cut_row: bigint>>")), not_above))
    # at most CELLS rows, which hold one boundary for each range
    return rows.withColumn("cell", cell).join(F.broadcast(table), "cell").withColumn("range", F.col("low") + found).drop("cell", "low", "cuts")
