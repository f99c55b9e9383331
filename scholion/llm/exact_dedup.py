"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of the surviving groups only.

The groups get smaller at every level and each level carries only what it needs. The first two levels count rows by length
and prefix hash and exchange one row a task for each; the full hash is taken of documents whose length and prefix another
document shares. Counts are combined before they are shuffled, so a text that a third of all rows repeat costs one row a
task and level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pick, text_of, written


def normalised(text: str = "text"):
    """White space runs become one space; null counts as empty."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, key_col: str | None = None, digest: bool = False) -> DataFrame:
    """Rows (id, key, keep_id, group_size, kept, text_sha256), one for each input row; key and text_sha256 on demand.

    Null texts count as empty ones and form one group with them. Of equal texts the smallest id stays; a null id is larger
    than any other. Rows that repeat an id and a text are copies too, of which a single one stays. Very long texts are
    hashed where they are read; with `digest`, the SHA-256 of every normalised text is returned, so each is read in full.
    `key_col` names a column by which the caller tells rows apart; it is handed on. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    names = [id_col, text_col] + ([key_col] if key_col else [])
    key = F.col(f"`{key_col}`") if key_col else F.lit(None).cast("long")
    base = pick(docs, *names).select(F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("key"), normalised(text_col).alias("t"))
    level = base.select("id", "key", "t", F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("head"))

    # One row for each length and prefix hash: a length that many rows share is no hot key any more.
    pairs = level.groupBy("len", "head").agg(F.count("*").alias("n"))
    pairs = written(pairs, "dedup-heads")
    shared_len = pairs.groupBy("len").agg(F.sum("n").alias("rows")).where("rows > 1").select("len")
    heads = written(pairs.where("n > 1").join(shared_len, "len", "left_semi").select("len", "head", F.lit(True).alias("shared")), "dedup-groups")

    # The full hash: of surviving groups, and where the caller wants all digests, of all rows before the join, so that no text moves.
    sha = F.sha2(F.encode("t", "UTF-8"), 256)
    if digest:
        hashed = level.select("id", "key", "len", "head", sha.alias("sha")).join(heads, ["len", "head"], "left")
    else:
        hashed = level.join(heads, ["len", "head"], "left").withColumn("sha", F.when(F.col("shared"), sha))
    # The written row number tells rows apart that repeat an id, so that exactly one row of a group stays.
    rows = written(hashed.select("id", "key", F.coalesce("shared", F.lit(False)).alias("shared"), "sha", F.monotonically_increasing_id().alias("row")), "dedup-hashes")
    first = F.coalesce(F.min_by("row", "id"), F.min("row"))
    groups = rows.where("shared").groupBy("sha").agg(F.min("id").alias("least"), first.alias("first"), F.count("*").alias("size")).where("size > 1")
    groups = written(groups, "dedup-keeps")

    # Only joins of written tables follow, so that adaptive execution may split the group that a third of all rows belong to.
    single = F.col("size").isNull()
    alone = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    found = [F.when(single, F.col("id")).otherwise(F.col("least")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), (single | (F.col("row") == F.col("first"))).alias("kept")]
    out = rows.where("shared").join(groups, "sha", "left").select("id", "key", *found, "sha").unionByName(rows.where("NOT shared").select("id", "key", *alone, "sha"))
    named = [F.col("id").alias(id_col)] + ([F.col("key").alias(key_col)] if key_col else []) + ["keep_id", "group_size", "kept"] + ([F.col("sha").alias("text_sha256")] if digest else [])
    return out.select(*named)
