"""Matching records of two sources: cascades, disjoint branches of identity, full joins of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """Match by the first pair of keys, what is left by the next, and so on.

    Returns the matches (left id, right id, step) and the rows of left that no step matched. Null keys match nothing; ids of
    left that are null are never matched away.
    """
    found, rest = [], left
    for step, (a, b) in enumerate(keys):
        l = rest.select(F.col(left_id).alias("left_id"), a.alias("_k"))
        r = right.where(F.col(right_id).isNotNull()).select(F.col(right_id).alias("right_id"), b.alias("_k"))
        hit = l.join(r, "_k").select("left_id", "right_id").distinct().withColumn("step", F.lit(step))
        found.append(hit)
        rest = rest.join(hit.select(F.col("left_id").alias(left_id)).distinct(), left_id, "left_anti")
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out, rest


#: Parts that the rows of a key are dealt into, for keys that many rows share.
PARTS = 16
#: Rows, as counted, up to which what others are joined to is broadcast; beyond that it is shuffled.
FEW = 100_000


def broadcast_few(rows: DataFrame) -> DataFrame:
    """Rows to join to, broadcast if they are few, so that what is joined to them isn't shuffled for it."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def by_branches(rows: DataFrame, known: DataFrame, keys: list[str], surrogate: str, keep: list[str]) -> DataFrame:
    """Look up the surrogate by the first key that a row has at all, each key being a branch of its own.

    A row whose first key is unknown keeps a null surrogate. Equal result rows are returned once: rows are made distinct before they meet
    what is known, so that what a key that many share unfolds into isn't shuffled; only rows with several keys need that afterwards.
    Rows are shuffled once if few are known, else a second time to meet them.
    """
    names = [f"_keep{n}" for n in range(len(keep))]
    kept = [F.col(k).alias(n) for k, n in zip(keep, names, strict=True)]
    first = F.coalesce(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(n).alias("branch"), F.col(k).cast("string").alias("key"))) for n, k in enumerate(keys)])
    mine = rows.select(*kept, first.alias("_first")).where("_first IS NOT NULL").select(*names, F.col("_first.branch").alias("_branch"), F.col("_first.key").alias("_key"))
    once = mine.repartition(*names).distinct().withColumn("_several", F.count("*").over(Window.partitionBy(*names)) > 1)
    pairs = F.array(*[F.struct(F.lit(n).alias("_branch"), F.col(k).cast("string").alias("_key"), F.col(surrogate).alias("_found")) for n, k in enumerate(keys)])
    lookup, on = known.select(F.inline(pairs)).where("_key IS NOT NULL").distinct(), ["_branch", "_key"]
    if known.count() <= FEW:
        # rows of a key lie together, so that a file holds few surrogates at a time; Catalyst drops a sort below a join unless something like explode is between
        lookup, once = F.broadcast(lookup), once.sortWithinPartitions("_branch", "_key").withColumn("_key", F.explode(F.array("_key")))
    else:
        once, on = once.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(PARTS)).cast("int")), [*on, "_part"]
        lookup = lookup.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("shuffle_hash")
    found = lambda some: some.join(lookup, on, "left").select(*names, "_found")
    out = found(once.where(~F.col("_several"))).unionAll(found(once.where("_several")).distinct())
    return out.toDF(*[k.strip("`") for k in keep], surrogate)


def merged(a: DataFrame, b: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Entities of both sources in a full join; shared columns come from a where it has them."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full")
    rest_a = [F.col(f"x.{c}") for c in a.columns if c not in (key, *shared)]
    rest_b = [F.col(f"y.{c}") for c in b.columns if c not in (key, *shared)]
    return both.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), *[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in shared], *rest_a, *rest_b)


def settled(rows: DataFrame, key: Column, value: str, name: str) -> DataFrame:
    """One value for all rows of a key: the smallest that isn't null."""
    return rows.withColumn(name, F.min(value).over(Window.partitionBy(key)))


def first_present(rows: DataFrame, key: str, value: str, order: list[Column], name: str) -> DataFrame:
    """The first value of a key that isn't null, in a total order, on every row of the key."""
    w = Window.partitionBy(key).orderBy(F.col(value).isNull().cast("int"), *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(value).over(w))
