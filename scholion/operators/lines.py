"""Lines of laid-out text: header detection, section trees, contiguous ranges, ratios by parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import modes


def body_scales(lines: DataFrame, doc: str = "doc", scale: str = "scale", n_chars: str = "n_chars") -> DataFrame:
    """The scale that most characters of a document have."""
    return modes(lines, [doc], scale, n_chars).select(doc, F.col("mode").alias("body"))


def sections(lines: DataFrame, skip: str | None = None) -> DataFrame:
    """Sections of documents: doc, idx, weight, bold, title, content (array of lines), first_line.

    lines (doc, line_no, text, scale, bold, n_chars). A header is larger than the body, or bold and not smaller than the line before;
    headers of one scale and weight that follow each other are one title; lines of scale 0 or the body's are content;
    others are dropped. Lines that contain `skip` are left out first. What stands before the first header is section 0.
    """
    if skip:
        lines = lines.where(~F.lower("text").contains(skip.lower()))
    in_doc = Window.partitionBy("doc").orderBy("line_no")
    d = lines.join(body_scales(lines), "doc")
    before_scale, before_bold = F.lag("scale").over(in_doc), F.lag("bold").over(in_doc)
    d = d.withColumn("header", (F.col("scale") > F.col("body")) | (F.col("bold") & (F.col("scale") >= F.coalesce(before_scale, F.lit(0.0))) & (F.col("scale") > 0)))
    # a header line continues the one before if that was a header of the same looks
    same = F.coalesce(F.lag("header").over(in_doc) & (before_scale == F.col("scale")) & (before_bold == F.col("bold")), F.lit(False))
    d = d.withColumn("starts", (F.col("header") & ~same).cast("int"))
    d = d.withColumn("idx", F.sum("starts").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    content = ~F.col("header") & ((F.col("scale") == 0) | (F.col("scale") == F.col("body")))
    line = F.struct("line_no", "text")
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, line))), lambda x: x["text"])
    out = d.groupBy("doc", "idx").agg(F.max(F.when(F.col("header"), F.col("scale"))).alias("weight"), F.bool_or(F.col("header") & F.col("bold")).alias("bold"), of(F.col("header")).alias("titles"), of(content).alias("content"), F.min("line_no").alias("first_line"))
    return out.select("doc", "idx", F.when(F.col("idx") > 0, F.col("weight")).alias("weight"), "bold", F.array_join("titles", " ").alias("title"), "content", "first_line")


def parents(found: DataFrame) -> DataFrame:
    """Each section with its parent: the nearest one before it that is strictly heavier; 0 is the root.

    A document's sections meet in one array, no larger than the document, and are folded once with a stack of those that are
    still open; the stack is as deep as there are different weights.
    """
    rest = [c for c in found.columns if c not in ("doc", "idx", "weight")]
    section = F.struct("idx", F.col("weight").cast("double").alias("weight"), F.struct(*rest).alias("rest"))
    start = F.struct(F.array().cast("array<struct<idx: bigint, weight: double>>").alias("open"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        above = F.filter(acc["open"], lambda s: s["weight"] > x["weight"])
        parent = F.coalesce(F.get(above, F.size(above) - 1)["idx"], F.lit(0))
        inner = x["idx"] > 0
        return F.struct(F.when(inner, F.concat(above, F.array(x))).otherwise(acc["open"]).alias("open"), F.concat(acc["out"], F.array(F.when(inner, parent))).alias("out"))

    s = found.groupBy("doc").agg(F.array_sort(F.collect_list(section)).alias("_s"))
    tree = F.aggregate(F.transform("_s", lambda x: F.struct(x["idx"].alias("idx"), x["weight"].alias("weight"))), start, add)["out"]
    each = s.withColumn("parent", tree).select("doc", F.explode(F.arrays_zip("_s", "parent")).alias("_x"))
    return each.select("doc", "_x._s.idx", "_x._s.weight", "_x._s.rest.*", "_x.parent")


def subtree(found: DataFrame, word: str) -> DataFrame:
    """The sections from the first whose title contains a word on, as long as they are below it.

    A document without such a section has none; see failures.
    """
    hit = F.lower("title").contains(word.lower())
    start = found.where(hit & (F.col("idx") > 0)).groupBy("doc").agg(F.min_by(F.struct("idx", "weight"), "idx").alias("start"))
    d = found.join(start, "doc").where(F.col("idx") >= F.col("start.idx"))
    later = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = F.max(((F.col("idx") > F.col("start.idx")) & (F.col("weight") >= F.col("start.weight"))).cast("int")).over(later)
    return d.withColumn("_left", out).where("_left = 0").drop("_left", "start")


def failures(found: DataFrame, word: str) -> DataFrame:
    """A status for each document: FAILED with a message if no title contains the word."""
    hit = F.max((F.lower("title").contains(word.lower()) & (F.col("idx") > 0)).cast("int"))
    s = found.groupBy("doc").agg(F.coalesce(hit, F.lit(0)).alias("hit"))
    return s.select("doc", F.when(F.col("hit") == 1, "SUCCEEDED").otherwise("FAILED").alias("status"), F.when(F.col("hit") == 0, "No organisation position found").alias("message"))


def islands(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Maximal runs of adjacent positions: first, last, how many. Repeated positions count once."""
    w = Window.partitionBy(*keys).orderBy(position)
    d = rows.select(*keys, position).distinct().withColumn("_island", F.col(position) - F.row_number().over(w))
    return d.groupBy(*keys, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_island")


def raw_ranges(positions: Column) -> Column:
    """Ranges as positions come in: a position inside a range leaves it, one beside it widens it, any other opens one."""

    def add(ranges: Column, p: Column) -> Column:
        touches = lambda r: (p >= r["lo"] - 1) & (p <= r["hi"] + 1)
        at = F.coalesce(F.array_position(F.transform(ranges, touches), True), F.lit(0))
        wider = F.transform(ranges, lambda r, i: F.when(i + 1 == at, F.struct(F.least(r["lo"], p).alias("lo"), F.greatest(r["hi"], p).alias("hi"))).otherwise(r))
        return F.when(at > 0, wider).otherwise(F.concat(ranges, F.array(F.struct(p.alias("lo"), p.alias("hi")))))

    return F.aggregate(positions, F.array().cast("array<struct<lo: int, hi: int>>"), add)


def clean_ranges(positions: Column) -> Column:
    """The same positions as sorted ranges of which no two are adjacent."""

    def add(ranges: Column, p: Column) -> Column:
        joins = (F.size(ranges) > 0) & (F.try_element_at(ranges, F.lit(-1))["hi"] >= p - 1)
        return F.when(joins, F.concat(F.slice(ranges, 1, F.size(ranges) - 1), F.array(F.struct(F.try_element_at(ranges, F.lit(-1))["lo"].alias("lo"), p.alias("hi"))))).otherwise(F.concat(ranges, F.array(F.struct(p.alias("lo"), p.alias("hi")))))

    return F.aggregate(F.array_sort(F.array_distinct(positions)), F.array().cast("array<struct<lo: int, hi: int>>"), add)


def parity_ratios(lines: DataFrame, keys: list[str], number: str, condition: Column, name: str = "ratio") -> DataFrame:
    """Share of lines that fit, by group and by odd or even line number."""
    parity = F.when(F.col(number) % 2 == 1, "ODD").otherwise("EVEN").alias("parity")
    return lines.groupBy(*keys, parity).agg(F.count("*").alias("n_lines"), F.avg(condition.cast("double")).alias(name))


def all_hold(lines: DataFrame, keys: list[str], condition: Column, name: str = "all_hold") -> DataFrame:
    """Whether every row of a group fits."""
    return lines.groupBy(*keys).agg(F.every(condition).alias(name))
