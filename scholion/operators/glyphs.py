"""Glyphs of pages to lines of laid-out text (P1 to P3, O9): window functions find the lines, a fold places the glyphs.

Glyphs come from whatever reads the documents: rows (doc, page, x, y, width, height, text, scale, bold), in points from the
page's upper left corner. A line is four points a column, so columns of the page are columns of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in points: the width of a column, the least step down that makes a line, the widest gap inside a word.
COLUMN, STEP, WORD = 4, 5.5, 1


def placed(glyphs: Column) -> Column:
    """One line of text from its glyphs in order, an array of structs (x, width, text).

    A glyph that touches the one before follows it; one that is at most a column away follows after a space; any other stands in its own
    column, at least one space further on. A space that is a glyph ends a word.
    """

    def add(acc: Column, g: Column) -> Column:
        gap = F.abs(F.round(g["x"] - acc["end"]))
        length = F.length(acc["line"])
        column = F.floor(g["x"] / COLUMN).cast("int")
        free = (
            F.when(acc["end"].isNull(), column)
            .when((gap <= WORD) & ~acc["line"].endswith(" "), length)
            .when((gap > WORD) & (gap <= COLUMN), F.when(acc["line"].endswith(" "), length).otherwise(length + 1))
            .otherwise(F.greatest(column, F.when(acc["line"].endswith(" "), length).otherwise(length + 1)))
        )
        line = F.when(g["text"] == " ", acc["line"]).otherwise(F.concat(F.rpad(acc["line"], F.greatest(free, F.lit(0)), F.lit(" ")), g["text"]))
        return F.struct(line.alias("line"), (g["x"] + g["width"]).alias("end"))

    start = F.struct(F.lit("").alias("line"), F.lit(None).cast("double").alias("end"))
    return F.aggregate(glyphs, start, add, lambda acc: acc["line"])


def lines(glyphs: DataFrame) -> DataFrame:
    """Rows (doc, page, line_no, text, scale, bold, n_chars), blank lines included.

    A line ends where the next glyph is lower by more than the step; the height of that glyph tells how many blank lines
    lie between. Scale and weight are those of a line's last glyph; blank lines have scale 0.
    """
    order = Window.partitionBy("doc", "page").orderBy(F.round("y"), "x", "text")
    down = F.round("y") - F.lag(F.round("y")).over(order)
    skipped = F.greatest(F.lit(1), (F.floor(down) / F.col("height")).cast("int") - 1)
    g = glyphs.withColumn("_new", F.when(down > STEP, skipped).otherwise(0))
    g = g.withColumn("_line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(order))
    one = F.struct(F.col("_nth"), F.col("x").cast("double").alias("x"), F.col("width").cast("double").alias("width"), "text", "scale", "bold")
    each = g.groupBy("doc", "page", F.col("_line").alias("line")).agg(F.array_sort(F.collect_list(one)).alias("g"), F.max("_new").alias("skipped"))
    last = F.element_at("g", -1)
    full = each.select("doc", "page", "line", "skipped", placed(F.col("g")).alias("text"), last["scale"].cast("double").alias("scale"), last["bold"].alias("bold"), F.size("g").alias("n_chars"))
    blank = full.where("skipped > 1").select("doc", "page", F.explode(F.sequence(F.col("line") - F.col("skipped") + 1, F.col("line") - 1)).alias("line"), F.lit("").alias("text"), F.lit(0.0).alias("scale"), F.lit(False).alias("bold"), F.lit(0).alias("n_chars"))
    out = full.drop("skipped").unionByName(blank)
    # numbers run through the pages of a document
    sizes = out.groupBy("doc", "page").agg((F.max("line") + 1).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.join(before, ["doc", "page"]).select("doc", "page", (F.col("line") + F.col("_before")).alias("line_no"), "text", "scale", "bold", "n_chars")
