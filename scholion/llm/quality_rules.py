"""Quality rules: rules on single documents, and cross-document line frequency within a host.

Lines are normalised and hashed; each host counts the distinct documents of every line; lines above the limit are removed;
a document of which too little remains is rejected. Texts are read once: measures and hashed lines of each are written, and
only hashes and counts are exchanged after that. Counts are combined before the shuffle, so a line that all documents share
costs one row a task. The frequent lines of a host are one array, which its documents meet by a join on the host; whatever
the sizes, that is the only path, and adaptive execution splits a host that a third of all rows belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pick, text_of, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words that a document needs, as it stands and without its frequent lines.
LEAST_WORDS = 10
#: A line is frequent in its host above this share of the host's documents, and above this number of them.
SHARE, LEAST_DOCS = 0.05, 2
#: Share of a document's words that its frequent lines must leave.
REMAIN = 0.5


def words(text: Column) -> Column:
    """Words in order: runs of anything but ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """Evaluate value once and hand it to use; a plain reference would be computed anew at each mention."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column, n: int = 5) -> Column:
    """Words in n-word windows that occur twice or more in the text, first occurrence included.

    Nearly all documents are done when their windows turn out distinct. Of the others the windows are sorted by hash with
    their places, equal neighbours give the places, and the places give the length of the union.
    """

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, k, d: F.coalesce(F.get(s, k + d)["x"] == e["x"], F.lit(False))
            hit = F.filter(s, lambda e, k: F.when(k > 0, same(e, k, -1)).otherwise(False) | same(e, k, 1))
            return F.sort_array(F.transform(hit, lambda e: e["i"]))

        def covered(p: Column) -> Column:
            last = F.size(p) - 1
            gaps = F.transform(p, lambda x, k: F.when(k < last, F.least(F.get(p, k + 1) - x, F.lit(n))).otherwise(n))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bound(_bound(ordered, places), covered))

    def windows(a: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(n)]))
        return F.when(F.size(a) > n, _bound(each, count)).otherwise(F.lit(0).cast("long"))

    return _bound(w, windows)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measures(t: Column) -> Column:
    """The five measures of a text, as one struct."""
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        _bound(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("m"),
        F.char_length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def _own(of: str) -> list[Column]:
    return [F.col(f"{of}.m.n_words"), F.col(f"{of}.word_chars"), F.col(f"{of}.n_symbols"), F.col(f"{of}.n_dup_lines"), F.col(f"{of}.m.n_repeat_words")]


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of single documents; null texts have none of anything."""
    d = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias(id_col), _measures(text_of(text_col)).alias("of"))
    return d.select(id_col, *_own("of"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _hashed_lines(text: Column) -> Column:
    """Hash and number of words of each line that has a word, by lower case and single spaces."""
    lines = F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))


def _host(host_col: str) -> Column:
    return F.xxhash64(F.col(f"`{host_col}`").cast("string"))


def _frequent(slim: DataFrame, share: float, least: int) -> DataFrame:
    """Rows (host, frequent), written: the hashes of each host's frequent lines.

    A frequent line takes more than `share` of the host's documents, so an array holds no more hashes than 1 / share documents
    of the host have lines on average. Only joins of written tables are made, which adaptive execution can split.
    """
    docs_of = written(slim.where("size(lines) > 0").groupBy("host").agg(F.count("*").alias("docs")), "host-documents")
    once = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    counts = slim.select("host", F.explode(once).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    lines = written(written(counts, "line-counts").join(docs_of, "host").where(F.col("n") > share * F.col("docs")).select("host", "h"), "frequent-lines")
    return written(lines.groupBy("host").agg(F.collect_list("h").alias("frequent")), "frequent-by-host")


def _judged(slim: DataFrame, frequent: DataFrame, remain: float, keep: list[str]) -> DataFrame:
    """Each row of slim with its frequent lines; rows are judged by themselves, whether their ids are null or repeated."""
    none = F.array().cast("array<bigint>")
    both = slim.join(frequent, "host", "left").withColumn("common", F.array_intersect(F.transform("lines", lambda x: x["h"]), F.coalesce("frequent", none)))
    both = both.withColumn("hit", F.filter("lines", lambda x: F.array_contains("common", x["h"])))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["w"])
    out = both.select(*keep, F.size("lines").cast("long").alias("n_lines"), F.size("hit").cast("long").alias("n_frequent_lines"), total("lines").alias("line_words"), total("hit").alias("frequent_words"))
    left = F.col("line_words") - F.col("frequent_words")
    return out.withColumn("depleted", (F.col("n_frequent_lines") > 0) & ((left < remain * F.col("line_words")) | (left < LEAST_WORDS)))


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST_DOCS, remain: float = REMAIN
) -> DataFrame:
    """Rows (id, n_lines, n_frequent_lines, line_words, frequent_words, depleted), one for each input row.

    A line is normalised by lower case and single spaces. It is frequent in its host if more than `least` documents and
    more than `share` of the host's documents with a line hold it; a document counts once however often it holds a line. A
    document is depleted if its frequent lines leave less than `remain` of its words, or fewer words than any document
    needs. A null host is a host of its own. Null and empty texts have no lines. Each row is a document of its own, also
    where rows repeat an id, or a text, or have none. Very long texts are so many lines. An empty table gives an empty result.
    """
    slim = pick(docs, id_col, text_col, host_col).select(F.col(f"`{id_col}`").alias("id"), _host(host_col).alias("host"), _hashed_lines(text_of(text_col)).alias("lines"))
    slim = written(slim, "lines")
    return _judged(slim, _frequent(slim, share, least), remain, ["id"]).withColumnRenamed("id", id_col)


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST_DOCS) -> DataFrame:
    """Rows (id, clean_text), one for each input row: the texts without the frequent lines, null texts being empty."""
    slim = written(pick(docs, text_col, host_col).select(_host(host_col).alias("host"), _hashed_lines(text_of(text_col)).alias("lines")), "lines")
    found = _frequent(slim, share, least).withColumnRenamed("host", "host_hash")
    t = pick(docs, id_col, text_col, host_col).select(F.col(f"`{id_col}`").alias("id"), _host(host_col).alias("host"), text_of(text_col).alias("t"))
    left = F.array_join(F.filter(F.split("t", "\n"), lambda x: ~F.array_contains("frequent", F.xxhash64(_normal(x)))), "\n")
    return t.join(found, F.col("host") == F.col("host_hash"), "left").select(F.col("id").alias(id_col), F.when(F.col("frequent").isNull(), F.col("t")).otherwise(left).alias("clean_text"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST_DOCS, remain: float = REMAIN
) -> DataFrame:
    """The measures, what line_frequency finds, and base_failed and kept, one row for each input row.

    A document is kept if it passes the base rules and its host's frequent lines don't deplete it. Null and empty texts
    have no words and fail the base rules. Each row is judged by itself, also where rows repeat an id or a text or have a
    null id. Very long texts are judged whole. An empty table gives an empty result. Extra columns are ignored.
    """
    t = text_of(text_col)
    slim = pick(docs, id_col, text_col, host_col).select(F.col(f"`{id_col}`").alias("id"), _host(host_col).alias("host"), _hashed_lines(t).alias("lines"), _measures(t).alias("of"))
    slim = written(slim.select("id", "host", "lines", *_own("of")), "lines")
    out = _judged(slim, _frequent(slim, share, least), remain, ["id", *MEASURES])
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).withColumnRenamed("id", id_col)
