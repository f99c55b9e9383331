"""Article and person edges: co-authors inside and outside a venue, citation chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def abbreviation_lists(seed: DataFrame, name: str, abbreviation: str) -> DataFrame:
    """The sorted abbreviations of each name."""
    return seed.groupBy(name).agg(F.array_sort(F.collect_list(abbreviation)).alias("abbreviations"))


def coauthor_rows(editors: DataFrame, edges: DataFrame, articles: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """A row for each editor, article of the editor, and author of it, the editor included.

    editors (editor, journal, person), edges (article, person), articles (article, venue, year, title), abbreviations
    (journal, abbreviations). Editors without articles have a row of nulls. The self-join is on the article alone.
    """
    e1 = edges.select(F.col("article"), F.col("person").alias("person"))
    e2 = edges.select(F.col("article"), F.col("person").alias("author"))
    out = editors.join(abbreviations, "journal", "left").join(e1, "person", "left").join(e2, "article", "left").join(articles, "article", "left")
    own = F.coalesce(F.col("person") == F.col("author"), F.lit(False))
    inside = F.coalesce(F.array_contains("abbreviations", F.col("venue")), F.lit(False))
    return out.withColumns({"is_author": F.when(own, 1).otherwise(0), "in_journal": F.when(inside, 1).otherwise(0)})


def _counts(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct authors and titles in and out of the journal, from rows (keys, author, title, inside, outside) with either null.

    Each author and title is one row a key before it is counted, so that nothing is expanded for the distinct counts.
    """
    once = sides.groupBy(*keys, "author", "title").agg(F.max("inside").alias("inside"), F.max("outside").alias("outside"))
    of = lambda c, side: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), side)), F.lit(0)).cast("long")
    inside, outside = F.col("inside"), F.col("outside")
    return once.groupBy(*keys).agg(
        of("author", outside).alias("coauthors_out"), of("author", inside).alias("coauthors_in"),
        of("title", outside).alias("articles_out"), of("title", inside).alias("articles_in"), F.count("title").alias("articles"),
    )


def coauthor_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct co-authors and articles in and out of the journal, editors themselves left out."""
    others = rows.where("is_author = 0").select(*keys, "author", "title", F.col("in_journal").alias("inside"), (1 - F.col("in_journal")).alias("outside"))
    types = dict(others.dtypes)
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    either = F.explode(F.array(F.struct(F.col("author"), none("title")), F.struct(none("author"), F.col("title")))).alias("x")
    return _counts(others.select(*keys, "inside", "outside", either).select(*keys, "inside", "outside", "x.author", "x.title"), keys)


def coauthor_summary(editors: DataFrame, edges: DataFrame, articles: DataFrame, abbreviations: DataFrame, keys: list[str]) -> DataFrame:
    """The counts of coauthor_counts over coauthor_rows, from the editors' own articles: only co-authors fan out.

    keys are columns of editors, abbreviations or articles. Articles count if they have another author, which the least and the largest
    author tell; editors without articles have a row of zeros.
    """
    inside = F.when(F.coalesce(F.array_contains("abbreviations", F.col("venue")), F.lit(False)), 1).otherwise(0)
    own = editors.join(abbreviations, "journal", "left").join(edges.select("article", "person"), "person", "left").join(articles, "article", "left")
    own = own.select(*keys, "article", "person", "title", inside.alias("inside"), (1 - inside).alias("outside"))
    types = dict(own.dtypes)
    several = edges.groupBy("article").agg(((F.min("person") != F.max("person")) | (F.count("*") > F.count("person"))).alias("several"))
    counted = own.join(several, "article", "left").where(F.col("article").isNull() | F.col("several"))
    titles = counted.select(*keys, F.lit(None).cast(types["person"]).alias("author"), "title", "inside", "outside")
    others = own.join(edges.select("article", F.col("person").alias("author")), "article").where(F.col("author") != F.col("person"))
    return _counts(others.select(*keys, "author", F.lit(None).cast(types["title"]).alias("title"), "inside", "outside").unionByName(titles), keys)


def coauthor_measures(rows: DataFrame) -> DataFrame:
    """Co-authors of each member by journal, year and kind of article, beside means of the journal's year and of the year.

    rows (member, journal, pub_year, kind, person, author, article, in_journal). Rows of the member as author, and those whose
    author or member isn't known, don't count. Means are taken by kind but looked up by journal and year, or by year, alone, so a row
    stands beside the means of each kind.
    """
    keys = ["member", "journal", "pub_year", "kind"]
    sides = rows.where("person <> author").select(*keys, "author", F.col("article").alias("title"), F.col("in_journal").alias("inside"), (1 - F.col("in_journal")).alias("outside"))
    types = dict(sides.dtypes)
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    either = F.explode(F.array(F.struct(F.col("author"), none("title")), F.struct(none("author"), F.col("title")))).alias("x")
    once = sides.select(*keys, "inside", "outside", either).select(*keys, "inside", "outside", "x.author", "x.title")
    once = once.groupBy(*keys, "author", "title").agg(F.max("inside").alias("inside"), F.max("outside").alias("outside"))
    of = lambda c, side: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col(side))), F.lit(0)).cast("long")
    c = once.groupBy(*keys).agg(
        F.count("author").alias("cnt_coauthor_total"), of("author", "inside").alias("cnt_coauthors_inside_journal"), of("author", "outside").alias("cnt_coauthors_outside_journal"),
        F.count("title").alias("cnt_publications"), of("title", "inside").alias("cnt_publications_inside_journal"), of("title", "outside").alias("cnt_publications_outside_journal"),
    )
    return with_means(c)


#: What is counted of a member's journal, year and kind.
COUNTS = ("cnt_coauthor_total", "cnt_coauthors_inside_journal", "cnt_coauthors_outside_journal", "cnt_publications", "cnt_publications_inside_journal", "cnt_publications_outside_journal")


def with_means(c: DataFrame) -> DataFrame:
    """Counts by (member, journal, pub_year, kind) with shares and, of each kind, their means of the journal's year and of the year.

    Counts are shuffled once, by journal and year as one value that is never null: the means read the same exchange, so they need all its
    columns and no filter of theirs may sink below it, for which what they filter by is aggregated. Years' means come from the sums of
    journals, and both are put together before they meet the counts. An unknown journal or year has no means.
    """
    percent = lambda side: (F.col(f"cnt_coauthors_{side}_journal") / F.col("cnt_coauthor_total") * 100).alias(f"perc_coauthors_{side}_journal")
    c = c.withColumn("_at", F.struct("journal", "pub_year")).repartition("_at")
    sums = [x for s in ("inside", "outside") for x in (F.sum(percent(s)).alias(s), F.count(percent(s)).alias(f"n_{s}"))]
    dated = F.col("pub_year").isNotNull()
    known = (F.max(dated).alias("_dated"), F.max(dated & F.col("journal").isNotNull()).alias("_both"), F.max(F.xxhash64(*c.columns)).alias("_all"))
    by_journal = c.groupBy("_at", "kind").agg(*sums, F.struct(F.max("pub_year").alias("pub_year")).alias("_year"), *known).where("_all IS NOT NULL")
    mean = lambda name: [F.try_divide(F.col(s), F.col(f"n_{s}")).alias(f"{name}_avg_perc_coauthors_{s}_journal") for s in ("inside", "outside")]
    by_year = by_journal.where("_dated").groupBy("_year", "kind").agg(*[F.sum(x).alias(x) for s in ("inside", "outside") for x in (s, f"n_{s}")])
    means = by_journal.select("_at", "_year").distinct().join(by_journal.where("_both").select("_at", *mean("journal")), "_at", "left").join(by_year.select("_year", *mean("year")), "_year", "left")
    out = c.select("*", percent("inside"), percent("outside"), (F.col("cnt_coauthors_inside_journal") - F.col("cnt_coauthors_outside_journal")).alias("cnt_coauthor_diff"))
    return out.join(means.drop("_year"), "_at").drop("_at")


def _coded(names: DataFrame, board: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers in place of persons: names (name, person) and board (member, journal, person) with person a number.

    Persons are numbered within buckets of their hash, so that no order over all of them is needed. The last two bits say if a person is
    no member (0), a member's only person (1), or one of several (2).
    """
    buckets = 1024
    bucket = F.pmod(F.xxhash64("person"), F.lit(buckets))
    number = (F.row_number().over(Window.partitionBy("_bucket").orderBy("person")).cast("long") - 1) * buckets + F.col("_bucket")
    several = names.groupBy("name").agg((F.count("*") > 1).alias("several"))
    members = board.join(several.withColumnRenamed("name", "member"), "member")
    flags = members.groupBy("person").agg(F.max(F.when(F.col("several"), 2).otherwise(1)).alias("_flag"))
    codes = names.select("person").distinct().withColumn("_bucket", bucket).withColumn("_number", number).join(flags, "person", "left")
    codes = codes.select("person", (F.col("_number") * 4 + F.coalesce("_flag", F.lit(0))).cast("int").alias("_code"))
    return tuple(x.join(codes, "person").drop("person").withColumnRenamed("_code", "person") for x in (names, members))


def board_measures(editors: DataFrame, names: DataFrame, written: DataFrame, publications: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """What coauthor_measures gives over coauthor_rows, without a row for each member, article and co-author that is shuffled.

    editors (member, journal), names (name, person), written (id, name), publications (id, article, venue, kind, pub_year), abbreviations
    (journal, abbreviations). Persons are numbers, an article has its authors as one list, and a member's articles meet in one place,
    where co-authors are unfolded and counted. Of members with several persons, co-authors and articles stay apart until persons meet.
    """
    names = names.where("name IS NOT NULL AND person IS NOT NULL").distinct()
    board = editors.distinct().join(names.withColumnRenamed("name", "member"), "member")
    lookup, members = _coded(names, board)
    by_id = written.join(lookup.hint("shuffle_hash"), "name").select("id", "person").repartition("id").groupBy("id").agg(F.collect_set("person").alias("persons"))
    found = publications.where("article IS NOT NULL").join(by_id, "id").select("article", "venue", "kind", "pub_year", "persons").repartition("article")
    articles = found.groupBy("article", "venue").agg(F.collect_set(F.struct("kind", "pub_year")).alias("_at"), F.array_distinct(F.flatten(F.collect_list("persons"))).alias("persons"))
    flag = lambda x: x.bitwiseAND(F.lit(3))
    own = articles.select("article", "venue", "_at", "persons", F.explode(F.filter("persons", lambda x: flag(x) != 0)).alias("person"))
    own = own.select("article", "venue", "person", F.filter("persons", lambda x: x != F.col("person")).alias("others"), F.inline("_at")).where(F.size("others") > 0)
    own = own.withColumn("article", F.when(flag(F.col("person")) == 2, F.col("article")))
    boards = members.join(abbreviations, "journal", "left")
    inside = F.when(F.coalesce(F.array_contains("abbreviations", F.col("venue")), F.lit(False)), 1).otherwise(0)
    cell = ["member", "journal", "pub_year", "kind"]
    rows = own.join(boards.hint("shuffle_hash"), "person").select("person", "several", *cell, "article", inside.alias("inside"), "others")
    # an article itself stands beside its authors as author -1
    rows = rows.select("person", "several", *cell, "article", "inside", F.explode(F.concat("others", F.array(F.lit(-1)))).alias("author"))
    rows = rows.withColumn("article", F.when(F.col("author") < 0, F.col("article")))
    once = rows.groupBy("person", "several", *cell, "author", "article").agg(F.max("inside").alias("i"), F.max(1 - F.col("inside")).alias("o"), F.count("*").alias("n"), F.sum("inside").alias("n_i"))
    is_author = F.col("author") >= 0
    values = (F.when(is_author, 1), F.when(is_author, F.col("i")), F.when(is_author, F.col("o")), F.when(~is_author, F.col("n")), F.when(~is_author, F.col("n_i")), F.when(~is_author, F.col("n") - F.col("n_i")))
    apart = [F.when(F.col("several"), F.col(c)).alias(f"_{c}") for c in ("author", "article")]
    by_person = once.groupBy("person", *cell, *apart).agg(*[F.sum(v).alias(c) for c, v in zip(COUNTS, values, strict=True)])
    met = by_person.groupBy(*cell, "_author", "_article").agg(*[F.max(c).alias(c) for c in COUNTS])
    return with_means(met.groupBy(*cell).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]))


def citation_authors(chapters: DataFrame, references: DataFrame, dois: DataFrame, edges: DataFrame, persons: DataFrame) -> DataFrame:
    """From a chapter's DOI over what it cites to the authors of that.

    chapters (from_key, doi), references (citing, cited), dois (article, doi), edges (article, person), persons (person,
    name). Keys are trimmed; chapters that cite nothing keep a row of nulls.
    """
    r = references.select(F.trim("citing").alias("citing_key"), "citing", "cited", F.trim("cited").alias("cited_key"))
    c = chapters.select("from_key", F.trim(F.replace(F.col("doi"), F.lit("https://doi.org/"), F.lit(""))).alias("from_doi_key"))
    out = c.join(r, c["from_doi_key"] == r["citing_key"], "left").join(dois.withColumnRenamed("doi", "known_doi"), F.col("cited_key") == F.col("known_doi"), "left")
    out = out.join(edges, "article", "left").join(persons, "person", "left")
    return out.select("from_key", F.col("citing").alias("from_doi"), F.col("cited").alias("to_doi"), F.col("article").alias("to_key"), F.col("person").alias("to_person"), F.col("name").alias("to_name"))


def citation_summary(chapters: DataFrame, references: DataFrame, dois: DataFrame, edges: DataFrame, persons: DataFrame) -> DataFrame:
    """For each chapter what citation_authors finds, counted: n_rows, n_found, n_authors and the first author's name.

    Numbers of rows are carried along: citations are counted before they meet authors, whose names are looked up once for each
    edge; after that the least name is only looked for among a chapter's distinct ones.
    """
    r = references.select(F.trim("citing").alias("citing_key"), F.trim("cited").alias("cited_key"))
    c = chapters.select("from_key", F.trim(F.replace(F.col("doi"), F.lit("https://doi.org/"), F.lit(""))).alias("from_doi_key"))
    cited = c.join(r, c["from_doi_key"] == r["citing_key"], "left").join(dois.withColumnRenamed("doi", "known_doi"), F.col("cited_key") == F.col("known_doi"), "left")
    cited = cited.groupBy("from_key", "article").agg(F.count("*").alias("n"))
    names = edges.join(persons, "person", "left").select("article", "name")
    by_name = cited.join(names, "article", "left").groupBy("from_key", "name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("article").isNotNull(), F.col("n"))).alias("found"))
    return by_name.groupBy("from_key").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum("found"), F.lit(0)).alias("n_found"), F.count("name").alias("n_authors"), F.min("name").alias("first_author"))
