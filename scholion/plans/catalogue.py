"""The models of the bibliographic platform, from landed text tables to measures of committees, boards and authors.

Names and columns of models are the interface that users query; how they are computed is put together from operators.
Sources are landed tables of text by schema and name. A run needs only the sources of the models it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, measures, text
from ..operators import front_matter, graph, matching, stats
from ..sources import sinks, tables
from .registry import Registry, Run

registry = Registry()
model = registry.model

#: Roles that make a member of a board an editor.
EDITOR_ROLES = ["Associate Editors", "Editors-in-Chief", "Editor-in-Chief"]
RANKS = ["A*", "A", "B"]
SERIES = "Lecture Notes in Computer Science"
RANKING_SITE = "https://dblp.uni-trier.de/db/"

# -- landing: text to types


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _landed(run: Run, source: str, **columns: Column) -> DataFrame:
    """Columns of a landed element table; the caller's come after its number."""
    return run.source("dblp_dump", source).select(_q("$_object_id").cast("int").alias("id"), *[c.alias(n) for n, c in columns.items()])


def _publication(source: str, name: str, distinct: bool = False):
    def build(run: Run) -> DataFrame:
        out = _landed(run, source, mdate=F.col("mdate").cast("date"), dblp_key=F.col("key"), publtype=text.blank_to_null("publtype"))
        return out.withColumn("dblp_key", text.blank_to_null("dblp_key")).distinct() if distinct else out

    build.__name__ = name
    model(kind="table", schema="dblp_dump", tags=("dblp",), unique=(("id",), ("dblp_key",)), present=("id", "dblp_key"))(build)


def _child(source: str, value: str, cast: str = "string", more: tuple[str, ...] = ()):
    def build(run: Run) -> DataFrame:
        parent = {"parent_id": _q("$_parent_object_id").cast("int"), "parent_type": _q("$_parent_object_type")}
        return _landed(run, source, **parent, **{value: text.blank_to_null(source).cast(cast)}, **{m: text.blank_to_null(m) for m in more})

    build.__name__ = f"lan_{source}"
    model(kind="table", schema="dblp_dump", tags=("dblp",), unique=(("parent_id", "id"),), present=(value,))(build)


for _kind in ("article", "inproceedings", "incollection"):
    _publication(_kind, f"lan_{_kind}")
_publication("www", "lan_www", distinct=True)
_child("title", "title", more=("bibtex",))
_child("year", "year", "smallint")
for _kind in ("journal", "volume", "pages", "number"):
    _child(_kind, _kind)


@model(kind="table", schema="dblp_dump", tags=("dblp",), unique=(("parent_id", "id"),), present=("id", "parent_id", "parent_type", "author_name"))
def lan_author(run: Run) -> DataFrame:
    return _authors(run).distinct()


def _authors(run: Run) -> DataFrame:
    """Rows of lan_author with their repeats, for what doesn't count them."""
    more = {c: text.blank_to_null(c) for c in ("orcid", "bibtex", "aux")}
    return _landed(run, "author", parent_id=_q("$_parent_object_id").cast("int"), parent_type=_q("$_parent_object_type"), author_name=text.blank_to_null("author"), **more)


@model(kind="table", schema="dblp_dump", tags=("dblp",), unique=(("parent_id", "id"),), present=("doi",))
def lan_ee(run: Run) -> DataFrame:
    out = _landed(run, "ee", parent_id=_q("$_parent_object_id").cast("int"), parent_type=_q("$_parent_object_type"), doi_link=text.blank_to_null("ee"), doi=text.doi_of_link("ee"))
    return out.where(F.col("doi_link").startswith("https://doi.org"))


# -- staging of the bibliography

_STAGED = {"kind": "table", "schema": "dblp_dump", "tags": ("dblp", "staging")}


@model("lan_article", "lan_inproceedings", "lan_incollection", kind="table", schema="dblp_dump", tags=("dblp",), unique=(("id",), ("dblp_key",)), present=("id", "object_type", "dblp_key"))
def cte_scope(run: Run) -> DataFrame:
    kinds = ("article", "inproceedings", "incollection")
    return sinks.union_by_name(*[run.ref(f"lan_{k}").select("id", F.lit(k).alias("object_type"), "dblp_key", "publtype") for k in kinds])


@model("cte_scope", "lan_title", "lan_year", "lan_journal", "lan_volume", "lan_pages", "lan_number", unique=(("dblp_object_id",),), present=("dblp_object_id",), **_STAGED)
def stg_dblp_article(run: Run) -> DataFrame:
    """A child that a publication repeats multiplies its row, as the checks report. All joins are on the one key."""
    out = run.ref("cte_scope").select(F.col("id").alias("dblp_object_id"), F.col("object_type").alias("dblp_object_type"), F.col("dblp_key").alias("dblp_object_key"), F.col("publtype").alias("dblp_publtype"))
    for child in ("title", "year", "journal", "volume", "pages", "number"):
        values = run.ref(f"lan_{child}").select(F.col("parent_id").alias("dblp_object_id"), F.col(child).alias(f"dblp_{child}"))
        out = out.join(values, "dblp_object_id", "left")
    return out


@model("lan_author", "lan_www", kind="table", schema="tempory_tables", tags=("dblp", "staging"))
def www_cte(run: Run) -> DataFrame:
    a = _authors(run).where("parent_type = 'www'").select("parent_id", "author_name").distinct()
    return a.join(run.ref("lan_www"), F.col("parent_id") == F.col("id"), "left").select("author_name", F.col("dblp_key").alias("www_dblp_key"))


@model("lan_author", "www_cte", unique=(("dblp_name", "dblp_unique_person_key"),), **_STAGED)
def stg_dblp_person(run: Run) -> DataFrame:
    """A person is known by the home page, else by the name; the ORCID of one name holds for all names of a person."""
    a = _authors(run).groupBy("author_name").agg(F.min("orcid").alias("orcid"))
    w = run.ref("www_cte").withColumnRenamed("author_name", "www_name")
    both = a.join(w, F.col("author_name") == F.col("www_name"), "left").withColumn("dblp_unique_person_key", F.coalesce("www_dblp_key", "author_name"))
    out = matching.settled(both, F.col("dblp_unique_person_key"), "orcid", "dblp_orcid")
    return out.select(F.col("author_name").alias("dblp_name"), "dblp_orcid", "dblp_unique_person_key").distinct()


@model("cte_scope", "lan_author", "stg_dblp_person", unique=(("dblp_object_key", "dblp_unique_person_key"),), **_STAGED)
def stg_dblp_article_person(run: Run) -> DataFrame:
    a = run.ref("lan_author").select("parent_id", "author_name")
    out = run.ref("cte_scope").join(a, F.col("id") == F.col("parent_id"), "left").join(run.ref("stg_dblp_person"), F.col("author_name") == F.col("dblp_name"), "left")
    return out.select(F.col("dblp_key").alias("dblp_object_key"), "dblp_unique_person_key").distinct()


@model("cte_scope", "lan_ee", unique=(("dblp_doi",),), present=("dblp_object_id", "dblp_doi"), **_STAGED)
def stg_dblp_doi(run: Run) -> DataFrame:
    e = run.ref("lan_ee").select("parent_id", F.col("doi").alias("dblp_doi"))
    out = run.ref("cte_scope").join(e, F.col("id") == F.col("parent_id"), "left").where("dblp_doi IS NOT NULL")
    return out.select(F.col("id").alias("dblp_object_id"), F.col("object_type").alias("dblp_object_type"), F.col("dblp_key").alias("dblp_object_key"), F.col("publtype").alias("dblp_publtype"), "dblp_doi").distinct()


# -- rankings and proceedings lists


@model(schema="dblp_api")
def lncs(run: Run) -> DataFrame:
    venue = F.lit(False)
    for c in ("info_venue", "info_venue_0", "info_venue_1"):
        venue = venue | F.coalesce(F.col(c) == SERIES, F.lit(False))
    found = run.source("dblp_api", "document").where(venue & F.col("info_ee").isNotNull()).select(F.col("info_key").alias("dblp_key"), F.col("info_ee").alias("url"))
    by_hand = run.source("dblp_api", "manual_dblp_api_document").where("type = 'LNCS'").select("dblp_key", "url")
    return found.unionAll(by_hand).distinct()


@model(schema="core")
def cln_conf_ranks(run: Run) -> DataFrame:
    r = run.source("core", "conf_ranks").where(F.col("Rank").isin(RANKS))
    return r.select(F.col("Title").alias("title"), F.col("Acronym").alias("acronym"), F.col("Rank").alias("ranking"), text.blank_to_null("DBLP", "none").alias("dblp_url"))


@model(schema="core")
def cln_jnl_ranks(run: Run) -> DataFrame:
    r = run.source("core", "jnl_ranks").where(F.col("Rank").isin(RANKS) & F.col("DBLP").isNotNull())
    return r.select(F.col("Title").alias("title"), F.col("Rank").alias("ranking"), F.col("DBLP").alias("dblp_url"), F.replace("DBLP", F.lit(RANKING_SITE), F.lit("")).alias("dblp_key"))


@model("cln_conf_ranks", schema="core")
def conferences(run: Run) -> DataFrame:
    """Links that the ranking lacks come from the seed."""
    s = run.source("core", "manual_dblp_url").select("title", "acronym", F.replace("dblp_url", F.lit("/index.html"), F.lit("")).alias("seed_url"))
    out = run.ref("cln_conf_ranks").join(s, ["title", "acronym"], "left")
    return out.select("title", "acronym", "ranking", F.replace(F.coalesce("dblp_url", "seed_url"), F.lit(RANKING_SITE), F.lit("")).alias("dblp_key"))


# -- proceedings

BOOK = [
    "$_book_url", "$_dblp_key", "$_extract_dts", "book_subtitle", "book_title", "copyright_information", "doi", "ebook_isbn", "ebook_packages", "edition_number", "front_matter_url",
    "number_of_illustrations", "number_of_pages", "publisher_name", "series_e-issn", "series_issn", "series_title", "softcover_isbn", "series_abbreviated_title", "license", "authors", "hardcover_isbn",
]


def _doi_hash(c: str = "doi") -> Column:
    return text.digest(text.doi_of_link(_q(c)))


@model(schema="springer_lncs")
def bus_book(run: Run) -> DataFrame:
    return run.source("springer_lncs", "book").select(_doi_hash().alias("surrogate_id"), *map(_q, BOOK))


@model(kind="table", schema="springer_lncs", tags=("lncs", "staging"))
def stg_lncs_article(run: Run) -> DataFrame:
    b = run.source("springer_lncs", "book").alias("b")
    c = run.source("springer_lncs", "chapter").alias("c")
    mine = {"lncs_chapter_doi_link": "doi", "lncs_chapter_online_isbn": "online_isbn", "lncs_chapter_print_isbn": "print_isbn", "lncs_chapter_publisher_name": "publisher_name", "lncs_chapter_title": "title", "lncs_chapter_first_online": "first_online", "lncs_chapter_revised": "revised"}
    out = c.join(b, F.col("c.`$_book_url`") == F.col("b.`$_book_url`"), "left")
    return out.select(F.col("b.`$_book_url`").alias("lncs_book_url"), F.col("c.`$_paper_url`").alias("lncs_chapter_url"), text.doi_of_link(F.col("c.doi")).alias("lncs_paper_doi"), *[F.col(f"c.`{v}`").alias(k) for k, v in mine.items()], "b.*")


@model(kind="table", schema="springer_lncs")
def stg_lncs_author(run: Run) -> DataFrame:
    """Authors by ORCID, then by email where there is no ORCID, then by name where there is neither."""
    a, m = run.source("springer_lncs", "author"), run.source("springer_lncs", "manual_author")
    known = m.select(F.col("name").alias("m_name"), F.col("email").alias("m_email"), F.col("orc").alias("m_orc"))
    core = a.select("name", "email", "orc").distinct().join(known, text.same_name("name", "m_name"), "left").select("name", F.coalesce("m_email", "email").alias("email"), text.without_scheme(F.coalesce("m_orc", "orc")).alias("orc")).distinct()
    cols = ["surrogate_id", "orc", "email", "name"]
    by_orc = core.where("orc IS NOT NULL").withColumn("surrogate_id", text.digest("orc")).select(cols)
    e, o = core.where("orc IS NULL AND email IS NOT NULL").alias("e"), by_orc.alias("o")
    # of those who share an email with an ORCID only the email is kept, unless the ORCID lacks a name: no pair is formed for each of them
    emails = e.select("email", F.lit(None).cast("string").alias("name"), F.lit(False).alias("named")).unionAll(e.select("email", "name", F.lit(True))).distinct().alias("s")
    with_orc = o.join(emails, (F.lower("o.email") == F.lower("s.email")) & (F.col("o.name").isNull() == F.col("s.named")), "left").select("o.surrogate_id", "o.orc", "s.email", F.coalesce("o.name", "s.name").alias("name"))
    without = e.join(o, F.lower("e.email") == F.lower("o.email"), "left_anti").select(text.digest("email").alias("surrogate_id"), F.lit(None).cast("string").alias("orc"), "email", "name")
    by_email = with_orc.unionAll(without)
    n, x = core.where("orc IS NULL AND email IS NULL").alias("n"), by_email.alias("x")
    by_name = n.join(x, F.col("n.name") == F.col("x.name"), "left").select(F.coalesce("x.surrogate_id", text.digest("n.name")).alias("surrogate_id"), "x.orc", "x.email", "n.name")
    return by_orc.unionAll(by_email).unionAll(by_name).distinct()


@model("stg_lncs_author", kind="table", schema="springer_lncs")
def stg_lncs_author_chapter(run: Run) -> DataFrame:
    a = run.source("springer_lncs", "author").select(_q("$_paper_url"), "doc_person_id", "name", "email", text.without_scheme("orc").alias("orc"))
    known = run.ref("stg_lncs_author").withColumnRenamed("surrogate_id", "author_surrogate_id")
    return matching.by_branches(a, known, ["orc", "email", "name"], "author_surrogate_id", ["`$_paper_url`", "doc_person_id"])


@model("stg_dblp_doi", "stg_dblp_article_person", "stg_dblp_person", kind="table", schema="integration")
def lncs_citation_authors(run: Run) -> DataFrame:
    c = run.source("springer_lncs", "chapter").select(_q("$_dblp_key").alias("from_key"), "doi")
    dois = run.ref("stg_dblp_doi").select(F.col("dblp_object_key").alias("article"), F.col("dblp_doi").alias("doi"))
    edges = run.ref("stg_dblp_article_person").select(F.col("dblp_object_key").alias("article"), F.col("dblp_unique_person_key").alias("person"))
    persons = run.ref("stg_dblp_person").select(F.col("dblp_unique_person_key").alias("person"), F.col("dblp_name").alias("name"))
    out = graph.citation_authors(c, run.source("opencitations_dump", "reference"), dois, edges, persons)
    return out.toDF("from_dblp_key", "from_doi", "to_doi", "to_dblp_key", "to_dblp_unique_person_key", "to_author_name")


# -- committees


def _run_tables(run: Run) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(run.source("lncs_front_matter", t) for t in ("file", "section", "member"))


@model(kind="table", schema="lncs_front_matter")
def validation(run: Run) -> DataFrame:
    out = front_matter.validation(*_run_tables(run))
    return out


@model("validation", kind="inlined", schema="lncs_front_matter")
def clean_source(run: Run) -> DataFrame:
    return front_matter.clean_members(*_run_tables(run), run.ref("validation"))


@model("clean_source", kind="table", schema="lncs_front_matter", unique=(("member_name", "book_filename", "role"),))
def stg_lncs_fm_member_book(run: Run) -> DataFrame:
    return run.ref("clean_source").select(F.col("name").alias("member_name"), F.col("filename").alias("book_filename"), "role").distinct()


@model("validation", kind="table", schema="lncs_front_matter")
def run_performance_metrics(run: Run) -> DataFrame:
    return front_matter.run_metrics(run.source("lncs_front_matter", "file"), run.ref("validation"))


def _book_outliers(counts: DataFrame, value: str) -> DataFrame:
    return stats.mad_outliers(counts, ["dblp_key"], value)


def _written_in_book(run: Run) -> DataFrame:
    """Articles that members wrote in their own books; members of books in which no member wrote have no book and are left out."""
    b, c, a = (run.source("springer_lncs", t) for t in ("book", "chapter", "author"))
    books = b.select(_q("$_dblp_key").alias("book_key"), _q("$_book_url").alias("book"))
    chapters = c.select(_q("$_book_url").alias("book"), _q("$_paper_url").alias("paper"))
    wrote = books.join(chapters, "book").join(a.select(_q("$_paper_url").alias("paper"), F.col("name").alias("author_name")), "paper").withColumn("file", text.file_of_key("book_key")).select("book_key", "file", "author_name")
    m = run.ref("stg_lncs_fm_member_book")
    hits = m.join(wrote, (F.col("member_name") == F.col("author_name")) & (F.col("book_filename") == F.col("file")), "left")
    key = F.max("book_key").over(_by("book_filename"))
    return hits.withColumn("dblp_key", key).groupBy("dblp_key", "member_name").agg(F.count("author_name").alias("cnt_articles_written_in_book"))


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


@model("stg_lncs_fm_member_book", kind="table", schema="analysis")
def analysis_lncs_members_publishing(run: Run) -> DataFrame:
    out = _book_outliers(_written_in_book(run), "cnt_articles_written_in_book")
    return out.select(F.col("dblp_key").alias("book_dblp_key"), F.col("n").alias("members_in_book"), "member_name", "cnt_articles_written_in_book", "mad", "ratio")


def _cited_in_book(run: Run) -> DataFrame:
    m = run.ref("stg_lncs_fm_member_book").select(text.key_of_file("book_filename").alias("dblp_key"), "member_name").distinct()
    c = run.ref("lncs_citation_authors").groupBy("from_dblp_key", "to_author_name").agg(F.count("*").alias("n_cited"))
    out = m.join(c, (F.col("dblp_key") == F.col("from_dblp_key")) & (F.col("member_name") == F.col("to_author_name")), "left")
    return out.select("dblp_key", "member_name", F.coalesce("n_cited", F.lit(0)).alias("cnt_author_cited_in_book"))


@model("stg_lncs_fm_member_book", "lncs_citation_authors", kind="table", schema="analysis")
def analysis_lncs_members_citations(run: Run) -> DataFrame:
    out = _book_outliers(_cited_in_book(run), "cnt_author_cited_in_book")
    return out.select(F.col("dblp_key").alias("book_dblp_key"), F.col("median").alias("median_author_cited_in_book"), "member_name", "cnt_author_cited_in_book", F.col("mad").alias("mad_score"), "ratio")


@model("analysis_lncs_members_publishing", "analysis_lncs_members_citations", kind="table", schema="analysis")
def analysis_lncs_members(run: Run) -> DataFrame:
    p = run.ref("analysis_lncs_members_publishing").select("book_dblp_key", "member_name", F.col("cnt_articles_written_in_book").alias("cnt_published"), F.col("mad").alias("book_publishing_mad"), F.col("ratio").alias("publishing_ratio"))
    c = run.ref("analysis_lncs_members_citations").select("book_dblp_key", "member_name", F.col("cnt_author_cited_in_book").alias("cnt_cited"), F.col("mad_score").alias("book_citations_mad"), F.col("ratio").alias("citation_ration"))
    both = p.join(c, ["book_dblp_key", "member_name"], "full").where("cnt_published IS NOT NULL AND cnt_cited IS NOT NULL")
    parts = [F.split_part("book_dblp_key", F.lit("/"), F.lit(k)).alias(f"book_dblp_key_{n}") for k, n in ((1, "type"), (2, "conf"), (3, "period"))]
    return both.select("book_dblp_key", *parts, "member_name", text.digest("member_name").alias("member_name_anom"), "cnt_published", "book_publishing_mad", "publishing_ratio", "cnt_cited", "book_citations_mad", "citation_ration")


# -- editorial boards

_BOARD = {"kind": "table", "schema": "acm_analysis", "tags": ("acm",)}


@model(**_BOARD)
def clean_editorial_board(run: Run) -> DataFrame:
    b = run.source("acm", "editorial_boards").where(F.col("role").isin(EDITOR_ROLES)).select("name", "journal").distinct()
    return sinks.numbered(b, "editorial_board_id", "name", "journal").select("editorial_board_id", "name", "journal")


@model("stg_dblp_person", "stg_dblp_article_person", "stg_dblp_article", **_BOARD)
def board_dblp_articles(run: Run) -> DataFrame:
    b = run.source("acm", "editorial_boards")
    b = b.select(*[F.col(c).alias(f"acm_{c}") for c in ("affiliation", "country", "journal", "name", "role")])
    p = run.ref("stg_dblp_person").select("dblp_name", "dblp_unique_person_key")
    out = b.join(p, F.col("acm_name") == F.col("dblp_name"), "left").join(run.ref("stg_dblp_article_person"), "dblp_unique_person_key", "left").join(run.ref("stg_dblp_article"), "dblp_object_key", "left")
    return out.select(*b.columns, "dblp_unique_person_key", *run.ref("stg_dblp_article").columns)


def _editors(run: Run) -> tuple[DataFrame, DataFrame]:
    """Editors of boards (editor, journal), and abbreviations of journals."""
    b = run.source("acm", "editorial_boards").where(F.col("role").isin(EDITOR_ROLES)).select(F.col("name").alias("editor"), "journal").distinct()
    seed = run.source("acm", "journal_dblp").select(F.col("acm_journal").alias("journal"), F.col("dblp_abbreviation").alias("abbreviation"))
    return b, graph.abbreviation_lists(seed, "journal", "abbreviation")


@model("stg_dblp_person", "stg_dblp_article_person", "stg_dblp_article", **_BOARD)
def acm_analysis_set(run: Run) -> DataFrame:
    b, abbreviations = _editors(run)
    p = run.ref("stg_dblp_person").select(F.col("dblp_name").alias("editor"), F.col("dblp_unique_person_key").alias("person"))
    edges = run.ref("stg_dblp_article_person").select(F.col("dblp_object_key").alias("article"), F.col("dblp_unique_person_key").alias("person"))
    a = run.ref("stg_dblp_article").select(F.col("dblp_object_key").alias("article"), F.col("dblp_year").alias("year"), F.col("dblp_journal").alias("article_journal"), F.col("dblp_title").alias("title"), "dblp_object_type")
    a = a.withColumn("venue", text.first_group("article", r"/(\w+)/"))
    out = graph.coauthor_rows(b.join(p, "editor", "left"), edges, a, abbreviations)
    return out.select(
        F.col("editor").alias("editor_name"), "journal", F.col("abbreviations").alias("dblp_journal_abbreviations"), F.col("person").alias("editor_dblp_person_key"), F.col("article").alias("article_dblp_object_key"),
        text.first_group("article", r"/(\w+)/").alias("article_journal_abbriviation"), F.col("author").alias("author_dblp_person_key"), F.col("year").alias("article_publication_year"), "article_journal",
        F.col("title").alias("article_title"), F.col("is_author").alias("ind_editor_is_author"), F.col("in_journal").alias("ind_article_in_journal"), "dblp_object_type",
    )


@model("acm_analysis_set", schema="acm_analysis")
def acm_analysis_subset(run: Run) -> DataFrame:
    rows = run.ref("acm_analysis_set").select("editor_name", F.col("dblp_journal_abbreviations").alias("journal_keys"), F.col("article_publication_year").alias("publication_year"), F.col("author_dblp_person_key").alias("author"), F.col("article_title").alias("title"), F.col("ind_editor_is_author").alias("is_author"), F.col("ind_article_in_journal").alias("in_journal"))
    out = graph.coauthor_counts(rows, ["editor_name", "journal_keys", "publication_year"])
    return out.toDF("editor_name", "journal_keys", "publication_year", "count_distinct_coauthor_out_journal", "count_distinct_coauthor_in_journal", "count_distinct_articles_out_journal", "count_distinct_articles_in_journal", "count_distinct_articles")


def _others(run: Run) -> DataFrame:
    return run.ref("acm_analysis_set").where("ind_editor_is_author = 0")


@model("acm_analysis_set", **_BOARD)
def co_author_pub_hist(run: Run) -> DataFrame:
    """How many co-authors share how many articles; an order would not outlive the table and is left to its reader."""
    keys = ["editor_name", "dblp_journal_abbreviations", "article_publication_year"]
    per = _others(run).groupBy(*keys, "author_dblp_person_key", "ind_article_in_journal").agg(F.count("*").alias("cnt_articles"))
    return per.groupBy(*keys, "cnt_articles", "ind_article_in_journal").agg(F.count_distinct("author_dblp_person_key").alias("cnt_unique_coauthor"))


@model("acm_analysis_set", **_BOARD)
def co_author_pub_hist_viz(run: Run) -> DataFrame:
    return _others(run).groupBy("editor_name", "journal", "article_publication_year", "author_dblp_person_key", "ind_article_in_journal").agg(F.count("*").alias("cnt_articles"))


@model("acm_analysis_set", **_BOARD)
def coauthor_pubcount(run: Run) -> DataFrame:
    return _others(run).groupBy("editor_name", F.col("author_dblp_person_key").alias("coauthor_dblp_key"), "ind_article_in_journal").agg(F.count("*").alias("cnt_articles"))


@model("acm_analysis_set", **_BOARD)
def coauthors(run: Run) -> DataFrame:
    """Co-authors of members by journal, year and kind of article, beside the means of the journal's year and of the year.

    The rows of acm_analysis_set, which define the counts, are counted without being made, from models that it needs.
    """
    editors, abbreviations = _editors(run)
    names = run.ref("stg_dblp_person").select(F.col("dblp_name").alias("name"), F.col("dblp_unique_person_key").alias("person"))
    written = _authors(run).select(F.col("parent_id").alias("id"), F.col("author_name").alias("name"))
    years = run.ref("lan_year").select(F.col("parent_id").alias("id"), F.col("year").alias("pub_year"))
    scope = run.ref("cte_scope").select("id", F.col("dblp_key").alias("article"), text.first_group("dblp_key", r"/(\w+)/").alias("venue"), F.col("object_type").alias("kind"))
    counted = graph.board_measures(editors.withColumnRenamed("editor", "member"), names, written, scope.join(years, "id", "left"), abbreviations)
    return counted.withColumnsRenamed({"journal": "acm_journal", "kind": "dblp_object_type"}).select(
        "member", "acm_journal", "pub_year", "dblp_object_type", "cnt_coauthor_total", *[f"{c}_{side}_journal" for side in ("inside", "outside") for c in ("cnt_coauthors", "perc_coauthors", "journal_avg_perc_coauthors", "year_avg_perc_coauthors")],
        "cnt_coauthor_diff", "cnt_publications", "cnt_publications_inside_journal", "cnt_publications_outside_journal",
    )


@model("acm_analysis_set", **_BOARD)
def coauthors_z_score(run: Run) -> DataFrame:
    """Co-authors of editors by journal and year, with the journal's and the year's means, the z-score and differences.

    Only journal articles count. Means are windows over the counts, so rows are neither joined nor multiplied.
    """
    rows = _others(run).where(text.first_group("article_dblp_object_key", r"(\w+)/") == "journals")
    inside, outside = F.col("ind_article_in_journal") == 1, F.col("ind_article_in_journal") == 0
    who, what = "author_dblp_person_key", "article_dblp_object_key"
    c = rows.groupBy("editor_name", "journal", F.col("article_publication_year").alias("pub_year")).agg(
        F.count_distinct(what).alias("cnt_publications"), measures.distinct_where(what, inside).alias("cnt_publications_inside_journal"), measures.distinct_where(what, outside).alias("cnt_publications_outside_journal"),
        F.count_distinct(who).alias("cnt_coauthor_total"), measures.distinct_where(who, inside).alias("cnt_coauthors_inside_journal"), measures.distinct_where(who, outside).alias("cnt_coauthors_outside_journal"),
    )
    i, o = "cnt_coauthors_inside_journal", "cnt_coauthors_outside_journal"
    c = c.withColumns({"perc_coauthors_inside_journal": measures.share(i, "cnt_coauthor_total"), "perc_coauthors_outside_journal": measures.share(o, "cnt_coauthor_total"), "cnt_coauthor_diff": F.col(i) - F.col(o)})
    j, y = _by("journal", "pub_year"), _by("pub_year")
    c = c.withColumns({"jnl_avg_coauthor_inside": F.avg(i).over(j), "jnl_stdev_coauthor_inside": F.stddev_samp(i).over(j), "year_avg_perc_coauthors_inside_journal": F.avg("perc_coauthors_inside_journal").over(y), "year_avg_perc_coauthors_outside_journal": F.avg("perc_coauthors_outside_journal").over(y)})
    return c.withColumn("z_score", measures.z_score(i, "jnl_avg_coauthor_inside", "jnl_stdev_coauthor_inside"))


# -- publication lag


@model(kind="table", schema="elsevier")
def article_metadata_input(run: Run) -> DataFrame:
    j = sinks.numbered(run.source("elsevier", "journals").select("href", "title"), "id", "title", "href")
    return j.select("id", "href", "title", F.lit("TODO").alias("status"))


def _authors_and_dates(run: Run) -> DataFrame:
    ids = ["$_id", "$_journal"]
    a = stats.pivot_least(run.source("elsevier", "authors"), [f"`{k}`" for k in ids] + ["article_author_id"], "property", "value", {"given_name": "given-name", "surname": "surname"})
    a = a.select(*map(_q, ids), "article_author_id", F.concat("given_name", F.lit(" "), "surname").alias("author_name"))
    d = run.source("elsevier", "dates")
    day = {"date_received": "Received", "date_available_online": "Available online", "date_accepted": "Accepted", "date_publication": "Publication date"}
    d = d.groupBy(*map(_q, ids)).agg(measures.count_where(F.col("type") == "Revised").alias("cnt_revised"), *[measures.least_where(text.free_date("value"), F.col("type") == v).alias(k) for k, v in day.items()])
    d = d.withColumn("publication_lag", F.datediff("date_accepted", "date_received"))
    return a.alias("a").join(d.alias("d"), (F.col("a.`$_id`") == F.col("d.`$_id`")) & (F.col("a.`$_journal`") == F.col("d.`$_journal`")), "left")


@model(kind="table", schema="elsevier_analysis", tags=("acm",))
def analysis_set_raw(run: Run) -> DataFrame:
    out = _authors_and_dates(run)
    return out.select(F.col("a.`$_id`").alias("id"), "author_name", F.col("d.`$_journal`").alias("journal"), F.year("date_publication").alias("year_pub"), "publication_lag")


@model("stg_dblp_person", "stg_dblp_article_person", "stg_dblp_article", kind="table", schema="elsevier_analysis", tags=("acm",))
def analysis_set(run: Run) -> DataFrame:
    e = _authors_and_dates(run).groupBy("author_name", F.col("d.`$_journal`").alias("$_journal"), F.year("date_publication").alias("year_pub")).agg(F.avg("publication_lag").alias("avg_pulication_lag"))
    key = "dblp_object_key"
    d = run.ref("stg_dblp_person").join(run.ref("stg_dblp_article_person"), "dblp_unique_person_key").where(text.first_group(key, r"(\w+)/") == "journals").join(run.ref("stg_dblp_article").select(key, "dblp_year"), key, "left")
    d = d.groupBy("dblp_name", "dblp_unique_person_key", "dblp_year").agg(F.count("*").alias("cnt_journal_publications"), F.count_distinct(text.first_group(key, r"/(\w+)/")).alias("cnt_distinct_venues"))
    out = e.join(d, (F.col("year_pub") == F.col("dblp_year")) & (F.col("author_name") == F.col("dblp_name")), "left")
    return out.select(*map(_q, e.columns), "dblp_unique_person_key", "cnt_journal_publications", "cnt_distinct_venues")


# -- the retired layer: typed joins, links and DOIs of several kinds, hubs and links

_CLEAN = {"schema": "dblp_clean", "tags": ("retired",)}


def _typed(run: Run, kind: str, children: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """Publications of a kind with child values, matched by type and number."""
    out = run.source("dblp", kind).withColumnRenamed("key", "dblp_key")
    for child, values in children.items():
        c = run.source("dblp", child).select(_q("$_parent_object_type").alias("_t"), _q("$_parent_object_id").alias("_i"), *[F.col(v).alias(n) for n, v in (x.split("=") if "=" in x else (x, x) for x in values)])
        out = out.join(c, (_q("$_object_type") == F.col("_t")) & (_q("$_object_id") == F.col("_i")), "left").drop("_t", "_i")
    return out.select(*map(_q, ["$_object_id", "$_object_type", "dblp_key", *columns]))


@model(**_CLEAN)
def article(run: Run) -> DataFrame:
    values = ["title", "year", "journal", "volume", "pages", "number"]
    return _typed(run, "article", {v: [v] for v in values}, ["publtype", *values])


@model(**_CLEAN)
def inproceedings(run: Run) -> DataFrame:
    return _typed(run, "inproceedings", {"title": ["title"], "booktitle": ["booktitle"], "url": ["url_type=type", "url"], "year": ["year"], "pages": ["pages"]}, ["title", "booktitle", "url_type", "url", "year", "pages"])


@model(**_CLEAN)
def incollection(run: Run) -> DataFrame:
    return _typed(run, "incollection", {"title": ["title"], "booktitle": ["booktitle"], "url": ["url_type=type", "url"], "year": ["year"], "pages": ["pages"], "crossref": ["crossref"]}, ["title", "booktitle", "url_type", "url", "year", "pages", "crossref"])


@model("article", "incollection", "inproceedings", **_CLEAN)
def publication(run: Run) -> DataFrame:
    cols = ["$_object_id", "$_object_type", "dblp_key", "publtype", "title", "booktitle", "year", "journal", "volume", "pages", "number"]
    out = sinks.union_by_name(run.ref("article"), run.ref("incollection").drop("url_type", "url", "crossref"), run.ref("inproceedings").drop("url_type", "url"))
    return out.select(*map(_q, cols))


@model(**_CLEAN)
def ee_clean(run: Run) -> DataFrame:
    e = run.source("dblp", "ee")
    cols = ["$_valid_on", "$_object_type", "$_object_id", "$_parent_object_id", "$_parent_object_type", "ee"]
    return e.select(*map(_q, cols), classify.link_class("ee").alias("ee_type"))


@model(schema="arxiv_clean", tags=("retired",))
def document(run: Run) -> DataFrame:
    d = run.source("arxiv", "document")
    return d.withColumns({c: text.blank_to_null(c, "None") for c in ("journal_ref", "doi")})


@model("ee_clean", "document", **_CLEAN)
def doi(run: Run) -> DataFrame:
    """DOIs of links: read from the link, or looked up in what other sites know of it."""
    e = run.ref("ee_clean")
    cols = [*map(_q, ["$_valid_on", "$_object_type", "$_object_id", "$_parent_object_id", "$_parent_object_type"]), F.col("ee").alias("doi_link")]
    read = e.where(F.col("ee_type").isin(list(classify.DOI_PREFIXES))).select(*cols, classify.doi_in_link("ee", "ee_type").alias("doi"))

    def looked_up(kind: str, known: DataFrame, on: Column) -> DataFrame:
        return e.where(F.col("ee_type") == kind).join(known, on).where("found IS NOT NULL").select(*cols, F.col("found").alias("doi"))

    arxiv = run.ref("document").where(_q("$_api_status") == "SUCCEEDED").select(_q("$_dblp_ee").alias("known"), F.col("doi").alias("found"))
    wiki = run.source("wikidata", "document").select(F.col("url").alias("known"), F.col("doi").alias("found"))
    ieee = run.source("ieee_explore", "document").select(_q("$_dblp_document_id").alias("known"), F.col("doi").alias("found"))
    out = read.unionAll(looked_up("arxiv", arxiv, F.col("ee") == F.col("known"))).unionAll(looked_up("wikidata", wiki, F.col("ee") == F.col("known")))
    return out.unionAll(looked_up("ieee_explore", ieee, _q("$_parent_object_id") == F.col("known"))).distinct()


_VAULT = {"kind": "table", "schema": "integration", "tags": ("retired", "dblp")}


def _projected(name: str, source: str, columns: list[str], constants: dict[str, str] | None = None, distinct: bool = True, where: str | None = None):
    """A hub, satellite or entity: columns of a staged table, with constants, each row once."""

    def build(run: Run) -> DataFrame:
        d = run.source("staging", source)
        d = d.where(where) if where else d
        d = d.select(*[F.lit(v).alias(k) for k, v in (constants or {}).items()], *map(_q, columns))
        return d.distinct() if distinct else d

    build.__name__ = name
    model(**_VAULT)(build)


_projected("article_h", "stg_article", ["article_hash_key", "article_business_key"])
_projected("article_s_dblp", "stg_article", ["article_hash_key", "publtype", "title", "year", "journal", "volume", "pages", "number"], {"rec_src": "dblp"}, distinct=False)
_projected("article_s_dblp_doi", "stg_article_doi", ["article_hash_key", "doi_link", "doi_type", "doi"], {"rec_src": "dblp"})
_projected("person_h", "stg_person", ["person_business_key", "person_hash_key"])
_projected("person_s_dblp_name", "stg_person", ["person_hash_key", "name"], {"rec_src": "dblp_dump"})
_projected("person_s_dblp_orc", "stg_person", ["person_hash_key", "orcid"], {"rec_src": "dblp_dump"}, where="orcid IS NOT NULL")


@model(**_VAULT)
def lnk_article_person(run: Run) -> DataFrame:
    e = run.source("staging", "stg_article_person").select("article_hash_key", "person_hash_key").distinct()
    return e.select(F.md5(text.concat_skipping_nulls("article_hash_key", "person_hash_key")).alias("lnk_hash_key"), "article_hash_key", "person_hash_key")


@model(**_VAULT)
def paper(run: Run) -> DataFrame:
    return run.source("springer_lncs", "bus_chapter").select(F.col("surrogate_id").alias("integration_id"), "title", "doi", F.col("surrogate_id").alias("springer_lncs_surrogate_id"))


@model("bus_book", **_VAULT)
def proceeding(run: Run) -> DataFrame:
    kept = ["book_title", "book_subtitle", "doi", "ebook_isbn", "ebook_packages", "edition_number", "front_matter_url", "publisher_name", "series_e-issn", "series_issn", "series_title", "softcover_isbn", "hardcover_isbn"]
    return run.ref("bus_book").select(F.col("surrogate_id").alias("integration_id"), *map(_q, kept), F.col("surrogate_id").alias("springer_lncs_surrogate_id"))


@model(**_VAULT)
def person(run: Run) -> DataFrame:
    a = run.source("springer_lncs", "bus_author").select("name", F.col("surrogate_id").alias("springer_lncs_surrogate_id"))
    m = run.source("lncs_front_matter", "bus_member").select("name", F.col("surrogate_id").alias("lncs_front_matter_surrogate_id"))
    both = matching.merged(a, m, "name", [])
    return both.select(F.coalesce("springer_lncs_surrogate_id", "lncs_front_matter_surrogate_id").alias("integration_id"), "name", "springer_lncs_surrogate_id", "lncs_front_matter_surrogate_id").distinct()


@model(**_VAULT)
def lnk_paper_proceeding(run: Run) -> DataFrame:
    b = run.source("springer_lncs", "book").select(_q("$_book_url").alias("book"), _doi_hash().alias("b"))
    c = run.source("springer_lncs", "chapter").select(_q("$_book_url").alias("book"), _doi_hash().alias("c"))
    out = b.join(c, "book", "left")
    return out.select(F.col("b").alias("springer_lncs_book_surrogate_id"), F.col("c").alias("springer_lncs_paper_surrogate_id"), F.col("c").alias("paper_integration_id"), F.col("b").alias("proceeding_integration_id"))


@model("paper", "person", **_VAULT)
def lnk_paper_person(run: Run) -> DataFrame:
    e = run.source("springer_lncs", "bus_author_chapter").select(_q("$_paper_url").alias("url"), "author_surrogate_id")
    c = run.source("springer_lncs", "chapter").select(_q("$_paper_url").alias("url"), _doi_hash().alias("paper_key"))
    p = run.ref("paper").select(F.col("springer_lncs_surrogate_id").alias("paper_key"), F.col("integration_id").alias("paper_integration_id"))
    who = run.ref("person").select(F.col("springer_lncs_surrogate_id").alias("author_surrogate_id"), F.col("integration_id").alias("person_integration_id"))
    return e.join(c, "url", "left").join(p, "paper_key", "left").join(who, "author_surrogate_id", "left").select("paper_integration_id", "person_integration_id")


# -- reports


@model("stg_lncs_fm_member_book", tags=("report",))
def z_score_members(run: Run) -> DataFrame:
    """Members who wrote in their book far more than its members do: ratio above 3."""
    out = _book_outliers(_written_in_book(run), "cnt_articles_written_in_book").where("cnt_articles_written_in_book > 0 AND ratio > 3")
    return out.select("dblp_key", F.col("n").alias("p_members"), F.col("least").alias("x_min"), F.col("deviation").alias("x_stddev"), F.col("most").alias("x_max"), F.col("mean").alias("x_avg"), "median", "member_name", "cnt_articles_written_in_book", "mad", "ratio")


@model("stg_lncs_fm_member_book", "lncs_citation_authors", tags=("report",))
def members_cited(run: Run) -> DataFrame:
    """The fifty members with the largest ratio of citations in their book."""
    out = _book_outliers(_cited_in_book(run), "cnt_author_cited_in_book").select("dblp_key", "median", "member_name", "cnt_author_cited_in_book", "mad", "ratio")
    return stats.top(out, 50, F.col("ratio").desc_nulls_last(), F.col("dblp_key").asc(), F.col("member_name").asc())


@model(tags=("report",))
def clean_name(run: Run) -> DataFrame:
    """A thousand authors by name, with names of plain letters."""
    a = run.source("springer_lncs", "bus_author")
    return stats.top(a.select("surrogate_id", "orc", "email", "name", text.letters_and_spaces(text.unaccented("name")).alias("clean_name")), 1000, F.col("name").asc_nulls_last(), F.col("surrogate_id").asc())


@model("publication", "doi", tags=("report",))
def unmatched_titles(run: Run) -> DataFrame:
    """Publications before 2020 that another collection has neither by DOI nor by title, counted by title, kind and year."""
    p = run.ref("publication").where(F.col("year").cast("int") < 2020)
    d = run.ref("doi").select(_q("$_parent_object_id").alias("i"), F.col("doi").alias("p_doi"))
    left = p.join(d, _q("$_object_id") == F.col("i"), "left").withColumn("id", _q("$_object_id"))
    right = run.source("aminer", "paper").select("id", F.col("doi").alias("a_doi"), F.col("title").alias("a_title")).withColumnRenamed("id", "a_id")
    bare = lambda c: F.replace(F.col(c), F.lit("."), F.lit(""))
    _, rest = matching.cascade(left, right, "id", "a_id", [(F.col("p_doi"), F.col("a_doi")), (bare("title"), bare("a_title"))])
    rest = rest.dropDuplicates(["id"])
    return rest.groupBy("title", _q("$_object_type"), "year").agg(F.count("*").alias("cnt"))


def _without_doi(run: Run) -> DataFrame:
    e = run.ref("ee_clean").where(_q("$_parent_object_type").isin("article", "incollection", "inproceedings"))
    return tables.not_in(e, _q("$_parent_object_id"), run.ref("doi").select(_q("$_parent_object_id").alias("_known")))


@model("ee_clean", "doi", tags=("report",))
def doi_completeness(run: Run) -> DataFrame:
    """Kinds of links of publications without a DOI."""
    return _without_doi(run).groupBy("ee_type").agg(F.count("*").alias("cnt"))


@model("ee_clean", "doi", tags=("report",))
def hosts_without_doi(run: Run) -> DataFrame:
    """Hosts of links of no known kind, of publications without a DOI."""
    e = _without_doi(run).where(F.col("ee_type") == "unknown").where(~F.col("ee").like("db/%") & ~F.col("ee").like("ftp://%") & ~F.col("ee").like("%.pdf"))
    return e.groupBy(text.host_of("ee").alias("x")).agg(F.count("*").alias("cnt"))


@model("validation", tags=("report",))
def file_outcomes(run: Run) -> DataFrame:
    """Share of files by outcome and reason."""
    each = run.ref("validation").groupBy("file_id").agg(F.min("file_pass").alias("ok"), F.array_join(F.array_sort(F.collect_list("message")), "|").alias("m"))
    message = F.when(F.col("ok") == 1, "OK").when(F.col("m").isin("null", ""), "Unknown").when(F.col("m").like("%organisation%"), F.col("m")).otherwise("Internal error")
    return stats.shares(each, F.when(F.col("ok") == 0, "FAIL").otherwise("PASS").alias("status"), message.alias("message")).withColumnRenamed("n", "file_count")


@model("validation", tags=("report",))
def files_of_interest(run: Run) -> DataFrame:
    """Share of files that pass by whether they have a section of interest."""
    each = run.ref("validation").where("file_pass = 1").groupBy("file_id").agg(F.max("section_interested").alias("ind_interested"))
    return stats.shares(each, "ind_interested").withColumnRenamed("n", "file_count")
