"""Each model of the catalogue as a query: landed tables are made of the driver's whole tables, and the model runs on them.

A landed table is one SQL text in the dialect that Spark and DuckDB share, so that both sides start from equal rows. What is
expected of a model is SQL of its own, written over landed tables (schema__table) and the models that it needs. Orders are
publications (by status articles, papers or chapters of collections), line items their authors, suppliers persons, parts books.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import broadcast_few
from ..sources import tables
from . import queries
from .catalogue import BOOK, EDITOR_ROLES, RANKING_SITE, RANKS, SERIES, registry

DRIVER = ("nation", "region", "supplier", "customer", "part", "orders", "lineitem")
KINDS = {"article": ("F", "journals"), "inproceedings": ("O", "conf"), "incollection": ("P", "books")}


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


_KEY = "CASE o_orderstatus WHEN 'F' THEN 'journals' WHEN 'O' THEN 'conf' ELSE 'books' END || '/j' || substring(o_orderpriority, 1, 1) || '/' || o_orderkey"
_KIND = "CASE o_orderstatus WHEN 'F' THEN 'article' WHEN 'O' THEN 'inproceedings' ELSE 'incollection' END"
_DAY = _text("CAST(o_orderdate AS DATE)")
_PUBTYPE = "CASE WHEN o_totalprice > 150000 THEN 'survey' ELSE '' END"


def _of_orders(value: str, where: str = "", kind: str = "'article'", number: str = "'1'") -> str:
    """A child element of orders; value is its columns."""
    return f"""SELECT {number} AS "$_object_id", {_text("o_orderkey")} AS "$_parent_object_id", {kind} AS "$_parent_object_type", {value} FROM {{orders}} {where}"""


_MONTH, _YEAR = _text("month(o_orderdate)"), _text("year(o_orderdate)")
_PAGES = "CASE WHEN o_totalprice > 100000 THEN '1-' || o_custkey ELSE '' END AS pages"
_AUTHOR = """SELECT {n} AS "$_object_id", {p} AS "$_parent_object_id", {t} AS "$_parent_object_type", {a} AS author, {o} AS orcid, '' AS bibtex, '' AS aux FROM {{{s}}}"""
_HOME = {"p": _text("-1 - s_suppkey"), "t": "'www'", "o": "''", "s": "supplier"}
_LINK = (
    "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'https://doi.org/10.1/' || o_orderkey WHEN '2' THEN 'http://arxiv.org/abs/' || o_orderkey "
    "WHEN '3' THEN 'https://www.wikidata.org/Q' || o_orderkey WHEN '4' THEN 'http://ieeexplore.ieee.org/' || o_orderkey ELSE 'http://h' || month(o_orderdate) || '.org/p/' || o_orderkey END"
)
_BOOK_KEY = "'conf/' || p_brand || '/' || p_partkey"
_BOOK_VALUES = {"$_book_url": "'https://books/' || p_partkey", "$_dblp_key": _BOOK_KEY, "$_extract_dts": "'2020-01-01'", "doi": "'https://doi.org/10.9/b' || p_partkey", "book_title": "p_name", "number_of_pages": _text("p_size")}
_PAPER, _WRITER = "'https://papers/' || l_orderkey || '-' || l_linenumber", "'Author ' || l_suppkey"
_CHAPTER_DOI = "'https://doi.org/10.9/c' || l_orderkey || '-' || l_linenumber || CASE WHEN l_returnflag = 'R' THEN ' ' ELSE '' END"
_SEED = ", ".join(f"('{a}', 'j{p[0]}')" for a, p in queries.ABBREVIATIONS)

#: Landed tables by schema and name, in SQL that Spark and DuckDB read alike.
LANDED = {
    **{f"dblp_dump__{k}": f"""SELECT {_text("o_orderkey")} AS "$_object_id", {_DAY} AS mdate, {_KEY} AS key, {_PUBTYPE} AS publtype FROM {{orders}} WHERE o_orderstatus = '{s}'""" for k, (s, _) in KINDS.items()},
    "dblp_dump__www": f"""SELECT {_text("-1 - s_suppkey")} AS "$_object_id", '2020-01-01' AS mdate, 'homepages/' || s_suppkey AS key, '' AS publtype FROM {{supplier}} WHERE s_acctbal >= 0""",
    "dblp_dump__author": " UNION ALL ".join([
        _AUTHOR.format(n=_text("l_linenumber"), p=_text("l_orderkey"), t="'article'", a=_WRITER, o="CASE WHEN l_returnflag = 'R' THEN 'o-' || l_suppkey ELSE '' END", s="lineitem"),
        _AUTHOR.format(n="'1'", a="'Author ' || s_suppkey", **_HOME) + " WHERE s_acctbal >= 0",
        _AUTHOR.format(n="'2'", a="'Alias ' || s_suppkey", **_HOME) + " WHERE s_acctbal >= 0",
    ]),
    "dblp_dump__title": _of_orders("'Title ' || o_custkey AS title, '' AS bibtex"),
    "dblp_dump__year": _of_orders(f"{_YEAR} AS year"),
    "dblp_dump__journal": _of_orders("o_orderpriority AS journal", "WHERE o_orderstatus = 'F'"),
    "dblp_dump__volume": _of_orders(f"{_MONTH} AS volume"),
    "dblp_dump__pages": _of_orders(_PAGES),
    "dblp_dump__number": _of_orders(f"{_text('day(o_orderdate)')} AS number", "WHERE o_orderstatus = 'F'"),
    "dblp_dump__ee": _of_orders("CASE WHEN o_orderstatus = 'P' THEN 'https://dx.org/' ELSE 'https://doi.org/10.1/' END || o_orderkey AS ee") + " UNION ALL " + _of_orders("'http://site.org/' || o_orderkey AS ee", number="'2'"),
    "acm__editorial_boards": """SELECT 'U' || s_nationkey AS affiliation, n_name AS country, r_name AS journal, 'Author ' || s_suppkey AS name, CASE WHEN s_acctbal < 1000 THEN 'Staff' WHEN s_acctbal < 5000 THEN 'Editor-in-Chief' ELSE 'Associate Editors' END AS role
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "acm__journal_dblp": f"SELECT * FROM (VALUES {_SEED}) AS seed(acm_journal, dblp_abbreviation)",
    "core__conf_ranks": f"""SELECT p_name AS "Title", p_brand AS "Acronym", CASE WHEN p_size < 10 THEN 'A*' WHEN p_size < 20 THEN 'A' WHEN p_size < 30 THEN 'B' ELSE 'C' END AS "Rank", CASE WHEN p_retailprice > 905 THEN '{RANKING_SITE}conf/' || p_partkey ELSE 'none' END AS "DBLP" FROM {{part}}""",
    "core__jnl_ranks": f"""SELECT p_name AS "Title", CASE WHEN p_size < 15 THEN 'A*' WHEN p_size < 35 THEN 'A' ELSE 'C' END AS "Rank", CASE WHEN p_retailprice > 905 THEN '{RANKING_SITE}journals/' || p_partkey END AS "DBLP" FROM {{part}}""",
    "core__manual_dblp_url": f"""SELECT p_name AS title, p_brand AS acronym, '{RANKING_SITE}conf/m' || min(p_partkey) || '/index.html' AS dblp_url FROM {{part}} GROUP BY p_name, p_brand""",
    "dblp_api__document": f"""SELECT CASE WHEN p_size < 10 THEN '{SERIES}' ELSE p_type END AS info_venue, CASE WHEN p_size = 20 THEN '{SERIES}' END AS info_venue_0, CASE WHEN p_size = 30 THEN '{SERIES}' END AS info_venue_1, CASE WHEN p_retailprice > 905 THEN 'https://doi.org/10.9/b' || p_partkey END AS info_ee, {_BOOK_KEY} AS info_key FROM {{part}}""",
    "dblp_api__manual_dblp_api_document": "SELECT CASE WHEN s_acctbal > 0 THEN 'LNCS' ELSE 'other' END AS type, 'conf/s/' || s_suppkey AS dblp_key, 'https://s/' || s_nationkey AS url FROM {supplier}",
    "springer_lncs__book": "SELECT " + ", ".join(f'{_BOOK_VALUES.get(c, "p_type")} AS "{c}"' for c in BOOK) + " FROM {part}",
    "springer_lncs__chapter": f"""SELECT 'https://books/' || p_partkey AS "$_book_url", {_PAPER} AS "$_paper_url", {_BOOK_KEY} AS "$_dblp_key", {_CHAPTER_DOI} AS doi, 'Chapter ' || l_partkey AS title, 'o' || l_linenumber AS online_isbn, 'p' || l_linenumber AS print_isbn,
        p_brand AS publisher_name, {_text("CAST(l_shipdate AS DATE)")} AS first_online, l_linestatus AS revised FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "springer_lncs__author": f"""SELECT {_PAPER} AS "$_paper_url", {_text("l_suppkey")} AS doc_person_id, {_WRITER} AS name, CASE WHEN s_acctbal > 1000 THEN 'A' || s_nationkey || '@x' END AS email, CASE WHEN s_acctbal > 5000 THEN 'https://orcid.org/' || s_suppkey END AS orc
        FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "springer_lncs__manual_author": "SELECT 's' AS rec_src, 'AUTHOR ' || s_suppkey AS name, CAST(NULL AS STRING) AS email, 'http://orcid.org/m' || s_suppkey AS orc FROM {supplier} WHERE s_acctbal < -500",
    "opencitations_dump__reference": "SELECT '10.9/c' || l_orderkey || '-' || l_linenumber AS citing, ' 10.1/' || l_partkey AS cited FROM {lineitem}",
    "lncs_front_matter__file": "SELECT r.run_id, p_partkey AS id, 'conf_' || p_brand || '_' || p_partkey || '.pdf' AS filename, CASE WHEN p_size > 45 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN p_size > 48 THEN 'No organisation position found' WHEN p_size > 45 THEN 'null' ELSE '' END AS message FROM {part} CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) AS r(run_id)",
    "lncs_front_matter__section": "SELECT CAST(2 AS BIGINT) AS run_id, p_partkey AS id, p_partkey AS file_id, 'Two_Name_Affiliation' AS parser, CAST(count(DISTINCT l_suppkey) + CASE WHEN min(p_size) > 40 THEN 1 ELSE 0 END AS INT) AS num_section_lines_non_empty, 0 AS num_merged_lines FROM {part} JOIN {lineitem} ON p_partkey = l_partkey GROUP BY p_partkey",
    "lncs_front_matter__member": "SELECT DISTINCT CAST(2 AS BIGINT) AS run_id, l_suppkey AS id, l_partkey AS section_id, CASE WHEN p_size > 30 THEN 'Steering Committee' ELSE 'Program Committee' END AS role, ' Author' AS firstname, " + _text("l_suppkey") + " AS lastname, 'x' AS name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "elsevier__journals": "SELECT '/c' || c_custkey AS href, c_mktsegment AS title, '1' AS issn FROM {customer}",
    "elsevier__authors": " UNION ALL ".join(f"""SELECT 'a' || o_orderkey AS "$_id", o_orderpriority AS "$_journal", '1' AS article_author_id, '{p}' AS property, {v} AS value FROM {{orders}}""" for p, v in (("given-name", "CASE WHEN o_orderstatus <> 'P' THEN 'Author' END"), ("surname", _text("o_custkey")))),
    "elsevier__dates": """SELECT 'a' || l_orderkey AS "$_id", o_orderpriority AS "$_journal", CASE l_linenumber WHEN 1 THEN 'Received' WHEN 2 THEN 'Revised' WHEN 3 THEN 'Accepted' WHEN 4 THEN 'Available online' ELSE 'Publication date' END AS type,
        CASE WHEN l_linenumber = 2 THEN 'later' ELSE """ + _text("CAST(l_shipdate AS DATE)") + " END AS value FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    # the retired layer
    **{f"dblp__{k}": f"""SELECT '{k}' AS "$_object_type", {_text("o_orderkey")} AS "$_object_id", {_KEY} AS key, {_PUBTYPE} AS publtype FROM {{orders}} WHERE o_orderstatus = '{s}'""" for k, (s, _) in KINDS.items()},
    **{
        f"dblp__{c}": _of_orders(f"{v} AS {c}", kind=_KIND)
        for c, v in {"title": "'Title ' || o_custkey || '.'", "year": _YEAR, "journal": "o_orderpriority", "volume": _MONTH, "pages": "'1-' || o_custkey", "number": "substring(o_orderpriority, 1, 1)", "booktitle": "'Book ' || o_custkey", "crossref": "'c/' || o_custkey"}.items()
    },
    "dblp__url": _of_orders("'db/' || o_custkey AS url, CASE WHEN o_totalprice > 100000 THEN 'archive' END AS type", kind=_KIND),
    "dblp__ee": f"""SELECT {_DAY} AS "$_valid_on", 'ee' AS "$_object_type", '1' AS "$_object_id", {_text("o_orderkey")} AS "$_parent_object_id", {_KIND} AS "$_parent_object_type", {_LINK} AS ee FROM {{orders}}""",
    "arxiv__document": f"""SELECT {_LINK} AS "$_dblp_ee", CASE WHEN o_totalprice > 100000 THEN '10.2/' || o_orderkey ELSE 'None' END AS doi, 'None' AS journal_ref, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCEEDED' END AS "$_api_status" FROM {{orders}} WHERE o_orderpriority LIKE '2%'""",
    "wikidata__document": "SELECT 'https://www.wikidata.org/Q' || c_custkey AS url, CASE WHEN c_acctbal > 0 THEN '10.3/' || c_custkey END AS doi FROM {customer}",
    "ieee_explore__document": f"""SELECT {_text("p_partkey")} AS "$_dblp_document_id", '10.4/' || p_partkey AS doi FROM {{part}}""",
    "aminer__paper": "SELECT 'x' || c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN '10.1/' || c_custkey END AS doi, CASE WHEN c_acctbal < 2000 THEN 'Title ' || c_custkey ELSE 'Other' END AS title FROM {customer}",
    "staging__stg_article": f"SELECT md5({_KEY}) AS article_hash_key, {_KEY} AS article_business_key, {_PUBTYPE} AS publtype, 'Title ' || o_custkey AS title, year(o_orderdate) AS year, o_orderpriority AS journal, {_MONTH} AS volume, '1-2' AS pages, 'n' AS number FROM {{orders}}",
    "staging__stg_article_doi": f"SELECT md5({_KEY}) AS article_hash_key, {_LINK} AS doi_link, o_orderpriority AS doi_type, '10.1/' || o_custkey AS doi FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey",
    "staging__stg_person": "SELECT 'p' || l_suppkey AS person_business_key, md5('p' || l_suppkey) AS person_hash_key, 'Name ' || l_suppkey || l_linestatus AS name, CASE WHEN l_returnflag = 'R' THEN 'o-' || l_suppkey END AS orcid FROM {lineitem}",
    "staging__stg_article_person": "SELECT md5('a' || l_orderkey) AS article_hash_key, CASE WHEN l_discount < 0.09 THEN md5('p' || l_suppkey) END AS person_hash_key FROM {lineitem}",
    "springer_lncs__bus_author": "SELECT md5('Author ' || s_suppkey) AS surrogate_id, 'o' || s_suppkey AS orc, 'e' || s_suppkey AS email, 'Author ' || s_suppkey AS name FROM {supplier}",
    "springer_lncs__bus_chapter": f"SELECT md5(replace({_CHAPTER_DOI}, 'https://doi.org/', '')) AS surrogate_id, 'Chapter ' || l_partkey AS title, '10.9' AS doi FROM {{lineitem}}",
    "springer_lncs__bus_author_chapter": f"""SELECT {_PAPER} AS "$_paper_url", md5({_WRITER}) AS author_surrogate_id FROM {{lineitem}}""",
    "lncs_front_matter__bus_member": "SELECT md5('m' || c_custkey) AS surrogate_id, 'Author ' || c_custkey AS name FROM {customer}",
}


def sources(spark: SparkSession, d: str):
    """Landed tables over the driver's, by schema and name."""
    at = {t: tables.table(spark, d, t) for t in DRIVER}

    def source(schema: str, name: str) -> DataFrame:
        sql = LANDED[f"{schema}__{name}"]
        given = {t: at[t] for t in DRIVER if f"{{{t}}}" in sql}
        if "JOIN {supplier}" in sql:  # persons, which are few beside what they wrote
            given["supplier"] = broadcast_few(at["supplier"])
        return spark.sql(sql.replace('"', "`"), **given)

    return source


def _child_sql(source: str, cast: str = "", more: str = "") -> str:
    value = f"CAST(nullif({source}, '') AS {cast})" if cast else f"nullif({source}, '')"
    return f"""SELECT CAST("$_object_id" AS INT) AS id, CAST("$_parent_object_id" AS INT) AS parent_id, "$_parent_object_type" AS parent_type, {value} AS {source}{more} FROM dblp_dump__{source}"""


_ROLES = ", ".join(f"'{r}'" for r in EDITOR_ROLES)
_RANKS = ", ".join(f"'{r}'" for r in RANKS)
_OTHERS = "FROM acm_analysis_set WHERE ind_editor_is_author = 0"
_N = {"authors": "count(DISTINCT author_dblp_person_key)", "articles": "count(DISTINCT article_dblp_object_key)"}
_IN, _OUT = "FILTER (WHERE ind_article_in_journal = 1)", "FILTER (WHERE ind_article_in_journal = 0)"
_WROTE = """SELECT dblp_key, member_name, count(author_name) AS x FROM (
    SELECT m.*, w.author_name, max(book_key) OVER (PARTITION BY book_filename) AS dblp_key FROM stg_lncs_fm_member_book m LEFT JOIN (
        SELECT b."$_dblp_key" AS book_key, replace(b."$_dblp_key", '/', '_') || '.pdf' AS file, a.name AS author_name FROM springer_lncs__book b JOIN springer_lncs__chapter c ON b."$_book_url" = c."$_book_url" JOIN springer_lncs__author a ON c."$_paper_url" = a."$_paper_url"
    ) w ON member_name = author_name AND book_filename = file) GROUP BY ALL"""
_CITED = """SELECT m.dblp_key, member_name, coalesce(n, 0) AS x FROM (SELECT DISTINCT replace(replace(book_filename, '_', '/'), '.pdf', '') AS dblp_key, member_name FROM stg_lncs_fm_member_book) m
    LEFT JOIN (SELECT from_dblp_key, to_author_name, count(*) AS n FROM lncs_citation_authors GROUP BY ALL) c ON m.dblp_key = from_dblp_key AND member_name = to_author_name"""


def _mad_sql(counts: str, columns: str) -> str:
    return f"""WITH c AS ({counts}), g AS (SELECT dblp_key, count(*) AS n, min(x) AS least, max(x) AS most, avg(x) AS mean, stddev_samp(x) AS deviation, median(x) AS middle FROM c GROUP BY dblp_key),
        a AS (SELECT dblp_key, median(abs(middle - x)) AS mad FROM c JOIN g USING (dblp_key) GROUP BY dblp_key)
        SELECT {columns} FROM (SELECT *, round(abs(x - mad) / CASE WHEN mad = 0 THEN 1 ELSE mad END, 6) AS ratio FROM c JOIN g USING (dblp_key) JOIN a USING (dblp_key))"""


def _typed_sql(kind: str, children: list[str], columns: str) -> str:
    joins = " ".join(f"""LEFT JOIN dblp__{c} ON x."$_object_type" = dblp__{c}."$_parent_object_type" AND x."$_object_id" = dblp__{c}."$_parent_object_id\"""" for c in children)
    return f"""SELECT x."$_object_id", x."$_object_type", x.key AS dblp_key, {columns} FROM dblp__{kind} x {joins}"""


_EE_COLUMNS = '"$_valid_on", "$_object_type", "$_object_id", "$_parent_object_id", "$_parent_object_type"'
_DATES = """(SELECT "$_id", "$_journal", article_author_id, min(value) FILTER (WHERE property = 'given-name') || ' ' || min(value) FILTER (WHERE property = 'surname') AS author_name FROM elsevier__authors GROUP BY ALL) a
    LEFT JOIN (SELECT "$_id", "$_journal", date_diff('day', min(TRY_CAST(value AS DATE)) FILTER (WHERE type = 'Received'), min(TRY_CAST(value AS DATE)) FILTER (WHERE type = 'Accepted')) AS lag, year(min(TRY_CAST(value AS DATE)) FILTER (WHERE type = 'Publication date')) AS year_pub FROM elsevier__dates GROUP BY ALL) d
    ON a."$_id" = d."$_id" AND a."$_journal" = d."$_journal\""""
_VAULT_ARTICLE = "article_hash_key, publtype, title, year, journal, volume, pages, number"

#: What each model gives, over landed tables and the models that it needs.
MODEL_SQL = {
    **{f"lan_{k}": f"""SELECT CAST("$_object_id" AS INT) AS id, CAST(mdate AS DATE) AS mdate, key AS dblp_key, nullif(publtype, '') AS publtype FROM dblp_dump__{k}""" for k in (*KINDS, "www")},
    "lan_title": _child_sql("title", more=", nullif(bibtex, '') AS bibtex"),
    "lan_year": _child_sql("year", "SMALLINT"),
    **{f"lan_{c}": _child_sql(c) for c in ("journal", "volume", "pages", "number")},
    "lan_author": """SELECT DISTINCT CAST("$_object_id" AS INT) AS id, CAST("$_parent_object_id" AS INT) AS parent_id, "$_parent_object_type" AS parent_type, nullif(author, '') AS author_name, nullif(orcid, '') AS orcid, nullif(bibtex, '') AS bibtex, nullif(aux, '') AS aux FROM dblp_dump__author""",
    "lan_ee": """SELECT CAST("$_object_id" AS INT) AS id, CAST("$_parent_object_id" AS INT) AS parent_id, "$_parent_object_type" AS parent_type, ee AS doi_link, replace(ee, 'https://doi.org/', '') AS doi FROM dblp_dump__ee WHERE ee LIKE 'https://doi.org%'""",
    "cte_scope": " UNION ALL ".join(f"SELECT id, '{k}' AS object_type, dblp_key, publtype FROM lan_{k}" for k in KINDS),
    "stg_dblp_article": "SELECT s.id AS dblp_object_id, object_type AS dblp_object_type, dblp_key AS dblp_object_key, publtype AS dblp_publtype, " + ", ".join(f"lan_{c}.{c} AS dblp_{c}" for c in ("title", "year", "journal", "volume", "pages", "number"))
    + " FROM cte_scope s " + " ".join(f"LEFT JOIN lan_{c} ON s.id = lan_{c}.parent_id" for c in ("title", "year", "journal", "volume", "pages", "number")),
    "www_cte": "SELECT author_name, dblp_key AS www_dblp_key FROM (SELECT DISTINCT parent_id, author_name FROM lan_author WHERE parent_type = 'www') LEFT JOIN lan_www ON parent_id = id",
    "stg_dblp_person": """SELECT DISTINCT author_name AS dblp_name, min(orcid) OVER (PARTITION BY k) AS dblp_orcid, k AS dblp_unique_person_key
        FROM (SELECT a.author_name, orcid, coalesce(www_dblp_key, a.author_name) AS k FROM (SELECT author_name, min(orcid) AS orcid FROM lan_author GROUP BY 1) a LEFT JOIN www_cte w ON a.author_name = w.author_name)""",
    "stg_dblp_article_person": "SELECT DISTINCT dblp_key AS dblp_object_key, dblp_unique_person_key FROM cte_scope s LEFT JOIN lan_author a ON s.id = a.parent_id LEFT JOIN stg_dblp_person p ON author_name = dblp_name",
    "stg_dblp_doi": "SELECT DISTINCT s.id AS dblp_object_id, object_type AS dblp_object_type, dblp_key AS dblp_object_key, publtype AS dblp_publtype, doi AS dblp_doi FROM cte_scope s JOIN lan_ee e ON s.id = e.parent_id WHERE doi IS NOT NULL",
    "lncs": f"SELECT info_key AS dblp_key, info_ee AS url FROM dblp_api__document WHERE '{SERIES}' IN (coalesce(info_venue, ''), coalesce(info_venue_0, ''), coalesce(info_venue_1, '')) AND info_ee IS NOT NULL UNION SELECT dblp_key, url FROM dblp_api__manual_dblp_api_document WHERE type = 'LNCS'",
    "cln_conf_ranks": f"""SELECT "Title" AS title, "Acronym" AS acronym, "Rank" AS ranking, nullif("DBLP", 'none') AS dblp_url FROM core__conf_ranks WHERE "Rank" IN ({_RANKS})""",
    "cln_jnl_ranks": f"""SELECT "Title" AS title, "Rank" AS ranking, "DBLP" AS dblp_url, replace("DBLP", '{RANKING_SITE}', '') AS dblp_key FROM core__jnl_ranks WHERE "Rank" IN ({_RANKS}) AND "DBLP" IS NOT NULL""",
    "conferences": f"SELECT c.title, c.acronym, ranking, replace(coalesce(c.dblp_url, replace(m.dblp_url, '/index.html', '')), '{RANKING_SITE}', '') AS dblp_key FROM cln_conf_ranks c LEFT JOIN core__manual_dblp_url m ON c.title = m.title AND c.acronym = m.acronym",
    "bus_book": "SELECT md5(replace(doi, 'https://doi.org/', '')) AS surrogate_id, * FROM springer_lncs__book",
    "stg_lncs_article": """SELECT b."$_book_url" AS lncs_book_url, c."$_paper_url" AS lncs_chapter_url, replace(c.doi, 'https://doi.org/', '') AS lncs_paper_doi, c.doi AS lncs_chapter_doi_link, c.online_isbn AS lncs_chapter_online_isbn, c.print_isbn AS lncs_chapter_print_isbn,
        c.publisher_name AS lncs_chapter_publisher_name, c.title AS lncs_chapter_title, c.first_online AS lncs_chapter_first_online, c.revised AS lncs_chapter_revised, b.* FROM springer_lncs__chapter c LEFT JOIN springer_lncs__book b ON c."$_book_url" = b."$_book_url\"""",
    "stg_lncs_author": """WITH core AS (SELECT DISTINCT a.name, coalesce(m.email, a.email) AS email, regexp_replace(coalesce(m.orc, a.orc), '^https?://', '') AS orc FROM springer_lncs__author a LEFT JOIN springer_lncs__manual_author m ON lower(strip_accents(a.name)) = lower(strip_accents(m.name))),
        o AS (SELECT md5(orc) AS surrogate_id, orc, email, name FROM core WHERE orc IS NOT NULL),
        e AS (SELECT coalesce(o.surrogate_id, md5(c.email)) AS surrogate_id, o.orc, c.email, coalesce(o.name, c.name) AS name FROM (SELECT * FROM core WHERE orc IS NULL AND email IS NOT NULL) c FULL JOIN o ON lower(c.email) = lower(o.email)),
        n AS (SELECT coalesce(e.surrogate_id, md5(c.name)) AS surrogate_id, e.orc, e.email, c.name FROM (SELECT * FROM core WHERE orc IS NULL AND email IS NULL) c LEFT JOIN e ON c.name = e.name)
        SELECT * FROM o UNION SELECT * FROM e UNION SELECT * FROM n""",
    "stg_lncs_author_chapter": """WITH a AS (SELECT "$_paper_url", doc_person_id, name, email, regexp_replace(orc, '^https?://', '') AS orc FROM springer_lncs__author)
        SELECT "$_paper_url", doc_person_id, k.surrogate_id AS author_surrogate_id FROM a LEFT JOIN stg_lncs_author k ON a.orc = k.orc WHERE a.orc IS NOT NULL
        UNION SELECT "$_paper_url", doc_person_id, k.surrogate_id FROM a LEFT JOIN stg_lncs_author k ON a.email = k.email WHERE a.orc IS NULL AND a.email IS NOT NULL
        UNION SELECT "$_paper_url", doc_person_id, k.surrogate_id FROM a LEFT JOIN stg_lncs_author k ON a.name = k.name WHERE a.orc IS NULL AND a.email IS NULL AND a.name IS NOT NULL""",
    "lncs_citation_authors": """SELECT c."$_dblp_key" AS from_dblp_key, citing AS from_doi, cited AS to_doi, d.dblp_object_key AS to_dblp_key, e.dblp_unique_person_key AS to_dblp_unique_person_key, dblp_name AS to_author_name
        FROM springer_lncs__chapter c LEFT JOIN opencitations_dump__reference r ON trim(replace(c.doi, 'https://doi.org/', '')) = trim(citing) LEFT JOIN stg_dblp_doi d ON trim(cited) = dblp_doi
        LEFT JOIN stg_dblp_article_person e ON d.dblp_object_key = e.dblp_object_key LEFT JOIN stg_dblp_person p ON e.dblp_unique_person_key = p.dblp_unique_person_key""",
    "validation": """WITH m AS (SELECT run_id, section_id, count(*) AS n, max(CASE WHEN role = 'Program Committee' THEN 'program committee' ELSE 'steering committee' END) AS clean_role FROM lncs_front_matter__member GROUP BY ALL),
        s AS (SELECT s.*, CASE WHEN num_section_lines_non_empty - num_merged_lines = n THEN 'PASS' ELSE 'FAIL' END AS section_pass, clean_role, coalesce(n, 0) AS num_members FROM lncs_front_matter__section s LEFT JOIN m ON s.id = m.section_id AND s.run_id = m.run_id),
        f AS (SELECT f.run_id, f.id, CASE WHEN c.n IS NULL OR status = 'FAILED' THEN 0 ELSE 1 END AS file_pass, CASE WHEN c.n IS NULL AND message IS NULL THEN 'No sections' ELSE message END AS message FROM lncs_front_matter__file f LEFT JOIN (SELECT run_id, file_id, count(*) AS n FROM s GROUP BY ALL) c ON f.id = c.file_id AND f.run_id = c.run_id)
        SELECT f.run_id, f.id AS file_id, file_pass, CASE WHEN s.id IS NOT NULL THEN CASE WHEN clean_role = 'program committee' THEN 1 ELSE 0 END END AS section_interested, section_pass, message, s.id AS section_id, clean_role, num_members FROM f LEFT JOIN s ON f.id = s.file_id AND f.run_id = s.run_id AND file_pass = 1""",
    "clean_source": """SELECT filename, CASE WHEN m.role = 'Program Committee' THEN 'program committee' ELSE 'steering committee' END AS role, trim(firstname) || ' ' || trim(lastname) AS name
        FROM lncs_front_matter__file f JOIN (SELECT DISTINCT file_id, section_id FROM validation WHERE section_interested = 1 AND section_pass = 'PASS' AND file_pass = 1) v ON f.id = v.file_id JOIN lncs_front_matter__member m ON v.section_id = m.section_id WHERE f.run_id = (SELECT max(run_id) FROM lncs_front_matter__file)""",
    "stg_lncs_fm_member_book": "SELECT DISTINCT name AS member_name, filename AS book_filename, role FROM clean_source",
    "run_performance_metrics": """WITH f AS (SELECT run_id, file_id, max(section_interested) AS w, count(*) FILTER (WHERE section_interested = 1) AS nw, count(*) FILTER (WHERE section_interested = 1 AND section_pass = 'PASS') AS ng FROM validation WHERE file_pass = 1 GROUP BY ALL),
        m AS (SELECT run_id, '# files total' AS metrics, 1 AS n FROM lncs_front_matter__file
        UNION ALL SELECT run_id, lower('# files ' || status || ' (' || CASE WHEN status = 'SUCCEEDED' THEN 'OK' WHEN message IN ('null', '') THEN 'Unknown' WHEN message LIKE '%organisation%' THEN message ELSE 'Internal error' END || ')'), 1 FROM lncs_front_matter__file
        UNION ALL SELECT run_id, CASE WHEN w = 1 THEN '# files with interesting sections' ELSE '# files without interesting sections' END, 1 FROM f
        UNION ALL SELECT run_id, CASE WHEN section_interested = 1 THEN '# sections of interest' ELSE '# sections not of interest' END, 1 FROM validation WHERE file_pass = 1
        UNION ALL SELECT run_id, CASE WHEN ng > 0 THEN '# files with interesting parseable sections' ELSE '# files with interesting non-parseable sections' END, 1 FROM f WHERE nw > 0
        UNION ALL SELECT run_id, CASE WHEN section_pass = 'PASS' THEN '# interesting parseable sections' ELSE '# interesting non-parseable sections' END, 1 FROM validation WHERE file_pass = 1 AND section_interested = 1
        UNION ALL SELECT run_id, '# members of interest extractable (' || clean_role || ')', num_members FROM validation WHERE file_pass = 1 AND section_pass = 'PASS' AND section_interested = 1 AND clean_role <> '-')
        SELECT run_id, metrics, CAST(sum(n) AS BIGINT) AS count FROM m GROUP BY ALL""",
    "analysis_lncs_members_publishing": _mad_sql(_WROTE, "dblp_key AS book_dblp_key, n AS members_in_book, member_name, x AS cnt_articles_written_in_book, mad, ratio"),
    "analysis_lncs_members_citations": _mad_sql(_CITED, "dblp_key AS book_dblp_key, middle AS median_author_cited_in_book, member_name, x AS cnt_author_cited_in_book, mad AS mad_score, ratio"),
    "analysis_lncs_members": """SELECT p.book_dblp_key, split_part(p.book_dblp_key, '/', 1) AS book_dblp_key_type, split_part(p.book_dblp_key, '/', 2) AS book_dblp_key_conf, split_part(p.book_dblp_key, '/', 3) AS book_dblp_key_period, p.member_name, md5(p.member_name) AS member_name_anom,
        cnt_articles_written_in_book AS cnt_published, p.mad AS book_publishing_mad, p.ratio AS publishing_ratio, cnt_author_cited_in_book AS cnt_cited, mad_score AS book_citations_mad, c.ratio AS citation_ration FROM analysis_lncs_members_publishing p JOIN analysis_lncs_members_citations c ON p.book_dblp_key = c.book_dblp_key AND p.member_name = c.member_name""",
    "clean_editorial_board": f"SELECT row_number() OVER (ORDER BY name, journal) AS editorial_board_id, name, journal FROM (SELECT DISTINCT name, journal FROM acm__editorial_boards WHERE role IN ({_ROLES}))",
    "board_dblp_articles": """SELECT b.affiliation AS acm_affiliation, b.country AS acm_country, b.journal AS acm_journal, b.name AS acm_name, b.role AS acm_role, p.dblp_unique_person_key, a.*
        FROM acm__editorial_boards b LEFT JOIN stg_dblp_person p ON b.name = dblp_name LEFT JOIN stg_dblp_article_person e ON p.dblp_unique_person_key = e.dblp_unique_person_key LEFT JOIN stg_dblp_article a ON e.dblp_object_key = a.dblp_object_key""",
    "acm_analysis_set": f"""SELECT b.name AS editor_name, b.journal, array_to_string(s.a, '|') AS dblp_journal_abbreviations, p.dblp_unique_person_key AS editor_dblp_person_key, e.dblp_object_key AS article_dblp_object_key, split_part(e.dblp_object_key, '/', 2) AS article_journal_abbriviation,
        o.dblp_unique_person_key AS author_dblp_person_key, dblp_year AS article_publication_year, dblp_journal AS article_journal, dblp_title AS article_title, CASE WHEN o.dblp_unique_person_key = p.dblp_unique_person_key THEN 1 ELSE 0 END AS ind_editor_is_author,
        CASE WHEN list_contains(s.a, split_part(e.dblp_object_key, '/', 2)) THEN 1 ELSE 0 END AS ind_article_in_journal, dblp_object_type
        FROM (SELECT DISTINCT name, journal FROM acm__editorial_boards WHERE role IN ({_ROLES})) b LEFT JOIN (SELECT acm_journal, list(dblp_abbreviation ORDER BY dblp_abbreviation) AS a FROM acm__journal_dblp GROUP BY 1) s ON b.journal = acm_journal LEFT JOIN stg_dblp_person p ON b.name = dblp_name
        LEFT JOIN stg_dblp_article_person e ON p.dblp_unique_person_key = e.dblp_unique_person_key LEFT JOIN stg_dblp_article_person o ON e.dblp_object_key = o.dblp_object_key LEFT JOIN stg_dblp_article t ON e.dblp_object_key = t.dblp_object_key""",
    "acm_analysis_subset": f"""SELECT editor_name, dblp_journal_abbreviations AS journal_keys, article_publication_year AS publication_year, {_N["authors"]} {_OUT} AS count_distinct_coauthor_out_journal, {_N["authors"]} {_IN} AS count_distinct_coauthor_in_journal,
        count(DISTINCT article_title) {_OUT} AS count_distinct_articles_out_journal, count(DISTINCT article_title) {_IN} AS count_distinct_articles_in_journal, count(DISTINCT article_title) AS count_distinct_articles {_OTHERS} GROUP BY ALL""",
    "co_author_pub_hist": f"""SELECT editor_name, dblp_journal_abbreviations, article_publication_year, cnt_articles, ind_article_in_journal, count(DISTINCT author_dblp_person_key) AS cnt_unique_coauthor
        FROM (SELECT editor_name, dblp_journal_abbreviations, article_publication_year, author_dblp_person_key, ind_article_in_journal, count(*) AS cnt_articles {_OTHERS} GROUP BY ALL) GROUP BY ALL""",
    "co_author_pub_hist_viz": f"SELECT editor_name, journal, article_publication_year, author_dblp_person_key, ind_article_in_journal, count(*) AS cnt_articles {_OTHERS} GROUP BY ALL",
    "coauthor_pubcount": f"SELECT editor_name, author_dblp_person_key AS coauthor_dblp_key, ind_article_in_journal, count(*) AS cnt_articles {_OTHERS} GROUP BY ALL",
    "coauthors": f"""WITH c AS (SELECT editor_name AS member, journal AS acm_journal, article_publication_year AS pub_year, dblp_object_type, {_N["authors"]} AS t, {_N["authors"]} {_IN} AS i, {_N["authors"]} {_OUT} AS o, {_N["articles"]} AS p, {_N["articles"]} {_IN} AS pi, {_N["articles"]} {_OUT} AS po
            FROM acm_analysis_set WHERE editor_dblp_person_key <> author_dblp_person_key GROUP BY ALL),
        j AS (SELECT acm_journal, pub_year, avg(100.0 * i / t) AS ji, avg(100.0 * o / t) AS jo FROM c GROUP BY acm_journal, pub_year, dblp_object_type), y AS (SELECT pub_year, avg(100.0 * i / t) AS yi, avg(100.0 * o / t) AS yo FROM c GROUP BY pub_year, dblp_object_type)
        SELECT member, c.acm_journal, c.pub_year, dblp_object_type, t AS cnt_coauthor_total, i AS cnt_coauthors_inside_journal, o AS cnt_coauthors_outside_journal, round(100.0 * i / t, 6) AS perc_coauthors_inside_journal, round(100.0 * o / t, 6) AS perc_coauthors_outside_journal,
            round(ji, 6) AS journal_avg_perc_coauthors_inside_journal, round(jo, 6) AS journal_avg_perc_coauthors_outside_journal, round(yi, 6) AS year_avg_perc_coauthors_inside_journal, round(yo, 6) AS year_avg_perc_coauthors_outside_journal, i - o AS cnt_coauthor_diff,
            p AS cnt_publications, pi AS cnt_publications_inside_journal, po AS cnt_publications_outside_journal FROM c LEFT JOIN j ON c.acm_journal = j.acm_journal AND c.pub_year = j.pub_year LEFT JOIN y ON c.pub_year = y.pub_year""",
    "coauthors_z_score": f"""WITH c AS (SELECT editor_name, journal, article_publication_year AS pub_year, {_N["articles"]} AS cnt_publications, {_N["articles"]} {_IN} AS cnt_publications_inside_journal, {_N["articles"]} {_OUT} AS cnt_publications_outside_journal, {_N["authors"]} AS t, {_N["authors"]} {_IN} AS i, {_N["authors"]} {_OUT} AS o
            {_OTHERS} AND article_dblp_object_key LIKE 'journals/%' GROUP BY ALL),
        m AS (SELECT journal, pub_year, avg(i) AS mi, stddev_samp(i) AS si FROM c GROUP BY ALL), y AS (SELECT pub_year, avg(100.0 * i / t) AS yi, avg(100.0 * o / t) AS yo FROM c GROUP BY ALL)
        SELECT editor_name, c.journal, c.pub_year, cnt_publications, cnt_publications_inside_journal, cnt_publications_outside_journal, t AS cnt_coauthor_total, i AS cnt_coauthors_inside_journal, o AS cnt_coauthors_outside_journal, round(100.0 * i / t, 6) AS perc_coauthors_inside_journal, round(100.0 * o / t, 6) AS perc_coauthors_outside_journal,
            i - o AS cnt_coauthor_diff, round(mi, 6) AS jnl_avg_coauthor_inside, round(si, 6) AS jnl_stdev_coauthor_inside, round(yi, 6) AS year_avg_perc_coauthors_inside_journal, round(yo, 6) AS year_avg_perc_coauthors_outside_journal, round((i - mi) / nullif(si, 0), 6) AS z_score
        FROM c JOIN m ON c.journal = m.journal AND c.pub_year = m.pub_year JOIN y ON c.pub_year = y.pub_year""",
    "article_metadata_input": "SELECT row_number() OVER (ORDER BY title, href) AS id, href, title, 'TODO' AS status FROM elsevier__journals",
    "analysis_set_raw": f"""SELECT a."$_id" AS id, author_name, d."$_journal" AS journal, year_pub, lag AS publication_lag FROM {_DATES}""",
    "analysis_set": f"""WITH e AS (SELECT author_name, d."$_journal", year_pub, round(avg(lag), 6) AS avg_pulication_lag FROM {_DATES} GROUP BY ALL),
        v AS (SELECT dblp_name, p.dblp_unique_person_key, dblp_year, count(*) AS cnt_journal_publications, count(DISTINCT split_part(x.dblp_object_key, '/', 2)) AS cnt_distinct_venues FROM stg_dblp_person p JOIN stg_dblp_article_person x ON p.dblp_unique_person_key = x.dblp_unique_person_key
            LEFT JOIN stg_dblp_article a ON x.dblp_object_key = a.dblp_object_key WHERE x.dblp_object_key LIKE 'journals/%' GROUP BY ALL)
        SELECT e.*, dblp_unique_person_key, cnt_journal_publications, cnt_distinct_venues FROM e LEFT JOIN v ON year_pub = dblp_year AND author_name = dblp_name""",
    "article": _typed_sql("article", ["title", "year", "journal", "volume", "pages", "number"], "publtype, title, year, journal, volume, pages, number"),
    "inproceedings": _typed_sql("inproceedings", ["title", "booktitle", "url", "year", "pages"], "title, booktitle, type AS url_type, url, year, pages"),
    "incollection": _typed_sql("incollection", ["title", "booktitle", "url", "year", "pages", "crossref"], "title, booktitle, type AS url_type, url, year, pages, crossref"),
    "publication": """SELECT "$_object_id", "$_object_type", dblp_key, publtype, title, NULL AS booktitle, year, journal, volume, pages, number FROM article
        UNION ALL SELECT "$_object_id", "$_object_type", dblp_key, NULL, title, booktitle, year, NULL, NULL, pages, NULL FROM incollection UNION ALL SELECT "$_object_id", "$_object_type", dblp_key, NULL, title, booktitle, year, NULL, NULL, pages, NULL FROM inproceedings""",
    "ee_clean": f"SELECT {_EE_COLUMNS}, ee, CASE WHEN ee LIKE 'https://doi.org/%' THEN 'doi_doi.org' WHEN ee LIKE 'https://www.wikidata.org/%' THEN 'wikidata' WHEN ee LIKE '%arxiv%' THEN 'arxiv' WHEN ee LIKE '%ieeexplore.ieee.org%' THEN 'ieee_explore' ELSE 'unknown' END AS ee_type FROM dblp__ee",
    "document": """SELECT "$_dblp_ee", nullif(doi, 'None') AS doi, nullif(journal_ref, 'None') AS journal_ref, "$_api_status" FROM arxiv__document""",
    "doi": f"""SELECT {_EE_COLUMNS}, ee AS doi_link, replace(ee, 'https://doi.org/', '') AS doi FROM ee_clean WHERE ee_type = 'doi_doi.org'
        UNION SELECT {_EE_COLUMNS}, ee, d.doi FROM ee_clean JOIN document d ON ee = "$_dblp_ee" WHERE ee_type = 'arxiv' AND "$_api_status" = 'SUCCEEDED' AND d.doi IS NOT NULL
        UNION SELECT {_EE_COLUMNS}, ee, d.doi FROM ee_clean JOIN wikidata__document d ON ee = d.url WHERE ee_type = 'wikidata' AND d.doi IS NOT NULL
        UNION SELECT {_EE_COLUMNS}, ee, d.doi FROM ee_clean JOIN ieee_explore__document d ON "$_parent_object_id" = "$_dblp_document_id" WHERE ee_type = 'ieee_explore' AND d.doi IS NOT NULL""",
    "article_h": "SELECT DISTINCT article_hash_key, article_business_key FROM staging__stg_article",
    "article_s_dblp": f"SELECT 'dblp' AS rec_src, {_VAULT_ARTICLE} FROM staging__stg_article",
    "article_s_dblp_doi": "SELECT DISTINCT 'dblp' AS rec_src, article_hash_key, doi_link, doi_type, doi FROM staging__stg_article_doi",
    "person_h": "SELECT DISTINCT person_business_key, person_hash_key FROM staging__stg_person",
    "person_s_dblp_name": "SELECT DISTINCT 'dblp_dump' AS rec_src, person_hash_key, name FROM staging__stg_person",
    "person_s_dblp_orc": "SELECT DISTINCT 'dblp_dump' AS rec_src, person_hash_key, orcid FROM staging__stg_person WHERE orcid IS NOT NULL",
    "lnk_article_person": "SELECT md5(concat(article_hash_key, person_hash_key)) AS lnk_hash_key, article_hash_key, person_hash_key FROM (SELECT DISTINCT article_hash_key, person_hash_key FROM staging__stg_article_person)",
    "paper": "SELECT surrogate_id AS integration_id, title, doi, surrogate_id AS springer_lncs_surrogate_id FROM springer_lncs__bus_chapter",
    "proceeding": """SELECT surrogate_id AS integration_id, book_title, book_subtitle, doi, ebook_isbn, ebook_packages, edition_number, front_matter_url, publisher_name, "series_e-issn", series_issn, series_title, softcover_isbn, hardcover_isbn, surrogate_id AS springer_lncs_surrogate_id FROM bus_book""",
    "person": "SELECT DISTINCT coalesce(a.surrogate_id, m.surrogate_id) AS integration_id, coalesce(a.name, m.name) AS name, a.surrogate_id AS springer_lncs_surrogate_id, m.surrogate_id AS lncs_front_matter_surrogate_id FROM springer_lncs__bus_author a FULL JOIN lncs_front_matter__bus_member m ON a.name = m.name",
    "lnk_paper_proceeding": """SELECT b AS springer_lncs_book_surrogate_id, c AS springer_lncs_paper_surrogate_id, c AS paper_integration_id, b AS proceeding_integration_id FROM (SELECT md5(replace(b.doi, 'https://doi.org/', '')) AS b, md5(replace(c.doi, 'https://doi.org/', '')) AS c FROM springer_lncs__book b LEFT JOIN springer_lncs__chapter c ON b."$_book_url" = c."$_book_url")""",
    "lnk_paper_person": """SELECT p.integration_id AS paper_integration_id, w.integration_id AS person_integration_id FROM springer_lncs__bus_author_chapter e LEFT JOIN springer_lncs__chapter c ON e."$_paper_url" = c."$_paper_url"
        LEFT JOIN paper p ON md5(replace(c.doi, 'https://doi.org/', '')) = p.springer_lncs_surrogate_id LEFT JOIN person w ON e.author_surrogate_id = w.springer_lncs_surrogate_id""",
    "z_score_members": _mad_sql(_WROTE, "dblp_key, n AS p_members, least AS x_min, round(deviation, 6) AS x_stddev, most AS x_max, round(mean, 6) AS x_avg, middle AS median, member_name, x AS cnt_articles_written_in_book, mad, ratio") + " WHERE x > 0 AND ratio > 3",
    "members_cited": _mad_sql(_CITED, "dblp_key, middle AS median, member_name, x AS cnt_author_cited_in_book, mad, ratio") + " ORDER BY ratio DESC, dblp_key, member_name LIMIT 50",
    "clean_name": "SELECT surrogate_id, orc, email, name, regexp_replace(strip_accents(name), '[^a-zA-Z ]', '', 'g') AS clean_name FROM springer_lncs__bus_author ORDER BY name, surrogate_id LIMIT 1000",
    "unmatched_titles": """WITH p AS (SELECT p.*, d.doi AS p_doi FROM publication p LEFT JOIN doi d ON p."$_object_id" = d."$_parent_object_id" WHERE CAST(year AS INT) < 2020),
        f AS (SELECT "$_object_id" AS i FROM p JOIN aminer__paper a ON p_doi = a.doi), g AS (SELECT "$_object_id" AS i FROM p JOIN aminer__paper a ON replace(p.title, '.', '') = replace(a.title, '.', ''))
        SELECT title, "$_object_type", year, count(DISTINCT "$_object_id") AS cnt FROM p WHERE "$_object_id" NOT IN (SELECT i FROM f) AND "$_object_id" NOT IN (SELECT i FROM g) GROUP BY ALL""",
    "doi_completeness": """SELECT ee_type, count(*) AS cnt FROM ee_clean WHERE "$_parent_object_id" NOT IN (SELECT "$_parent_object_id" FROM doi) GROUP BY ALL""",
    "hosts_without_doi": """SELECT regexp_extract(ee, '^https?://([^/]*)/', 1) AS x, count(*) AS cnt FROM ee_clean WHERE ee_type = 'unknown' AND "$_parent_object_id" NOT IN (SELECT "$_parent_object_id" FROM doi) GROUP BY ALL""",
    "file_outcomes": """SELECT CASE WHEN ok = 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN ok = 1 THEN 'OK' WHEN m IN ('null', '') THEN 'Unknown' WHEN m LIKE '%organisation%' THEN m ELSE 'Internal error' END AS message, count(*) AS file_count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage
        FROM (SELECT file_id, min(file_pass) AS ok, string_agg(message, '|' ORDER BY message) AS m FROM validation GROUP BY 1) GROUP BY ALL""",
    "files_of_interest": "SELECT ind_interested, count(*) AS file_count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM (SELECT file_id, max(section_interested) AS ind_interested FROM validation WHERE file_pass = 1 GROUP BY 1) GROUP BY ALL",
}


def oracle(name: str) -> str:
    """SQL of a model with all that it reads: landed tables and models before it."""
    models = registry.order([name])
    used = dict.fromkeys(s for m in models for s in re.findall(r"\b\w+?__\w+\b", MODEL_SQL[m]))
    bare = {t: t for t in DRIVER}
    parts = [f"{s} AS MATERIALIZED ({LANDED[s].format(**bare)})" for s in used] + [f"{m} AS MATERIALIZED ({MODEL_SQL[m]})" for m in models]
    return "WITH " + ",\n    ".join(parts) + f"\n    SELECT * FROM {name}"


def _add(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = registry.run(spark, sources(spark, d), [name]).done[name]
        joined = {"double": lambda c: F.round(c, queries.ROUND), "array<string>": lambda c: F.array_join(c, "|")}
        return out.select(*[joined.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in out.dtypes])

    run.__name__ = f"model_{name}"
    run.__doc__ = f"The model {name} of the catalogue over landed tables."
    queries.query(oracle(name))(run)


for _name in MODEL_SQL:
    _add(_name)
