"""Queries that lay the driver's rows out as pages, committees, glyphs and batches, and read them back.

The reader of each layout runs on every row of its tables; SQL says what it must find.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import glyphs, grid, html
from ..sources import sinks
from ..streaming import incremental
from .queries import _t, query

# -- committees


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as members of committees: one for each nation and some hundred keys, in one of eight layouts by nation."""
    customer = _t(spark, d, "customer")
    section = F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.floor(F.col("c_custkey") / 500).cast("string"))
    return customer.select(section.alias("section"), (F.col("c_nationkey") % 8).alias("layout"), "c_custkey", F.col("c_custkey").cast("string").alias("c"))


def _committees(spark: SparkSession, d: str) -> DataFrame:
    p = _people(spark, d)
    cell = lambda *parts: F.rpad(F.concat(*[x if not isinstance(x, str) else F.col("c") if x == "c" else F.lit(x) for x in parts]), 36, " ")
    first = F.col("c_custkey") == F.min("c_custkey").over(_by_section())
    rows = {
        0: F.array(F.concat(F.lit("Name "), "c", F.lit(", University of "), "c", F.lit(", Land"))),
        1: F.array(F.concat(F.lit("Name "), "c"), F.concat(F.lit("University of "), "c", F.lit(", Land"))),
        2: F.array(F.concat(cell("Name ", "c"), F.lit("University of "), "c", F.lit(", Land"))),
        3: F.array(F.concat(F.when(first, cell("General Chairs")).otherwise(cell("")), F.lit("Name "), "c", F.lit(" (Aff "), "c", F.lit(")"))),
        4: F.array(F.concat(cell("Last", "c", ", Ann"), F.lit("Last"), "c", F.lit(", Bob"))),
        5: F.array(F.concat(cell("Last", "c", ", Ann"), cell("Last", "c", ", Bob"), F.lit("Last"), "c", F.lit(", Cleo"))),
        6: F.array(F.concat(cell("Last", "c"), cell("First", "c"), F.lit("Hill University "), "c")),
        7: F.array().cast("array<string>"),
    }
    lines = F.array().cast("array<string>")
    for k, v in rows.items():
        lines = F.when(F.col("layout") == k, v).otherwise(lines)
    each = p.withColumn("lines", lines).groupBy("section", "layout").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "lines"))).alias("all"))
    return each.select("section", "layout", F.flatten(F.transform("all", lambda x: x["lines"])).alias("content"), F.lit("Program Committee").alias("title"))


def _by_section():
    from pyspark.sql import Window

    return Window.partitionBy("section")


_PEOPLE_SQL = "p AS (SELECT c_nationkey || '-' || (c_custkey // 500) AS section, c_nationkey % 8 AS layout, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 500 ORDER BY c_custkey) - 1 AS n FROM customer)"


@query(f"""WITH {_PEOPLE_SQL}
    SELECT section, n AS member_no, 'Program Committee' AS role, 'Name ' || c AS name, CAST(NULL AS VARCHAR) AS firstname, CAST(NULL AS VARCHAR) AS lastname, 'University of ' || c || ', Land' AS affiliation FROM p WHERE layout IN (0, 1, 2)
    UNION ALL SELECT section, n, 'General Chairs', 'Name ' || c, NULL, NULL, 'Aff ' || c FROM p WHERE layout = 3
    UNION ALL SELECT section, 2 * n + k, 'Program Committee', 'Last' || c || ', ' || f, f, 'Last' || c, NULL FROM p, (VALUES (0, 'Ann'), (1, 'Bob')) v(k, f) WHERE layout = 4
    UNION ALL SELECT section, 3 * n + k, 'Program Committee', 'Last' || c || ', ' || f, f, 'Last' || c, NULL FROM p, (VALUES (0, 'Ann'), (1, 'Bob'), (2, 'Cleo')) v(k, f) WHERE layout = 5
    UNION ALL SELECT section, n, 'Program Committee', 'Last' || c || ', First' || c, 'First' || c, 'Last' || c, 'Hill University ' || c FROM p WHERE layout = 6""")
def grid_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Committees in eight layouts, each read by the parser that its statistics choose."""
    return grid.members(grid.parsed(_committees(spark, d)), "section").select("section", "member_no", "role", "name", "firstname", "lastname", "affiliation")


_CHOSEN = ["OneColumnNameAffiliation", "OneColumnOddNameEvenAffiliation", "Two_Name_Affiliation", "Two_Role_NameAff", "TwoLastNameFirstNameParser", "ThreeLastNameFirstNameParser", "ThreeLastFirstAffParser", "ZeroParser"]


@query(f"""WITH {_PEOPLE_SQL}, s AS (SELECT section, layout, count(*) AS n, min(c) AS c FROM p GROUP BY ALL)
    SELECT section, ['{"', '".join(_CHOSEN)}'][layout + 1] AS parser, CASE layout WHEN 1 THEN 2 * n WHEN 7 THEN 0 ELSE n END AS n_rows, CASE WHEN layout < 2 THEN 1 WHEN layout < 5 THEN 2 WHEN layout < 7 THEN 3 ELSE 0 END AS n_columns,
           CASE layout WHEN 0 THEN 'Name ' || c || ', University of ' || c || ', Land' WHEN 1 THEN 'Name ' || c WHEN 2 THEN 'Name ' || c WHEN 3 THEN 'General Chairs' WHEN 4 THEN 'Last' || c || ', Ann' WHEN 5 THEN 'Last' || c || ', Ann' WHEN 6 THEN 'Last' || c END AS first_cell,
           CASE WHEN layout = 1 THEN 'University of ' || c || ', Land' END AS cell_below_name FROM s""")
def grid_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Parsers chosen for eight layouts, and cells of their grids by place."""
    g, rows = grid.parsed(_committees(spark, d)), F.col("rows")
    below = F.when(F.col("layout") == 1, grid.below(rows, 0, 0))
    return g.select("section", "parser", F.size(rows).alias("n_rows"), "n_columns", grid.at(rows, 0, 0).alias("first_cell"), below.alias("cell_below_name"))


# -- glyphs


@query("""WITH s AS (SELECT s_nationkey AS doc, s_name AS text, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)
    SELECT doc, 1 AS page, n AS line_no, repeat(' ', CAST(n % 5 AS INT)) || text AS text, length(text) AS n_chars, 9.5 AS scale, n % 2 = 0 AS bold FROM s""")
def glyph_lines(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs at their places to lines of text; each line starts some columns further on."""
    from pyspark.sql import Window

    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_name").alias("t"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("n"))
    each = s.select("doc", "n", F.posexplode(F.split("t", "")).alias("k", "text"))
    x = (4 * (F.col("n") % 5) + 5 * F.col("k")).cast("double")
    g = each.select("doc", F.lit(1).alias("page"), x.alias("x"), (20.0 * F.col("n")).alias("y"), F.lit(5.0).alias("width"), F.lit(10.0).alias("height"), "text", text.rounded(F.lit(9.499)).alias("scale"), (F.col("n") % 2 == 0).alias("bold"))
    return glyphs.lines(g).select("doc", "page", "line_no", "text", "n_chars", "scale", "bold")


# -- pages


def _joined(order: str, part):
    """The parts of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("h")))), lambda x: x["h"]), "")


def _f(pattern: str, *columns):
    return F.format_string(pattern, *[F.col(c) for c in columns])


@query("""WITH r AS (SELECT n_regionkey AS page, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'http://x/db/' || n_nationkey ELSE 'none' END AS link, CAST(n_nationkey % 2 AS INT) AS odd, n_nationkey FROM nation)
    SELECT page, row_number() OVER (PARTITION BY page ORDER BY odd, n_nationkey) - 1 AS n, title, link FROM r""")
def ranking_pages(spark: SparkSession, d: str) -> DataFrame:
    """Rankings as tables, cells that only say "view" being their links; even rows come first."""
    cell = F.when(F.col("n_nationkey") % 2 == 0, _f('<a href="http://x/db/%d"> view </a>', "n_nationkey")).otherwise("none")
    row = F.concat(F.when(F.col("n_nationkey") % 2 == 0, '<tr class="evenrow"><td> ').otherwise('<tr class="oddrow"><td> '), "n_name", F.lit(" </td><td>"), cell, F.lit("</td></tr>"))
    page = _t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("page")).agg(F.concat(F.lit("<table><tr><th><b>Title</b></th><th><b>DBLP</b></th></tr>"), _joined("n_nationkey", row), F.lit("</table>")).alias("html"))
    return html.fields(html.parse(page, html.ranking_rows, "page"), ["Title", "DBLP"], "page", "n").toDF("page", "n", "title", "link")


@query("""SELECT n_regionkey AS page, 'Journal of ' || r_name AS journal, CASE WHEN n_nationkey % 2 = 0 THEN 'Editors' ELSE 'Others' END AS role, n_name AS name, 'Uni & ' || n_nationkey AS affiliation, CASE WHEN n_nationkey % 3 = 0 THEN 'Land' END AS country
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def board_pages(spark: SparkSession, d: str) -> DataFrame:
    """Editorial boards, whose profiles have the role of the title above them."""
    nation, region = _t(spark, d, "nation", "region")
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    profile = F.concat(F.lit('<div class="row"><div class="profile-meta"><h4 class="item-meta-row"> '), "n_name", _f('\n</h4><div class="item-meta-row">Uni  &amp; %d</div>', "n_nationkey"), F.when(F.col("n_nationkey") % 3 == 0, "<em>Land</em>").otherwise(""), F.lit("</div></div>"))
    part = lambda odd: _joined("n_nationkey", F.when(F.col("n_nationkey") % 2 == odd, profile).otherwise(""))
    head = F.concat(F.lit('<h1 class="title">Journal of\n '), F.first("r_name"), F.lit('</h1><div><h3 class="section__title">Editors</h3>'))
    page = n.groupBy(F.col("n_regionkey").alias("page")).agg(F.concat(head, part(0), F.lit('<p>no</p><h3 class="section__title">Others</h3>'), part(1), F.lit("</div>")).alias("html"))
    return html.fields(html.parse(page, html.board_members, "page"), ["journal", "role", "name", "affiliation", "country"], "page")


_INFO = '<li class="bibliographic-information__item"><span class="bibliographic-information__title">{}</span><span class="bibliographic-information__value">{}</span></li>'
_PERSON = '<li itemprop="{}"><span class="authors-affiliations__name">Name  %d</span><span class="author-information__orcid"><a href="http://o/%d">x</a></span><span class="author-information"><span><a itemprop="email" title="m%d@x">m</a></span></span><ul class="authors-affiliations__indexes"><li data-affiliation="%d">1</li></ul></li>'
_PLACE = '<li class="affiliation" data-affiliation-highlight="%d"><span class="affiliation__name">Uni %d</span><span class="affiliation__country">Land</span></li>'


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Nations as books: suppliers are editors with an affiliation each; nations whose key 3 divides list names only."""
    nation, supplier = _t(spark, d, "nation", "supplier")
    people = supplier.groupBy("s_nationkey").agg(
        _joined("s_suppkey", _f(_PERSON.format("editor"), *["s_suppkey"] * 4)).alias("people"), _joined("s_suppkey", _f(_PLACE, "s_suppkey", "s_suppkey")).alias("places"), _joined("s_suppkey", _f("Name %d<br/>", "s_suppkey")).alias("names")
    )
    books = nation.join(people, F.col("n_nationkey") == F.col("s_nationkey"), "left").na.fill("", ["people", "places", "names"])
    title, listed = _INFO.format("Book Title", "On  %s").replace("%s", "%2$s"), _INFO.format("Editors", "%3$s")
    front = '<li class="front-matter-item"><a aria-label="Download PDF - Front Matter" href="/f%1$d.pdf">x</a></li><li class="chapter-item"><a class="u-interface-link" href="/c%1$d/1">a</a></li><li class="chapter-item"><a class="u-interface-link" href="/c%1$d/2">b</a></li>'
    page = F.format_string(f"<ul>{title}{listed}</ul><ol>{front}</ol>", "n_nationkey", "n_name", "names")
    whole = F.concat(page, F.lit('<div id="editorsandaffiliations"><ul>'), "people", F.lit("</ul></div><ul>"), "places", F.lit("</ul>"))
    return books.select(F.col("n_nationkey").alias("page"), F.when(F.col("n_nationkey") % 3 == 0, page).otherwise(whole).alias("html"))


@query("""SELECT n_nationkey AS page, 'On ' || n_name AS book_title, '/f' || n_nationkey || '.pdf' AS front_matter_url, '/c' || n_nationkey || '/' || k AS chapter FROM nation, (VALUES (1), (2)) v(k)""")
def book_pages(spark: SparkSession, d: str) -> DataFrame:
    """What book pages say of the book, its front matter and the links to its chapters."""
    b = _books(spark, d)
    info = html.fields(html.parse(b, html.book_info, "page"), ["book_title", "front_matter_url"], "page")
    return info.join(html.fields(html.parse(b, html.chapter_links, "page"), ["href"], "page").withColumnRenamed("href", "chapter"), "page")


@query("""WITH s AS (SELECT s_nationkey AS page, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, s_nationkey % 3 = 0 AS listed FROM supplier)
    SELECT page, CAST(n AS VARCHAR) AS editor_id, 'Name ' || s AS name, CASE WHEN NOT listed THEN 'http://o/' || s END AS orc, CASE WHEN NOT listed THEN 'm' || s || '@x' END AS email, CASE WHEN NOT listed THEN 'Uni ' || s END AS affiliation FROM s""")
def editor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Editors with their affiliations, from the bibliographic list where a page has no list of editors."""
    b = _books(spark, d)
    who = html.fields(html.parse(b, html.editors, "page"), ["editor_id", "name", "orc", "email", "affiliation_ids"], "page")
    where = html.fields(html.parse(b, html.affiliations, "page"), ["id", "department", "name", "city", "country"], "page")
    places = html.with_affiliations(who, where, "page", "editor_id").select("page", "editor_id", F.col("name").alias("affiliation"))
    return who.drop("affiliation_ids").join(places, ["page", "editor_id"], "left")


@query("""SELECT c_custkey AS page, 'https://doi.org/10.1/' || c_custkey AS doi, c_name AS title, 'Name ' || c_custkey AS author, 'http://o/' || c_custkey AS orc, 'm' || c_custkey || '@x' AS email FROM customer""")
def chapter_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chapters with their authors, ORCIDs and marked properties."""
    customer = _t(spark, d, "customer")
    head = F.format_string('<h1 class="ChapterTitle">%s</h1><ul>' + _INFO.format("DOI", "https://doi.org/10.1/%d") + "</ul>", "c_name", "c_custkey")
    page = customer.select(F.col("c_custkey").alias("page"), F.concat(head, F.lit('<section id="authorsandaffiliations"><ul>'), _f(_PERSON.format("author"), *["c_custkey"] * 4), F.lit("</ul></section>")).alias("html"))
    info = html.fields(html.parse(page, html.chapter_info, "page"), ["doi", "title"], "page")
    return info.join(html.fields(html.parse(page, html.authors, "page"), ["name", "orc", "email"], "page").withColumnRenamed("name", "author"), "page")


@query("""SELECT n_regionkey AS page, '/j' || n_nationkey AS href, n_name AS title, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey || '-X' END AS issn, 'run 1' AS batch FROM nation""")
def journal_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lists of journals, stamped with their batch."""
    issn = F.when(F.col("n_nationkey") % 4 != 0, _f('<span class="journal-result-issn">%d-X</span>', "n_nationkey")).otherwise("")
    entry = F.concat(F.format_string('<article class="search-result"><h2 class="search-result-journal-title"><a href="/j%d">%s</a></h2>', "n_nationkey", "n_name"), issn, F.lit("</article>"))
    page = _t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("page")).agg(_joined("n_nationkey", entry).alias("html"))
    return html.stamped(html.fields(html.parse(page, html.journals, "page"), ["href", "title", "issn"], "page"), batch="run 1")


# -- JSON


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events)
    SELECT event_id, 'a_k' AS path, k AS value FROM e UNION ALL SELECT event_id, 'a_list_0', '1' FROM e UNION ALL SELECT event_id, 'a_list_1_kind', event_type FROM e
    UNION ALL SELECT event_id, 'a_list_2_0', 'true' FROM e UNION ALL SELECT event_id, 'none', NULL FROM e""")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of nested JSON by path, places in lists being parts of it, below names that are left out nothing."""
    k = F.get_json_object("props", "$.k")
    nested = F.concat(F.lit('{"a": {"k": '), k, F.lit(', "authors": [{"author": "x"}], "list": [1, {"kind": "'), "event_type", F.lit('"}, [true]]}, "none": null}'))
    return incremental.flattened(_t(spark, d, "events").select("event_id", nested.alias("j")), "j", "event_id")


# -- sinks


def _table(spark: SparkSession) -> tuple[str, str]:
    """A table of our own, dropped when the application ends."""
    name = f"t_{uuid.uuid4().hex}"

    def gone() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            sinks.drop(spark, "scholion_landing", name)

    atexit.register(gone)
    return "scholion_landing", name


@query("""SELECT event_id AS id, event_type, CASE WHEN event_type IN ('view', 'signup') THEN value END AS value, CASE WHEN event_type NOT IN ('view', 'signup') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def schema_merge_append(spark: SparkSession, d: str) -> DataFrame:
    """K1 K3 K4 K5: two batches of different columns appended to one table, which gains the second one's."""
    e, where = _t(spark, d, "events"), _table(spark)
    early = F.col("event_type").isin("view", "signup")
    sinks.append(e.where(early).select(F.col("event_id").alias("id"), "event_type", "value"), *where)
    sinks.append(e.where(~early).select(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_id").alias("id"), "event_type"), *where)
    return spark.table(".".join(where))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' WHEN o_orderkey % 3 = 1 THEN 'SUCCEEDED' ELSE 'NEW' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'No organisation position found' END AS message, o_totalprice AS price FROM orders""")
def status_update(spark: SparkSession, d: str) -> DataFrame:
    """Statuses set by id in a table, the latest of several updates counting."""
    orders, where = _t(spark, d, "orders"), _table(spark)
    sinks.reload(orders.select(F.col("o_orderkey").alias("id"), F.lit("NEW").alias("status"), F.lit("old").cast("string").alias("message"), F.col("o_totalprice").alias("price")), *where)
    sinks.update(spark, *where, orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("message")), "id")
    bad = F.col("o_orderkey") % 3 == 0
    new = orders.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("id"), F.when(bad, "FAILED").otherwise("SUCCEEDED").alias("status"), F.when(bad, "No organisation position found").alias("message"), F.lit(2).alias("at"))
    old = new.withColumns({"status": F.lit("STARTED"), "message": F.lit("x"), "at": F.lit(1)})
    sinks.update(spark, *where, new.unionByName(old), "id")
    return spark.table(".".join(where))


@query("""SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier""")
def widened_and_clustered(spark: SparkSession, d: str) -> DataFrame:
    """A table ordered by a unique column, one of its columns widened, with its documentation."""
    where = _table(spark)
    sinks.clustered(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), *where, "id", unique=True)
    sinks.widen(spark, *where, "nation", "bigint")
    sinks.describe(spark, *where, "suppliers", nation="the nation's key")
    return spark.table(".".join(where))


# -- keys and texts


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority LIKE '1%') AND nullif(o_orderstatus, 'P') <> 'O' AND regexp_extract(o_orderpriority, '-(\\w+)', 1) = 'URGENT'""")
def filter_rules(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives over columns, an inequality that drops nulls, and equality with what a pattern finds."""
    o = _t(spark, d, "orders")
    status = text.blank_to_null("o_orderstatus", "P")
    kept = ((F.col("o_orderstatus") == "F") | F.col("o_orderpriority").like("1%")) & (status != "O") & (text.first_group("o_orderpriority", r"-(\w+)") == "URGENT")
    return o.where(kept).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower('M' || (c_custkey % 200) || '@X') = lower('m' || s_suppkey || '@x')""")
def email_join(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that differ in case."""
    customer, supplier = _t(spark, d, "customer", "supplier")
    left = F.concat(F.lit("M"), (F.col("c_custkey") % 200).cast("string"), F.lit("@X"))
    right = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"), F.lit("@x"))
    return customer.join(supplier, F.lower(left) == F.lower(right)).select("c_custkey", "s_suppkey")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS collapsed, lower(replace(source || ' of  Doc', '  ', '_')) AS no_key, lower('a_' || source || '_doc') AS column_key FROM documents""")
def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed white space, and titles as names of columns."""
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.collapsed(F.coalesce("text", F.lit("")))).alias("collapsed"), F.lower(F.replace(F.concat("source", F.lit(" of  Doc")), F.lit("  "), F.lit("_"))).alias("no_key"), text.column_key(F.concat(F.lit(" A  "), "source", F.lit("\n Doc"))).alias("column_key"))
