"""Page parsers on small pages of the layouts they read."""

from scholion.operators import html


def run(spark, page, parser, fields):
    d = spark.createDataFrame([("p", page)], "path string, html string")
    return [tuple(r) for r in html.fields(html.parse(d, parser), fields).collect()]


def test_ranking(spark):
    page = """<table><tr><th><b>Title</b></th><th><b>DBLP</b></th></tr><tr class="oddrow"><td>Odd</td><td>none</td></tr>
      <tr class="evenrow"><td> Even &amp; so </td><td><a href="http://x/db/a">view</a></td></tr></table>"""
    assert run(spark, page, html.ranking_rows, ["Title", "DBLP"]) == [("Even & so", "http://x/db/a"), ("Odd", "none")]


def test_board(spark):
    p = lambda n, c="": f'<div class="profile-meta"><h4 class="item-meta-row">{n}</h4><div class="item-meta-row">Uni {n}</div>{c}</div>'
    page = f"""<h1 class="title">Journal of\n X</h1><div><h3 class="section__title">Editors</h3><div class="row">{p("A", "<em>NL</em>")}{p("B")}</div><p>no</p><div class="row">{p("C")}</div>
      <h3 class="section__title">Others</h3><div class="row">{p("D")}</div></div>"""
    got = run(spark, page, html.board_members, ["role", "journal", "name", "affiliation", "country"])
    assert got == [("Editors", "Journal of X", "A", "Uni A", "NL"), ("Editors", "Journal of X", "B", "Uni B", None), ("Editors", "Journal of X", "C", "Uni C", None), ("Others", "Journal of X", "D", "Uni D", None)]


INFO = '<li class="bibliographic-information__item"><span class="bibliographic-information__title">{}</span><span class="bibliographic-information__value">{}</span></li>'


def test_book(spark):
    people = """<div id="editorsandaffiliations"><ul><li itemprop="editor"><span class="authors-affiliations__name">Ada  Moss</span><span class="author-information__orcid"><a href="http://o/1">x</a></span>
      <ul class="authors-affiliations__indexes"><li data-affiliation="1">1</li><li data-affiliation="2">2</li></ul></li></ul></div>
      <ul><li class="affiliation" data-affiliation-highlight="1"><span class="affiliation__name">Hill</span><span class="affiliation__country">Land</span></li></ul>"""
    page = f"""<div id="bibliographic-info"><ul>{INFO.format("Book Title", "On  X")}{INFO.format("Editors", "Ada<br/>Ben")}</ul></div>
      <div id="booktoc" class="book-toc-container"><ol class="content-type-list"><li class="front-matter-item"><a aria-label="Download PDF - Front Matter" href="/f.pdf">x</a></li></ol></div>
      <li class="chapter-item"><a class="u-interface-link" href="/c1">c</a></li>"""
    assert run(spark, page, html.book_info, ["book_title", "front_matter_url", "editors"]) == [("On X", "/f.pdf", None)]
    assert run(spark, page, html.editors, ["editor_id", "name"]) == [("1", "Ada"), ("2", "Ben")]
    assert run(spark, page + people, html.editors, ["editor_id", "name", "orc"]) == [("1", "Ada Moss", "http://o/1")]
    assert run(spark, page, html.chapter_links, ["href"]) == [("/c1",)]
    d = spark.createDataFrame([("p", page + people)], "path string, html string")
    who = html.fields(html.parse(d, html.editors), ["editor_id", "affiliation_ids"], "path")
    where = html.fields(html.parse(d, html.affiliations), ["id", "department", "name", "city", "country"], "path")
    assert [(r["editor_id"], r["affiliation_id"], r["name"]) for r in html.with_affiliations(who, where, "path", "editor_id").collect()] == [("1", "1", "Hill")]


def test_chapter(spark):
    page = f"""<h1 class="ChapterTitle">T</h1><ul class="bibliographic-information__list">{INFO.format("DOI", "https://doi.org/1")}</ul><section id="authorsandaffiliations"><ul>
      <li itemprop="author"><span class="authors-affiliations__name">Ada</span><span class="author-information"><span><a itemprop="email" title="a@x">m</a></span></span></li></ul></section>"""
    assert run(spark, page, html.chapter_info, ["doi", "title"]) == [("https://doi.org/1", "T")]
    assert run(spark, page, html.authors, ["doc_person_id", "name", "email"]) == [("1", "Ada", "a@x")]


def test_journals_and_failures(spark):
    page = '<article class="search-result x"><h2 class="search-result-journal-title"><a href="/j">J</a></h2><span class="journal-result-issn">1-2</span></article>'
    assert run(spark, page, html.journals, ["href", "title", "issn"]) == [("/j", "J", "1-2")]
    d = spark.createDataFrame([("a", page), ("b", None), ("c", "<x")], "path string, html string")
    boom = lambda page: 1 / (len(page.all()) > 0)
    got = {r["path"]: r["status"] for r in html.parse(d, lambda page: [{"n": str(boom(page))}]).collect()}
    assert got == {"a": "SUCCEEDED", "b": "FAILED", "c": "FAILED"}
    assert html.stamped(d, run="1").columns[-1] == "run"


def test_elements_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from scholion.plans import queries as q

    odd = ["<title>a &amp b</title><li>cut &am</li>", "<h1>x&copy;&middot;&#38;&nbsp;&amp;lt;</h1>", "<li>a<ul><li>b</li></ul></li><li>open", "<LI>A</LI><li class='c'>B</li><li> \u00a0c\u3000d\x0be\x0c \u2003</li>",
           "<!-- <li>no</li> --><script>var t = '<li>s</li>'</script>", "<h1>a & <b>b</b>&<i>lt;</i>\r\n c</h1><li></li>", "", None, "<li>a<b</li>"]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(q.ORACLE_SQL["html_elements"])
    got = q.QUERIES["html_elements"](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
