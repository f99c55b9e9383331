"""The models end to end on a small library: two journals, one committee, one board."""

import pytest

from scholion.plans.catalogue import registry
from scholion.plans.registry import Registry

E = lambda i, p, t, v, *more: (str(i), str(p), t, v, *more)
ELEMENT = "`$_object_id` string, `$_parent_object_id` string, `$_parent_object_type` string, "
PUBLICATION = "`$_object_id` string, mdate string, key string, publtype string"

TABLES = {
    ("dblp_dump", "article"): ([("1", "2020-01-02", "journals/tois/A1", ""), ("2", "2020-01-03", "journals/cacm/B2", "x")], PUBLICATION),
    ("dblp_dump", "inproceedings"): ([("3", "2020-01-04", "conf/x/C3", None)], PUBLICATION),
    ("dblp_dump", "incollection"): ([], PUBLICATION),
    ("dblp_dump", "www"): ([("9", "2020-01-01", "homepages/a", ""), ("9", "2020-01-01", "homepages/a", "")], PUBLICATION),
    ("dblp_dump", "author"): (
        [E(1, 1, "article", "Ada", "", "", ""), E(2, 1, "article", "Ben", "o-b", "", ""), E(1, 2, "article", "A. Moss", "", "", ""), E(2, 2, "article", "Cleo", "", "", ""), E(1, 3, "inproceedings", "Ada", "o-a", "", ""),
         E(1, 9, "www", "Ada", "", "", ""), E(2, 9, "www", "A. Moss", "", "", ""), E(2, 9, "www", "A. Moss", "", "", "")],
        ELEMENT + "author string, orcid string, bibtex string, aux string",
    ),
    ("dblp_dump", "title"): ([E(1, 1, "article", "One", ""), E(1, 2, "article", "Two", ""), E(1, 3, "inproceedings", "Three", "")], ELEMENT + "title string, bibtex string"),
    ("dblp_dump", "year"): ([E(1, 1, "article", "2020"), E(1, 2, "article", "2020"), E(1, 3, "inproceedings", "")], ELEMENT + "year string"),
    ("dblp_dump", "journal"): ([E(1, 1, "article", "TOIS"), E(1, 2, "article", "CACM")], ELEMENT + "journal string"),
    ("dblp_dump", "volume"): ([], ELEMENT + "volume string"),
    ("dblp_dump", "pages"): ([E(1, 1, "article", "1-2")], ELEMENT + "pages string"),
    ("dblp_dump", "number"): ([], ELEMENT + "number string"),
    ("dblp_dump", "ee"): ([E(1, 1, "article", "https://doi.org/10.1/a"), E(2, 1, "article", "http://x"), E(1, 2, "article", "https://doi.org/10.1/b")], ELEMENT + "ee string"),
    ("acm", "editorial_boards"): ([("U", "NL", "Journal T", "Ada", "Associate Editors"), ("U", "NL", "Journal T", "Ada", "Editor-in-Chief"), ("V", None, "Journal Z", "Zoe", "Associate Editors"), ("V", None, "Journal Z", "Ben", "Staff")], "affiliation string, country string, journal string, name string, role string"),
    ("acm", "journal_dblp"): ([("Journal T", "tois"), ("Journal T", "tist")], "acm_journal string, dblp_abbreviation string"),
    ("springer_lncs", "book"): ([tuple("https://doi.org/10.9/bk" if c == "doi" else "b1" if c == "$_book_url" else "conf/x/2019" if c == "$_dblp_key" else "v" for c in __import__("scholion.plans.catalogue", fromlist=["BOOK"]).BOOK)], ", ".join(f"`{c}` string" for c in __import__("scholion.plans.catalogue", fromlist=["BOOK"]).BOOK)),
    ("springer_lncs", "chapter"): ([("b1", "p1", "conf/x/2019", "https://doi.org/10.9/c1 ", "T1", *"vwxyz"), ("b1", "p2", "conf/x/2019", "https://doi.org/10.9/c2", "T2", *"vwxyz")], "`$_book_url` string, `$_paper_url` string, `$_dblp_key` string, doi string, title string, online_isbn string, print_isbn string, publisher_name string, first_online string, revised string"),
    ("springer_lncs", "author"): ([("p1", "1", "Ada Moss", "a@x", "https://o/1"), ("p2", "1", "Ada Moss", "a@x", "https://o/1"), ("p2", "2", "Ben Brook", "B@x", None), ("p2", "3", "Zoë", None, None)], "`$_paper_url` string, doc_person_id string, name string, email string, orc string"),
    ("springer_lncs", "manual_author"): ([("s", "ZOE", None, "http://o/9")], "rec_src string, name string, email string, orc string"),
    ("opencitations_dump", "reference"): ([("10.9/c1", " 10.1/a"), ("10.9/c1", "10.1/b"), ("10.9/none", "10.1/a")], "citing string, cited string"),
    ("lncs_front_matter", "file"): ([(1, 1, "old.pdf", "SUCCEEDED", ""), (2, 1, "conf_x_2019.pdf", "SUCCEEDED", ""), (2, 2, "b.pdf", "FAILED", "No organisation position found"), (2, 3, "c.pdf", "SUCCEEDED", "")], "run_id long, id long, filename string, status string, message string"),
    ("lncs_front_matter", "section"): ([(2, 10, 1, "Two_Name_Affiliation", 3, 0), (2, 11, 1, "ZeroParser", 0, 0), (2, 12, 2, "ZeroParser", 0, 0)], "run_id long, id long, file_id long, parser string, num_section_lines_non_empty int, num_merged_lines int"),
    ("lncs_front_matter", "member"): ([(2, n, 10, "Program Committee", a, b, c) for n, (a, b, c) in enumerate([(" Ada ", "Moss", "x"), ("null", "null", " Ben Brook (Y)"), ("null", "null", "A. Moss,")])], "run_id long, id long, section_id long, role string, firstname string, lastname string, name string"),
    ("elsevier", "journals"): ([("/b", "Same", "1"), ("/a", "Same", "2")], "href string, title string, issn string"),
    ("elsevier", "authors"): ([("a1", "J", "1", "given-name", "Ada"), ("a1", "J", "1", "surname", "Moss"), ("a1", "J", "2", "surname", "Only")], "`$_id` string, `$_journal` string, article_author_id string, property string, value string"),
    ("elsevier", "dates"): ([("a1", "J", "Received", "1 March 2020"), ("a1", "J", "Accepted", "2020-03-11"), ("a1", "J", "Revised", "soon"), ("a1", "J", "Publication date", "1 May 2020")], "`$_id` string, `$_journal` string, type string, value string"),
    ("core", "conf_ranks"): ([("T", "A1", "A*", "none"), ("U", "B1", "B", "https://dblp.uni-trier.de/db/conf/u"), ("V", "C1", "C", "x")], "Title string, Acronym string, Rank string, DBLP string"),
    ("core", "jnl_ranks"): ([("T", "A", "https://dblp.uni-trier.de/db/journals/t"), ("U", "A", None)], "Title string, Rank string, DBLP string"),
    ("core", "manual_dblp_url"): ([("T", "A1", "https://dblp.uni-trier.de/db/conf/t/index.html")], "title string, acronym string, dblp_url string"),
    ("dblp_api", "document"): ([("k1", "e1", "Lecture Notes in Computer Science", None, None), ("k1", "e1", None, "Lecture Notes in Computer Science", None), ("k2", None, "Lecture Notes in Computer Science", None, None), ("k3", "e3", "Other", None, None)], "info_key string, info_ee string, info_venue string, info_venue_0 string, info_venue_1 string"),
    ("dblp_api", "manual_dblp_api_document"): ([("k1", "e1", "LNCS"), ("k9", "e9", "LNCS"), ("k8", "e8", "X")], "dblp_key string, url string, type string"),
    ("dblp", "ee"): ([("v", "ee", "1", "1", "article", "https://doi.org/10.1/a"), ("v", "ee", "2", "2", "article", "http://arxiv.org/abs/2"), ("v", "ee", "3", "3", "article", "https://www.wikidata.org/Q3"), ("v", "ee", "4", "4", "article", "http://ieeexplore.ieee.org/4"), ("v", "ee", "5", "5", "article", "http://host.org/p/q"), ("v", "ee", "6", "6", "article", "http://arxiv.org/abs/6")], "`$_valid_on` string, `$_object_type` string, `$_object_id` string, `$_parent_object_id` string, `$_parent_object_type` string, ee string"),
    ("dblp", "article"): ([("article", "1", "k1", None), ("article", "5", "k5", None), ("article", "7", "k7", None)], "`$_object_type` string, `$_object_id` string, key string, publtype string"),
    ("dblp", "inproceedings"): ([("inproceedings", "1", "i1", None)], "`$_object_type` string, `$_object_id` string, key string, publtype string"),
    ("dblp", "incollection"): ([], "`$_object_type` string, `$_object_id` string, key string, publtype string"),
    **{("dblp", c): ([("article", "1", f"{c}1"), ("inproceedings", "1", f"{c}i")] if c != "year" else [("article", "1", "2019"), ("article", "5", "2019"), ("article", "7", "2019"), ("inproceedings", "1", "2021")], f"`$_parent_object_type` string, `$_parent_object_id` string, {c} string") for c in ("year", "journal", "volume", "pages", "number", "booktitle", "crossref")},
    ("dblp", "title"): ([("article", "1", "One."), ("article", "5", "Five."), ("article", "7", "Seven"), ("inproceedings", "1", "In.")], "`$_parent_object_type` string, `$_parent_object_id` string, title string"),
    ("dblp", "url"): ([("inproceedings", "1", "db/x", None)], "`$_parent_object_type` string, `$_parent_object_id` string, url string, type string"),
    ("arxiv", "document"): ([("http://arxiv.org/abs/2", "10.2/z", "None", "SUCCEEDED"), ("http://arxiv.org/abs/6", "None", "None", "SUCCEEDED")], "`$_dblp_ee` string, doi string, journal_ref string, `$_api_status` string"),
    ("wikidata", "document"): ([("https://www.wikidata.org/Q3", "10.3/w")], "url string, doi string"),
    ("ieee_explore", "document"): ([("4", "10.4/i")], "`$_dblp_document_id` string, doi string"),
    ("aminer", "paper"): ([("x1", "10.1/a", "other"), ("x5", None, "Five")], "id string, doi string, title string"),
    ("springer_lncs", "bus_author"): ([("s1", "o", "e", "Zoë Łis"), ("s2", None, None, "Ben")], "surrogate_id string, orc string, email string, name string"),
    ("springer_lncs", "bus_chapter"): ([("7ee24f6cab16b5ad9a53b7a4b3ad8d3c", "T1", "d")], "surrogate_id string, title string, doi string"),
    ("springer_lncs", "bus_author_chapter"): ([("p2", "s2")], "`$_paper_url` string, author_surrogate_id string"),
    ("lncs_front_matter", "bus_member"): ([("m1", "Ben"), ("m2", "Only")], "surrogate_id string, name string"),
    ("staging", "stg_article"): ([("h1", "b1", None, "t", 1, "j", "v", "p", "n")] * 2, "article_hash_key string, article_business_key string, publtype string, title string, year int, journal string, volume string, pages string, number string"),
    ("staging", "stg_article_doi"): ([("h1", "l", "t", "d")] * 2, "article_hash_key string, doi_link string, doi_type string, doi string"),
    ("staging", "stg_person"): ([("b", "h", "n", None), ("b", "h", "n", "o")], "person_business_key string, person_hash_key string, name string, orcid string"),
    ("staging", "stg_article_person"): ([("h1", "h"), ("h1", "h"), ("h1", None)], "article_hash_key string, person_hash_key string"),
}


@pytest.fixture(scope="module")
def run(spark):
    return registry.run(spark, lambda schema, name: spark.createDataFrame(*TABLES[schema, name]))


def got(run, name, *columns):
    return sorted((tuple(r) for r in run.done[name].select(*[f"`{c}`" for c in columns]).collect()), key=str)


def test_every_model_runs(run):
    for name, df in run.done.items():
        assert df.collect() is not None, name


def test_persons_share_a_page(run):
    assert got(run, "stg_dblp_person", "dblp_name", "dblp_orcid", "dblp_unique_person_key") == [("A. Moss", "o-a", "homepages/a"), ("Ada", "o-a", "homepages/a"), ("Ben", "o-b", "Ben"), ("Cleo", None, "Cleo")]
    assert len(got(run, "stg_dblp_article_person", "dblp_object_key")) == 5


def test_publications(run):
    assert got(run, "stg_dblp_article", "dblp_object_id", "dblp_title", "dblp_year", "dblp_pages", "dblp_publtype") == [(1, "One", 2020, "1-2", None), (2, "Two", 2020, None, "x"), (3, "Three", None, None, None)]
    assert got(run, "stg_dblp_doi", "dblp_object_key", "dblp_doi") == [("journals/cacm/B2", "10.1/b"), ("journals/tois/A1", "10.1/a")]


def test_board(run):
    assert got(run, "clean_editorial_board", "editorial_board_id", "name") == [(1, "Ada"), (2, "Zoe")]
    subset = got(run, "acm_analysis_subset", "editor_name", "publication_year", "count_distinct_coauthor_out_journal", "count_distinct_coauthor_in_journal", "count_distinct_articles")
    assert subset == [("Ada", 2020, 1, 1, 2), ("Zoe", None, 0, 0, 0)]
    assert got(run, "coauthors_z_score", "editor_name", "cnt_coauthor_total", "cnt_coauthor_diff", "perc_coauthors_inside_journal", "z_score") == [("Ada", 2, 0, 50.0, None)]
    assert got(run, "co_author_pub_hist", "editor_name", "cnt_articles", "cnt_unique_coauthor")[0] == ("Ada", 1, 1)
    assert len(got(run, "board_dblp_articles", "acm_name")) == 3 * 2 + 1 + 1


def test_committee(run):
    assert got(run, "validation", "file_id", "file_pass", "section_pass", "section_interested") == [(1, 0, None, None), (1, 1, "PASS", 0), (1, 1, "PASS", 1), (2, 0, None, None), (3, 0, None, None)]
    assert got(run, "stg_lncs_fm_member_book", "member_name", "book_filename", "role") == [(n, "conf_x_2019.pdf", "program committee") for n in ("A. Moss", "Ada Moss", "Ben Brook")]
    assert got(run, "analysis_lncs_members_publishing", "book_dblp_key", "member_name", "cnt_articles_written_in_book", "mad", "ratio") == [("conf/x/2019", "A. Moss", 0, 1.0, 1.0), ("conf/x/2019", "Ada Moss", 2, 1.0, 1.0), ("conf/x/2019", "Ben Brook", 1, 1.0, 0.0)]
    assert got(run, "analysis_lncs_members_citations", "member_name", "cnt_author_cited_in_book") == [("A. Moss", 2), ("Ada Moss", 0), ("Ben Brook", 0)]
    assert got(run, "analysis_lncs_members", "member_name", "book_dblp_key_conf", "cnt_published", "cnt_cited")[0] == ("A. Moss", "x", 0, 2)
    metrics = dict(got(run, "run_performance_metrics", "metrics", "count"))
    assert metrics["# files failed (no organisation position found)"] == 1 and metrics["# members of interest extractable (program committee)"] == 3 and metrics["# interesting parseable sections"] == 1


def test_authors_are_resolved(run):
    a = got(run, "stg_lncs_author", "name", "orc", "email")
    assert ("Zoë", "o/9", None) in a and ("Ada Moss", "o/1", "a@x") in a and ("Ben Brook", None, "B@x") in a
    c = {(u, n): s for u, n, s in got(run, "stg_lncs_author_chapter", "$_paper_url", "doc_person_id", "author_surrogate_id")}
    assert c["p1", "1"] == c["p2", "1"] and c["p2", "2"]


def test_lags_rankings_and_links(run):
    assert got(run, "analysis_set_raw", "author_name", "year_pub", "publication_lag") == [("Ada Moss", 2020, 10), (None, 2020, 10)]
    assert got(run, "conferences", "title", "dblp_key") == [("T", "conf/t"), ("U", "conf/u")]
    assert got(run, "cln_jnl_ranks", "dblp_key") == [("journals/t",)] and got(run, "lncs", "dblp_key") == [("k1",), ("k9",)]
    assert got(run, "article_metadata_input", "id", "href") == [(1, "/a"), (2, "/b")]
    assert got(run, "doi", "doi") == [("10.1/a",), ("10.2/z",), ("10.3/w",), ("10.4/i",)]
    assert got(run, "unmatched_titles", "title") == [("Seven",)]
    assert got(run, "doi_completeness", "ee_type", "cnt") == [("arxiv", 1), ("unknown", 1)] and got(run, "hosts_without_doi", "x") == [("host.org",)]
    assert got(run, "clean_name", "clean_name") == [("Ben",), ("Zoe Lis",)]
    assert len(got(run, "publication", "title")) == 4 and len(got(run, "lnk_article_person", "lnk_hash_key")) == 2


def test_checks_report(run):
    bad = {(r["model"], r["check"]): r["violations"] for r in registry.violations(run).collect() if r["violations"]}
    assert bad == {("lan_year", "not_null(year)"): 1}


def test_written_tables_and_order(spark):
    r = registry.run(spark, lambda s, n: spark.createDataFrame(*TABLES[s, n]), ["stg_dblp_doi"], write=True, namespace=lambda s: f"test_{s}")
    assert spark.table("test_dblp_dump.stg_dblp_doi").count() == 2 and set(r.done) == {"lan_article", "lan_inproceedings", "lan_incollection", "cte_scope", "lan_ee", "stg_dblp_doi"}
    assert registry.order(["cte_scope"])[-1] == "cte_scope" and "acm_analysis_set" in registry.tagged("acm")
    x = Registry()
    x.model("b")(type("a", (), {"__name__": "a"}))
    with pytest.raises(KeyError):
        x.order()
