"""Operators on small frames with nulls, ties, repeated rows and groups of one."""

import pytest
from pyspark.sql import functions as F

from scholion.operators import checks, graph, lines, matching, stats
from scholion.sources import sinks, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_mad_of_even_odd_and_single_groups(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 5), ("c", 1), ("c", 3), (None, 9)], "k string, x int")
    got = {(r["k"], r["x"]): r for r in stats.mad_outliers(d, ["k"], "x").collect()}
    assert got["a", 4]["median"] == 2 and got["a", 4]["mad"] == 1 and got["a", 4]["ratio"] == 3
    assert got["b", 5]["deviation"] is None and got["b", 5]["mad"] == 0 and got["b", 5]["ratio"] == 5
    assert got["c", 1]["median"] == 2 and (None, 9) not in got


def test_modes(spark):
    d = spark.createDataFrame([("a", 3, 1), ("a", 2, 1), ("a", 2, 1), ("a", 3, 1), ("b", 1, 1), ("b", 7, 5)], "k string, x int, w int")
    assert rows(stats.modes(d, ["k"], "x").select("k", "mode")) == [("a", 2), ("b", 1)]
    assert rows(stats.modes(d, ["k"], "x", "w").select("k", "mode")) == [("a", 2), ("b", 7)]
    d = spark.createDataFrame([([1],), ([1, 2, 2],), ([1, 3, 2, 3, 2, 3],), ([3, 2, 2, 3],), ([],)], "v array<int>")
    assert [r[0] for r in d.select(stats.mode_of(F.col("v"))).collect()] == [1, 2, 3, 2, 0]


def test_ranges(spark):
    d = spark.createDataFrame([([2, 1, 3, 6, 5, 7],), ([1, 3, 2, 5, 7, 6],), ([8, 1, 6, 3, 7, 2],), ([0, 11, 47],), ([],)], "v array<int>")
    got = d.select(F.size(lines.raw_ranges(F.col("v"))), F.size(lines.clean_ranges(F.col("v")))).collect()
    assert [tuple(r) for r in got] == [(2, 2), (4, 2), (4, 2), (3, 3), (0, 0)]


def test_cascade(spark):
    a = spark.createDataFrame([(1, "d1", "T."), (2, None, "U."), (3, "d9", "V"), (4, None, None), (None, "d1", "T")], "id int, doi string, title string")
    b = spark.createDataFrame([(10, "d1", "x"), (20, None, "U"), (30, None, None)], "bid int, bdoi string, btitle string")
    bare = lambda c: F.replace(F.col(c), F.lit("."), F.lit(""))
    found, rest = matching.cascade(a, b, "id", "bid", [(F.col("doi"), F.col("bdoi")), (bare("title"), bare("btitle"))])
    assert {(r["left_id"], r["right_id"], r["step"]) for r in found.collect() if r["left_id"]} == {(1, 10, 0), (2, 20, 1)}
    assert {r["id"] for r in rest.collect()} == {3, 4, None}


def test_branches(spark):
    a = spark.createDataFrame([(1, "o1", "m9", "n1"), (2, None, "m1", "n1"), (3, None, None, "n1"), (4, "ox", "m1", "n1"), (3, None, None, "n1")], "id int, orc string, email string, name string")
    k = spark.createDataFrame([("o1", "m1", "n1", "p"), ("o1", "m2", "n1", "p")], "orc string, email string, name string, person string")
    assert rows(matching.by_branches(a, k, ["orc", "email", "name"], "person", ["id"])) == [(1, "p"), (2, "p"), (3, "p"), (4, None)]


def test_merged_and_settled(spark):
    a = spark.createDataFrame([(1, "x", 1), (None, "n", 0)], "k int, n string, u int")
    b = spark.createDataFrame([(1, "y", 5), (2, "z", 6)], "k int, n string, v int")
    assert rows(matching.merged(a, b, "k", ["n"])) == [(1, "x", 1, 5), (2, "z", None, 6), (None, "n", 0, None)]
    d = spark.createDataFrame([("p", None), ("p", "b"), ("p", "a"), (None, "q")], "k string, v string")
    assert rows(matching.settled(d, F.col("k"), "v", "s").select("k", "s")) == [("p", "a")] * 3 + [(None, "q")]


def test_not_in(spark):
    d = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some = spark.createDataFrame([(2,)], "v int")
    assert rows(tables.not_in(d, "k", some)) == [(1,)]
    assert rows(tables.not_in(d, "k", spark.createDataFrame([(2,), (None,)], "v int"))) == []
    assert rows(tables.unseen(d, some.toDF("k"), "k")) == [(1,), (None,)]
    assert tables.unseen(d, None, "k").count() == 3


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_numbered(spark, n):
    d = spark.range(n).select(F.xxhash64("id").alias("a"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("b"))
    got = sinks.numbered(d, "n", "b", "a", range_rows=190).collect()
    assert sorted(r["n"] for r in got) == list(range(1, n + 1))
    order = sorted(got, key=lambda r: (r["b"] is not None, r["b"] or 0, r["a"]))
    assert [r["n"] for r in order] == list(range(1, n + 1))


def test_coauthors_leave_the_editor_out(spark):
    editors = spark.createDataFrame([("E", "J", 1), ("F", "K", 9)], "editor string, journal string, person long")
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (2, 2)], "article long, person long")
    articles = spark.createDataFrame([(1, "j", 2020, "A"), (2, "x", 2020, "B")], "article long, venue string, year int, title string")
    seed = spark.createDataFrame([("J", "j")], "journal string, abbreviation string")
    r = graph.coauthor_counts(graph.coauthor_rows(editors, edges, articles, graph.abbreviation_lists(seed, "journal", "abbreviation")), ["editor", "year"])
    got = {x["editor"]: x for x in r.collect()}
    assert (got["E"]["coauthors_in"], got["E"]["coauthors_out"], got["E"]["articles"]) == (1, 2, 2)
    assert got["F"]["coauthors_out"] == 0 and got["F"]["year"] is None


def test_sections(spark):
    x = [(0, "Intro", 10.0, False), (1, "Organization", 14.0, False), (2, "and People", 14.0, False), (3, "Program Committee", 12.0, False), (4, "a b", 10.0, False), (5, "Chairs", 10.0, True), (6, "c d e f g h i j k", 10.0, False), (7, "Other", 14.0, False), (8, "z", 9.0, False), (9, "ORGANIZATION mark", 10.0, False)]
    d = spark.createDataFrame([("d", n, t, s, b, len(t)) for n, t, s, b in x], "doc string, line_no int, text string, scale double, bold boolean, n_chars int")
    s = lines.parents(lines.sections(d, "mark"))
    got = {r["idx"]: r for r in s.collect()}
    assert [got[k]["title"] for k in sorted(got)] == ["", "Organization and People", "Program Committee", "Chairs", "Other"]
    assert [got[k]["parent"] for k in (1, 2, 3, 4)] == [0, 1, 2, 0] and got[2]["content"] == ["a b"] and got[4]["content"] == []
    assert sorted(r["idx"] for r in lines.subtree(s, "organization").collect()) == [1, 2, 3]
    assert lines.failures(s, "nowhere").first()["status"] == "FAILED" and lines.failures(s, "organization").first()["status"] == "SUCCEEDED"


def test_checks(spark):
    d = spark.createDataFrame([(1, None), (1, "a"), (None, "a"), (None, "a")], "k int, v string")
    assert rows(checks.repeated(d, "k")) == [(1, 2)]
    assert {r["check"]: r["violations"] for r in checks.report(d, [["k"], ["k", "v"]], ["v"]).collect()} == {"unique(k)": 1, "unique(k, v)": 1, "not_null(v)": 1}
    assert checks.missing(d, "k").count() == 2


def test_sinks(spark, tmp_path):
    sinks.save(spark, "land", "t", [])
    assert not tables.has_table(spark, "land", "t")
    sinks.save(spark, "land", "t", [{"b": "1", "a": 2}, {"a": None}])
    sinks.save(spark, "land", "t", [{"c": "x"}])
    assert tables.column_info(spark, "land", "t") == {"a": "string", "b": "string", "c": "string"}
    assert rows(spark.table("land.t")) == [("2", "1", None), (None, None, "x"), (None, None, None)]
    assert sinks.widths(spark.table("land.t")).first().asDict() == {"a": 1, "b": 1, "c": 1}
    sinks.reload(spark.range(2), "land", "t")
    assert tables.records(spark.table("land.t").orderBy("id")) == [{"id": 0}, {"id": 1}] and tables.exists(spark.table("land.t"))
    sinks.drop(spark, "land", "t", "never")
    assert not tables.has_table(spark, "land", "t") and tables.has_schema(spark, "land")
    files = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.pdf", None)], "filename string, content binary")
    assert [(r["filename"], r["status"]) for r in sorted(sinks.write_files(files, str(tmp_path / "f")).collect())] == [("a.pdf", "SUCCEEDED"), ("b.pdf", "FAILED")]
    assert tables.binaries(spark, str(tmp_path / "f")).first()["length"] == 1


def test_seed_and_pages(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1,\n2,x\n")
    assert rows(tables.seed(spark, str(tmp_path / "s.csv"), ["a", "b"])) == [("1", None), ("2", "x")]
    (tmp_path / "p.html").write_text("<title>x\ny</title>")
    assert tables.pages(spark, str(tmp_path)).first()["html"].startswith("<title>x\ny")


def test_settings_and_lookup(spark, tmp_path):
    (tmp_path / ".env").write_text("# none\n\nA=1\nB = 'x=y'\n")
    assert tables.settings(str(tmp_path / ".env")) == {"A": "1", "B": "x=y"}
    d = spark.createDataFrame([("https://doi.org/10.1/a",), (None,), ("b",)], "ee string")
    assert rows(tables.lookup(d, "ee", "10.1/")) == [("https://doi.org/10.1/a",)]


def test_shares_histogram_and_pivot(spark):
    d = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 3), ("b", "x", None)], "k string, p string, v int")
    assert rows(stats.shares(d, "k")) == [("a", 2, 50.0), ("b", 2, 50.0)]
    assert rows(stats.count_of_counts(d, ["k", "p"], ["p"])) == [("x", 1, 1), ("x", 2, 1), ("y", 1, 1)]
    assert rows(stats.pivot_least(d, ["k"], "p", "v", {"x": "x", "z": "z"})) == [("a", 1, None), ("b", None, None)]
    assert [r["z"] for r in stats.z_scores(d.where("v = 3"), ["k"], "v").collect()] == [None]
    assert rows(lines.islands(spark.createDataFrame([(1,), (2,), (2,), (5,)], "p int").withColumn("g", F.lit("g")), ["g"], "p")) == [("g", 1, 2, 2), ("g", 5, 5, 1)]


def test_not_in_follows_sql(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    left = lambda *v: sorted((r["k"] for r in tables.not_in(rows, "k", values(*v)).collect()), key=str)
    assert left() == [1, 2, None] and left(1, 1) == [2] and left(1, None) == [] and left(None) == [] and left(7) == [1, 2]


def test_numbers_over_several_ranges(spark):
    d = spark.range(3000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b")).repartition(6)
    got = sinks.numbered(d, "n", "a", "b", range_rows=100).collect()
    key = lambda r: (r["a"], r["b"] is not None, r["b"] or 0)
    assert [r["n"] for r in sorted(got, key=lambda r: (key(r), r["n"]))] == list(range(1, 3001))
    assert sinks.numbered(d.limit(0), "n", "a").count() == 0


def test_status_updates(spark):
    rows = spark.createDataFrame([(1, "NEW", None), (2, "NEW", "m"), (None, "NEW", "x")], "id long, status string, message string")
    new = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (9, "C", 1), (None, "D", 1)], "id long, status string, at int")
    got = sorted((tuple(r) for r in sinks.merged_by_key(rows, new, "id").collect()), key=str)
    assert got == sorted([(1, "B", None), (2, "NEW", "m"), (None, "NEW", "x")], key=str)


def test_widening_and_order(spark):
    d = spark.createDataFrame([(2, "7"), (1, "x")], "id int, t string")
    sinks.clustered(d, "wide", "t", "id", unique=True)
    sinks.widen(spark, "wide", "t", "id", "bigint")
    sinks.describe(spark, "wide", "t", "it's a table", t="a \\ text")
    assert dict(spark.table("wide.t").dtypes)["id"] == "bigint" and spark.table("wide.t").count() == 2
    assert [c.description for c in spark.catalog.listColumns("wide.t") if c.name == "t"] == ["a \\ text"]
    with pytest.raises(ValueError):
        sinks.widen(spark, "wide", "t", "t", "int")
    with pytest.raises(ValueError):
        sinks.clustered(d.unionByName(d), "wide", "u", "id", unique=True)
    sinks.drop(spark, "wide", "t")


def test_parents_of_deep_sections(spark):
    weights = [5, 3, 1, 1, 2, 4, 3, 6, 1, 5]
    d = spark.createDataFrame([("d", 0, None, "t0")] + [("d", k, float(w), f"t{k}") for k, w in enumerate(weights, 1)], "doc string, idx long, weight double, title string")
    got = {r["idx"]: r["parent"] for r in lines.parents(d).collect()}
    want = {k: max((j for j in range(1, k) if weights[j - 1] > w), default=0) for k, w in enumerate(weights, 1)}
    assert got == {0: None, **want}


def test_two_ways_of_counting_coauthors(spark):
    """The summary from the editors' articles equals the counts over all rows, with unknown authors and editors without articles."""
    editors = spark.createDataFrame([("E", "J", 1), ("F", "J", 2), ("G", "K", 9)], "editor string, journal string, person long")
    edges = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (12, 1), (12, None), (13, 2), (13, 3), (13, 1)], "article long, person long")
    articles = spark.createDataFrame([(10, "j1", 2000, "a"), (11, "j1", 2000, "b"), (12, "x", 2000, "c"), (13, "x", 2001, "a")], "article long, venue string, year int, title string")
    abbreviations = spark.createDataFrame([("J", ["j1"])], "journal string, abbreviations array<string>")
    keys = ["editor", "abbreviations", "year"]
    rows = graph.coauthor_counts(graph.coauthor_rows(editors, edges, articles, abbreviations), keys)
    short = graph.coauthor_summary(editors, edges, articles, abbreviations, keys)
    as_set = lambda d: {(r["editor"], tuple(r["abbreviations"] or ()), *r[2:]) for r in d.collect()}
    assert as_set(rows) == as_set(short) and rows.columns == short.columns


def _written(node) -> int:
    """Rows that a plan that ran has shuffled, what is read again counted once."""
    kind = node.getClass().getSimpleName()
    if kind in ("AdaptiveSparkPlanExec", "ReusedExchangeExec"):
        return _written(node.executedPlan()) if kind.startswith("A") else 0
    if kind.endswith("QueryStageExec"):
        return _written(node.plan())
    own, children = node.metrics().get("shuffleRecordsWritten"), node.children()
    return (own.get().value() if own.isDefined() else 0) + sum(_written(children.apply(k)) for k in range(children.size()))


def test_members_are_measured_without_a_row_for_each_coauthor(spark):
    """The same as over all rows, for members of several persons, persons of several members, keys of several numbers, and unknowns."""
    editors = spark.createDataFrame([("E", "J"), ("E", "K"), ("E", None), ("F", "J"), ("G", "J"), ("H", "K"), (None, "K")], "member string, journal string")
    names = spark.createDataFrame([("E", "e1"), ("E", "e2"), ("F", "f"), ("G", "f"), ("X", "x"), ("Y", "y"), ("Y2", "y"), ("Y2", "y"), ("Z", None), (None, "n")], "name string, person string")
    by = {10: "EFX", 11: ["E", "Y", "Y2"], 12: "E", 13: "FG", 14: ["X", "E", None], 15: "FXZQ", 16: ["F", "Y"], 17: ["F", "X"], 18: ["X", "Y"], 19: ["F", "X"]}
    written = spark.createDataFrame([(i, n) for i, ns in by.items() for n in ns] + [(10, "X"), (None, "E")], "id int, name string")
    rows = [(10, "j/J1/a", "a", 2000), (11, "j/J1/b", "a", 2000), (12, "j/J1/c", "a", 2000), (13, "j/J1/d", "a", 2001), (14, "j/K1/e", "p", 2000), (14, "j/K1/e", "a", 2000), (15, "j/J1/f", "a", None), (16, "j/J1/g", "a", 2000), (17, "j/J1/g", "a", 2000), (17, "j/J1/g", "p", 2001), (19, None, "a", 2000), (10, "j/J1/a", "a", 2000)]
    publications = spark.createDataFrame(rows, "id int, article string, kind string, pub_year int").withColumn("venue", F.split_part("article", F.lit("/"), F.lit(2)))
    abbreviations = spark.createDataFrame([("J", ["J1"]), ("K", ["K1", "K2"])], "journal string, abbreviations array<string>")
    edges = publications.join(written, "id").join(names, "name").select("article", "person").distinct()
    articles = publications.select("article", "venue", F.col("pub_year"), "kind").distinct()
    board = editors.join(names.withColumnRenamed("name", "member"), "member").distinct()
    want = graph.coauthor_measures(graph.coauthor_rows(board, edges, articles, abbreviations))
    got = graph.board_measures(editors, names, written, publications, abbreviations).select(want.columns)
    as_rows = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
    assert as_rows(got) == as_rows(want) and len(as_rows(got)) > 12


def test_coauthors_shuffle_a_few_rows_for_each_author(spark):
    from helpers import DATA

    from scholion.plans import queries as q

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for n in names:
            spark.conf.set(n, "-1")
        out = q.QUERIES["model_coauthors"](spark, DATA)
        out.collect()
    finally:
        for n in names:
            spark.conf.unset(n)
    assert 0 < _written(out._jdf.queryExecution().executedPlan()) < 6 * spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_keys_that_many_share_unfold_after_the_last_shuffle(spark):
    """Each row once, where rows, keys or both repeat; what a shared key unfolds into isn't shuffled."""
    from scholion.operators import matching

    a = [("p", 1, None, "e", None), ("p", 1, None, "e", None), ("p", 1, "o", "e", None), ("q", 1, "none", "e", None), ("q", 1, None, None, "N"), ("r", None, None, None, "n"), ("r", None, None, None, None), ("s", 1, None, "no", "n"), ("s", 1, None, "na", "n")]
    rows = spark.createDataFrame(a + [(f"x{n}", n, None, "e", None) for n in range(60)], "paper string, who int, o string, e string, n string")
    known = spark.createDataFrame([("o", "e", "n", "s1"), ("o", None, None, "s1"), (None, "e", None, "s2"), (None, None, "n", "s2")] + [(None, "e", None, f"t{n}") for n in range(50)] * 2, "o string, e string, n string, s string")
    out = matching.by_branches(rows, known, ["o", "e", "n"], "s", ["`paper`", "who"])
    rest = {f"t{n}" for n in range(50)}
    want = [("p", 1, s) for s in {"s1", "s2"} | rest] + [("q", 1, None), *[("r", None, s) for s in ("s1", "s2")], ("s", 1, None)] + [(f"x{n}", n, s) for n in range(60) for s in {"s1", "s2"} | rest]
    assert out.columns == ["paper", "who", "s"] and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert 0 < _written(out._jdf.queryExecution().executedPlan()) < 60 * 50


def test_rows_are_shuffled_once_where_few_are_known(spark):
    """Chapters' authors by several keys: no shuffle of line items to meet suppliers, names or surrogates, whatever Spark would broadcast by itself."""
    from helpers import DATA

    from scholion.plans import queries as q

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for n in names:
            spark.conf.set(n, "-1")
        out = q.QUERIES["model_stg_lncs_author_chapter"](spark, DATA)
        out.collect()
    finally:
        for n in names:
            spark.conf.unset(n)
    assert 0 < _written(out._jdf.queryExecution().executedPlan()) < 1.5 * spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_surrogates_are_the_same_where_many_are_known(spark, monkeypatch):
    """Beyond the rows that are broadcast, rows are shuffled again to meet what is known."""
    from scholion.operators import matching

    a = [("p", "o", "e"), ("p", None, "e"), ("q", None, "none"), ("q", None, "none"), ("r", None, None), *[(f"x{n}", None, "e") for n in range(20)]]
    rows = spark.createDataFrame(a, "paper string, o string, e string")
    known = spark.createDataFrame([("o", "e", "s1"), (None, "e", "s2"), (None, "e", "s2")], "o string, e string, s string")
    want = sorted([("p", "s1"), ("p", "s2"), ("q", None), *[(f"x{n}", s) for n in range(20) for s in ("s1", "s2")]], key=str)
    for few in (matching.FEW, 0):
        monkeypatch.setattr(matching, "FEW", few)
        out = matching.by_branches(rows, known, ["o", "e"], "s", ["paper"])
        assert sorted(map(tuple, out.collect()), key=str) == want


def test_authors_who_share_an_email_form_no_pairs(spark):
    """One row for each ORCID of an email, in all its spellings; a name that an ORCID lacks comes from everyone who shares the email."""
    from scholion.plans.catalogue import registry

    a = [("P", "E@x", "o1"), (None, "e@x", "o2"), ("T", None, "o3"), ("Q", "e@x", None), ("R", "e@X", None), (None, "e@x", None), ("S", "s@x", None), ("S", None, None), ("Q", None, None), ("U", None, None)]
    a += [(f"n{n}", "e@x", None) for n in range(200)] + [(f"k{n}", "e@x", f"k{n}") for n in range(200)]
    tables = {"author": spark.createDataFrame(a, "name string, email string, orc string"), "manual_author": spark.createDataFrame([], "name string, email string, orc string")}
    out = registry.run(spark, lambda schema, name: tables[name], ["stg_lncs_author"]).done["stg_lncs_author"]
    got = {(r["name"], r["email"], r["orc"]) for r in out.collect()}
    shared = {"e@x", "e@X"}
    want = {(n, e, o) for n, e, o in a if o} | {(n, e, o) for n, o in [("P", "o1"), *[(f"k{n}", f"k{n}") for n in range(200)]] for e in shared} | {("T", None, "o3"), ("S", "s@x", None), ("U", None, None)}
    want |= {(n, e, "o2") for n, e, o in a if e in shared and not o} | {("Q", "e@x", "o2")}
    assert got == want and out.count() == len({(r["surrogate_id"], *k) for r in out.collect() for k in [(r["name"], r["email"], r["orc"])]})
    assert 0 < _written(out._jdf.queryExecution().executedPlan()) < 200 * 200
