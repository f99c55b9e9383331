"""Expressions at their edges: nulls, empty strings, missing matches."""

from pyspark.sql import functions as F

from scholion.functions import classify, measures, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_nulls_and_non_matches(spark):
    null = F.lit(None).cast("string")
    r = one(
        spark, a=text.blank_to_null(F.lit("")), b=text.blank_to_null(F.lit("none"), "none"), c=text.concat_skipping_nulls(F.lit("a"), null), d=text.first_group(F.lit("conf/x"), r"(\d+)"),
        e=text.first_group(F.lit("journals/tois/X1"), r"/(\w+)/"), f=text.digest(F.lit("a"), null), g=text.digest(F.lit("a"), F.lit("b")), h=text.first_group(null, "(x)"),
    )
    assert r["a"] is None and r["b"] is None and r["c"] == "a" and r["d"] is None and r["e"] == "tois" and r["f"] is None and r["h"] is None
    import hashlib

    assert r["g"] == hashlib.md5(b"a^b").hexdigest()


def test_links_and_keys(spark):
    r = one(
        spark, a=text.without_scheme(F.lit("https://orcid.org/http://x")), b=text.host_of(F.lit("https://a.b/c/d")), c=text.host_of(F.lit("https://a.b")), d=text.file_of_key(F.lit("conf/x/2019")),
        e=text.key_of_file(F.lit("conf_x_2019.pdf")), f=text.column_key(F.lit(" Online  ISBN ")), g=text.doi_of_link(F.lit("https://doi.org/10.1/x")),
    )
    assert r == {"a": "orcid.org/http://x", "b": "a.b", "c": "", "d": "conf_x_2019.pdf", "e": "conf/x/2019", "f": "online_isbn", "g": "10.1/x"}


def test_names(spark):
    r = one(
        spark, a=text.unaccented(F.lit("Łukasz Müßig-Ñø é")), b=text.same_name(F.lit("JOSÉ Łis"), F.lit("jose lis")), c=text.last_first(F.lit("Kari, Jarkko")), d=text.last_first(F.lit("Kari")),
        e=text.name_and_parenthesis(F.lit("Hongbin Zha (Peking, China) (x)")), f=text.letters_and_spaces(F.lit("O'Neil 2nd")),
    )
    assert r["a"] == "Lukasz Mussig-No e" and r["b"] is True and r["f"] == "ONeil nd"
    assert tuple(r["c"]) == ("Kari", "Jarkko") and tuple(r["d"]) == (None, None) and tuple(r["e"]) == ("Hongbin Zha", "Peking, China")


def test_dates(spark):
    r = one(spark, a=text.free_date(F.lit("1 March 2020")), b=text.free_date(F.lit("2020-03-01")), c=text.free_date(F.lit("soon")), d=text.free_date(F.lit(None).cast("string")))
    assert str(r["a"]) == str(r["b"]) == "2020-03-01" and r["c"] is None and r["d"] is None


def test_classes(spark):
    roles = {"Program Chair": "program chair", "Program Co-Chairs": "-", "Programme committee": "program committee", "External Referees": "reviewer", "Steering Committee": "steering committee", "PC Members": "program committee", "Local": "-", None: "-"}
    d = spark.createDataFrame([(k, v) for k, v in roles.items()], "role string, want string").withColumn("got", classify.role_class("role"))
    assert all(r["got"] == r["want"] for r in d.collect())
    links = [("https://doi.org/10.1/a", "doi_doi.org", "10.1/a"), ("https://dl.acm.org/doi/abs/10.2/b", "doi_acm", "10.2/b"), ("http://arxiv.org/abs/1", "arxiv", None), ("db/x", "unknown", None), (None, "unknown", None)]
    d = spark.createDataFrame(links, "link string, kind string, doi string").withColumn("k", classify.link_class("link")).withColumn("d", classify.doi_in_link("link", "k"))
    assert all(r["k"] == r["kind"] and r["d"] == r["doi"] for r in d.collect())


def test_measures(spark):
    r = one(spark, a=measures.outlier_ratio(F.lit(132), F.lit(1.5)), b=measures.outlier_ratio(F.lit(7), F.lit(0.0)), c=measures.share(F.lit(1), F.lit(0)), d=measures.share(F.lit(1), F.lit(4)), e=measures.z_score(F.lit(1), F.lit(2.0), F.lit(0.0)), f=measures.z_score(F.lit(1), F.lit(2.0), F.lit(None).cast("double")))
    assert r == {"a": 87.0, "b": 7.0, "c": None, "d": 25.0, "e": None, "f": None}
