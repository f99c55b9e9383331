"""Quality rules, URL filters, sharding, the classifier and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from scholion.llm import crf
from scholion.llm import queries as q
from scholion.llm import quality_rules as rules
from scholion.llm.sharding import shard
from scholion.llm.url_filter import DigestArray, filter_urls


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_base(text):
    t = text or ""
    w = split(t)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = Counter(grams)
    again = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if split(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))


def test_base_measures(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.base_measures(docs).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def plain_frequency(rows, share, least, remain):
    """(id, kept by lines alone) by counting in plain Python; each row is a document."""
    lines = [[re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ") for x in (t or "").split("\n")] for _, t, _ in rows]
    lines = [[x for x in ls if x] for ls in lines]
    docs = Counter(s for (_, _, s), ls in zip(rows, lines, strict=True) if ls)
    count = Counter((s, x) for (_, _, s), ls in zip(rows, lines, strict=True) for x in set(ls))
    out = []
    for (i, _, s), ls in zip(rows, lines, strict=True):
        hit = [x for x in ls if count[s, x] > least and count[s, x] > share * docs[s]]
        total, gone = (sum(len(x.split(" ")) for x in some) for some in (ls, hit))
        out.append((i, len(ls), len(hit), total, gone, bool(hit) and (total - gone < remain * total or total - gone < 10)))
    return sorted(out, key=str)


def test_line_frequency(spark):
    nav, own = "Home | About  us", "unique text number {} with some more words of its own"
    rows = [(i, f"{nav}\n{own.format(i)}" if i < 30 else f"{nav}\n{nav.lower()}\nx{i}" if i < 40 else "only own words here", "a") for i in range(60)] + [(100, nav, "b"), (101, None, "b"), (102, nav, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r for r in rules.quality_rules(d, least=25, share=0.1).collect()}
    assert not any(got[i]["depleted"] for i in range(30)) and all(got[i]["depleted"] for i in range(30, 40))
    assert not got[100]["depleted"] and not got[101]["kept"] and not got[102]["depleted"]
    clean = {r["doc_id"]: r["clean_text"] for r in rules.clean_texts(d, least=25, share=0.1).collect()}
    assert clean[3] == own.format(3) and clean[35] == "x35" and clean[100] == nav and clean[101] == ""
    found = [tuple(r) for r in rules.line_frequency(d, least=25, share=0.1).collect()]
    assert sorted(found, key=str) == plain_frequency(rows, 0.1, 25, 0.5)


def test_rows_are_judged_by_themselves(spark):
    """Rows without an id or with a shared one don't meet each other's lines."""
    nav = "the same line of navigation on every page of this host"
    clean = "a clean document of more than ten words that stands for itself alone {}"
    rows = [(None if i % 2 else 7, f"{nav}\nx{i}" if i < 20 else clean.format(i), "h") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = rules.quality_rules(d).collect()
    assert len(got) == 40 and sum(r["kept"] for r in got) == 20 and all(r["kept"] != r["depleted"] for r in got)
    assert sorted((tuple(r) for r in rules.line_frequency(d).collect()), key=str) == plain_frequency(rows, rules.SHARE, rules.LEAST_DOCS, rules.REMAIN)
    assert rules.clean_texts(d).count() == 40


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lines_reject_documents_that_base_rules_keep(spark, sf):
    got = rules.quality_rules(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("NOT base_failed AND NOT kept").collect()
    assert got and all(r["depleted"] and r["frequent_words"] > 0 for r in got)


def test_quality_rules_edges(empty, docs, texts):
    assert rules.quality_rules(empty).count() == 0
    assert sorted(r["doc_id"] for r in rules.quality_rules(docs).collect()) == list(range(len(texts)))


@pytest.mark.parametrize("name", ["op4_sharding", "op6_quality_rules"])
def test_native_plans(spark, name, monkeypatch):
    """Neither the plan nor the lineage of what runs has Python in it, in the result and in all tables written before."""
    from scholion.llm import common, quality_rules, sharding

    seen = []

    def noted(df, *a):
        seen.append(df)
        return common.written(df, *a)

    for m in (quality_rules, sharding):
        monkeypatch.setattr(m, "written", noted)
    seen.append(q.QUERIES[name](spark, DATA))
    assert len(seen) > 3
    for df in seen:
        run = df._jdf.queryExecution()
        assert not re.search("Python|Pandas|Arrow(?!Eval)", run.toString())
        assert "PythonRDD" not in run.toRdd().toDebugString()


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def plain_url(url, blocked=()):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in RULES:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and host and (best is None or len(r) > len(best)):
            best = r
    own = any(host == b or host.endswith("." + b) for b in blocked)
    return host, path, best, RULES[best] if best else "block" if own else "allow"


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://example.com/en", "http://xexample.com/en/1", "x://b.net/es/1", "ftp://net/fr/", "http://net/frx", "http://bad.org/", "http://a.bad.org?x", "http://notbad.org/", None, "", "nohost", "http://", "http:///en/", "http://é.com/é", "http://com/", "http://a.net#/es/", "http://example.com\n/en/", "a://b://c.com/en/"]
    d = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(d, q.URL_RULES, ["bad.org"]).collect()}
    assert got == {i: plain_url(u, ["bad.org"]) for i, u in enumerate(urls * 2)}
    assert filter_urls(d.limit(0), q.URL_RULES).count() == 0 and filter_urls(d, []).count() == len(urls) * 2


def test_digests_are_confirmed(tmp_path, monkeypatch):
    """Strings of one digest are told apart by themselves."""
    monkeypatch.setattr("scholion.llm.url_filter.xxhash.xxh64_intdigest", lambda s: len(s) % 2)
    DigestArray.write(str(tmp_path / "d"), [("aa", True), ("bb", False), ("ccc", True), ("aa", False)])
    d = DigestArray(str(tmp_path / "d"))
    at = d.find(["bb", "aa", "zz", "c", "ccc"])
    assert [d.string(i) if i >= 0 else None for i in at] == ["bb", "aa", None, None, "ccc"]
    assert [bool(d.verdicts[i]) for i in at if i >= 0] == [False, False, True]


def test_long_lists(spark):
    """A million listed hosts, taken from a table; the few that are asked for are found."""
    names = spark.range(1_000_000).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(".example.org")).alias("host"), F.lit(1).alias("n"))
    urls = [f"http://a.host{k}.example.org/x" for k in (0, 5, 999_999)] + ["http://host1000000.example.org/", "http://example.org/", None]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(d, [], names.unionByName(names.limit(3)).unionByName(spark.createDataFrame([(None, 1)], "host string, n int"))).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def check_shards(rows, texts, shards):
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    loads = Counter({s: 0 for s in range(shards)})
    slots = {}
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 16, zlib.crc32(t), "bytes") and 0 <= r["shard"] < shards
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_shards(docs, texts):
    rows = shard(docs, 4).collect()
    loads = check_shards(rows, dict(enumerate(texts)), 4)
    assert max(loads.values()) <= 1.1 * sum(loads.values()) / 4


def test_shards_with_a_hot_text(spark):
    texts = {i: "hot " * 50 if i % 3 == 0 else f"text {i} " * (i % 40) for i in range(6000)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    loads = check_shards(shard(d, 8).collect(), texts, 8)
    mean = sum(loads.values()) / 8
    assert max(loads.values()) <= 1.03 * mean and min(loads.values()) >= 0.97 * mean


def test_shards_of_equal_rows(spark):
    """Thousands of rows equal in text and id, or without an id, are subdivided all the same."""
    d = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).cast("long").alias("doc_id"), F.lit("the same text in every row").alias("text"), F.col("id").alias("row")).repartition(5)
    rows = shard(d, 8).collect()
    count = Counter(r["shard"] for r in rows)
    assert len(rows) == 9000 and len({(r["shard"], r["slot"]) for r in rows}) == 9000 and max(count.values()) <= 1.05 * 9000 / 8


def test_shards_with_records_around_the_edge(spark):
    """Records just below and above the size that is placed first."""
    texts = {i: "x" * (400 if i < 20 else 20 + i % 7) for i in range(1500)}
    total = sum(len(t) + 16 for t in texts.values())
    for extra in (-1, 0, 1):
        size = total // (4 * 64) - 16 + extra
        some = texts | {2000 + k: "y" * size for k in range(5)}
        d = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
        loads = check_shards(shard(d, 4).collect(), some, 4)
        assert max(loads.values()) <= 1.05 * sum(loads.values()) / 4


def test_shards_edges(spark, empty):
    assert shard(empty, 3).count() == 0
    d = spark.createDataFrame([(None, None), (None, None), (1, "x"), (1, "x"), (2, "y" * 5000)], "doc_id long, text string")
    rows = shard(d, 3).collect()
    assert len(rows) == 5 and len({(r["shard"], r["slot"]) for r in rows}) == 5
    assert shard(d, 1).count() == 5


def test_shard_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = q.op4_sharding(spark, DATA).collect()
    loads = check_shards(rows, texts, 40)
    most = max(len((t or "").encode()) + 16 for t in texts.values())
    assert max(loads.values()) <= max(1.05 * sum(loads.values()) / 40, most) and all(r["grown_shard"] is None for r in rows)


def test_marginals_are_those_of_all_labellings():
    """Forward and backward against the sum over every labelling of short chains."""
    from itertools import product

    r = np.random.default_rng(3)
    n = [1, 4, 3]
    first, odds, stay = np.cumsum([0, *n]), r.normal(size=sum(n)), 0.7
    good, norm = crf.marginals(odds, first, stay)
    for d in range(3):
        x = odds[first[d] : first[d + 1]]
        total, each = 0.0, np.zeros(len(x))
        for y in product((0, 1), repeat=len(x)):
            w = np.exp(sum(a for a, k in zip(x, y, strict=True) if k) + stay * sum(a == b for a, b in zip(y, y[1:], strict=False)))
            total += w
            each += w * np.array(y)
        assert np.allclose(good[first[d] : first[d + 1]], each / total) and np.isclose(norm[d], np.log(total))


def test_gradient_is_that_of_the_likelihood():
    """Finite differences of the chains' own likelihood, by some weights and by the score of equal neighbours."""
    texts = ["a b c\nd e\n!!! ###\nlong words here indeed", "x", "UP UP\n1234\n1234", "good text in a line\nmore of it\nand more"]
    features, _, first = crf.line_features(pa.array(texts))
    target = crf.Likelihood(features, first, np.array([1, 0, 0, 1]), np.array([0.25, 0.4, 0.1, 0.25]))
    r = np.random.default_rng(4)
    weights, stay, step = r.normal(size=crf.WIDTH), 0.8, 1e-5
    g = target.gradient(weights, stay)
    for k in [*np.unique(features[features >= 0])[::5], crf.WIDTH - 1]:
        d = np.zeros(crf.WIDTH)
        d[k] = step
        assert np.isclose((target.value(weights + d, stay) - target.value(weights - d, stay)) / (2 * step), g[k], atol=1e-7)
    assert np.isclose((target.value(weights, stay + step) - target.value(weights, stay - step)) / (2 * step), g[-1], atol=1e-7)


def test_agreement_of_neighbours():
    good, agree, _ = crf.chains(np.zeros(5), np.array([0, 2, 5]), 1.0)
    assert np.allclose(agree[[1, 3, 4]], 1 / (1 + np.exp(-1))) and agree[0] == agree[2] == 0 and np.allclose(good, 0.5)


def test_training_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(1, 80)] + [(3, "again " * 90)] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 80)], "doc_id long, quality int")
    seen = []

    def fit(texts, y):
        seen.append((len(texts), texts.nbytes))
        return crf.Model(np.zeros(crf.WIDTH), 1.0)

    import unittest.mock

    with unittest.mock.patch.object(crf, "fit", fit):
        crf.train(docs, labels, most=10, most_bytes=5500)
    assert seen[0][0] <= 10 and 0 < seen[0][1] <= 6000


def test_line_features_of_edges():
    f, length, first = crf.line_features(pa.array(["a b\n\n  \nc!", None, "", "\n", "x\nx\n", "UP %% é"]))
    assert np.diff(first).tolist() == [2, 1, 1, 1, 2, 1] and f.max() < crf.WIDTH and (length > 0).all()
    whole = pa.array(["skip", "a b\n\n  \nc!"]).slice(1)
    assert (crf.line_features(whole)[0] == f[:2]).all()


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = crf.train(docs, labels)
    got = {r["doc_id"]: r for r in crf.score(docs, m).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) >= 0.95 and np.mean([a for a, b in held if b]) >= 0.97


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    m = crf.train(docs, labels)
    kept = crf.score(docs.withColumn("score", F.lit("x")), m, keep=True, names=("s", "p"))
    assert kept.count() == docs.count() and kept.columns == [*docs.columns, "score", "s", "p"] and {r["score"] for r in kept.collect()} == {"x"}
    with pytest.raises(AssertionError):
        crf.score(docs.withColumn("Score", F.lit("x")), m, keep=True)
    assert crf.score(empty, m).count() == 0
    for few in (labels.limit(0), labels.where("doc_id = 1")):
        assert crf.score(docs, crf.train(docs, few)).count() == docs.count()


def test_classifier_query(spark):
    got = q.op10_quality_classifier(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and {r["predicted"] for r in got} == {0, 1}
