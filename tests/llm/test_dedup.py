"""Exact dedup, Jaccard join and substring dedup against plain versions."""

import re
from collections import Counter, defaultdict

import pytest
from helpers import DATA, values
from pyspark.sql import functions as F

from scholion.llm import queries as q
from scholion.llm.common import written
from scholion.llm.components import components
from scholion.llm.exact_dedup import exact_dedup
from scholion.llm.jaccard_join import Tree, jaccard_components
from scholion.llm.jaccard_join import useful as module_useful
from scholion.llm.substring_dedup import substring_dedup


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}


def test_exact_dedup(docs, texts):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()}
    assert got == plain_dedup(enumerate(texts))


def test_exact_dedup_edges(spark, empty):
    assert exact_dedup(empty).count() == 0
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, " a"), (3, "  a"), (4, "c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(d).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, False), (1, 1, 1, True), (None, 1, 3, False), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True)], key=str)


def test_exact_dedup_keys_and_digests(spark):
    """Rows with repeated and null ids: one row out for each, in the query too."""
    import hashlib

    rows = [(i, f"text {i}") for i in range(60)] + [(5, "text 5")] * 3 + [(5, "other")] * 2 + [(None, "text 1")] * 2 + [(None, None)] * 2
    d = spark.createDataFrame([(i, t, "x", k, True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, sha string, row_key long, shared boolean").repartition(4)
    got = exact_dedup(d, key_col="row_key", digest=True).collect()
    assert sorted(r["row_key"] for r in got) == list(range(len(rows)))
    assert all(r["text_sha256"] == hashlib.sha256((rows[r["row_key"]][1] or "").encode()).hexdigest() for r in got)
    kept = Counter(rows[r["row_key"]][1] or "" for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == 62
    assert {r["keep_id"] for r in got if rows[r["row_key"]][1] == "text 1"} == {1}


def test_exact_dedup_query_with_repeated_ids(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(60)] + [(5, "text 5")] * 3 + [(5, "other")] * 2 + [(None, "text 1")] * 4
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q.op7_exact_dedup(spark, str(tmp_path)).count() == len(rows)


def test_full_hash_only_of_survivors(spark, monkeypatch):
    """Without digests, only documents that share length and prefix with another are hashed in full."""
    from scholion.llm import exact_dedup as module

    seen = {}
    monkeypatch.setattr(module, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    d = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, "longer text")], "doc_id long, text string")
    exact_dedup(d).collect()
    assert "sha" not in seen["dedup-heads"].columns and seen["dedup-hashes"].where("sha IS NOT NULL").count() == 2


def plain_components(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = split((t or "").translate(low))
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard(docs, texts, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, n=n, percent=percent).collect()}
    assert got == plain_components(enumerate(texts), n, percent)


@pytest.mark.parametrize(("cell", "shingles"), [(3, 400_000), (1, 400_000), (512, 100)])
def test_jaccard_small_cells(docs, texts, monkeypatch, cell, shingles):
    """Cells that are split by shingles and dealt in chunks find the same links, whether classes or shingles are too many."""
    monkeypatch.setattr("scholion.llm.jaccard_join.CELL", cell)
    monkeypatch.setattr("scholion.llm.jaccard_join.SHINGLES", shingles)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == plain_components(enumerate(texts), 4, 85)


def test_jaccard_families_that_share_a_shingle(spark, monkeypatch):
    """Many families of near copies whose rarest common shingle is the same: both rounds of chunks are needed."""
    import random

    monkeypatch.setattr("scholion.llm.jaccard_join.CELL", 5)
    r, rows = random.Random(8), []
    for f in range(12):
        base = ["same", "words", "open", "all", *(f"f{f}w{k}" for k in range(30))]
        for _ in range(9):
            w = list(base)
            w[r.randrange(20, 34)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_components(d, percent=70).collect()}
    assert got == plain_components(rows, 4, 70)


def test_jaccard_long_texts(spark, monkeypatch):
    """Texts far beyond the others share a cell with short ones, and are chunks by themselves."""
    monkeypatch.setattr("scholion.llm.jaccard_join.SHINGLES", 1000)
    long = [f"w{k}" for k in range(30_000)]
    rows = [(0, " ".join(long)), (1, " ".join([*long[:-5], "end"])), (2, " ".join(long[:100])), (3, " ".join([*long[:99], "z"])), (4, " ".join(long[:15_000]))]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_useful_members():
    """Members without a partner they could link with go, all others stay."""
    import numpy as np

    r = np.random.default_rng(6)
    for percent in (50, 80, 85):
        group, size, early = np.sort(r.integers(0, 30, 200)), r.integers(1, 60, 200), r.random(200) < 0.4
        order = np.lexsort((size, group))
        group, size, early = group[order], size[order], early[order]
        fits = lambda a, b: percent * max(size[a], size[b]) <= 100 * min(size[a], size[b])
        partner = lambda a, b: group[a] == group[b] and fits(a, b) and ((size[a] <= size[b] and early[a]) or (size[b] <= size[a] and early[b]))
        want = [any(partner(a, b) for b in range(200) if a != b) for a in range(200)]
        assert module_useful(group, size, early, percent).tolist() == want


def test_jaccard_edges(spark, empty):
    assert jaccard_components(empty).count() == 0
    d = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (3, "A b\nc d"), (4, None), (5, ""), (6, "a b"), (7, "a B")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(d).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (3, 1, 1), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6)], key=str)


def test_jaccard_one_id_with_two_texts(spark):
    """Both texts of a repeated id keep their links, wherever their rows stand."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    d = spark.createDataFrame([(1, a), (1, b), (2, f"{a} z"), (3, f"{b} z")], "doc_id long, text string").repartition(4)
    assert {r["component_id"] for r in jaccard_components(d).collect() if r["doc_id"] > 1} == {1}


def test_tree_finds_every_link():
    """Sets around the threshold, in many sizes: the tree connects exactly those that a full comparison does."""
    import numpy as np

    r = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = r.integers(0, 2**63, r.integers(3, 200)).astype(np.uint64)
        for _ in range(r.integers(1, 6)):
            keep = base[r.random(len(base)) < 0.95]
            sets.append(np.unique(np.append(keep, r.integers(0, 2**63, r.integers(0, 6)).astype(np.uint64))))
    sets.sort(key=len)
    comp = Tree(sets, 85).connect()
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k) and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert comp.tolist() == want and len(set(want)) < len(sets)


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 100), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_substrings(rows, n):
    words = {i: split(t) for i, t in rows}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            least.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - n + 1) if least[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("n", [13, 50, 2])
def test_substrings(docs, texts, n):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(docs, window=n).collect()}
    assert got == plain_substrings(enumerate(texts), n)
    assert any(v[1] for v in got.values())


def test_substring_layout_and_spans(docs, texts):
    plain = plain_substrings(enumerate(texts), 13)
    for r in substring_dedup(docs, layout=True).collect():
        text = texts[r["doc_id"]] or ""
        assert split(r["kept_text"]) == plain[r["doc_id"]][2].split(" ") if plain[r["doc_id"]][2] else not split(r["kept_text"])
        assert sum(s["end"] - s["first"] for s in r["removed"]) == r["n_removed"]
        if not r["n_removed"]:
            assert r["kept_text"] == text and r["removed"] == []


def test_substring_carries_all_columns(spark):
    """Rows keep their other columns of any type, null texts and repeated rows, without a join."""
    p = " ".join(f"w{k}" for k in range(20))
    rows = [(1, p, None, [1, 2], 1.5), (2, f"x  {p}", "a", None, None), (2, f"x  {p}", "b", [], 2.5), (None, p, "c", [3], 0.0), (3, None, "d", [4], -1.0), (4, "", "e", [5], 3.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `kept text` string, row array<int>, n_removed double").repartition(2)
    got = substring_dedup(d, layout=True, carry=True)
    assert got.select("row.*").columns == d.columns
    out = sorted((tuple(r["row"]) + (r["n_words"],) for r in got.collect()), key=str)
    want = [(1, p, None, [1, 2], 1.5, 20), (2, "x  ", "a", None, None, 21), (2, "x  ", "b", [], 2.5, 21), (None, p, "c", [3], 0.0, 20), (3, None, "d", [4], -1.0, 0), (4, "", "e", [5], 3.0, 0)]
    assert out == sorted(want, key=str)
    assert substring_dedup(d.limit(0), carry=True).count() == 0


def test_substring_edges(spark, empty):
    assert substring_dedup(empty).count() == 0
    p = " ".join(f"w{k}" for k in range(14))
    d = spark.createDataFrame([(1, f"{p} {p}"), (1, p), (None, p), (2, f"x {p}"), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(d).collect()), key=str)
    assert got == sorted([(1, 28, 0), (1, 14, 0), (None, 14, 0), (2, 15, 14), (3, 0, 0)], key=str)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    want = duck.sql(q.ORACLE_SQL[name])
    assert values(df.collect(), df.columns) == values(want.fetchall(), want.columns)


def test_jaccard_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op2_jaccard_join(spark, DATA).collect()}
    assert got == plain_components(rows, 4, 85)


def test_hot_group(spark):
    """A third of all rows are copies of one text, near copies of it another third."""
    p = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(p) if i % 3 == 0 else " ".join([*p[:60], f"n{i}", *p[61:]]) if i % 3 == 1 else " ".join(f"{i}u{k}" for k in range(50))) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    c = Counter(r["component_id"] for r in jaccard_components(d).collect())
    assert c[0] == 400 and len(c) == 201
    assert d.join(exact_dedup(d).where("kept").select(F.col("doc_id").alias("k")), F.col("doc_id") == F.col("k")).count() == 401
