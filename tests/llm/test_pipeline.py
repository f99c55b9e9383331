"""Each stage of the pipeline on its own input, against a plain version."""

import random
import re

import pytest
from helpers import DATA
from test_dedup import plain_components, plain_dedup, plain_substrings
from test_tokens import whole_sequences

import corpus_pipeline as c
from scholion.llm.common import written


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    docs = [c.table(spark, DATA, "documents")]
    for name, f in c.STAGES:
        docs.append(written(f(spark, docs[-1], DATA), f"test-{name}"))
    return docs


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "substring_dedup", "best_fit_packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_classifier_keeps_clean_documents(stages, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = rows(stages[1])
    good = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i, y in labels.items() if y == 0) <= 0.2 * sum(y == 0 for y in labels.values())


def test_copies(stages):
    before = rows(stages[1])
    assert set(rows(stages[2])) == {i for i, v in plain_dedup(before.items()).items() if v[2]}


def test_near_copies(stages):
    before = rows(stages[2])
    assert set(rows(stages[3])) == {i for i, v in plain_components(before.items(), 5, 80).items() if v[1] == i}


def test_passages(stages):
    before, after = rows(stages[3]), rows(stages[4])
    for i, (_, gone, kept) in plain_substrings(before.items(), 50).items():
        if kept or not gone:
            assert split(after[i]) == split(kept) and (gone or after[i] == before[i])
        else:
            assert i not in after


def test_packing(stages):
    out = stages[5].collect()
    assert {r["doc_id"] for r in out} == set(rows(stages[4]))
    whole_sequences(out, 2048)


def test_run_and_planted(spark, tmp_path):
    """Planted copies, near copies and passages in clean documents; a table of few labels beside them."""
    draw = random.Random(2)
    clean = [" ".join(f"w{draw.randrange(2000)}" for _ in range(150)) for _ in range(30)]
    passage = " ".join(f"planted{k}" for k in range(60))
    near = " ".join(["changed", *clean[3].split(" ")[1:]])
    texts = [*clean, clean[2], near, f"{clean[5][:300]} x {passage}", f"{' '.join(f'v{k}' for k in range(80))}\n{passage} tail words", None, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d = docs
    for name, f in c.STAGES[1:4]:
        d = written(f(spark, d, DATA), f"planted-{name}")
    got = rows(d)
    assert set(range(30)) <= set(got) and 30 not in got and 31 not in got and passage in got[32]
    assert "planted" not in got[33] and got[33].startswith("v0 v1") and got[33].endswith("tail words") and all(got[i] == texts[i] for i in range(30))


def test_repeated_ids_and_nulls(spark):
    """Rows that share an id are told apart by their texts; nulls and empty texts don't stop a stage."""
    draw = random.Random(4)
    a, b, p = (" ".join(f"{x}{draw.randrange(10**6)}" for _ in range(90)) for x in "abp")
    rows = [(0, a), (1, a), (1, b), (1, b), (1, b.replace(" ", "\n\t", 1)), (2, f"{p} q"), (3, f"{p} r"), (3, "short text"), (None, a), (None, "lone words"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = sorted(((r["doc_id"], r["text"]) for r in c.exact_copies(spark, docs, DATA).collect()), key=str)
    assert len(once) == 7 and (1, a) not in once and (None, a) not in once and sum(i == 1 for i, _ in once) == 1 and {(0, a), (2, f"{p} q"), (3, f"{p} r"), (3, "short text"), (None, "lone words")} <= set(once)
    d = c.repeated_passages(spark, written(c.near_copies(spark, docs, DATA), "repeated"), DATA)
    texts = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert (3, "short text") in texts and (3, f"{p} r") not in texts and (2, f"{p} q") in texts
    assert c.best_fit_packing(spark, docs, DATA).count() == len(rows) and c.quality_classifier(spark, docs, DATA).columns == docs.columns


CLASHING = ["stay_key", "stay_id", "text_crc32", "kept_text", "cut_id", "_key", "_row", "score", "predicted", "row", "row_number", "lost_number", "n_removed", "id", "key", "component_id", "b", "Score"]


@pytest.fixture
def clashing(spark):
    draw = random.Random(9)
    base = [" ".join(f"w{draw.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [*base, base[3], base[4] + " end", f"{base[5][:200]} {passage}", f"lead {passage} tail", None, "", "long " * 30_000]
    names = [c for c in CLASHING if c != "Score"]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)).repartition(3)


def test_clashing_names(spark, clashing):
    """Columns that are called as those stages use inside come out as they went in."""
    d = written(clashing, "clashing")
    before = {r["doc_id"]: r for r in d.collect()}
    for name, f in c.STAGES[:4]:
        d = written(f(spark, d, DATA), f"clash-{name}")
        assert d.columns == clashing.columns and d.schema["n_chars"].dataType == clashing.schema["n_chars"].dataType
        for r in d.collect():
            assert all(r[k] == before[r["doc_id"]][k] for k in d.columns if k not in ("text", "n_chars"))
    assert c.best_fit_packing(spark, d, DATA).count() >= d.count()
    for _, f in c.STAGES[1:4]:
        out = {r["doc_id"] for r in f(spark, clashing, DATA).collect()}
        assert {0, 1, 2, 3, 16, 17} <= out | {17}


def test_run_on_clashing_and_empty_tables(spark, clashing, empty, tmp_path):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, d in (("clash", clashing), ("none", clashing.limit(0)), ("bare", empty)):
        folder = str(tmp_path / name)
        d.write.parquet(f"{folder}/documents.parquet")
        (labels if name == "clash" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        out = c.run(spark, folder)
        assert (out.count() > 0) == (name == "clash") and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_repeated_rows_stay_as_many(spark):
    """A passage stage on rows that share id and text gives each of them once."""
    p = " ".join(f"w{k}" for k in range(80))
    d = spark.createDataFrame([(1, p, "a"), (2, f"x {p}", "b"), (2, f"x {p}", "c"), (2, f"x {p}", "d")], "doc_id long, text string, lang string")
    assert sorted(r["lang"] for r in c.repeated_passages(spark, d, DATA).collect()) == ["a", "b", "c", "d"]
