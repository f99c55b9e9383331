"""Encoders, packing and token files against the libraries and plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from scholion.llm import queries as q
from scholion.llm import sentencepieces as sp
from scholion.llm import tokens
from scholion.llm.common import written
from scholion.llm.orc_tokens import read_tokens, summaries, write_tokens
from scholion.llm.packing import pack, pack_texts, plan

BPE, PIECES = tokens.vocabulary("word_bpe_49k.json"), tokens.vocabulary("piece_bpe_32k.model")
ODD = list("abcXYZ 019'!?.,-<>$(){};:\t\n\r\x00Éé日本語ßẞİΣς\u0338\u0331\u0301ñ😀—…€½²▁ ") + ["'s", "'ll", "the ", "ing", "\r\n", "    ", "<s>", "<|endoftext|>", "\u0085", " ▁"]


def odd_texts(n=600):
    r = random.Random(11)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(50))) for _ in range(n)] + [None, "", " ", "a" * 3000, " " * 70]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_chunk_encoder_is_the_library():
    texts = odd_texts()
    e = tokens.ChunkEncoder(BPE)
    assert e.by_chunk
    for lo in range(0, len(texts), 50):  # slices of a longer column, and chunks that are known already
        ids, o = e.encode(pa.array(texts).slice(lo, 50))
        assert [ids[a:b].tolist() for a, b in zip(o, o[1:], strict=False)] == library(texts[lo : lo + 50])


def test_chunk_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 5)
    e, texts = tokens.ChunkEncoder(BPE), ["one two three four five six", "one two", "seven one"] * 3
    for t in texts:
        assert e.encode(pa.array([t]))[0].tolist() == library([t])[0]


def test_sentencepiece_is_the_library():
    from sentencepiece import SentencePieceProcessor

    lib, m, texts = SentencePieceProcessor(model_file=PIECES), sp.PieceEncoder(PIECES), odd_texts()
    ids, o = m.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(o, o[1:], strict=False)] == [lib.encode(t or "") for t in texts]
    data, ends = m.decode(ids, o)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:], strict=False)] == [(t or "").replace("▁", " ") for t in texts]


def test_sentencepiece_operators(docs, texts, empty):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=PIECES)
    coded = sp.encode_texts(docs, PIECES)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: lib.encode(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in sp.decode_ids(coded, PIECES).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert sp.encode_texts(empty, PIECES).count() == sp.decode_ids(sp.encode_texts(empty, PIECES), PIECES).count() == 0


def test_sentencepiece_query(spark):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in q.op3_sentencepiece(spark, DATA).collect():
        ids = lib.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["same"] and r["decoded_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())


def test_orc_tokens(spark, docs, texts, tmp_path):
    folder = str(tmp_path / "orc")
    write_tokens(docs, folder, BPE, end=1)
    want = {i: [*x, 1] for i, x in enumerate(library(texts))}
    assert {r["doc_id"]: r["ids"] for r in read_tokens(spark, folder).collect()} == want
    assert {r["doc_id"] for r in read_tokens(spark, folder, [3, 5]).collect()} == {3, 5}
    starts = np.cumsum([0, *(len(want[i]) for i in range(len(texts)))])
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in summaries(spark, folder).collect()}
    assert got == {i: (starts[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_orc_tokens_edges(spark, empty, tmp_path):
    write_tokens(empty, str(tmp_path / "e"), BPE)
    assert summaries(spark, str(tmp_path / "e")).count() == 0
    d = spark.createDataFrame([(5, "a"), (None, "b b"), (5, "c"), (7, None)], "doc_id long, text string")
    write_tokens(d, str(tmp_path / "o"), BPE)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in summaries(spark, str(tmp_path / "o")).collect()), key=str)
    assert got == [(0, None, 3), (3, 5, 2), (5, 5, 2), (7, 7, 1)]


def test_orc_files_grow_in_number_with_the_input(spark, docs, texts, tmp_path, monkeypatch):
    from scholion.llm import orc_tokens

    monkeypatch.setattr(orc_tokens, "estimate", lambda d: 30 * orc_tokens.FILE)
    write_tokens(docs, str(tmp_path / "many"), BPE, end=1)
    assert len(list((tmp_path / "many").glob("*.orc"))) > 20
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in summaries(spark, str(tmp_path / "many")).collect())
    assert [r[1] for r in rows] == list(range(len(texts))) and all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_orc_files_skip_what_is_not_asked(spark, tmp_path):
    """Row groups that can't hold an id are not read, and rows of one id may lie in several files."""
    from pyarrow import orc

    d = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.lit("a b c").alias("text")).repartition(3)
    folder = str(tmp_path / "orc")
    write_tokens(d, folder, BPE)
    plan = read_tokens(spark, folder, [6])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(doc_id,6)]" in plan or "PushedFilters: [In(doc_id" in plan or "doc_id,6" in plan
    read = read_tokens(spark, folder, [6])
    assert read.count() == 1
    spans = sorted((t["doc_id"].to_numpy().min(), t["doc_id"].to_numpy().max()) for t in (orc.read_table(str(f), columns=["doc_id"]) for f in (tmp_path / "orc").glob("*.orc")) if t.num_rows)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    one = d.select(F.lit(9).cast("long").alias("doc_id"), F.concat("text", F.lit(" "), (F.col("doc_id") % 11).cast("string")).alias("text"))
    write_tokens(one, str(tmp_path / "one"), BPE)
    got = sorted((r["start"], r["n_tokens"]) for r in summaries(spark, str(tmp_path / "one")).collect())
    assert len(got) == 20_000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))


def test_long_pieces_are_found_by_the_suffix_array():
    """Pieces beyond 16 bytes, in texts that repeat their beginnings."""
    from sentencepiece import SentencePieceProcessor

    lib, m = SentencePieceProcessor(model_file=PIECES), sp.PieceEncoder(PIECES)
    long = sorted((p.replace("▁", " ") for i, p in enumerate(m.pieces) if m.normal[i]), key=lambda p: -len(p.encode()))[:200]
    assert len(long[0].encode()) > 16
    texts = [p + q[:k] for k, (p, q) in enumerate(zip(long, long[1:], strict=False), 1)] + [p[:-1] for p in long] + ["".join(long)]
    ids, o = m.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(o, o[1:], strict=False)] == [lib.encode(t) for t in texts]


def test_orc_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    at = 0
    got = {r["doc_id"]: r for r in q.op9_orc_tokens(spark, DATA).collect()}
    for (i, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        at += len(ids) + 1


def whole_sequences(rows, size):
    """Sequences without gaps or overlaps, none longer than size."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs)


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_everything_once(seed):
    r = random.Random(seed)
    histogram = {r.randrange(1, 65): r.randrange(1, 50) for _ in range(r.randrange(1, 40))}
    placed, used = {}, {}
    for length, rank, n, first, offset in plan(histogram, 64):
        placed.setdefault(length, []).extend(range(rank, rank + n))
        for s in range(first, first + n):
            assert used.get(s, 0) == offset
            used[s] = offset + length
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(v)) for k, v in histogram.items()}
    assert max(used.values()) <= 64
    # no worse than best fit, longest first, over single pieces
    rooms = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fit = min((x for x in rooms if x >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((64 if fit is None else fit) - length)
    assert len(used) == len(rooms)


def test_pack_texts(docs, texts):
    rows = pack_texts(docs, BPE, size=64, end=0).collect()
    for i, ids in enumerate(library(texts)):
        ids = [*ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in mine] == [(k // 64, k, min(64, len(ids) - k)) for k in range(0, len(ids), 64)]
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()) for k in range(0, len(ids), 64)]
    n = whole_sequences(rows, 64)
    assert n <= sum(r["length"] for r in rows) / 64 * 1.1 + 1


def test_pack_edges(spark, empty):
    assert pack_texts(empty, BPE).count() == 0
    d = spark.createDataFrame([(None, 0, 3, "keep"), (1, 0, 3, "a"), (1, 0, 3, "a"), (2, 0, 10, None)], "doc_id long, piece int, length long, base string")
    rows = pack(d, 10).collect()
    assert len(rows) == 4 and whole_sequences(rows, 10) == 2 and {r["base"] for r in rows} == {"keep", "a", None}


def test_pack_lengths_that_most_pieces_share(spark, monkeypatch):
    """Many full pieces and many of one length, in more parts than one."""
    monkeypatch.setattr("scholion.llm.packing.PART_ROWS", 20)
    n = 3000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 64).when(F.col("id") % 3 == 1, 20).otherwise(F.col("id") % 60 + 1).cast("long").alias("length"))
    rows = pack(written(d, "pieces-test"), 64).collect()
    assert len(rows) == n and {r["doc_id"] for r in rows} == set(range(n))
    assert whole_sequences(rows, 64) <= sum(r["length"] for r in rows) / 64 * 1.02 + 1
    with pytest.raises(AssertionError):
        pack(spark.createDataFrame([(1, 0, 65)], "doc_id long, piece int, length long"), 64)


def test_pack_query(spark):
    rows = q.op8_best_fit_packing(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    lengths = {i: len(x) + 1 for i, x in zip(texts, library(list(texts.values())), strict=True)}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == lengths
    n = whole_sequences(rows, 2048)
    assert n <= -(-sum(lengths.values()) // 2048) * 1.02 + 1
