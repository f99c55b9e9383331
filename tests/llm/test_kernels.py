"""The vectorised kernels against plain Python, on texts that hypothesis makes up."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scholion.llm import kernels as k
from scholion.llm.bundles import parts_of
from scholion.llm.substring_dedup import _pack, _pack_ids, _unpack, _unpack_ids

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab é日 \u0085 \t\n\x0b\x0c\r\x1c", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words(texts):
    data, offsets = k.text_buffers(pa.array(texts, pa.string()))
    starts, ends, first = k.word_spans(data, offsets)
    got = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    want = [(t or "").encode().split() for t in texts]
    assert [got[a:b] for a, b in zip(first, first[1:], strict=False)] == want
    h = k.span_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(got))
    g, fits = k.ngrams(h, first, 3)
    grams = [tuple(w[i : i + 3]) for w in want for i in range(len(w) - 2)]
    assert fits.sum() == len(grams) and len(set(g[fits].tolist())) == len(set(grams))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    words = [b"w" * n + bytes([65 + n % 20]) for n in range(1, 300)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = k.word_spans(data, np.array([0, len(data)]))
    whole = [k.span_hashes(data, starts, ends, x) for x in (0, 1)]
    monkeypatch.setattr(k, "BLOCK", 64)
    assert all((k.span_hashes(data, starts, ends, x) == whole[x]).all() for x in (0, 1)) and (whole[0] != whole[1]).all()


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_pieces_keep_every_row(texts, most):
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["i", "t"])
    got = [r for p in k.pieces(iter([b]), 1, most) for r in p.column(0).to_pylist()]
    assert got == list(range(len(texts)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), min_size=1, max_size=50, unique=True), st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20))
def test_packed_numbers(keys, ids):
    keys = np.array(sorted(keys), np.uint64)
    raw = _pack(keys)
    got, size = _unpack(memoryview(raw + b"rest"), len(keys))
    assert (got == keys).all() and size == len(raw)
    assert _unpack_ids(memoryview(b"x" + _pack_ids(np.array(ids, np.int64))), len(ids), 1).tolist() == ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=4), max_size=6))
def test_ragged(parts):
    flat = [x for p in parts for x in p]
    size = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(size) - size
    order = np.arange(len(parts))[::-1]
    got = np.array(flat, np.int64)[k.ragged(starts[order], size[order])] if flat else np.empty(0)
    assert got.tolist() == [x for p in parts[::-1] for x in p]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**48 - 1), max_size=60, unique=True), st.integers(1, 1 << 20))
def test_parts_are_intervals(keys, n):
    keys = np.array(sorted(keys), np.uint64)
    part, cut = parts_of(keys, n, 48)
    whole = [int(k) * n >> 48 for k in keys & ~np.uint64(0xFFFF)]
    assert np.repeat(part, np.diff(cut)).tolist() == whole and part.tolist() == sorted(set(whole)) and cut[-1] == len(keys)
