"""Substring dedup by fixed-block anchors.

Texts are gathered in bundles of some megabytes. Reference blocks do not overlap:
block k of a text is its words 7k to 7k + 6, so any window of 13 words holds a whole block. Three rounds follow, in each
of which a bundle asks and gets a bit for each question:

1. Every bundle sends the hashes of its rolling 7-word windows, those marked that are blocks. A bit comes back for each
   that is a block somewhere and lies in two documents: an anchor.
2. Anchors are extended to all 13-word windows around them. The bundle sends these with the smallest document that holds
   each; a bit comes back where another bundle has a smaller one.
3. Windows that a smaller document holds are merged to maximal repeats, and their words are removed.

Questions are sorted, made unique and packed as differences, so a passage that all documents share is one question a
bundle, and no pair of documents is ever formed. The answer to a question is one bit at its place, so it needs no key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bundles
from .bundles import own, parts_of
from .common import written
from .kernels import U, ngrams, owners, ragged, span_hashes, text_buffers, word_spans

BITS = 48


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as the first one and differences of 4 or 8 bytes."""
    gaps = np.diff(keys)
    width = 4 if not len(gaps) or int(gaps.max()) < 2**32 else 8
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + gaps.astype(f"<u{width}").tobytes()


def _unpack(raw: memoryview, n: int) -> tuple[np.ndarray, int]:
    """(keys, bytes read)."""
    width = raw[0]
    gaps = np.frombuffer(raw, f"<u{width}", n - 1, 9).astype(U)
    first = U(int.from_bytes(raw[1:9], "little"))
    return np.cumsum(np.concatenate(([first], gaps)), dtype=U), 9 + width * (n - 1)


class Bundle:
    """Words of the texts of one bundle."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int, block: int):
        self.window, self.block = window, block
        self.data, self.offsets = text_buffers(texts)
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets)
        self.doc = owners(self.first)
        self.known = np.asarray(ids.is_valid())  # texts without an id take no part
        self.ids = ids.fill_null(0).to_numpy()
        self.words = span_hashes(self.data, self.starts, self.ends)

    def questions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Round 1: (places of the windows, unique keys, which key each window has)."""
        h, fits = ngrams(self.words, self.first, self.block)
        self.places = np.flatnonzero(fits & self.known[self.doc])
        keys, which = np.unique(h[self.places] >> U(64 - BITS), return_inverse=True)
        return self.places, keys, which

    def marks(self, keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a block here, lies in two documents here) for each key."""
        at = self.places - self.first[self.doc[self.places]]
        is_block = np.zeros(len(keys), bool)
        is_block[which[at % self.block == 0]] = True
        ids = self.ids[self.doc[self.places]]
        order = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[order], np.arange(len(keys)))
        low, high = (f.reduceat(ids[order], cut) if len(keys) else ids for f in (np.minimum, np.maximum))
        return is_block, low != high

    def candidates(self, anchored: np.ndarray):
        """Round 2: (places, keys, second hashes, smallest ids here, which of these each place has) of the windows around anchors."""
        hit = np.zeros(len(self.words) + 1, np.int64)
        hit[self.places[anchored] + 1] = 1
        upto = np.cumsum(hit)
        h, fits = ngrams(self.words, self.first, self.window)
        reach = np.minimum(np.arange(len(self.words)) + self.window - self.block + 1, len(self.words))
        places = np.flatnonzero(fits & self.known[self.doc] & (upto[reach] > upto[:-1]))
        if not len(places):
            none = np.empty(0, U)
            return places, none, none, np.empty(0, np.int64), places
        need = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(need, places, 1)
        np.add.at(need, places + self.window, -1)
        used = np.flatnonzero(np.cumsum(need[:-1]) > 0)
        second = np.zeros(len(self.words), U)
        second[used] = span_hashes(self.data, self.starts[used], self.ends[used], 1)
        k, s = h[places] >> U(64 - BITS), ngrams(second, self.first, self.window)[0][places]
        order = np.lexsort((s, k))
        new = np.append(True, (np.diff(k[order]) != 0) | (np.diff(s[order]) != 0))
        which = np.empty(len(places), np.int64)
        which[order] = np.cumsum(new) - 1
        ids = self.ids[self.doc[places]]
        return places, k[order][new], s[order][new], np.minimum.reduceat(ids[order], np.flatnonzero(new)), which

    def removed(self, places: np.ndarray) -> np.ndarray:
        """Whether each word lies in a window at one of the places."""
        cover = np.zeros(len(self.words) + 1, np.int64)
        cover[places] += 1
        cover[places + self.window] -= 1
        return np.cumsum(cover[:-1]) > 0 if len(self.words) else np.zeros(0, bool)

    def kept(self, gone: np.ndarray) -> pa.Array:
        """The words that stay, joined by one space."""
        stay = np.flatnonzero(~gone)
        size = self.ends[stay] - self.starts[stay] + 1
        out = np.append(self.data, np.uint8(32))[ragged(self.starts[stay], size)]
        upto = np.cumsum(size)
        out[upto - 1] = 32
        n = np.bincount(self.doc[stay], minlength=len(self.ids)) if len(stay) else np.zeros(len(self.ids), np.int64)
        last = np.cumsum(n)
        ends = np.append(0, upto)[last]
        full = n > 0
        out = np.delete(out, ends[full] - 1)
        return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.append(0, ends - np.cumsum(full)).astype(np.int64)), pa.py_buffer(out)])

    def cut(self, gone: np.ndarray) -> pa.Array:
        """The texts without the removed words and the white space after each of them; the rest keeps its layout."""
        word = np.flatnonzero(gone)
        next_start = np.append(self.starts, len(self.data))[word + 1] if len(word) else word
        stop = np.minimum(next_start, self.offsets[self.doc[word] + 1]) if len(word) else word
        edge = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edge, self.starts[word], 1)
        np.add.at(edge, stop, -1)
        out = np.cumsum(edge[:-1]) == 0
        kept = np.concatenate(([0], np.cumsum(out)))[self.offsets]
        return pa.Array.from_buffers(pa.large_string(), len(self.ids), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(self.data[out])])

    def spans(self, gone: np.ndarray) -> pa.Array:
        """Maximal removed repeats of each text: first word and the word after the last."""
        edge = np.zeros(len(gone) + 1, bool)
        edge[self.first[:-1][self.first[:-1] < len(gone)]] = True
        begin = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1]))) if len(gone) else np.empty(0, np.int64)
        stop = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1 if len(gone) else begin
        d = self.doc[begin] if len(begin) else begin
        base = self.first[d]
        pairs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - base)], ["first", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(len(self.ids) + 1)), pa.int32()), pairs)


def _open(b: pa.RecordBatch, k: int, window: int, block: int) -> Bundle:
    return Bundle(*bundles.opened(b, k), window, block)


def _with_answers(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """Each bundle with the answers to it: one bit for each of its questions, so no more than the bundle is large."""
    return bundles.joined(stored, answers.groupBy("b").agg(F.collect_list(F.struct("round", "hb", "bits")).alias("answers")))


def _read_answers(answers: pa.Scalar, round_: int, parts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The bits for all questions of a bundle, in the order of its keys; parts and cut are those of the questions."""
    out = np.zeros(int(cut[-1]), bool)
    if answers.is_valid:
        v = answers.values
        mine = np.flatnonzero(v.field("round").to_numpy() == round_)
        hbs, bits = v.field("hb").to_numpy(), v.field("bits")
        for k, at in zip(mine, np.searchsorted(parts, hbs[mine]), strict=True):
            out[cut[at] : cut[at + 1]] = np.unpackbits(np.frombuffer(bits[int(k)].as_buffer(), np.uint8), count=int(cut[at + 1] - cut[at])).astype(bool)
    return out


ASK = "hb int, b long, n int, payload binary"
ANSWER = "b long, round int, hb int, bits binary"
ASK_SCHEMA = pa.schema([("hb", pa.int32()), ("b", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())])
ANSWER_SCHEMA = pa.schema([("b", pa.int64()), ("round", pa.int32()), ("hb", pa.int32()), ("bits", pa.binary())])


def _asked(batch: pa.RecordBatch, k: int, parts: np.ndarray, cut: np.ndarray, load: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), own(batch, k, len(parts)), pa.array(np.diff(cut), pa.int32()), pa.array(load, pa.binary())], schema=ASK_SCHEMA)


def _answered(t: pa.Table, counts: list[int], bits: np.ndarray, round_: int) -> pa.Table:
    at = np.concatenate(([0], np.cumsum(counts)))
    packed = [np.packbits(bits[a:z]).tobytes() for a, z in zip(at, at[1:], strict=False)]
    return pa.Table.from_arrays([t.column("b"), pa.array([round_] * t.num_rows, pa.int32()), t.column("hb"), pa.array(packed, pa.binary())], schema=ANSWER_SCHEMA)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, layout: bool = False, carry: bool = False) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_text, removed), one for each input row; with carry, (row, n_words, n_removed), too.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id; windows are
    judged on the input. kept_text has the words that stay, joined by one space; with layout, it is the text without the
    removed words and the white space after them. `removed` lists maximal repeats as first word and word after the last. With
    carry, `row` is a struct of all columns of the input with the kept text in place of its text, null where that was null;
    nothing is joined, so rows need no key. Null and empty texts have no words. Rows with a null id keep all words and take
    none from others. Rows that share an id are one document, which takes nothing from itself. Texts shorter than a window
    keep all words; a very long one is a bundle of its own. An empty table gives an empty result; other columns are ignored.
    """
    block = (window + 1) // 2
    stored = bundles.store(docs, id_col, text_col, "substring_bundles", carry)
    n_parts = bundles.parts(stored)
    names = list(docs.columns)

    def ask(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        x = _open(batch, k, window, block)
        _, keys, which = x.questions()
        is_block, shared = x.marks(keys, which)
        parts, cut = parts_of(keys, n_parts, BITS)
        load = [_pack(keys[a:z]) + np.packbits(is_block[a:z]).tobytes() + np.packbits(shared[a:z]).tobytes() for a, z in zip(cut, cut[1:], strict=False)]
        return _asked(batch, k, parts, cut, load)

    def anchors(t: pa.Table) -> pa.Table:
        counts = t.column("n").to_pylist()
        keys, blocks, shared = [], [], []
        for raw, n in zip(t.column("payload"), counts, strict=True):
            m = memoryview(raw.as_buffer())
            k, at = _unpack(m, n)
            size = -(-n // 8)
            keys.append(k)
            blocks.append(np.unpackbits(np.frombuffer(m, np.uint8, size, at), count=n))
            shared.append(np.unpackbits(np.frombuffer(m, np.uint8, size, at + size), count=n))
        keys, blocks, shared = np.concatenate(keys), np.concatenate(blocks), np.concatenate(shared)
        order = np.argsort(keys, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        many = np.diff(np.append(cut, len(keys))) > 1
        hit = (np.maximum.reduceat(blocks[order], cut) > 0) & (many | (np.maximum.reduceat(shared[order], cut) > 0))
        bits = np.empty(len(keys), bool)
        bits[order] = np.repeat(hit, np.diff(np.append(cut, len(keys))))
        return _answered(t, counts, bits, 1)

    def extend(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        x = _open(batch, k, window, block)
        _, keys, which = x.questions()
        hit = _read_answers(batch.column("answers")[k], 1, *parts_of(keys, n_parts, BITS))
        _, keys, second, low, _ = x.candidates(hit[which])
        parts, cut = parts_of(keys, n_parts, BITS)
        load = [_pack(keys[a:z]) + second[a:z].astype("<u8").tobytes() + _pack_ids(low[a:z]) for a, z in zip(cut, cut[1:], strict=False)]
        return _asked(batch, k, parts, cut, load)

    def compare(t: pa.Table) -> pa.Table:
        counts = t.column("n").to_pylist()
        keys, second, low = [], [], []
        for raw, n in zip(t.column("payload"), counts, strict=True):
            m = memoryview(raw.as_buffer())
            k, at = _unpack(m, n)
            keys.append(k)
            second.append(np.frombuffer(m, "<u8", n, at))
            low.append(_unpack_ids(m, n, at + 8 * n))
        keys, second, low = np.concatenate(keys), np.concatenate(second), np.concatenate(low)
        order = np.lexsort((second, keys))
        cut = np.flatnonzero(np.append(True, (np.diff(keys[order]) != 0) | (np.diff(second[order]) != 0)))
        least = np.repeat(np.minimum.reduceat(low[order], cut), np.diff(np.append(cut, len(keys))))
        bits = np.empty(len(keys), bool)
        bits[order] = low[order] > least
        return _answered(t, counts, bits, 2)

    def remove(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        x = _open(batch, k, window, block)
        answers = batch.column("answers")[k]
        _, keys, which = x.questions()
        hit = _read_answers(answers, 1, *parts_of(keys, n_parts, BITS))
        places, keys, _, low, which = x.candidates(hit[which])
        lost = _read_answers(answers, 2, *parts_of(keys, n_parts, BITS))
        gone = x.removed(places[lost[which] | (x.ids[x.doc[places]] > low[which])] if len(places) else places)
        n = np.diff(x.first)
        taken = np.bincount(x.doc[gone], minlength=len(n)) if len(gone) else np.zeros(len(n), np.int64)
        kept = (x.cut(gone) if layout else x.kept(gone)).cast(pa.string())
        counts = [pa.array(n, pa.int64()), pa.array(taken, pa.int64())]
        if not carry:
            return pa.RecordBatch.from_arrays([batch.column("ids")[k].values, *counts, kept, x.spans(gone)], ["id", "n_words", "n_removed", "kept_text", "removed"])
        others, null = bundles.carried(batch, k), bundles.opened(batch, k)[1].is_null()
        if null.true_count:
            kept = pc.if_else(null, pa.scalar(None, pa.string()), kept)
        fields = dict(zip([f.name for f in others.type], others.flatten(), strict=True))
        row = pa.StructArray.from_arrays([kept if c == text_col else fields[c] for c in names], names)
        return pa.RecordBatch.from_arrays([row, *counts], ["row", "n_words", "n_removed"])

    first = written(bundles.apply(stored, ask, ASK).groupBy("hb").applyInArrow(anchors, ANSWER), "anchors")
    asked = bundles.apply(_with_answers(stored, first), extend, ASK)
    second = written(asked.groupBy("hb").applyInArrow(compare, ANSWER), "repeats")
    both = _with_answers(stored, first.unionByName(second))
    if carry:
        as_text = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]
        return bundles.apply(both, remove, T.StructType([T.StructField("row", T.StructType(as_text)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
    done = bundles.apply(both, remove, "id long, n_words long, n_removed long, kept_text string, removed array<struct<first: long, end: long>>")
    return done.withColumnRenamed("id", id_col)


def _pack_ids(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    wide = int(ids.max()) - low >= 2**32
    return bytes([8 if wide else 4]) + low.to_bytes(8, "little", signed=True) + (ids.astype(U) - U(low % 2**64)).astype("<u8" if wide else "<u4").tobytes()


def _unpack_ids(raw: memoryview, n: int, at: int) -> np.ndarray:
    width, low = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little", signed=True)
    return (np.frombuffer(raw, f"<u{width}", n, at + 9).astype(U) + U(low % 2**64)).astype(np.int64)
