"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

The distinct chunks of a batch are concatenated and indexed by a suffix array; every piece is binary-searched in it, which
gives all its occurrences as one range. The occurrences are the edges of a lattice; they are sorted by position and relaxed
from left to right. For merges, relaxing means this: the last token of a prefix is that piece ending there whose
predecessor, the last token of the prefix before it, stays a token of its own when both are merged together. There is
exactly one, since a sequence is the result of merging if and only if each two neighbours are.
Where two characters are neighbours in no piece no token can span them, so texts are cut there and each chunk is encoded once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, text_of
from .kernels import U, pieces, ragged, text_buffers
from .tokens import SLICE, ChunkCache

#: The character that stands for a space in pieces.
META = "▁"
#: Bytes of distinct chunks that are indexed at once.
INDEXED = 1 << 19
_models: dict[str, "PieceEncoder"] = {}


def model(path: str) -> "PieceEncoder":
    """One encoder for each worker process and model."""
    if path not in _models:
        _models[path] = PieceEncoder(path)
    return _models[path]


class PieceEncoder(ChunkCache):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        if lib.encode(f"a {META}") != lib.encode(f"a{META} ") or lib.encode(" Ａ") != [*lib.encode(" "), *lib.encode("Ａ")[1:]] or not any(map(lib.is_byte, range(n))):
            raise ValueError("a model with byte fallback, a space before each text and no other normalisation is needed")
        self.normal = np.array([not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)) for i in range(n)])
        self.byte = np.full(256, -1, np.int64)
        for i in range(n):
            if lib.is_byte(i):
                self.byte[int(self.pieces[i][3:5], 16)] = i
        self.score = {self.pieces[i].replace(META, " "): lib.get_score(i) for i in range(n) if self.normal[i]}
        self.number = {self.pieces[i].replace(META, " "): i for i in range(n) if self.normal[i]}

        # What decoding writes for each id, as one buffer
        said = [p.replace(META, " ").encode() if self.normal[i] else b"" for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte):
            said[i] = bytes([b])
        for i in range(n):
            if lib.is_unknown(i):
                said[i] = " ⁇ ".encode()
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = np.concatenate(([0], np.cumsum([len(x) for x in said])))

        # Pieces for the search: big-endian keys of 8 bytes after 8 bytes, the least and the largest that begin like the piece
        ids = np.flatnonzero(self.normal)
        raw = [said[i] for i in ids]
        self.search_ids = ids
        self.search_len = np.array([len(r) for r in raw])
        self.steps = max(1, -(-int(self.search_len.max(initial=1)) // 8))
        keys = lambda pad: [np.array([int.from_bytes(r[8 * k : 8 * k + 8].ljust(8, pad), "big") for r in raw], U) for k in range(self.steps)]
        self.low, self.high = keys(b"\0"), keys(b"\xff")

        near = np.zeros((128, 128), bool)
        for r in raw:
            for a, b in zip(r, r[1:], strict=False):
                if a < 128 and b < 128:
                    near[a, b] = True
        self.near = near
        self.own: dict[int, bool] = {}
        self.pair_keys, self.pair_ok = np.empty(0, U), np.empty(0, bool)
        self.forget()

    # -- encoding

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as uint32, offsets of the texts)."""
        data, offsets = text_buffers(column)
        if META.encode() in data.tobytes():  # it means the same as a space
            column = pa.array([(t or "").replace(META, " ") for t in column.to_pylist()], pa.large_string())
            data, offsets = text_buffers(column)
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[full], 32)  # the space before each text
        size = np.diff(offsets)
        size[full] += 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        if not len(data):
            return np.empty(0, np.uint32), offsets
        cut = np.zeros(len(data) + 1, bool)
        a, b = data[:-1], data[1:]
        cut[1:-1] = (a < 128) & (b < 128) & ~self.near[a & 127, b & 127]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        ids, upto = self.ids_of(data, bounds)
        return ids, upto[np.searchsorted(bounds, offsets)]

    def encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffers(chunks)
        out, at = [], 0
        while at < len(chunks):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + INDEXED, "right")) - 1)
            out.append(self._lattice(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            at = to
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _edges(self, data: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids): every occurrence of every piece inside a unit, by the suffix array of the text."""
        n = len(data)
        reach = 8 * self.steps
        wide = np.concatenate([data, np.zeros(reach, np.uint8)]).astype(U)
        key = np.zeros(n + reach - 8, U)
        for k in range(8):
            key |= wide[k : k + n + reach - 8] << U(56 - 8 * k)
        suffixes = self._ordered(key, n)
        at = lambda k: key[suffixes + 8 * k]
        first = at(0)
        lo, hi = np.searchsorted(first, self.low[0]), np.searchsorted(first, self.high[0], "right")
        for step in range(1, self.steps):  # the range of a longer piece is narrowed by its next 8 bytes
            longer = np.flatnonzero((self.search_len > 8 * step) & (hi > lo))
            if not len(longer):
                break
            then = at(step)
            for k in longer:
                part = then[lo[k] : hi[k]]
                lo[k], hi[k] = lo[k] + np.searchsorted(part, self.low[step][k]), lo[k] + np.searchsorted(part, self.high[step][k], "right")
        count = hi - lo
        place = suffixes[ragged(lo, count)]
        which = np.repeat(np.arange(len(count)), count)
        inside = place + self.search_len[which] <= unit_end[place]
        return place[inside], self.search_ids[which[inside]]

    def _ordered(self, key: np.ndarray, n: int) -> np.ndarray:
        """The suffix array: places in the order of what follows them, as far as the longest piece reaches.

        The first 8 bytes order most; places that are equal so far are ordered by the next 8, and so on.
        """
        suffixes = np.argsort(key[:n], kind="stable")
        new = np.append(True, np.diff(key[suffixes]) != 0)
        for step in range(1, self.steps):
            tied = np.flatnonzero(~new | np.append(~new[1:], False))
            if not len(tied):
                break
            run = np.cumsum(new)[tied]
            here = suffixes[tied]
            order = np.lexsort((key[here + 8 * step], run))
            suffixes[tied] = here = here[order]
            value = key[here + 8 * step]
            new[tied] = np.append(True, (np.diff(run) != 0) | (np.diff(value) != 0))
        return suffixes

    def _lattice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, how many each has)."""
        n, size = len(data), np.diff(offsets)
        unit = np.repeat(np.arange(len(size)), size)
        start, end = offsets[:-1][unit], offsets[1:][unit]
        place, token = self._edges(data, end)
        width = self.said_at[1:] - self.said_at[:-1]
        stop = place + width[token]
        # characters that are no piece: an edge of their own, with a number beyond the pieces'
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        tails = np.append(heads[1:], n)
        single = np.zeros(n, bool)
        single[place[stop == tails[np.searchsorted(heads, place)]]] = True
        odd = np.flatnonzero(~single[heads])
        code = np.array([len(self.pieces) + ord(data[a:b].tobytes().decode("utf-8", "replace")[0]) for a, b in zip(heads[odd], tails[odd], strict=True)], np.int64)
        place, token, stop = np.concatenate([place, heads[odd]]), np.concatenate([token, code]), np.concatenate([stop, tails[odd]])
        # relax by distance from the unit's start, all units at once
        ahead = stop - start[place]
        order = np.argsort(ahead, kind="stable")
        place, token, stop, ahead = place[order], token[order], stop[order], ahead[order]
        groups = np.searchsorted(ahead, np.arange(1, (int(ahead[-1]) if len(ahead) else 0) + 2))
        last = np.full(n + 1, -1, np.int64)  # by the last byte's place, so that units don't meet
        for a, b in zip(groups, groups[1:], strict=False):
            if a == b:
                continue
            p, t = place[a:b], token[a:b]
            opening = p == start[p]
            before = np.where(opening, -1, last[p - 1])
            fits = (before >= 0) | opening
            fits[fits] = self._stay(before[fits], t[fits])
            last[stop[a:b][fits] - 1] = t[fits]
        # walk back from the ends
        lengths = lambda t, at: np.where(t < len(self.pieces), width[np.minimum(t, len(self.pieces) - 1)], self._char_bytes(t))
        active, at = np.arange(len(size)), offsets[1:].copy()
        active = active[size > 0]
        steps = []
        while len(active):
            t = last[at[active] - 1]
            at[active] -= lengths(t, at[active])
            steps.append((active, t, at[active]))
            active = active[at[active] > offsets[active]]
        u, t, pos = (np.concatenate([s[k] for s in steps]) if steps else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(pos, kind="stable")
        u, t, pos = u[order], t[order], pos[order]
        odd = t >= len(self.pieces)
        if odd.any():  # characters that are no piece become their bytes
            reps = np.where(odd, self._char_bytes(t), 1)
            src = np.repeat(np.arange(len(t)), reps)
            byte = data[ragged(pos, reps)]
            u, t = u[src], np.where(odd[src], self.byte[byte], t[src])
        return t.astype(np.uint32), np.bincount(u, minlength=len(size))

    def _char_bytes(self, t: np.ndarray) -> np.ndarray:
        c = t - len(self.pieces)
        return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)

    def _stay(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether merging before and token together gives just these two; before is -1 at the start of a unit."""
        key = ((before + 1).astype(U) << U(32)) | token.astype(U)
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        known = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(len(key), bool)
        if not known.all():
            new = np.unique(key[~known])
            ok = np.fromiter((self._merges_to(int(k >> U(32)) - 1, int(k & U(0xFFFFFFFF))) for k in new), bool, len(new))
            where = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_ok = np.insert(self.pair_keys, where, new), np.insert(self.pair_ok, where, ok)
            at = np.searchsorted(self.pair_keys, key)
        return self.pair_ok[at]

    def _text(self, token: int) -> str:
        return self.pieces[token].replace(META, " ") if token < len(self.pieces) else chr(token - len(self.pieces))

    def _merges_to(self, before: int, token: int) -> bool:
        if before < 0:
            if token not in self.own:
                self.own[token] = len(self._merged(self._text(token))) == 1
            return self.own[token]
        a, b = self._text(before), self._text(token)
        return self._merges_to(-1, token) and self._merged(a + b) == [a, b]

    def _merged(self, text: str) -> list[str]:
        """Merge neighbours, the best score first and the leftmost of equals, until none make a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    # -- decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts in order, offsets): the space before each text is taken off again."""
        width = self.said_at[1:] - self.said_at[:-1]
        size = width[ids]
        out = self.said[ragged(self.said_at[ids], size)]
        upto = np.concatenate(([0], np.cumsum(size)))[offsets]
        lead = np.zeros(len(out), bool)
        full = upto[:-1][np.diff(upto) > 0]
        lead[full] = out[full] == 32
        ends = upto - np.concatenate(([0], np.cumsum(lead)))[upto]
        return out[~lead], ends


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids), one for each input row, equal to the library's own.

    Null and empty texts have no ids. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in pieces(batches, 1, SLICE):
            ids, offsets = m.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))], ["id", "ids"])

    d = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    return d.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) for rows (id, ids); null and empty lists give empty texts, ids outside the model are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            lists = b.column(1).fill_null([])
            o = lists.offsets.to_numpy().astype(np.int64)
            data, ends = m.decode(lists.values.to_numpy()[o[0] : o[-1]].astype(np.int64), o - o[0])
            text = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string())], ["id", "text"])

    d = pick(coded, id_col, ids_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return d.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_ids, ids_crc32, decoded_crc32, same): whole texts encoded and decoded again in one pass.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers, decoded_crc32 that of the decoded text in
    UTF-8; same tells whether it equals the text. Null and empty texts have no ids and are the same again. Very long texts are slices of their
    own. Rows are coded one by one, whether ids are null or repeated. An empty table gives an empty result; other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in pieces(batches, 1, SLICE):
            ids, offsets = m.encode(b.column(1))
            text, ends = m.decode(ids, offsets)
            data, o = text_buffers(b.column(1))
            crc = lambda x, at, w: [zlib.crc32(x[w * a : w * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            raw, back, was = (memoryview(np.ascontiguousarray(x)).cast("B") for x in (ids.astype("<u4"), text, data))
            same = [was[a:z] == back[c:d] for a, z, c, d in zip(o[:-1].tolist(), o[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(crc(raw, offsets, 4), pa.int64()), pa.array(crc(back, ends, 1), pa.int64()), pa.array(same)], schema=schema)

    d = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    return d.mapInArrow(run, "id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean").withColumnRenamed("id", id_col)
