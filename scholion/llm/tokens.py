"""Token ids of whole texts by the tokenizers library, each distinct chunk between white space being encoded once.

The vocabulary drops white space and never joins text across it, so ids of a text are the ids of its chunks in order; this
is checked when the vocabulary is opened. Where it doesn't hold, or where a text holds an added token, texts are encoded
whole by the library's own rules.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .kernels import LOWER, WHITE, ragged, span_hashes, text_buffers, word_spans

#: Distinct chunks that a worker remembers; then it starts anew.
MEMORY = 600_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: The splitter for which chunks may also be cut between ASCII letters, digits and other ASCII characters but apostrophes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: 1: letters, 2: digits, 3: other ASCII characters; 0: apostrophes and bytes of longer characters, next to which nothing is cut.
KINDS = np.zeros(256, np.uint8)
KINDS[33:128] = 3
KINDS[48:58] = 2
KINDS[65:91] = KINDS[97:123] = 1
KINDS[39] = 0
_encoders: dict[str, "ChunkEncoder"] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "ChunkEncoder":
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class ChunkCache:
    """Ids of chunks that were met before; a subclass encodes new ones.

    Chunks are known by two independent 64-bit hashes, sorted by the first; bytes objects would take many times the memory.
    """

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.second = np.empty(0, np.uint64)
        self.entry = np.empty(0, np.int32)
        self.flat = np.empty(1 << 20, np.uint32)
        self.start = np.empty(1 << 16, np.int32)
        self.count = np.empty(1 << 16, np.int32)
        self.entries = self.used = 0

    def encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these chunks in order, how many each has)."""
        raise NotImplementedError

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        ids, counts = self.encode_new(chunks)
        n, new = self.entries, len(ids)
        while self.used + new > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(counts) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : self.used + new] = ids
        self.start[n : n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(counts)] = counts
        self.entries, self.used = n + len(counts), self.used + new
        return np.arange(n, self.entries, dtype=np.int32)

    def _entries(self, chunks: pa.Array) -> np.ndarray:
        """The entry of each of these distinct chunks, new ones being encoded first."""
        if self.entries > MEMORY:
            self.forget()
        data, offsets = text_buffers(chunks)
        key, second = (span_hashes(data, offsets[:-1], offsets[1:], k) for k in (0, 1))
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        found = (self.keys[at] == key) & (self.second[at] == second) if len(self.keys) else np.zeros(len(key), bool)
        out = np.empty(len(key), np.int32)
        out[found] = self.entry[at[found]]
        missing = np.flatnonzero(~found)
        if len(missing):
            out[missing] = self._learn(chunks.take(pa.array(missing)))
            new = missing[np.argsort(key[missing])]
            where = np.searchsorted(self.keys, key[new])
            self.keys, self.second, self.entry = np.insert(self.keys, where, key[new]), np.insert(self.second, where, second[new]), np.insert(self.entry, where, out[new])
        return out

    def ids_of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the adjacent chunks data[bounds[i] : bounds[i + 1]], how many ids come before each chunk and in all)."""
        narrow = len(data) < 2**31
        buffers = [None, pa.py_buffer(bounds.astype(np.int32 if narrow else np.int64)), pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.binary() if narrow else pa.large_binary(), len(bounds) - 1, buffers).dictionary_encode()
        entry = self._entries(coded.dictionary)[coded.indices.to_numpy()]
        counts = self.count[entry]
        return self.flat[ragged(self.start[entry], counts)], np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


class ChunkEncoder(ChunkCache):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.by_chunk = _drops_white_space(spec)
        self.added = [a["content"].encode() for a in spec.get("added_tokens", [])]
        self.forget()

    def encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids, counts = [], []
        for at in range(0, len(chunks), 20_000):
            part = [e.ids for e in encode([c.decode("utf-8", "replace") for c in chunks.slice(at, 20_000).to_pylist()], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, part), np.int64, len(part)))
            ids.append(np.fromiter(chain.from_iterable(part), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as uint32, offsets of the texts)."""
        data, offsets = text_buffers(column)
        if not self.by_chunk or any(a in data.tobytes() for a in self.added):  # added tokens in a text are not cut
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter((i for x in ids for i in x), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        starts, ends, first = word_spans(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        lengths = ends - starts
        joined = data[~WHITE[data]]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        kinds = KINDS[joined]
        cut = np.zeros(len(joined) + 1, bool)
        cut[1:-1] = (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
        cut[upto] = True
        follows = np.append(joined[1:] > 127, False) & ~cut[1:]
        joined = np.where(follows, joined, LOWER[joined])
        bounds = np.flatnonzero(cut)
        first = np.searchsorted(bounds, upto[first])
        ids, upto = self.ids_of(joined, bounds)
        return ids, upto[first]


def _drops_white_space(spec: dict) -> bool:
    """Whether normaliser and splitter are those that keep chunks between white space apart."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    white = any(s.get("type") == "Replace" and s.get("pattern", {}).get("Regex") == r"\s+" for s in steps) and {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}
    split = [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and pre[0]["pattern"].get("Regex") == PATTERN
    added = any(any(c.isspace() for c in a["content"]) or a["content"] != a["content"].lower() for a in spec.get("added_tokens", []))
    return bool(white and split and not added and spec.get("post_processor") is None)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one more id after each text."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
