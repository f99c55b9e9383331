"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Lines have features of their own and of their neighbours. Forward and backward passes give each line's marginal of being
good; the marginals, weighted by the lines' lengths, make up the quality of the document. The model is small (some hundred
weights), is trained here on a bounded sample of labelled documents and goes to the executors with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, pick, written
from .kernels import WHITE, mix, pieces, release, span_hashes, text_buffers, word_spans

#: Byte classes whose shares of a line are features.
LETTERS_UP, LETTERS_LOW, DIGITS, MARKS, SYMBOLS, BARS, BANGS, SPACES, HIGH = range(9)
CLASSES = np.full(256, MARKS, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = LETTERS_UP, LETTERS_LOW, DIGITS, HIGH
CLASSES[[ord(c) for c in "#*$%&<>"]] = SYMBOLS
CLASSES[ord("|")], CLASSES[ord("!")] = BARS, BANGS
CLASSES[WHITE] = SPACES
#: Shares and lengths fall into bins with these bounds; a bin is a feature that holds or not.
SHARES = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7])
LENGTHS = np.array([2, 4, 6, 8, 10, 13, 20, 40, 100, 300])
PER_SHARE = len(SHARES) + 1
#: Features of one line; the same again for the line before and the one after.
OWN = 9 * PER_SHARE + 2 * (len(LENGTHS) + 1) + 4
WIDTH = 3 * OWN + 1


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of the features that hold: one row a line, lines' lengths, first line of each text and one more).

    Lines end at LF; lines without a word are left out. A text without a word has one empty line.
    """
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    ends = np.union1d(np.flatnonzero(data == 10) + 1, offsets[1:])
    ends = ends[ends > 0]
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    inked = np.concatenate(([0], np.cumsum(~WHITE[data], dtype=np.int32)))
    full = inked[ends] > inked[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(offsets, starts, "right") - 1
    # texts without words get an empty line, so that each text has a chain
    bare = np.setdiff1d(np.arange(n), doc)
    starts, ends, doc = (np.concatenate(x) for x in ((starts, offsets[bare]), (ends, offsets[bare]), (doc, bare)))
    order = np.lexsort((starts, doc))
    starts, ends, doc = starts[order], ends[order], doc[order]
    size = ends - starts

    kinds = CLASSES[data]
    counts = np.empty((9, len(starts)), np.int64)
    for k in range(9):
        sums = np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int32)))
        counts[k] = sums[ends] - sums[starts]
    length = np.maximum(1, size - counts[SPACES])
    ws, we, _ = word_spans(data, offsets)
    wh = span_hashes(data, ws, we)
    lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = np.maximum(1, hi - lo)
    again = np.concatenate(([0, 0], np.cumsum(wh[1:] == wh[:-1], dtype=np.int64)))[: len(ws) + 1]  # words equal to the one before
    stutter = np.maximum(0, again[hi] - again[np.minimum(lo + 1, np.maximum(hi, lo))]) if len(ws) else np.zeros(len(starts), np.int64)
    shares = [counts[k] / length for k in (LETTERS_UP, LETTERS_LOW, DIGITS, MARKS, SYMBOLS, BARS, BANGS, HIGH)]
    shares.append(stutter / words)
    columns, base = [], 0
    for s in shares:
        columns.append(base + np.searchsorted(SHARES, s, "left"))
        base += PER_SHARE
    for v in (length / words, words):
        columns.append(base + np.searchsorted(LENGTHS, v, "left"))
        base += len(LENGTHS) + 1
    trimmed = ends - (data[np.minimum(ends, len(data)) - 1] == 10) if len(data) else ends
    h = span_hashes(data, starts, np.maximum(trimmed, starts)) if len(data) else np.zeros(len(starts), np.uint64)
    keyed = mix(h ^ doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, many = np.unique(keyed, return_inverse=True, return_counts=True)
    columns.append(base + (many[back] > 1))  # the line occurs again in its text
    columns.append(base + 2 + (size == 0))
    own = np.stack(columns, 1)
    first = np.searchsorted(doc, np.arange(n + 1))
    before, after = np.roll(own, 1, 0) + OWN, np.roll(own, -1, 0) + 2 * OWN
    before[first[:-1]] = -1
    after[first[1:] - 1] = -1
    return np.concatenate([own, before, after], 1).astype(np.int16), np.maximum(1, size), first


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good for each line by its features; the last weight is the bias, -1 is no feature."""
    padded = np.append(weights, 0.0)
    out = np.full(len(features), weights[-1])
    for k in range(features.shape[1]):
        out += padded[features[:, k]]
    return out


def chains(odds: np.ndarray, first: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability that each line is good, that it has the label of the line before, log of each text's normaliser).

    Equal neighbours score stay. The first line of a text has no line before, which counts as 0. Texts are taken step by step together, the
    long ones going on alone, so the cost is that of the lines and memory that of the batch.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    starts, sizes = first[:-1][order], n[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t lines
    e = np.zeros((len(odds), 2))
    e[:, 1] = odds
    forward, backward = np.empty_like(e), np.zeros_like(e)
    move = lambda m: np.stack([np.logaddexp(m[:, 0] + stay, m[:, 1]), np.logaddexp(m[:, 0], m[:, 1] + stay)], 1)
    for t in range(longest):
        at = starts[: active[t]] + t
        forward[at] = e[at] + (move(forward[at - 1]) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        backward[at] = move(e[at + 1] + backward[at + 1])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
    ends = first[1:] - 1
    norm = np.logaddexp(forward[ends, 0], forward[ends, 1])
    agree = np.zeros(len(odds))
    later = np.setdiff1d(np.arange(len(odds)), first[:-1])
    pair = forward[later - 1] + stay + e[later] + backward[later]
    agree[later] = np.exp(np.logaddexp(pair[:, 0], pair[:, 1]) - np.repeat(norm, n)[later])
    return good, agree, norm


def marginals(odds: np.ndarray, first: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, log of each text's normaliser)."""
    good, _, norm = chains(odds, first, stay)
    return good, norm


def document_scores(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean marginals by document, weighted by the lines' lengths."""
    return np.add.reduceat(good * length, first[:-1]) / np.add.reduceat(length, first[:-1]) if len(first) > 1 else np.empty(0)


class Model:
    """Weights of line features, the transition weight, and the scale that makes a score of a document's mean marginal."""

    def __init__(self, weights: np.ndarray, stay: float, scale: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.stay, self.scale = weights, stay, scale

    def raw(self, column: pa.Array) -> np.ndarray:
        features, length, first = line_features(column)
        good, _ = marginals(emissions(features, self.weights), first, self.stay)
        return document_scores(good, length, first)

    def score(self, column: pa.Array) -> np.ndarray:
        m = np.clip(self.raw(column), 1e-4, 1 - 1e-4)
        z = self.scale[0] * np.log(m / (1 - m)) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Likelihood:
    """Penalised log-likelihood of texts all of whose lines have the text's label, and its gradient.

    Each text counts by its weight, divided by its lines, so that a long one isn't heard more often.
    """

    def __init__(self, features: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray, decay: float = 1e-3, calm: float = 0.05):
        self.features, self.first, self.decay, self.calm = features, first, decay, calm
        self.n = np.diff(first)
        self.share = weight / self.n
        self.y = np.repeat(labels.astype(float), self.n)
        self.flat = np.where(features < 0, WIDTH, features).ravel()

    def value(self, weights: np.ndarray, stay: float) -> float:
        odds = emissions(self.features, weights)
        _, norm = marginals(odds, self.first, stay)
        path = np.add.reduceat(self.y * odds, self.first[:-1]) + stay * (self.n - 1)
        return float((self.share * (path - norm)).sum() - self.decay / 2 * (weights**2).sum() - self.calm / 2 * stay**2)

    def gradient(self, weights: np.ndarray, stay: float) -> np.ndarray:
        """By each weight, and by stay: what is observed less what the chains expect of single lines and of neighbours."""
        good, agree, _ = chains(emissions(self.features, weights), self.first, stay)
        w = np.repeat(self.share, self.n)
        residual = w * (self.y - good)
        grad = np.bincount(self.flat, np.repeat(residual, self.features.shape[1]), WIDTH + 1)[:WIDTH]
        grad[-1] = residual.sum()
        later = np.ones(len(w), bool)
        later[self.first[:-1]] = False
        return np.append(grad - self.decay * weights, (w * (1 - agree))[later].sum() - self.calm * stay)


def fit(texts: pa.Array, labels: np.ndarray, steps: int = 200, rate: float = 0.1) -> Model:
    """Maximum likelihood by full-batch steps: the chain of a document is labelled as the document is.

    Both labels weigh the same, so that a rare one isn't drowned. Without documents of either label the model is neutral.
    """
    weights, stay = np.zeros(WIDTH), 1.0
    if len(labels) == 0 or labels.min() == labels.max():
        weights[-1] = 0.0 if len(labels) == 0 else (4.0 if labels[0] else -4.0)
        return Model(weights, stay)
    # some texts at a time: what is counted for each byte on the way is many times the texts
    parts = [line_features(b.column(0)) for b in pieces(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), 0, 1 << 20)]
    features, length = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.concatenate([[0], *(p[2][1:] + at for p, at in zip(parts, np.cumsum([0, *(p[2][-1] for p in parts)]), strict=False))])
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    target = Likelihood(features, first, labels, share)
    m1, m2 = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for step in range(1, steps + 1):
        g = target.gradient(weights, stay)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        weights, stay = weights + move[:-1], float(np.clip(stay + move[-1], 0.0, 4.0))
    model = Model(weights, stay)
    good, _ = marginals(emissions(features, weights), first, stay)
    mean = np.clip(document_scores(good, length, first), 1e-4, 1 - 1e-4)
    model.scale = _calibrated(np.log(mean / (1 - mean)), labels.astype(float))
    return model


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on one number, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 1), (y - p).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum()]])
        d = np.linalg.solve(h, g)
        a, b = float(np.clip(a + d[0], 0.05, 20)), b + float(np.clip(d[1], -2, 2))
    return a, b


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, most_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most `most` labelled documents of `most_bytes` together, of those whose crc32 of the id is not 0 modulo 5.

    They are drawn by a hash of the id; a text that would exceed the bytes is passed over. Rows without a label, an id or a
    text are not learnt from; of contradicting labels of one id the larger counts; each row of a repeated id is a document.
    Without labelled documents, as with empty tables, the model is neutral. Other columns are ignored.
    """
    held_out = F.pmod(F.crc32(F.col("label_id").cast("string").cast("binary")), F.lit(5)) == 0
    known = pick(labels, id_col, label_col).select(F.col(f"`{id_col}`").cast("long").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where("label_id IS NOT NULL AND y IN (0, 1)").where(~held_out).groupBy("label_id").agg(F.max("y").alias("y"))
    # A threshold on the hash first, so that tasks keep their share of the sample and not the whole of it each.
    n = known.count()
    draw = F.pmod(F.xxhash64("label_id"), F.lit(2**40))
    drawn = known.where(draw <= int(2**40 * min(1.0, (2 * most + 100) / max(1, n)))).orderBy(draw, "label_id").limit(most)
    d = pick(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    sample = d.join(F.broadcast(drawn), F.col("id") == F.col("label_id")).select("id", "text", "y", F.octet_length("text").alias("size"), F.monotonically_increasing_id().alias("row"))
    sample = written(sample, "labelled")
    taken, total = [], 0
    for r in sample.select("row", "size").orderBy(F.pmod(F.xxhash64("id"), F.lit(2**40)), "row").limit(most).collect():
        if total + r["size"] <= most_bytes:
            taken.append(r["row"])
            total += r["size"]
    rows = sample.where(F.col("row").isin(taken)).select("id", "text", "y").toArrow().combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
    y = rows.column("y").to_numpy()
    model = fit(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), y)
    del rows
    release()
    return model


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: bool = False, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """Rows (id, score, predicted), one for each input row; with keep, all columns of the input and score and predicted.

    Null texts count as empty; empty texts have a score too; very long texts are scored whole, one at a time. Each row is
    scored by itself, also where rows repeat an id. An empty table gives an empty result. With keep, `names` of the two new
    columns must differ from those of the input.
    """
    model_weights, stay, scale = model.weights, model.stay, model.scale
    d = docs.select(*columns(docs)) if keep else pick(docs, id_col, text_col)
    at = d.columns.index(text_col)
    stays = [k for k in range(len(d.columns)) if keep or k != at]
    clash = {c.lower() for k, c in enumerate(d.columns) if k in stays} & {n.lower() for n in names}
    assert not clash, f"columns of the input are called {clash}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model_weights, stay, scale)
        for b in pieces(batches, at, 1 << 20):
            s = m.score(b.column(at))
            shape = pa.schema([*(b.schema.field(k) for k in stays), (names[0], pa.float64()), (names[1], pa.int32())])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in stays), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=shape)

    fields = [d.schema[k] for k in stays] + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return d.mapInArrow(run, T.StructType(fields))
