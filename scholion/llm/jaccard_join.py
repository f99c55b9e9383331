"""N-gram Jaccard join by signature trees.

Documents with equal shingle sets are one class, represented by the smallest id. Two classes that link share a shingle
among the first ones of each in a common order (the prefix of a set), in which shingles that are frequent in a sample come
last; in the smaller set it stands so far in front that the rest suffices for a link. Classes that share such a shingle with a partner of
fitting size are a group; groups with the same smallest class are one cell. The classes of a large cell are dealt in chunks.

A cell is a signature tree: leaves are classes ordered by size, with bitmaps of their shingles; nodes hold the OR of their
leaves' bitmaps, the range of sizes and the fewest bits of a leaf. A dual traversal takes pairs of nodes, drops those whose largest
possible overlap is too small or whose leaves are connected already, and ends with exact counts on the sets. Only which
classes are connected leaves a cell, as a star, so no pair of a group is emitted; components of the stars are the result.

Chunks meet in two rounds. In the first each is compared with itself and with the first chunk, which costs as many tasks as
there are chunks and connects a family of near copies. In the second, what a cell's largest component has not taken in is compared
among itself and with that component, shingle by shingle where much is left; pairs that are connected already are never
looked at. So no link is lost, and work grows with the square only of those classes of one shingle that stay unconnected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bundles
from .bundles import parts_of
from .common import written
from .components import components
from .kernels import LOWER, U, mix, ngrams, owners, span_hashes, text_buffers, word_spans
from .substring_dedup import ASK, BITS, _asked, _pack, _pack_ids, _unpack, _unpack_ids

#: Classes and shingles of a cell or chunk at most (a larger set is a chunk by itself); leaves below a lowest node, nodes below others.
CELL, SHINGLES = 512, 400_000
LEAVES, FAN = 16, 8
#: Documents of the sample by which frequent shingles are ordered last, and the count there from which one is frequent.
SAMPLE, FREQUENT = 20_000, 3


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text, offsets of the texts); A to Z count as a to z.

    A text of fewer than n words has its whole sequence as one shingle; one without words has none.
    """
    data, offsets = text_buffers(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    h, fits = ngrams(words, first, n)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    for k in range(1, n):  # shorter sequences by their own lengths, so they never equal a longer one
        some = short[size[short] == k]
        at = first[some]
        if len(at):
            fits[at] = True
            h[at] = ngrams(words, first, k)[0][at]
    doc = owners(first)[fits]
    h = h[fits]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (np.diff(h) != 0) | (np.diff(doc) != 0))[: len(h)]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(size) + 1))


def signatures(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    a = np.concatenate(([U(0)], np.cumsum(mix(h + U(0x51ED27)), dtype=U)))
    b = np.concatenate(([U(0)], np.cumsum(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U)))
    return mix(a[offsets[1:]] - a[offsets[:-1]]), mix(b[offsets[1:]] - b[offsets[:-1]] + U(1))


def prefix(size: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of that size the prefix holds."""
    return size - -(-percent * size // 100) + 1


def short_prefix(size: np.ndarray, percent: int) -> np.ndarray:
    """The same where the other set is no smaller: 2 * percent / (100 + percent) of the set must follow the first shared shingle."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def useful(group: np.ndarray, size: np.ndarray, early: np.ndarray, percent: int) -> np.ndarray:
    """Which members have a partner in their group that they could link with; rows are ordered by group and size.

    Of two sets that link and have a group's shingle as their first common one, the smaller has it early, that is in its
    short prefix. So a member needs one that is early and no larger than itself, or to be early and one that is no smaller.
    """
    wide = (int(size.max(initial=0)) + 1) * 100 // percent + 2
    at = group * wide + size
    upto = np.concatenate(([0], np.cumsum(early)))
    lower = np.searchsorted(at, group * wide + -(-percent * size // 100), "left")
    same, above = np.searchsorted(at, at, "left"), np.searchsorted(at, at, "right")
    higher = np.searchsorted(at, group * wide + 100 * size // percent, "right")
    return (early & (higher - same > 1)) | (upto[above] - upto[lower] - early > 0)


class Tree:
    """Signature tree over sets ordered by size; levels[0] are the lowest nodes."""

    def __init__(self, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, side: np.ndarray | None = None):
        """known: labels of sets that are connected already; side: only sets of different sides are compared."""
        self.sets, self.percent, self.side = sets, percent, side
        self.size = np.array([len(s) for s in sets])
        width = 256
        while width < 8192 and width < 2 * np.median(self.size):
            width *= 2
        dense = np.zeros((len(sets), width), bool)
        dense[np.repeat(np.arange(len(sets)), self.size), (np.concatenate(sets) % U(width)).astype(np.int64)] = True
        self.bits = np.packbits(dense, axis=1).view(U)
        self.ones = np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.comp = np.arange(len(sets))
        if known is not None:
            _, least, which = np.unique(known, return_index=True, return_inverse=True)
            self.comp = least[which]
        self.levels = []
        lo = np.arange(0, len(sets), LEAVES)
        hi = np.minimum(lo + LEAVES, len(sets))
        while True:
            self.levels.append({
                "lo": lo, "hi": hi, "or": np.bitwise_or.reduceat(self.bits, lo, axis=0),
                "least": self.size[lo], "most": self.size[hi - 1], "ones": np.minimum.reduceat(self.ones, lo),
            })
            if len(lo) == 1:
                break
            lo = lo[::FAN]
            hi = np.append(lo[1:], len(sets))

    def _hopeless(self, level: int, a: int, b: int) -> bool:
        n, p = self.levels[level], self.percent
        if p * max(n["least"][a], n["least"][b]) > 100 * min(n["most"][a], n["most"][b]):
            return True
        # x outside y holds at least the bits of x that no leaf of the other node has; a link leaves room for few
        common = int(np.bitwise_count(n["or"][a] & n["or"][b]).sum())
        room = lambda x, y: (100 * n["most"][x] - p * n["least"][y]) // (100 + p)
        return n["ones"][a] - common > room(a, b) or n["ones"][b] - common > room(b, a)

    def _connected(self, level: int, a: int, b: int) -> bool:
        n, c = self.levels[level], self.comp
        one = c[n["lo"][a]]
        return bool((c[n["lo"][a] : n["hi"][a]] == one).all() and (c[n["lo"][b] : n["hi"][b]] == one).all())

    def connect(self) -> np.ndarray:
        """The smallest place that each leaf is connected with."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if self._connected(level, a, b) or self._hopeless(level, a, b):
                continue
            if level == 0:
                self._leaves(a, b)
                continue
            n = len(self.levels[level - 1]["lo"])
            below = lambda x: range(x * FAN, min(n, (x + 1) * FAN))
            pairs = [(x, y) for x in below(a) for y in below(b) if x <= y]
            pairs.sort(key=lambda q: q[0] == q[1])  # nodes with themselves come off the stack first, so the rest finds them connected
            stack.extend((level - 1, x, y) for x, y in pairs)
        return self.comp

    def _leaves(self, a: int, b: int) -> None:
        n, p = self.levels[0], self.percent
        x, y = np.arange(n["lo"][a], n["hi"][a]), np.arange(n["lo"][b], n["hi"][b])
        sx, sy = self.size[x][:, None], self.size[y][None, :]
        fits = (p * np.maximum(sx, sy) <= 100 * np.minimum(sx, sy)) & (x[:, None] < y[None, :]) & (self.comp[x][:, None] != self.comp[y][None, :])
        if self.side is not None:
            fits &= self.side[x][:, None] != self.side[y][None, :]
        if not fits.any():
            return
        both = np.bitwise_count(self.bits[x][:, None, :] & self.bits[y][None, :, :]).sum(2).astype(np.int64)
        fits &= self.ones[x][:, None] - both <= (100 * sx - p * sy) // (100 + p)
        fits &= self.ones[y][None, :] - both <= (100 * sy - p * sx) // (100 + p)
        for i, j in zip(*np.nonzero(fits), strict=True):
            u, v = x[i], y[j]
            if self.comp[u] == self.comp[v]:
                continue
            common = len(np.intersect1d(self.sets[u], self.sets[v], assume_unique=True))
            if 100 * common >= p * (self.size[u] + self.size[v] - common):
                low, high = sorted((self.comp[u], self.comp[v]))
                self.comp[self.comp == high] = low


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Rows (id, n_shingles, component_id, class_id), one for each input row.

    Two documents link when 100 * intersection >= percent * union of their sets of n-word shingles; component_id is the smallest
    id that links reach, class_id the smallest with the same set. Texts without words, null ones included, link with
    nothing. Rows that repeat an id are one node, with the links of all their texts. Rows with a null id link with nothing and have a null component. A very
    long text is a bundle and a chunk of its own. An empty table gives an empty result; other columns are ignored.
    """
    stored = bundles.store(docs, id_col, text_col, "jaccard_bundles")
    n_parts = bundles.parts(stored)

    def classes(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        ids, texts = bundles.opened(batch, k)
        h, o = shingles(texts, n)
        one, two = signatures(h, o)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(o)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "n_shingles", "s1", "s2"])

    slim = written(bundles.apply(stored, classes, "id long, n_shingles long, s1 long, s2 long"), "classes")
    frequent = _frequent(stored, slim, n)

    def ask(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        ids, texts = bundles.opened(batch, k)
        h, o = shingles(texts, n)
        one, _ = signatures(h, o)
        size, doc = np.diff(o), owners(o)
        late = _counted(h, *frequent)
        order = np.lexsort((h, late, doc))
        rank = np.arange(len(h)) - o[doc]
        at = np.flatnonzero((rank < prefix(size, percent)[doc]) & np.asarray(ids.is_valid())[doc])
        take = order[at]
        # equal sets of this bundle ask once, by the smallest id
        d = doc[take]
        early = rank[at] < short_prefix(size, percent)[d]
        number = ids.fill_null(0).to_numpy()[d]
        key = h[take] >> U(64 - BITS)
        by = np.lexsort((number, one[d], key))
        key, sig, number, d, early = key[by], one[d][by], number[by], d[by], early[by]
        new = np.append(True, (np.diff(key) != 0) | (np.diff(sig) != 0))[: len(key)]
        key, sig, number, d, early = key[new], sig[new], number[new], d[new], early[new]
        parts, cut = parts_of(key, n_parts, BITS)
        load = [
            _pack(key[a:z]) + sig[a:z].astype("<u8").tobytes() + d[a:z].astype("<u4").tobytes() + (2 * size[d[a:z]] + early[a:z]).astype("<u4").tobytes() + _pack_ids(number[a:z])
            for a, z in zip(cut, cut[1:], strict=False)
        ]
        return _asked(batch, k, parts, cut, load)

    members = pa.schema([("cell", pa.int64()), ("shingle", pa.int64()), ("id", pa.int64()), ("b", pa.int64()), ("place", pa.int32()), ("size", pa.int32())])

    def cells(t: pa.Table) -> pa.Table:
        counts = t.column("n").to_pylist()
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for raw, c in zip(t.column("payload"), counts, strict=True):
            m = memoryview(raw.as_buffer())
            key, at = _unpack(m, c)
            for to, x in zip(cols, (key, np.frombuffer(m, "<u8", c, at), np.frombuffer(m, "<u4", c, at + 8 * c), np.frombuffer(m, "<u4", c, at + 12 * c), _unpack_ids(m, c, at + 16 * c)), strict=True):
                to.append(x)
        key, sig, place, size, number = (np.concatenate(c) for c in cols)
        b = np.repeat(t.column("b").to_numpy(), counts)
        order = np.lexsort((number, sig, key))
        key, sig, place, size, number, b = (x[order] for x in (key, sig, place, size, number, b))
        new = np.append(True, (np.diff(key) != 0) | (np.diff(sig) != 0))  # equal sets of all bundles: the smallest id
        key, place, size, number, b = (x[new] for x in (key, place, size, number, b))
        # classes of one shingle by size, without those that find no partner, cut where the next size is too large for any link
        early, size = (size & 1).astype(bool), (size >> 1).astype(np.int64)
        order = np.lexsort((size, key))
        key, place, size, number, b, early = (x[order] for x in (key, place, size, number, b, early))
        some = useful(np.cumsum(np.append(False, np.diff(key) != 0)), size, early, percent)
        key, place, size, number, b = (x[some] for x in (key, place, size, number, b))
        if not len(key):
            return members.empty_table()
        start = np.append(True, (np.diff(key) != 0) | (percent * size[1:] > 100 * size[:-1]))
        cut = np.flatnonzero(start)
        length = np.diff(np.append(cut, len(key)))
        cell = np.repeat(np.minimum.reduceat(number, cut), length)
        some = np.repeat(length > 1, length)
        columns = (cell, key.view(np.int64), number, b, place.astype(np.int32), size.astype(np.int32))
        return pa.Table.from_arrays([pa.array(c[some]) for c in columns], schema=members)

    found = bundles.apply(stored, ask, ASK).groupBy("hb").applyInArrow(cells, "cell long, shingle long, id long, b long, place int, size int")
    found = written(found, "cells")
    once = found.select("cell", "id", "b", "place", "size").distinct()
    one = written(_chunked(once, ["cell"]), "chunks")
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    first, mine, last = F.lit(0), F.col("mine"), F.col("chunks") - 1
    others = F.when(mine > 0, F.array(task(first, mine, 1))).when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda k: task(first, k, 0))).otherwise(F.array().cast("array<struct<i: int, j: int, side: int>>"))
    dealt = one.select("cell", "b", "place", F.col("id").alias("known"), F.explode(F.concat(F.array(task(mine, mine, 0)), others)).alias("t")).select("cell", "b", "place", "t.i", "t.j", "t.side", "known")

    def send(batch: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        w = batch.column("wanted")[k]
        if not w.is_valid or not len(w.values):
            return None
        here = w.values
        ids, texts = bundles.opened(batch, k)
        place = here.field("place")
        return pa.RecordBatch.from_arrays([*(here.field(c) for c in ("cell", "i", "j", "side", "known")), ids.take(place), texts.take(place)], ["cell", "i", "j", "side", "known", "id", "text"])

    edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(t: pa.Table) -> pa.Table:
        ids, known, side = (t.column(c).to_numpy() for c in ("id", "known", "side"))
        h, o = shingles(t.column("text").combine_chunks(), n)
        order = np.lexsort((ids, np.diff(o)))
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        tree = Tree([h[o[k] : o[k + 1]] for k in order], percent, known[order], None if same else side[order])
        before = tree.comp.copy()
        comp = tree.connect()
        ids, moved = ids[order], comp != before
        return pa.Table.from_arrays([pa.array(ids[before[moved]]), pa.array(ids[comp[moved]])], schema=edges)

    def linked(dealt: DataFrame) -> DataFrame:
        wanted = dealt.groupBy("b").agg(F.collect_list(F.struct("place", "cell", "i", "j", "side", "known")).alias("wanted"))
        sent = bundles.apply(bundles.joined(stored, wanted), send, "cell long, i int, j int, side int, known long, id long, text string")
        return sent.groupBy("cell", "i", "j").applyInArrow(join, "a long, b long")

    comps = components(linked(dealt))
    rest = _unconnected(one, found, comps)
    if rest is not None:
        stars = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comps = components(linked(rest).unionByName(stars))

    reps = slim.where("id IS NOT NULL AND n_shingles > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    resolved = reps.join(comps, reps["rep"] == comps["node"], "left").select("s1", "s2", "rep", F.coalesce("component", "rep").alias("component"))
    result = slim.join(resolved, ["s1", "s2"], "left")
    some = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    return result.select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(some, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.when(some, F.col("rep")).otherwise(F.col("id")).alias("class_id"),
    )


def _chunked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `chunks`, how many chunks their cell needs, and `mine`, the one they belong to."""
    sums = rows.groupBy(*keys).agg(F.least(F.count("*"), F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") / SHINGLES))).cast("int").alias("chunks"))
    return rows.join(written(sums, "chunk-counts"), keys).withColumn("mine", F.pmod(F.xxhash64("b", "place"), F.col("chunks")).cast("int"))


def _main(rows: DataFrame) -> DataFrame:
    """Rows (cell, main, rest) of the cells that are several components: the largest, and how many classes it hasn't."""
    sizes = rows.groupBy("cell", "known").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cell").agg(F.max_by("known", F.struct("n", "known")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    return written(main.where("rest > 0"), "main-components")


def _unconnected(one: DataFrame, found: DataFrame, comps: DataFrame) -> DataFrame | None:
    """The second round: (cell, b, place, i, j, side, known) of cells in several chunks that aren't one component yet.

    Where many classes are left, the cell gives way to one for each of its shingles. Chunks of the rest, which a cell's largest component
    has not taken in, meet each other; the component's chunks, numbered after them, meet those of the rest.
    """
    several = one.where("chunks > 1")
    if several.isEmpty():
        return None
    several = several.drop("chunks", "mine").join(comps, F.col("id") == F.col("node"), "left").withColumn("known", F.coalesce("component", "id"))
    several = written(several.select("cell", "b", "place", "size", "known"), "chunk-members")
    main = _main(several)
    if main.isEmpty():
        return None
    few = several.join(main.where(F.col("rest") <= CELL).select("cell"), "cell", "left_semi")
    many = several.join(main.where(F.col("rest") > CELL).select("cell"), "cell", "left_semi").join(found.select("cell", "shingle", "b", "place"), ["cell", "b", "place"])
    rows = written(few.unionByName(many.withColumn("cell", F.xxhash64("cell", "shingle")).drop("shingle")), "cells-left")
    rows = rows.join(_main(rows), "cell").withColumn("inside", F.col("known") == F.col("main"))
    rows = written(_chunked(rows, ["cell", "inside"]), "chunks-left")
    counts = rows.groupBy("cell").agg(F.max(F.when(~F.col("inside"), F.col("chunks"))).alias("r"), F.max(F.when(F.col("inside"), F.col("chunks"))).alias("d"))
    rows = rows.join(written(counts, "chunk-counts"), "cell")
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    mine, r = F.col("mine"), F.col("r")
    among = F.transform(F.sequence(F.lit(0), r - 1), lambda k: task(F.least(mine, k), F.greatest(mine, k), mine > k))
    across = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda k: task(mine, r + k, F.lit(0)))
    from_inside = F.transform(F.sequence(F.lit(0), r - 1), lambda k: task(k, r + mine, F.lit(1)))
    tasks = F.when(F.col("inside"), from_inside).otherwise(F.concat(among, across))
    return rows.select("cell", "b", "place", "known", F.explode(tasks).alias("t")).select("cell", "b", "place", "t.i", "t.j", "t.side", "known")


def _counted(h: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each shingle in the sample, 0 for those that aren't frequent there."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, counts[at], 0)


def _frequent(stored: DataFrame, slim: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that several of the sampled documents share, ascending, how many do).

    The order only decides how much work there is, never which links are found. The sample has about SAMPLE documents, drawn by a hash of
    the id, so what comes to the driver is bounded.
    """
    total = slim.count()
    limit = min(2**63 - 1, int(2**63 * SAMPLE / max(1, total)))

    def draw(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        ids, texts = bundles.opened(batch, k)
        chosen = np.flatnonzero(np.asarray(ids.is_valid()) & ((mix(ids.fill_null(0).to_numpy().view(U)) >> U(1)) <= U(limit)))
        h, _ = shingles(texts.take(pa.array(chosen)), n)
        key, count = np.unique(h, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["h", "n"])

    counts = bundles.apply(stored, draw, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).toArrow()
    h = counts.column("h").to_numpy().view(U)
    order = np.argsort(h)
    return h[order], counts.column("n").to_numpy()[order]
