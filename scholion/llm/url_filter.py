"""URL filters by a sorted digest array.

The listed strings (host plus path prefix) are stored as a file: the sorted 64-bit xxhash keys, then the strings
themselves. Executors fetch the file once through Spark's own file server and map it into memory; a batch of URLs is
probed by one vectorised binary search over the candidates of all its URLs, and a hit counts only if the stored string is equal.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .kernels import ragged

#: Strings that a list taken from a table may have: they are gathered on the driver, which writes the file.
MOST_LISTED = 50_000_000
_open: dict[str, "DigestArray"] = {}


class DigestArray:
    """Sorted keys, verdicts, string offsets and strings, mapped from one file."""

    def __init__(self, path: str):
        n, size = (int(x) for x in np.fromfile(path, "<u8", 2))
        self.keys = np.memmap(path, "<u8", "r", 16, (n,)) if n else np.empty(0, "<u8")
        self.offsets = np.memmap(path, "<u8", "r", 16 + 8 * n, (n + 1,))
        self.verdicts = np.memmap(path, "u1", "r", 24 + 16 * n, (n,)) if n else np.empty(0, "u1")
        self.strings = np.memmap(path, "u1", "r", 24 + 17 * n, (size,)) if size else np.empty(0, "u1")

    @staticmethod
    def write(path: str, entries: Iterable[tuple[str, bool]]) -> None:
        """entries: (string, blocks). A string listed twice keeps its last verdict."""
        rows = sorted((xxhash.xxh64_intdigest(s), s.encode(), b) for s, b in dict(entries).items())
        ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
        with open(path, "wb") as f:
            f.write(np.array([len(rows), ends[-1]], "<u8").tobytes() + np.array([r[0] for r in rows], "<u8").tobytes() + ends.tobytes())
            f.write(np.array([r[2] for r in rows], "u1").tobytes() + b"".join(r[1] for r in rows))

    def find(self, strings: list[str]) -> np.ndarray:
        """The place of each string, -1 where it isn't listed."""
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        keys = np.fromiter((xxhash.xxh64_intdigest(s) for s in raw), np.uint64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([0, *(len(s) for s in raw)])
        out = np.full(len(raw), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        left = np.flatnonzero(at < len(self.keys))
        while len(left):  # equal digests of different strings stand side by side, so a few steps at most
            left = left[self.keys[at[left]] == keys[left]]
            same = self._equal(at[left], data, ends[left], ends[left + 1])
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(self.keys)]
        return out

    def _equal(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the strings stored at these places are data[starts:ends]."""
        own = self.offsets[at].astype(np.int64)
        size = ends - starts
        same = (self.offsets[at + 1].astype(np.int64) - own) == size
        check = np.flatnonzero(same & (size > 0))
        if len(check):
            differ = self.strings[ragged(own[check], size[check])] != data[ragged(starts[check], size[check])]
            same[check] = ~np.logical_or.reduceat(differ, np.cumsum(size[check]) - size[check])
        return same

    def string(self, i: int) -> str:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes().decode()


def split_url(url: str):
    """(host, path) columns of a url column: both empty without "://", A to Z of the host in lower case."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _open_once(name: str) -> DigestArray:
    if name not in _open:
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def listed(table: DataFrame, column: str, blocks: bool = True) -> list[tuple[str, bool]]:
    """The entries of a list kept as a table; nulls don't count. Its size is checked before it is gathered on the driver."""
    names = table.select(F.col(f"`{column}`").alias("s")).where("s IS NOT NULL").distinct()
    n = names.count()
    if n > MOST_LISTED:
        raise ValueError(f"{n} strings are listed, {MOST_LISTED} at most can be")
    return [(s, blocks) for s in names.toArrow().column(0).to_pylist()]


def _ship(spark, entries: Iterable[tuple[str, bool]]) -> str:
    """Write the file on the driver, from where Spark's file server hands it to executors as long as the application lasts."""
    name = f"urls-{uuid.uuid4().hex}.bin"
    folder = os.path.realpath(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    DigestArray.write(os.path.join(folder, name), entries)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, bool]], blocked_hosts: Iterable[str] | DataFrame = (), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each input row.

    rules: ("example.com/en/", blocks). A rule fits its host and all subdomains if the path starts with the rule's; the
    longest one wins. Without a rule, a URL is blocked if its host or a parent domain is in blocked_hosts (names, or a table
    whose first column has them) and allowed otherwise. Very long urls are judged whole. Null urls and those without "://" have an empty host and path, which no rule fits. Repeated rows are each
    judged; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    rules = list(rules)
    assert all("/" in r for r, _ in rules), "a rule is a host and a path, as example.com/en/"
    hosts = listed(blocked_hosts, blocked_hosts.columns[0]) if isinstance(blocked_hosts, DataFrame) else [(h, True) for h in blocked_hosts]
    rule_file, host_file = _ship(spark, rules), _ship(spark, hosts)
    lengths = sorted({len(r) - r.index("/") for r, _ in rules}, reverse=True)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_rules, in_hosts = _open_once(rule_file), _open_once(host_file)
        for b in batches:
            probes, owner, ask, asker = [], [], [], []
            for k, (host, path) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if not host:
                    continue
                at = 0
                while True:  # the host itself, then each parent domain
                    domain = host[at:]
                    ask.append(domain)
                    asker.append(k)
                    for n in lengths:
                        if n <= len(path):
                            probes.append(domain + path[:n])
                            owner.append(k)
                    dot = host.find(".", at)
                    if dot < 0:
                        break
                    at = dot + 1
            rule: list[str | None] = [None] * b.num_rows
            verdict = ["allow"] * b.num_rows
            found = in_hosts.find(ask)
            for j in np.flatnonzero(found >= 0):
                verdict[asker[j]] = "block"
            hit = in_rules.find(probes)
            for j in np.flatnonzero(hit >= 0):
                k, text = owner[j], probes[j]
                if rule[k] is None or len(text) > len(rule[k]):
                    rule[k], verdict[k] = text, "block" if in_rules.verdicts[hit[j]] else "allow"
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    host, path = split_url(f"`{url_col}`")
    split = pick(pages, id_col, url_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), host.alias("host"), path.alias("path"))
    return split.mapInArrow(judge, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
