"""Shared plumbing: reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: tab, LF, VT, FF, CR and space.
SPACE = r"[\x20\x09-\x0D]+"

#: Shuffle files go when a query ends, not when the driver happens to collect garbage; rows may hold long texts.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_own_dir: str | None = None
_to_clean: set[str] = set()
#: Paths and tables of the scopes that are open, innermost last.
_scopes: list[list[str]] = []
#: Rows of a table made on the driver that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset in local mode (as in tests), one of our own.

    On a cluster an unset folder is an error: executors would each write to a disk that the others can't see.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="scholion-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when its scope closes, or else when the application ends."""
    root = f"{shared_dir(spark)}/scholion-{spark.sparkContext.applicationId}"
    if root not in _to_clean:
        _to_clean.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What operators called inside have written is removed at the end; write or count their results inside.

    For sessions that go on for long: without a scope, intermediate tables stay until the application ends.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def forget_at_end(spark: SparkSession, table: str) -> None:
    """Take a table out of the catalog when the application ends; its files lie in a scratch folder."""
    atexit.register(_forget, spark, table)


def _forget(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch path whose last reader is done."""
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already; then the folder stays for the operator of the cluster
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give their shuffle files back as they end, and send Python fewer rows at a time."""
    before = {k: spark.conf.get(k, None) for k in _TIDY}
    for k, v in _TIDY.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. A lost executor costs only its own tasks."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A table of whole numbers and names made on the driver, as a constant of the plan: no Python, no RDD, no file.

    It is broadcast if it has at most BROADCAST_ROWS rows; beyond that it is joined by a shuffle.
    """
    fields = [c.split() for c in kind.split(",")]
    text = json.dumps([dict(zip((name for name, _ in fields), r, strict=True)) for r in rows])
    shape = ", ".join(f"{name}: {of}" for name, of in fields)
    out = spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{shape}>>")))
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores added until no column of docs is called so."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def columns(docs: DataFrame) -> list:
    """The columns of docs by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def text_of(column: str = "text"):
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only these columns of the input, so that extra columns with clashing names can't interfere."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
