"""Paged sources (S7 to S10, R2, R5): pages are fetched on the executors, some at a time, until one has nothing.

How a page is fetched is the caller's: a function from a page's number to its records. It runs on executors, so it must be
importable or self-contained, and there is no network in tests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "page long, n int, status string, error string, record map<string, string>"


def fetched(spark: SparkSession, fetch: Callable[[int], Iterable[dict]], pages: Iterable[int], pause: float = 0.0) -> DataFrame:
    """Rows (page, n, status, error, record), one a record; a page without records, or that failed, has one row with n = -1.

    A worker waits `pause` seconds after each page (R5). A failure belongs to its page alone (R4).
    """

    def run(batches):
        for b in batches:
            out = []
            for page in b["page"]:
                try:
                    rows = [{k: None if v is None else str(v) for k, v in r.items()} for r in fetch(int(page))]
                    out += [(page, n, "SUCCEEDED", None, r) for n, r in enumerate(rows)] or [(page, -1, "EMPTY", None, {})]
                except Exception as e:  # noqa: BLE001  one page's failure is that page's
                    out.append((page, -1, "FAILED", str(e), {}))
                time.sleep(pause)
            yield pd.DataFrame(out, columns=["page", "n", "status", "error", "record"])

    numbers = [(int(p),) for p in pages]
    return spark.createDataFrame(numbers, "page long").repartition(max(1, len(numbers))).mapInPandas(run, RECORDS)


def crawl(spark: SparkSession, fetch: Callable[[int], Iterable[dict]], folder: str, first: int = 1, at_once: int = 8, most: int = 10_000, pause: float = 0.0) -> DataFrame:
    """Fetch pages from `first` on, `at_once` in parallel, append them to folder, and stop after the first empty or failed one.

    Returns the records before that page. Each round is appended by itself, so a later failure loses nothing; a crawl that is
    run again on the same folder goes on after its last page. A crawl that has not met its end after `most` pages is an error, so that
    partial data are never taken for whole.
    """
    from pyspark.errors import AnalysisException

    def last() -> tuple[int, int | None]:
        try:
            r = spark.read.parquet(folder).agg(F.max("page"), F.min(F.when(F.col("n") < 0, F.col("page")))).first()
        except AnalysisException:
            return first - 1, None
        return (first - 1 if r[0] is None else r[0]), r[1]

    at, stop = last()
    while stop is None and at < first + most - 1:
        fetched(spark, fetch, range(at + 1, min(at + 1 + at_once, first + most)), pause).write.mode("append").parquet(folder)
        at, stop = last()
    if stop is None:
        raise RuntimeError(f"no end after {most} pages: run again with a larger number")
    found = spark.read.schema(RECORDS).parquet(folder).where("n >= 0")
    return found.where(F.col("page") < stop)
