"""Streams take up only what is new, and give what the same expression gives on a table."""

from scholion.streaming import incremental as inc


def test_catch_up(spark, tmp_path):
    src, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(3).write.parquet(src)
    stream = lambda: inc.new_files(spark, src, "id long")
    inc.append_files(stream(), out, str(tmp_path / "c1"))
    spark.range(3, 5).write.mode("append").parquet(src)
    inc.append_files(stream(), out, str(tmp_path / "c1"))
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    inc.catch_up(stream(), str(tmp_path / "c2"), lambda df, n: seen.append((n, df.count())))
    inc.catch_up(stream(), str(tmp_path / "c2"), lambda df, n: seen.append((n, df.count())))
    assert seen == [(0, 5)]


def test_windows(spark, tmp_path):
    d = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 23:00:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-02 01:00:00', 'a', 4.0D")
    d.write.parquet(str(tmp_path / "w"))
    got = sorted((r["n"], r["value"]) for r in inc.windowed(d, "ts", "1 day", ["k"]).collect())
    assert got == [(1, 4.0), (2, 3.0)]
    s = inc.windowed(inc.new_files(spark, str(tmp_path / "w"), d.schema), "ts", "1 day", ["k"], late="1 hour")
    s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["n"], r["value"]) for r in spark.table("w").collect()) == got


def test_json(spark):
    d = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "authors": {"z": 1}, "n": null}'), (2, None)], "id int, j string")
    assert sorted((r["id"], r["path"], r["value"]) for r in inc.flattened(d, "j", "id").collect()) == [(1, "a_b_0", "1"), (1, "a_b_1", "x"), (1, "n", None)]
    d = spark.createDataFrame([(1, '{"t": "a"}'), (2, '[{"t": "b"}, {"t": "c"}]'), (3, None)], "id int, j string")
    assert sorted(tuple(r) for r in inc.exploded_objects(d, "j", "t string", "id").collect()) == [(1, "a"), (2, "b"), (2, "c")]
    assert inc.in_run(d, 7).first()["run_id"] == 7


def test_paged_sources(spark, tmp_path):
    from scholion.sources.paged import crawl, fetched

    def fetch(page):
        if page == 9:
            raise ValueError("no such page")
        return [{"id": page * 10 + k, "note": None} for k in range(0 if page > 5 else 2)]

    got = crawl(spark, fetch, str(tmp_path / "p"), at_once=3)
    assert sorted(r["record"]["id"] for r in got.collect()) == sorted(str(p * 10 + k) for p in range(1, 6) for k in range(2))
    assert crawl(spark, fetch, str(tmp_path / "p"), at_once=3).count() == 10
    assert {(r["page"], r["status"]) for r in fetched(spark, fetch, [1, 6, 9]).collect()} == {(1, "SUCCEEDED"), (6, "EMPTY"), (9, "FAILED")}
