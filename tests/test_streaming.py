"""Compaction of micro-batches by key, retries and restarts, and rows behind the watermark."""
import datetime as dt
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carelake.streaming import incremental as inc
from carelake.streaming.keyed import KeyedTable

SCHEMA = "k string, v bigint"


def folders(path):
    return sum(len(d) for _, d, _ in os.walk(path))


@pytest.mark.parametrize("combine", ["latest", "sum"])
def test_keyed_table_equals_replay_and_does_not_grow(spark, tmp_path, combine):
    path, every = str(tmp_path / "t"), 2
    table = KeyedTable(spark, path, SCHEMA, ["k"], combine, every)
    assert table.read().count() == 0
    want, seen = {}, []
    for b in range(11):
        rows = [(k, 10 * b + i) for i, k in enumerate("abcde") if (b + i) % 3 and b != 7]      # batch 7 is empty
        batch = spark.createDataFrame(rows, "k string, v bigint")
        table.merge(batch, b)
        if b in (3, 6):      # a retried batch, also one that compacts
            table.merge(batch, b)
        for k, v in rows:
            want[k] = v if combine == "latest" else want.get(k, 0) + v
        if b in (0, 1, 3, 4, 10):
            assert {r["k"]: r["v"] for r in KeyedTable(spark, path, SCHEMA, ["k"], combine, every).read().collect()} == want
        seen.append(folders(path))
    assert max(seen) == seen[-1] == seen[4] == 2 + 2 * every + 2      # two bases, four deltas, their two parents


def test_a_compaction_that_died_leaves_the_old_base(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, SCHEMA, ["k"], "sum", 2)
    one = spark.createDataFrame([("a", 1)], "k string, v bigint")
    for b in range(3):
        table.merge(one, b)
    monkeypatch.setattr(table, "_combined", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(one, 3)
    again = KeyedTable(spark, path, SCHEMA, ["k"], "sum", 2)
    assert again.read().collect() == [("a", 4)]      # the delta is there, its merge is not
    again.merge(one, 3)
    again.merge(one, 4)
    assert again.read().collect() == [("a", 5)]


def event(i, day, hour=1, kind="view"):
    return (i, dt.datetime(2024, 1, day, hour), kind, float(i))


def test_a_late_file_changes_the_late_count(spark):
    base = inc.work_dir(spark, "late-test")
    landing = f"{base}/landing"
    ddl = "event_id bigint, ts timestamp, event_type string, value double"

    def land(rows):
        spark.createDataFrame(rows, ddl).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(landing)

    def result():
        inc.run_daily_with_late(spark, landing, schema, base, "2 days", every=2)
        return {r["day"].day: (r["events"], r["value_sum"], r["errors"], r["late"]) for r in inc.read_daily_with_late(spark, base, 2).collect()}
    land([event(1, 1), event(2, 1, 2, "error"), event(3, 8)])
    schema = spark.read.parquet(landing).schema
    assert result() == {1: (2, 3.0, 1, 0), 8: (1, 3.0, 0, 0)}
    land([event(4, 1), event(5, 2, 3, "error"), event(6, 7), event(7, 9)])      # days 1 and 2 are closed, 7 is not
    assert result() == {1: (2, 3.0, 1, 1), 2: (0, None, 0, 1), 7: (1, 6.0, 0, 0), 8: (1, 3.0, 0, 0), 9: (1, 7.0, 0, 0)}
    assert result()[1] == (2, 3.0, 1, 1)      # a restart without new files changes nothing
    land([event(8, 7), event(9, 9)])      # the watermark is day 7, 01:00: that day is still open
    assert result()[7] == (2, 14.0, 0, 0)


def test_late_query_counts_every_event_once(spark):
    from carelake.plans.registry import all_queries
    from tests.conftest import SF_SMALL
    rows = all_queries()["stream_daily_late"](spark, SF_SMALL).collect()
    days = Counter(r[0] for r in spark.read.parquet(f"{SF_SMALL}/events.parquet").select(F.to_date("ts")).collect())
    assert {r["day"]: r["events"] + r["late"] for r in rows} == dict(days) and sum(r["late"] for r in rows) > 0
