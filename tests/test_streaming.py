"""Streamed windows against batch results: several batches, late rows, restarts and odd rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanstrata.streaming import drift

SCHEMA = "ts timestamp, kind string, value double"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour, minutes=minute)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def totals(spark, inbox, state):
    stream = spark.readStream.schema(SCHEMA).parquet(inbox)
    out = drift.window_rates(stream, "ts", F.col("kind"), "1 hour", "1 hour", state)
    return {(r.window_start.astimezone(dt.timezone.utc).hour, r.kind): (r.n, r.rate) for r in out.collect()}


def test_late_rows_and_a_second_run(spark, tmp_path):
    inbox, state = str(tmp_path / "in"), str(tmp_path / "state")
    arrive(spark, inbox, [(at(0, 5), "a", 1.0), (at(0, 6), "b", 1.0), (at(5), "a", 1.0), (None, "a", 1.0), (at(5, 1), None, None)])
    assert totals(spark, inbox, state) == {(0, "a"): (1, 0.5), (0, "b"): (1, 0.5), (5, "a"): (1, 0.5), (5, None): (1, 0.5)}
    # The watermark stands at 4:01: the row at 0:10 is late and dropped, the one at 4:30 is not.
    arrive(spark, inbox, [(at(0, 10), "a", 1.0), (at(4, 30), "c", 1.0), (at(5, 2), "a", 1.0)])
    want = {(0, "a"): (1, 0.5), (0, "b"): (1, 0.5), (4, "c"): (1, 1.0), (5, "a"): (2, pytest.approx(2 / 3)), (5, None): (1, pytest.approx(1 / 3))}
    assert totals(spark, inbox, state) == want
    assert totals(spark, inbox, state) == want


def test_psi_against_a_frozen_baseline(spark, tmp_path):
    reference = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "value double")
    edges, shares = drift.frozen_baseline(reference, "value", 4)
    assert sum(shares.values()) == pytest.approx(1) and set(shares) == {0, 1, 2, 3}
    inbox = str(tmp_path / "in")
    arrive(spark, inbox, [(at(0, i % 60), "a", float(i)) for i in range(100)] + [(at(1), "a", 500.0), (at(1), "a", None), (at(2), "a", None)])
    stream = spark.readStream.schema(SCHEMA).parquet(inbox)
    got = {r.window_start.astimezone(dt.timezone.utc).hour: r for r in drift.window_psi(stream, "ts", "value", edges, shares, "1 hour").collect()}
    assert set(got) == {0, 1} and got[0].psi == pytest.approx(0) and got[0].status == "PASS"
    assert got[1].n == 1 and got[1].psi > 1 and got[1].status == "FAIL"


def test_no_rows(spark, tmp_path):
    inbox = str(tmp_path / "in")
    arrive(spark, inbox, [])
    assert totals(spark, inbox, None) == {}
    assert drift.frozen_baseline(spark.createDataFrame([], "value double"), "value") == ([], {})
