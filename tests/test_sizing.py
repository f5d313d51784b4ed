"""Larger inputs get more tasks and buckets, not larger ones."""

import uuid

import pytest
from pyspark.sql import functions as F

from profilewatch.constants import EMBED_SIGNAL
from profilewatch.operators import parity
from profilewatch.session import TASK_BYTES, configure


@pytest.mark.parametrize("key", sorted(TASK_BYTES))
@pytest.mark.parametrize("was, now", [("128MB", None), ("1g", None), ("134217728b", None), ("64k", "64k"), ("4096", "4096")])
def test_configure_bounds_what_a_task_reads(spark, key, was, now):
    other = spark.newSession()
    other.conf.set(key, was)
    assert configure(other).conf.get(key) == (now or str(TASK_BYTES[key]))


def test_buckets_of_a_stored_capture_follow_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parity, "BUCKET_ROWS", 20)
    rows = spark.range(400).select(
        (F.col("id") % 90).cast("string").alias("request_id"),
        F.lit(EMBED_SIGNAL).alias("signal_type"),
        (F.col("id") % 5 + 1).cast("string").alias("forward_pass_index"),
        F.col("id").cast("double").alias("std"),
        "id",
    )
    name = f"sized_{uuid.uuid4().hex}"
    parity.store_capture(rows, name, "ours", str(tmp_path))
    parity.store_capture(rows.filter("id < 30"), name, "theirs", str(tmp_path))  # takes the table's buckets
    try:
        diff = parity.diff_stored(spark, name, "ours", "theirs")
        assert "Exchange" not in diff._jdf.queryExecution().toString() and diff.rdd.getNumPartitions() == 20
        assert sorted(map(repr, diff.collect())) == sorted(map(repr, parity.diff_rows(rows, rows.filter("id < 30")).collect()))
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_a_small_or_empty_capture_has_the_least_buckets(spark, tmp_path):
    rows = spark.createDataFrame([], "request_id string, signal_type string, forward_pass_index string, std double, id long")
    name = f"sized_{uuid.uuid4().hex}"
    parity.store_capture(rows, name, "ours", str(tmp_path))
    parity.store_capture(rows, name, "theirs", str(tmp_path))
    try:
        assert parity._buckets_of(name, rows) == parity.LEAST_BUCKETS
        assert parity.diff_stored(spark, name, "ours", "theirs").collect() == []
    finally:
        spark.sql(f"DROP TABLE {name}")
