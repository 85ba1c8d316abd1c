"""Streamed profiles: compaction, restarts, and half-written bases."""

import pytest
from pyspark.sql import functions as F

from clickfeat.sources.readers import clicks_from_events
from clickfeat.streaming import profiles

KEYS = ["ip", "app"]


@pytest.fixture()
def events(spark, tmp_path):
    """Events in nine files; the source takes one per batch."""
    path = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(9, "event_id").write.parquet(path)
    return path


def wanted(spark, path):
    return {tuple(r) for r in profiles.running_counts(clicks_from_events(spark.read.parquet(path)), KEYS).select(*KEYS, *profiles.MEASURES).collect()}


def newest(spark, out):
    return {tuple(r) for r in profiles.latest_profiles(spark, out, KEYS).select(*KEYS, *profiles.MEASURES).collect()}


def test_batches_are_compacted(spark, events, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    store = spark.conf.get(profiles.STATE_STORE)
    profiles.stream_profiles(spark, events, clicks_from_events, KEYS, out, state, files_per_batch=1, batches_per_base=2)
    assert spark.conf.get(profiles.STATE_STORE) == store
    assert newest(spark, out) == wanted(spark, events)
    base = profiles.base_of(spark, out)
    assert base is not None and base >= 5 and min(profiles.batches_of(spark, out)) > 0
    # A restart with more files goes on from the bases.
    more = spark.read.parquet("/root/testdata/sf0.01/events.parquet").limit(500).withColumn("event_id", F.col("event_id") + 1_000_000)
    more.write.mode("append").parquet(events)
    profiles.stream_profiles(spark, events, clicks_from_events, KEYS, out, state, files_per_batch=1, batches_per_base=2)
    assert newest(spark, out) == wanted(spark, events)
    assert profiles.base_of(spark, out) > base


def test_half_written_base_is_not_read(spark, events, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    profiles.stream_profiles(spark, events, clicks_from_events, KEYS, out, state, files_per_batch=3)
    assert profiles.base_of(spark, out) is None
    last = max(profiles.batches_of(spark, out))
    spark.read.parquet(f"{out}/batch_id={last}").limit(1).write.parquet(f"{out}/_base/upto={last}")
    (tmp_path / "out" / "_base" / f"upto={last}" / "_SUCCESS").unlink()
    assert profiles.base_of(spark, out) is None and newest(spark, out) == wanted(spark, events)
    assert profiles.compact_profiles(spark, out, KEYS) == last == profiles.compact_profiles(spark, out, KEYS)
    assert newest(spark, out) == wanted(spark, events)


def test_no_batches(spark, tmp_path):
    with pytest.raises(ValueError):
        profiles.latest_profiles(spark, str(tmp_path / "nothing"), KEYS)
