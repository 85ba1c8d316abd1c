"""Readers and writers."""

import datetime

import pytest
from pyspark.sql import functions as F

from clickfeat.operators.aggregate import add_count
from clickfeat.schema import TEST_LOG, TRAIN_LOG
from clickfeat.sources import readers, writers


def test_csv_scan_reads_only_the_columns_asked_for(spark, clicks, tmp_path):
    path = str(tmp_path / "log")
    writers.write_csv(clicks.withColumn("attributed_time", F.col("click_time")).select(*TRAIN_LOG.fieldNames()), path)
    df = readers.scan_csv(spark, path, TRAIN_LOG, ["ip", "click_time"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ip:bigint,click_time:timestamp>" in plan
    assert df.count() == 1000


def test_row_range_reaches_the_scan(spark, clicks):
    plan = readers.row_range(clicks, 100, 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,100)" in plan and "LessThan(event_id,150)" in plan
    assert readers.row_range(clicks, 100, 50).count() == 50
    assert readers.row_range(clicks, 990).count() == 10
    assert readers.tail_range(clicks, 30).agg(F.min("row_id")).first()[0] == 970


def test_projection_reaches_the_scan(clicks):
    plan = add_count(clicks, ["ip"]).select("row_id", "ip_count")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_tolerant_scan(spark, tmp_path):
    path = tmp_path / "broken.csv"
    good = "7,1,2,3,4,5,2017-11-06 14:32:21"
    path.write_text("\n".join([",".join(TEST_LOG.fieldNames()), good, "", "x", good + ",9", good[:-22]]) + "\n")
    rows = readers.scan_tolerant(spark, str(path), TEST_LOG, header=True).collect()
    assert len(rows) == 1
    assert (rows[0].click_id, rows[0].channel) == (7, 5)
    assert rows[0].click_time == datetime.datetime(2017, 11, 6, 14, 32, 21)


def test_many_files_keep_their_order(spark, tmp_path):
    for name, ip in (("a", 1), ("b", 2)):
        (tmp_path / name).write_text(",".join(TEST_LOG.fieldNames()) + f"\n1,{ip},0,0,0,0,2017-11-06 00:00:00\n")
    df = readers.scan_many(spark, [str(tmp_path / "b"), str(tmp_path / "a")], TEST_LOG)
    assert [r.ip for r in df.orderBy("file_ord").collect()] == [2, 1]


def test_jdbc_filter_quotes_values():
    assert readers.jdbc_filter(platform="o'x", day=20171213) == "platform = 'o''x' AND day = 20171213"
    with pytest.raises(ValueError):
        readers.jdbc_filter(**{"a b": 1})


def test_cached_feature_is_computed_once(spark, clicks, tmp_path):
    calls = []

    def compute(df):
        calls.append(1)
        return add_count(df, ["ip"]).select("row_id", "ip_count")

    for spec, version in ((["ip"], "v1"), (["ip"], "v1"), (["ip"], "v2"), (["app"], "v1")):
        out = writers.cached_feature(clicks, str(tmp_path), "f", spec, version, compute)
        assert out.count() == 1000
    assert len(calls) == 3


def test_gzip_files(spark, clicks, tmp_path):
    path = tmp_path / "z"
    writers.write_gzip(clicks.select("row_id", "ip"), str(path))
    assert list(path.glob("*.csv.gz"))


def test_feature_files_have_one_folder_per_split(spark, clicks, tmp_path):
    path = tmp_path / "f"
    df = clicks.withColumn("split", F.when(F.col("hour") < 12, "train").otherwise("test"))
    writers.write_features(df.select("row_id", "split"), str(path))
    assert sorted(p.name for p in path.glob("split=*")) == ["split=test", "split=train"]


def test_submission_text(spark):
    df = spark.createDataFrame([(1, 0.1234567891), (2, 0.0)], "click_id long, p double")
    assert [r.is_attributed for r in writers.submission(df, "p").collect()] == ["0.123456789", "0.000000000"]
