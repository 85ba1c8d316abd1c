"""Sinks: feature tables, submissions, compressed text, chunks, profiles, cached features, id pairs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.sources.readers import TIME_FORMAT


def write_features(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet, one folder per split, so a reader of one split skips the others."""
    df.hint("rebalance", split).write.mode("overwrite").partitionBy(split).parquet(path)


def submission(df: DataFrame, score: str, click_id: str = "click_id") -> DataFrame:
    """``click_id, is_attributed`` with the score as text of 9 decimals."""
    return df.select(
        F.col(click_id).alias("click_id"),
        F.format_string("%.9f", F.col(score).cast("double")).alias("is_attributed"),
    )


def write_submission(df: DataFrame, folder: str, tag: str, score: str, click_id: str = "click_id") -> str:
    """CSV with header under ``folder/sub_<tag>``; returns the path."""
    path = f"{folder.rstrip('/')}/sub_{tag}"
    submission(df, score, click_id).write.mode("overwrite").csv(path, header=True)
    return path


def write_csv(df: DataFrame, path: str, *, header: bool = True, compression: str = "none", sep: str = ",") -> None:
    df.write.mode("overwrite").csv(
        path, header=header, compression=compression, sep=sep, timestampFormat=TIME_FORMAT
    )


def write_gzip(df: DataFrame, path: str) -> None:
    write_csv(df, path, compression="gzip")


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk_id") -> None:
    """One folder per chunk number."""
    df.hint("rebalance", chunk).write.mode("overwrite").partitionBy(chunk).parquet(path)


def write_mapping(pairs: DataFrame, path: str) -> None:
    """Tab separated id pairs."""
    write_csv(pairs, path, header=False, sep="\t")


def _status(spark, path: str):
    """Hadoop's file status, None if there is no such file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(hadoop) if files.exists(hadoop) else None


def input_files(df: DataFrame) -> list[list]:
    """Name, size and time of each file that a table is read from; none for tables without files."""
    found = []
    for name in sorted(df.inputFiles()):
        status = _status(df.sparkSession, name)
        found.append([name, status.getLen() if status else 0, status.getModificationTime() if status else 0])
    return found


def cached_feature(
    df: DataFrame,
    folder: str,
    name: str,
    spec: object,
    version: str,
    compute: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Stored result of ``compute(df)`` if it is there, else compute, store and read it back.

    The file name carries a digest of the spec, the input version and the
    names, sizes and times of the files ``df`` reads, so a changed spec or input
    never meets an old file.  Only a folder whose job finished counts as stored.
    """
    version = json.dumps([version, input_files(df)])
    digest = hashlib.sha256(json.dumps([spec, version], sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{digest}"
    spark = df.sparkSession
    if _status(spark, f"{path}/_SUCCESS") is not None:
        return spark.read.parquet(path)
    compute(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sequence_rows(df: DataFrame, label: str = "is_attributed") -> DataFrame:
    """Per click: nine integers (ids, day, hour, minute/10, hour/4) as one array, and the label."""
    minute = F.minute("click_time")
    parts: Sequence = (
        F.col("ip"),
        F.col("app"),
        F.col("device"),
        F.col("os"),
        F.col("channel"),
        F.dayofmonth("click_time"),
        F.hour("click_time"),
        F.floor(minute / 10),
        F.floor(F.hour("click_time") / 4),
    )
    return df.select(
        "row_id",
        F.array(*[p.cast("long") for p in parts]).alias("features"),
        F.col(label).cast("long").alias("label"),
    )
