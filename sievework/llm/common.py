"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine (tests) names none, a temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; Spark removes it with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A table of a few numbers a row is broadcast up to so many rows (tens of MB), and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def sent_out(df: DataFrame) -> DataFrame:
    """df, which is kept already, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write df as Parquet to a new place in the shared folder and read it back."""
    path = new_place(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def new_place(spark: SparkSession, kind: str) -> str:
    return os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(col) -> "F.Column":
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ...: no name of the input can clash with one of an operator."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


#: Rows of a batch between Spark and Python. Texts are long: Spark's default of 10,000 takes hundreds of MB at once.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Let batches of texts be small, unless the session asks for smaller ones still."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(BATCH_ROWS):
        spark.conf.set(name, BATCH_ROWS)


def groups(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The rows of each value of a column, of batches that are sorted by it; a group is held as a whole."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[column].to_numpy()
        if held and held[-1][column].iloc[0] != values[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        edges = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
        for a, b in zip(edges[:-1], edges[1:]):
            if a and held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)
