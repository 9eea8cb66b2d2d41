"""Cutting lineage: loops over joins keep their plans short by tables written to the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster must name; /tmp/checkpoints in local sessions."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from Parquet files in the shared folder: written once, in one job, and kept whatever executors are lost."""
    folder = new_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def arrow_table(rows: list[tuple], schema: str) -> pa.Table:
    types = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows from the driver, as a relation that needs no Python workers."""
    return spark.createDataFrame(arrow_table(rows, schema))
