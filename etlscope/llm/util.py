"""Shared folder for cut lineage, small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the white-space kind, as a Java pattern.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) uses /tmp/checkpoints; a cluster must name one.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows per Arrow batch: documents average a few kB, so a batch stays near 5 MB.
BATCH_ROWS = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; Arrow batches of this session are kept small, as texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def find(df: DataFrame, name: str) -> str:
    """The column of ``df`` that Spark means by ``name``, which ignores case."""
    return next(c for c in df.columns if c.lower() == name.lower())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """White-space words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({SPACE_WORD})"), F.lit(1))


def held_out(doc_id: Column) -> Column:
    """Rows never used for learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
