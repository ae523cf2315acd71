"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that further columns never clash with its own."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, UPPER, LOWER)


def words(data: bytes) -> list[bytes]:
    """Runs of bytes other than space and \\t to \\r: the splitting rule of ``bytes``, unlike that of ``str``."""
    return data.split()


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        column_at = batch.schema.get_field_index(column)
        at = 0
        while at < batch.num_rows:
            n, size = 0, 0
            lengths = batch.column(column_at)
            while at + n < batch.num_rows and (n == 0 or size < most):
                size += len(lengths[at + n].as_buffer() or b"") if lengths[at + n].is_valid else 0
                n += 1
            yield batch.slice(at, n)
            at += n


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """The table written to the shared folder in buckets of ``key``: later joins on the key read it without moving it again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"by_{key}_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    return spark.table(name)
