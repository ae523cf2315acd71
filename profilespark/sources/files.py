"""Inventories of files as tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGE = 256 << 20  # bytes from which on a file is not held whole; no row can hold 2 GB


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file, read in small pieces."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
                found.append(hashlib.file_digest(file, "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "length", "sha256"])


def file_inventory(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Relative path, size and SHA-256 of every file below ``root``; hashing runs on the executors.

    A SHA-256 runs through its file from start to end, so one task reads each file. In folders that the tasks can open by path, large files
    are read there in pieces; elsewhere Spark's reader holds each file whole, and 2 GB are its limit.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    any_file = files.select("path").first()
    if any_file and any_file["path"].startswith("file:"):
        pieces = files.where(F.col("length") > LARGE).select("path", "length").mapInArrow(_digests, "path string, length long, sha256 string")
        files = files.where(F.col("length") <= LARGE).select("path", "length", F.sha2("content", 256).alias("sha256")).unionByName(pieces)
    else:
        files = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    rel = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rel = F.substring(rel, F.lit(len(root.rstrip("/")) + 2), F.length(rel))
    out = files.select(rel.alias("path"), F.col("length").alias("bytes"), "sha256")
    return out.where(~F.element_at(F.split("path", "/"), -1).isin(list(exclude))) if exclude else out


def verify_manifest(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """MISSING / UNEXPECTED / CHANGED / MATCH per path."""
    m = manifest.select("path", F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("expected_sha256"))
    j = inventory.join(m, "path", "full_outer")
    same = (F.col("bytes") == F.col("expected_bytes")) & (F.col("sha256") == F.col("expected_sha256"))
    return j.withColumn("status", F.when(F.col("bytes").isNull(), "MISSING").when(F.col("expected_bytes").isNull(), "UNEXPECTED").when(same, "MATCH").otherwise("CHANGED"))
