"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import positions

RECORD_SCHEMA = (
    "profile_id string, source_profile_id string, target_id string, tissue_id string, expression_dataset_id string, hr_score double, "
    "fingerprint_member boolean, support_status string, gesd_alpha double, source_artifact string, source_row long"
)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Parquet by suffix, otherwise CSV with header; without a schema the CSV is read twice to infer one."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", "\t")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv")) -> None:
    """The table as Parquet with a CSV companion; written by the executors, one file per partition.

    The table is worked out once: the companion is written from the Parquet files, so that sums whose last bits depend on the order of
    their terms are the same in both.
    """
    for f in sorted(formats, key=lambda f: f != "parquet"):
        if f == "parquet":
            df.write.mode("overwrite").parquet(f"{path}.parquet")
            df = df.sparkSession.read.schema(df.schema).parquet(f"{path}.parquet")
        else:
            df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """Columns renamed to canonical names by the first alias present (case ignored); a missing required one is an error."""
    have = {c.strip().lower(): c for c in df.columns}
    found = {canon: next((have[a.lower()] for a in names if a.lower() in have), None) for canon, names in aliases.items()}
    absent = [c for c in required if not found.get(c)]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df.select(*[F.col(f"`{src}`").alias(canon) for canon, src in found.items() if src])


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns}) if any(c not in df.columns for c in defaults) else df


def roundtrip_equivalence(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tol: float = 0.0) -> DataFrame:
    """One row: keys on one side only, NULL mask differences and largest difference per value column."""
    x = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    y = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("_b"))
    j = x.join(y, keys, "full_outer")
    mask = F.lit(0)
    delta = F.lit(0.0)
    for v in values:
        p, q = F.col(f"a_{v}"), F.col(f"b_{v}")
        mask = mask + (p.isNull() != q.isNull()).cast("int")
        delta = F.greatest(delta, F.coalesce(F.abs(p - q), F.lit(0.0)))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = j.agg(F.count(F.lit(1)).alias("keys"), F.count_if(~both).alias("unmatched"), F.coalesce(F.sum(F.when(both, mask)), F.lit(0)).alias("null_mismatches"),
                F.coalesce(F.max(F.when(both, delta)), F.lit(0.0)).alias("max_delta"))
    return out.withColumn("equal", (F.col("unmatched") == 0) & (F.col("null_mismatches") == 0) & (F.col("max_delta") <= tol))


def json_records_scan(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, multi_line: bool = True) -> DataFrame:
    """JSON arrays of exchange records; a record that does not fit the schema stops the read.

    ``multi_line`` reads each file as one array. Files of ``json_records_write`` hold one array per line and are split.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def json_records_write(records: DataFrame, path: str, chunk: int = 10_000) -> None:
    """Exported records as arrays of at most ``chunk``, one array per line."""
    block = F.floor((F.col("source_row") - 1) / chunk).alias("_block")
    arrays = records.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("source_row", "record"))).alias("_l"))
    arrays.select(F.concat(F.lit("["), F.array_join("_l.record", ","), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def json_records_export(calls: DataFrame, dataset: str, artifact: str, order: list[str]) -> DataFrame:
    """Call rows as exchange records (one JSON text each, fields in schema order) with their row number in the artifact."""
    numbered = row_numbers(calls, order, "source_row")
    rec = F.struct(
        F.col("profile").cast("string").alias("profile_id"), F.col("profile").cast("string").alias("source_profile_id"), F.col("target").alias("target_id"),
        F.col("tissue").alias("tissue_id"), F.lit(dataset).alias("expression_dataset_id"), F.col("score").alias("hr_score"), F.lit(True).alias("fingerprint_member"),
        F.lit("supported").alias("support_status"), F.col("alpha").alias("gesd_alpha"), F.lit(artifact).alias("source_artifact"), F.col("source_row"))
    return numbered.select("source_row", F.to_json(rec).alias("record"))


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based position in ``order``, first by the text of the leading column; ranges of that order are numbered, whatever one value holds."""
    return positions(df, [F.col(order[0]).cast("string"), *order], out)
