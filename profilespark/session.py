"""Session settings shared by tests, bench and examples."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


JIT_METHOD_BYTES = "8000"  # the JVM never compiles a larger method, so a larger generated stage would run interpreted


ARROW_BATCH = "4m"  # rows reach Arrow functions in batches of this size, however long their texts are


def tune(spark: SparkSession) -> None:
    """Generated stages above the JVM's compile limit fall back to split, compiled expressions (measured 2x on wide rules)."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once a session, so that Arrow functions run wherever the job was started."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    if any(Path(p).name == "profilespark.zip" for p in getattr(sc, "_python_includes", [])):
        return
    target = Path(tempfile.mkdtemp(prefix="profilespark-")) / "profilespark.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, Path("profilespark") / file.relative_to(home))
    sc.addPyFile(str(target))


def ready(spark: SparkSession) -> None:
    tune(spark)
    ship(spark)


def local_session(cpus: str | int = "8", memory: str = "12g") -> SparkSession:
    """Local session with the settings the operators are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("profilespark")
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ready(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; a temporary one only on a local master, whose tasks all see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named if named else tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """The table written to the shared checkpoint folder and read back: lineage ends here and the sizes are known.

    Reliable like ``checkpoint()`` (files outlive executors), but the plan that follows starts from a plain scan, so neither
    constraints nor missing statistics pile up over the rounds of an iterative job. With ``free`` the shuffle files behind the table
    are deleted once it is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, "false")
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)
