"""Session settings the jobs rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# UTC makes hour buckets and rendered dates independent of the host. The two
# legacy settings let `decode` accept the bank charsets of `rules.CHARSETS` and
# turn a bad byte into U+FFFD instead of failing the whole file.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# The cell parsers generate long methods, which the JVM interprets unless told
# to compile them. Without the flag, smaller methods (one per projection) win.
COMPILE_LONG_METHODS = "-XX:-DontCompileHugeMethods"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    flags = spark.conf.get("spark.driver.extraJavaOptions", "") + spark.conf.get("spark.executor.extraJavaOptions", "")
    if COMPILE_LONG_METHODS not in flags:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cpus: str = "*", app: str = "ledgerline", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.driver.extraJavaOptions", COMPILE_LONG_METHODS)
        # Recording the call site of every column expression triples the time
        # it takes to build these plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Small staged files: one task a core rather than one for four megabytes.
        .config("spark.sql.files.openCostInBytes", "262144")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="ledgerline-")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_root()
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a frame to the shared work folder and read it back; options are those of Spark's Parquet writer.

    For rows several later steps need: they are computed once, the lineage ends
    at the files, and a lost executor costs only its own tasks.
    """
    path = work_dir(df.sparkSession, label)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
