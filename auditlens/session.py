"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above 8000 bytes of bytecode. A fused stage
# over the 32 features is larger than that and would run interpreted; with this
# limit Spark falls back to one generated projection per operator, which it cuts
# into small methods. Measured on 4 million events: 3 s instead of 17 s.
TUNING = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def tune(spark: SparkSession) -> SparkSession:
    """Sets the runtime settings the jobs rely on, where they are at Spark's default."""
    for key, (default, value) in TUNING.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "auditlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    Only settings that do not depend on the cluster's size are made here;
    executor counts, memory and shuffle partitions belong to the submit command.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir.

    Without that setting a folder of our own is only made in local mode, where
    the driver's disk is the executors' disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="auditlens-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and fixes
    values that are not the same on recomputation (row positions).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path, on whatever file system it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def is_directory(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder, on whatever file system it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(there).isDirectory()
