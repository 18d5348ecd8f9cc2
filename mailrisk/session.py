"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on; sizes stay with the cluster's own configuration.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mailrisk")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Rows are whole texts, some very long: the default of 10,000 to a batch would hold tens of megabytes several times over.
ARROW_ROWS = 200
_SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Bound the batches sent to Python, and send it this package, once per application, wherever it runs from."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="mailrisk-")) / "mailrisk.zip"  # read by the driver only
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    key = "_MAILRISK_LOCAL_DIR"
    if key not in os.environ:
        os.environ[key] = tempfile.mkdtemp(prefix="mailrisk-")
    return os.environ[key]


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores enough of them for CPU-bound text work.

    A small table in one file would be read by one task. A large one has more splits than there
    are cores and is returned as it is, so no text is shuffled at scale.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediates this process wrote so far; how many. Frames read from them are of no use then."""
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in _WRITTEN]
    gone = sum(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True) for p in paths)
    _WRITTEN.clear()
    return gone


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later steps read, and read it back column by column.

    Cuts the lineage, survives the loss of executors, and lets each reader prune columns. The files stay until
    ``drop_written``: only the caller knows when the results built on them are no longer read.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
