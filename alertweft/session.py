"""Session set-up, shared scratch space and lineage cutting."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JIT compiles methods up to this size only; stages with longer ones are generated in parts
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # undecodable bytes become U+FFFD, which the codecs then drop, instead of failing the job
    "spark.sql.legacy.codingErrorAction": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (UTC, adaptive plans)."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "alertweft") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # column call sites are not recorded, which makes wide plans quicker to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ship(module: str) -> None:
    """Send the Python functions of a module with the job, so workers need not import the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    ``spark.checkpoint.dir`` names it.  Only a local-master session without that
    setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="alertweft-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of sorted joins only.

    Estimates follow the bytes of compressed files.  A table of many small rows, above all one
    derived from few columns, looks small enough to be broadcast and is then held whole by
    the driver; tables that grow with the input are therefore merged.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over several tasks a core, by its keys, before steps that cost far more than reading its rows.

    Tasks of a scan follow compressed bytes and row groups; narrow rows that become long texts, or
    meet many expressions, would keep a few cores busy and leave the others idle.
    """
    spark = df.sparkSession
    least = 4 * spark.sparkContext.defaultParallelism
    return df.repartition(max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    A written table survives the loss of executors and is computed only once,
    which matters for iterative operators and for tables with many readers.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
