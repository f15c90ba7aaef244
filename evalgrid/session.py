"""Session settings and lineage cuts shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "evalgrid") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session (tests) without
    one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="evalgrid-")
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_shared_folder(spark)}/evalgrid-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once and go on from the written table.

    Used where several later steps read one result. Computed in one pass (an eager checkpoint
    computes it twice), columnar, with real sizes for the planner; a lost executor costs a read.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
