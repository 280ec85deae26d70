"""Session helpers: table access, checkpoint folder, lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "inkgrid", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        # work in Python is heavy for its bytes: a small shuffle still goes to all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables: a parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the folder named by ``spark.checkpoint.dir``.

    Only a session on a single machine that names none (tests, the bench) gets
    a folder of this process's own, which is removed when the process ends; on
    a cluster the shared folder of the session is used, so the written blocks
    outlive any executor.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(named or scratch("checkpoints"))
    return df.checkpoint(eager=True)


_SCRATCH: dict[str, str] = {}


def scratch(name: str) -> str:
    """A temporary folder of this process, for sessions on a single machine; removed when the process ends."""
    if name not in _SCRATCH:
        _SCRATCH[name] = tempfile.mkdtemp(prefix=f"inkgrid-{name}-")
        atexit.register(shutil.rmtree, _SCRATCH[name], ignore_errors=True)
    return _SCRATCH[name]


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores before work in Python, if the input has fewer partitions than there are cores.

    A small file is one partition; larger inputs come in many splits and are
    left as they are, without a shuffle. What is shuffled is thus less than a
    split a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
