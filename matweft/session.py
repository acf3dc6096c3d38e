"""Session helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: str = "8", app: str = "matweft", memory: str = "20g") -> SparkSession:
    """A local session with the settings that tests and bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it.

    On a cluster the package comes from --py-files or the executors' image; there the
    added path does not exist and does no harm.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir; a temporary one
    only where there is no cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return (named or tempfile.mkdtemp(prefix="matweft-")).rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: what is used several times is
    made once, and a lost executor costs only the tasks it ran."""
    path = f"{shared_dir(df.sparkSession)}/matweft-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
