"""Shared pieces: the shared folder, staged tables and distributed union-find."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the cluster is this process alone (local, as in tests) and none is named is
    a temporary one made; on any other cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="matweft-")
    return _LOCAL[app]


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes made inside leave no shuffle files behind: once a table stands, nothing reads them.

    Else they stay until the driver happens to collect garbage, and a chain of staged tables
    holds the shuffles of all its steps on disk. The setting is put back, since a frame that the
    caller holds may be run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage at a place every executor can read, so that a lost executor costs
    only the tasks it ran, and so that a plan used twice is computed once. The shuffles of the
    write are removed with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find over edges (a, b): rows (node, component), one per node
    with an edge, component = the smallest node reachable.

    Alternates two contractions until nothing changes: every node hands its larger
    neighbours to its smallest neighbour (large star), then its smaller ones (small
    star). Each is a partial aggregate and an equi-join on slim rows, so that a node with
    very many neighbours is split by the adaptive skew join. Null nodes are ignored.
    """
    now = staged(_oriented(edges.select("a", "b")), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now = staged(_small_star(_large_star(now)), "cc")
        was, mark = mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError("connected_components did not converge")
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each link once, from the larger node a to the smaller b."""
    return (
        pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), "a", "b")
        .where("a is not null and b is not null and a <> b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.unionByName(least.select("a", F.col("m").alias("b"))))
