"""Logs of benchmark runs: one text a run, its configuration in the name."""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format of the logs.
SKETCH_FIELDS = ("nnode", "nproc", "nthread", "n", "r", "matmul1p1", "matmul1p2", "matmul1p3", "matmul2p1", "matmul2p2", "matmul2p3")
SKETCH_HEADER = r"Nystrom approximation of (\d+)x(\d+) matrix to rank (\d+) using ([\w-]+)"
SKETCH_TIMES = {
    "total_time": "Total time",
    "gen_omega_time": "Time to generate Omega",
    "dgemm1_time": "Time for first dgemm",
    "dgemm2_time": "Time for second dgemm",
    "all2all_time": "Time for all2all",
    "reduce_scatter_time": "Time for reduce-scatter",
    "reduce_scatter_1_time": "Time for first reduce-scatter",
    "reduce_scatter_2_time": "Time for second reduce-scatter",
    "unpack_time": "Time to unpack",
    "pack_time": "Time to pack for reduce-scatter",
}
MATMUL_HEADER = r"(\w+)\s+(\d+)x(\d+)\s+with\s+(\d+)x(\d+)\s+on\s+(\d+)x(\d+)x(\d+)\s+grid"
MATMUL_TIMES = {
    "gather_a_time": "Time to gather A",
    "gen_b_time": "Time to generate B",
    "gather_b_time": "Time to gather B",
    "local_multiply_time": "Time for local multiply",
    "cpu_gpu_data_move_time": "Time for host-device mem movement",
    "scatter_reduce_time": "Time to scatter and reduce C",
}
TIME = r":\s*([\d.]+) sec"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(name, body, modified) of the files of a folder; Spark's scans leave out files of no bytes."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("modified"))


def _times(labels: dict[str, str]) -> list[Column]:
    """Seconds by label; 0 where the label or a plain decimal number after it is missing."""
    return [F.coalesce(F.regexp_extract("body", label + TIME, 1).try_cast("double"), F.lit(0.0)).alias(name) for name, label in labels.items()]


def _held(logs: DataFrame) -> DataFrame:
    """logs with name and body through a generator: what they are made by is computed once a
    row and not again in every pattern."""
    return logs.select(F.inline(F.array(F.struct("name", "body", "modified"))))


def write_logs(logs: DataFrame, folder: str) -> int:
    """Write each log (name, body) as a file of a folder that all tasks see; how many there are."""

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(os.path.join(folder, name), "w") as f:
                    f.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    os.makedirs(folder, exist_ok=True)
    return logs.select("name", "body").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


NO_HEADER, DISAGREE = "no header", "name and header disagree"


def _part(separator: str, k: int) -> Column:
    """Field k of the name as a number; null where it is none."""
    return F.get(F.split("name", separator), F.lit(k)).try_cast("int")


def sketch_reason() -> Column:
    """Why a log of a sketch is not taken: null, NO_HEADER or DISAGREE."""
    head = [F.regexp_extract("body", SKETCH_HEADER, k).try_cast("int") for k in (1, 2, 3)]
    agree = (head[0] == _part(r"[_.x]+", 6)) & (head[1] == _part(r"[_.x]+", 6)) & (head[2] == _part(r"[_.x]+", 7))
    return _reason(SKETCH_HEADER, agree)


def matmul_reason() -> Column:
    """Why a log of a product is not taken: null, NO_HEADER or DISAGREE."""
    head = [F.regexp_extract("body", MATMUL_HEADER, k).try_cast("int") for k in range(2, 6)]
    agree = (head[0] == _part("_", 6)) & (head[1] == _part("_", 7)) & (head[2] == _part("_", 7)) & (head[3] == _part("_", 8))
    return _reason(MATMUL_HEADER, agree)


def _reason(header: str, agree: Column) -> Column:
    found = F.regexp_extract(F.coalesce("body", F.lit("")), header, 0) != ""
    return F.when(~found, NO_HEADER).when(~F.coalesce(agree, F.lit(False)), DISAGREE)


def rejects(logs: DataFrame, reason: Column) -> DataFrame:
    """(name, reason) of the logs that are not taken."""
    return _held(logs).select("name", reason.alias("reason")).where("reason is not null")


def _taken(logs: DataFrame, reason: Column, strict: bool) -> DataFrame:
    """Logs with a header; one that contradicts its name is an error, or is left out too."""
    logs = _held(logs).withColumn("__reason", reason).where(F.col("__reason").isNull() | (F.col("__reason") == DISAGREE))
    error = F.raise_error(F.concat(F.lit(f"{DISAGREE}: "), "name")).cast("boolean") if strict else F.lit(False)
    return logs.where(F.when(F.col("__reason").isNull(), True).otherwise(error)).drop("__reason")


def parse_sketch_logs(logs: DataFrame, strict: bool = True) -> DataFrame:
    """One row a log with a header; a header that contradicts the name is an error, or such a log
    is left out if not strict. `rejects` tells what was left out."""
    rows = _taken(logs, sketch_reason(), strict)
    names = [F.get(F.split("name", r"[_.x]+"), F.lit(k)).alias(c) for k, c in enumerate(("alg", "impl", "system"))]
    return rows.select(*names, *(_part(r"[_.x]+", k).alias(c) for k, c in enumerate(SKETCH_FIELDS, 3)), *_times(SKETCH_TIMES))


def parse_matmul_logs(logs: DataFrame, strict: bool = True) -> DataFrame:
    """As parse_sketch_logs, of logs of products."""
    rows = _taken(logs, matmul_reason(), strict)
    names = [F.get(F.split("name", "_"), F.lit(k)).alias(c) for k, c in enumerate(("alg", "impl", "system"))]
    names += [_part("_", k).alias(c) for k, c in enumerate(("nnode", "nproc", "thread_per_proc"), 3)]
    head = [F.regexp_extract("body", MATMUL_HEADER, k).try_cast("int") for k in range(2, 9)]
    sizes = [h.alias(c) for h, c in zip(head, ("a_rows", "a_cols", "b_rows", "b_cols", "p1", "p2", "p3"))]
    return rows.select(*names, *sizes, *_times(MATMUL_TIMES), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


def mean_runs(runs: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Mean of every other numeric column over runs that agree in the keys."""
    rest = [c for c, t in runs.dtypes if c not in keys and t in ("int", "bigint", "float", "double")]
    return runs.groupBy(*keys).agg(*(F.round(F.avg(c), digits).alias(c) for c in rest))


def breakdown_total(runs: DataFrame, parts: list[str]) -> DataFrame:
    """runs with breakdown_total_time, the sum of the parts without nulls."""
    return runs.withColumn("breakdown_total_time", reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts]))


def phase_metrics(runs: DataFrame, keys: list[str], phases: list[str], digits: int = 6) -> DataFrame:
    """Rows (keys, phase, n_runs, min_time, mean_time, max_time): the seconds that runs which
    agree in the keys spent in each phase."""
    long = runs.unpivot(keys, phases, "phase", "seconds")
    return long.groupBy(*keys, "phase").agg(F.count("seconds").alias("n_runs"), F.min("seconds").alias("min_time"), F.round(F.avg("seconds"), digits).alias("mean_time"), F.max("seconds").alias("max_time"))


def lookup(axis: DataFrame, runs: DataFrame, on: list[str], value: str, default: float | None = 0.0) -> DataFrame:
    """value for each row of axis: the least of several, the default if there is none; with
    no default a missing one is an error."""
    found = axis.join(runs.groupBy(*on).agg(F.min(value).alias(value)), on, "left")
    missing = F.raise_error(F.lit(f"no {value}")).cast("double") if default is None else F.lit(default)
    return found.withColumn(value, F.coalesce(value, missing))


def stacked(runs: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """One row a run and part, in order, with the running total (bottom) before it."""
    entries = F.array(*[F.struct(F.lit(k).alias("part_no"), F.lit(p).alias("part"), F.coalesce(F.col(p), F.lit(0.0)).alias("height")) for k, p in enumerate(parts)])
    before = [reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts[:k]], F.lit(0.0)) for k in range(len(parts))]
    rows = runs.select(*keys, F.explode(F.arrays_zip(entries.alias("e"), F.array(*before).alias("bottom"))).alias("s"))
    return rows.select(*keys, "s.e.part_no", "s.e.part", "s.e.height", F.round("s.bottom", 6).alias("bottom"))


def write_table(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
