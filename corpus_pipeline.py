"""A corpus from documents to mix: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. The last one returns the mix: what is left out is
dropped, what is taken twice stands twice. A row is told from others by its doc_id and the
hash of its text; rows alike in both are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matweft.llm import decontam, line_dedup, mixing, quality, simhash
from matweft.llm.common import staged
from matweft.llm.entries import remainder
from matweft.session import importable

#: Names of columns that no table has; they do not leave a stage.
ID, HASH, SCORE = "__doc_id", "__text_hash", "__quality_score"
MIX = ("size", "source_size", "target", "copies", "taken", "copy")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(HASH, F.xxhash64("text"))


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs with a text hash, joined with rows that have (ID, HASH)."""
    found = found.withColumnRenamed(HASH, f"{HASH}2")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col(HASH) == F.col(f"{HASH}2")), how)


def _as_id(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, text, others) with the pair of doc_id and text hash as the doc_id."""
    return docs.select(F.struct(F.col("doc_id").alias(ID), HASH).alias("doc_id"), "text", *others)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.3. Null and empty texts get the
    score of the bias alone; repeated rows share their score."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    return quality.score(docs, model, SCORE).where(F.col(SCORE) >= 0.3).drop(SCORE)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less lines that near-copy an earlier line; n_chars follows the text. Null
    texts stay null; rows alike in doc_id and text lose the same lines."""
    kept = line_dedup.dedup_lines(docs, counts=None)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked fingerprints the document with the smallest doc_id, null last; of
    several with that id the one with the least hash of its text. Null and empty texts are
    one class; rows alike in doc_id and text are one document and stay once."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias(ID), F.col("text_hash").alias(HASH)))
    kept = simhash.simhash_classes(docs).groupBy("class").agg(first.alias("k")).select(f"k.{ID}", f"k.{HASH}")
    return _joined(_keyed(docs), kept, "left_semi").dropDuplicates(["doc_id", HASH]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none."""
    keyed = _keyed(docs)
    found = decontam.contamination(_as_id(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _joined(keyed, found.where("n_hit > 0").select("doc_id.*").distinct(), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, each document as often as its copies say, numbered from 1 in copy,
    with sizes and targets. Null and empty texts have size 0 and stand with the whole copies
    of their source; a null source is a source of its own."""
    keyed = _keyed(docs).drop(*MIX)
    plan = mixing.mix(_as_id(keyed, "source")).select("doc_id.*", *MIX[:-1]).dropDuplicates([ID, HASH]).where("copies > 0")
    mixed = _joined(keyed, plan, "inner").select(*(c for c in docs.columns if c not in MIX), *MIX[:-1])
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learned scores, MinHash and SimHash have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
