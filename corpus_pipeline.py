"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents. Empty tables, null texts and extra columns pass through as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import common, packing, passages, pii, quality, simhash
from quillvec.llm.common import durable
from quillvec.llm.queries import KEY, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage that was called last, by its folder.
_tables: dict[str, list[str]] = {}


def _stage(f: Stage) -> Stage:
    """A stage's intermediate tables stay until the next stage on the same folder is called: its result has been written by then, and the tables take room."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.forget_paths(spark, _tables.pop(sf_dir, []))
        common.small_batches(spark)
        common.lean(spark)
        mine: list[str] = []
        token = common.collecting.set(mine)
        try:
            return f(spark, docs, sf_dir)
        finally:
            common.collecting.reset(token)
            _tables[sf_dir] = mine

    return run_stage


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs with a guarantee."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.rules(docs, labels, keep=COLUMNS).where("kept").select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash of words finds groups, five-word shingles with a similarity of 0.8 confirm them."""
    return simhash.distinct(docs.select(*COLUMNS))


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go."""
    made = passages.cut(docs.select(*COLUMNS))
    return _documents(made.where((F.col("_cut") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


@_stage
def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _documents(pii.replace(docs.select(*COLUMNS), KEY))


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens."""
    made = packing.pieces(docs, vocabulary(), 2048)
    cut = durable(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(cut, ["doc_id", "piece", "ids_crc32"], 2048)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", pii_surrogates),
    ("best-fit packing", best_fit_packing),
]

#: No stage's rows as a whole can be said in SQL (binomial tests, fingerprints, alignments, keyed surrogates, a search); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each result is written once; when the next one is, it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
