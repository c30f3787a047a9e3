"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written as
Parquet and reread as the next one's ``docs``. All but the last return the columns of ``documents``. A stage decides by row
(id and text), so texts under one id, repeated rows and rows without an id are each judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, langid, minhash, mixing, sharding
from quillgraph.llm.columns import row_key
from quillgraph.session import forget, table, written

#: Below this confidence a prediction doesn't name a language.
LEAST_SCORE = 0.3
#: Nor does one whose cosine is below the first figure, or from ``MANY_LETTERS`` letters on below the second. The score
#: only weighs the learned languages against each other. Of sf0.01's 337 held-out texts one is below, of 18 characters;
#: drawn Latin letters reach 0.16 in texts of 5 words, 0.22 in texts of 1,000, other scripts 0.06.
LEAST_COSINE, LONG_COSINE, MANY_LETTERS = 0.15, 0.3, 200
#: A document goes if at least this share of its words lies in benchmark windows.
MOST_HIT = 0.0
_ROW = "row__"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; texts without letters, in other languages or of noise go.

    Rows without an id stay or go by their text and are not learned from; repeated rows share their fate.
    """
    model = langid.learn(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    pred = langid.evidence(_keyed(docs), model, _ROW).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    pred = pred.where(F.col("cosine") >= F.when(F.col("letters") < MANY_LETTERS, LEAST_COSINE).otherwise(LONG_COSINE))
    return _only(docs, pred)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least id, any other before one without an id; of repeated rows one stays."""
    kept = minhash.classes(docs).where("row = keeper").select(F.col("row").alias(_ROW))
    return _only(docs, kept, once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontam.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"), key=_ROW)
    return _only(docs, found.where(F.col("n_hit") <= MOST_HIT * F.col("n_words")).select(F.col("doc_id").alias(_ROW)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; copies are repeated rows under the same id. Rows without an id have no label."""
    rates = mixing.mix(_keyed(docs), table(spark, sf_dir, "labels"), carry=(_ROW,)).where("copies > 0").select(_ROW, "copies").dropDuplicates([_ROW])
    both = _keyed(docs).join(rates, _ROW)
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(_ROW)).drop(_ROW)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, shard, depth and oversized of each row."""
    return sharding.assign(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_ROW, row_key("doc_id", "text"))


def _only(docs: DataFrame, rows: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` with one of the row keys, each ``once`` if asked, in the columns of ``docs``."""
    found = _keyed(docs).join(rows.select(_ROW).distinct(), _ROW, "left_semi")
    return (found.dropDuplicates([_ROW]) if once else found).select(*docs.columns)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing_stage),
    ("sharding", shard),
]

#: Neither language profiles nor order MinHash can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written under the shared checkpoint folder, reread, and deleted
    when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return docs
