"""A training-corpus pipeline: every stage works on all that its predecessor kept, and its decisions take effect.

1. language identification: texts without a letter, and texts whose two best languages are too close, go;
2. quality classifier: documents that score under the threshold go;
3. near duplicates (five-word shingles, similarity 0.8 or more): the smallest doc_id of each group stays;
4. benchmark decontamination: documents that hold a benchmark item, exactly or paraphrased, go;
5. SentencePiece: the documents left are encoded, and decoded again to show that nothing is lost.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.llm import decontamination, language_id, quality, segmentation
from collatio.llm.common import held_out, stored
from collatio.llm.near_dup import NearDuplicates

MARK = "__collatio"
MIN_QUALITY = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    return language_id.predict(docs, model, column=MARK).where(F.col(MARK)["accepted"]).drop(MARK)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4))
    return quality.score(docs, quality.fit(docs, labels), column=MARK).where(F.col(MARK) >= MIN_QUALITY).drop(MARK)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return NearDuplicates().kept(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    found = decontamination.find(docs, items, decontamination.fit(docs, items), column=MARK)
    return found.where(F.size(MARK) == 0).drop(MARK)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.digest(segmentation.encode(docs.select("doc_id", "text"), n=4, verify=True))


STAGES = [
    ("language ID", language),
    ("quality classifier", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", clean),
    ("SentencePiece encoding and decoding", tokens),
]

#: Trained models decide in stages 1, 2 and 4, which SQL cannot express; tests/llm hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
