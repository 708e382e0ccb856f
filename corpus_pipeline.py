"""The corpus pipeline: documents in, encoded clean documents out.

Each stage is written as Parquet and read again as the next one's documents. All but the
last return the columns they were given, extra ones too, whatever their names.

Results by case, of every stage: an empty table gives an empty one; very long texts are read
whole; a null text counts as empty. By stage:

- toxicity: rows without id are scored like others and never learnt from; null, empty and
  repeated texts stay or go by their score, which is 0 without words.
- simhash: texts without words are copies of each other; of a group the row of the least id
  stays, one without id only where no other is, of repeated rows one.
- decontamination: a row goes only if its own text holds an item; null and empty items are in nothing.
- secrets: a null text stays null; n_chars follows the new text and stays null where it was.
- pieces: a null text gives null lists, an empty one an empty list; a null id counts as 0 in the
  keyed hash; only the id and the text are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontam, nearcopies, pieces, secrets, toxicity
from maskwright.llm.common import ensure_checkpoint_dir, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return nearcopies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are masked in the text."""
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces, with merge-dropout."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last by way of a written table in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
