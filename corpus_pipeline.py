"""A corpus from raw documents to sampled pieces, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage's result as Parquet in shared scratch and
reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.catalog import PIECE_MODEL
from graphloom.llm.common import short_batches, table
from graphloom.llm.minhash import without_near_duplicates
from graphloom.llm.mixing import mixed_documents
from graphloom.llm.pieces import PieceModel, encode_pieces
from graphloom.llm.pii import redacted
from graphloom.llm.toxicity import fit_toxicity, score_documents
from graphloom.scratch import Scratch

TOXIC = 0.3  #: documents with this score or more go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; null and empty texts stay unless most labelled rows are toxic."""
    short_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, name="__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts (five words, 0.8).

    Rows are judged by their texts, so rows of one id with different texts stay
    apart.  Rows without words and rows with a null id all stay; an empty table
    gives no rows; other columns pass.
    """
    short_batches(spark)
    return without_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of its kinds; every document stays."""
    text = redacted(docs)
    return text.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    return mixed_documents(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentation, seeded by its id, in place of its text."""
    short_batches(spark)
    return encode_pieces(docs, PieceModel.load(PIECE_MODEL), keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", sample_pieces),
]

#: Training, chosen paths and sampling have no SQL: the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` table of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = scratch.save(stage(spark, docs, sf_dir), name)
        docs = done
    return docs
