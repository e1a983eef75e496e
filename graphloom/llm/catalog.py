"""The corpus operators' queries over the test tables and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import pii, topk
from graphloom.llm.ann import nearest
from graphloom.llm.common import table
from graphloom.llm.htmltext import extract_text
from graphloom.llm.language import identify_language
from graphloom.llm.minhash import near_duplicates
from graphloom.llm.mixing import mix
from graphloom.llm.pieces import PieceModel, sampled_round_trip
from graphloom.llm.toxicity import toxicity
from graphloom.llm.warc import warc_round_trip

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"  #: read by the driver only


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_round_trip(table(spark, sf_dir, "documents"), PieceModel.load(PIECE_MODEL))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_ann": op8_ann,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_top_k": op10_exact_top_k,
    "pipeline": pipeline,
}

_WARC_SQL = """
with d as (select page_id, sha1(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, '')))::bigint as n from pages),
g as (select digest, max(page_id) as target from d where n >= 1000 group by 1),
r as (select page_id, n, d.digest, case when n >= 1000 and page_id < target then target end as target from d left join g on g.digest = d.digest)
select page_id, n as payload_bytes, digest as payload_digest, case when target is null then 'response' else 'revisit' end as record_type, target as refers_to, true as verified from r
"""

SQL: dict[str, str] = {
    "op4_warc": _WARC_SQL,
    "op7_pii": pii.reference_sql(),
    "op10_exact_top_k": topk.REFERENCE_SQL,
}
