"""A pipeline over ``documents``: language ID, near-dedup, secret redaction, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, common, langid, mixing, neardup, secretscan


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with a posterior of a half or more.

    Null and empty texts and texts without letters are rejected. Without any labelled row no language is known and all
    rows go. Repeated rows are judged alike, in any number; ties in a language's score go to the one that sorts first.
    """
    told, score = common.fresh(docs, "_lang_pred", "_score")
    model = langid.train(docs)
    out = langid.identify(docs, model, prediction=told, score=score)
    return out.filter((F.col(told) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least doc_id: five-word shingles, similarity 0.8.

    Null and empty texts are near to nothing and stay. Of rows that agree in doc_id and text one stays; rows without an
    id all stay.
    """
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets' spans are replaced by a mark; all rows stay, repeated ones too. Null and empty texts are untouched."""
    return secretscan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Documents without words (null and empty texts) fill no target and go. A null source is a source of its own. Rows that
    agree in doc_id, or have none, are taken alike; of documents that would serve alike, a seeded digest of the id decides.
    """
    return mixing.take_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids, and the SHA-256 of the text that they decode to, of every row.

    Null and empty texts have no ids and the digest of nothing. Rows are neither added nor lost.
    """
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), digest="decoded_sha256")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]

#: Not expressible in SQL (a trained model, sketches, an automaton); tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
