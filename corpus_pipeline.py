"""The corpus pipeline: five stages from raw documents to token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import minhash, mixing, quality, repeats, sentencepiece_fst
from lectern.llm.common import load, written
from lectern.llm.queries import TOKENIZERS

#: No stage after the first two can be told in SQL; README.md says how far each stage is tested instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule cascade."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 or more."""
    return minhash.keep_one(docs, n_words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that also start elsewhere; ``n_chars`` follows."""
    out = repeats.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Good and plain documents keep their tokens, the toxic domain gets the weight 0."""
    mixed, _ = mixing.mix(docs, mixing.label_domains(load(spark, sf_dir, "labels")),
                          {"good": None, "plain": None, "toxic": 0.0})
    return mixing.apply_rates(docs, mixed)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece identifiers and their number, without the text."""
    out = sentencepiece_fst.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a data folder."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
