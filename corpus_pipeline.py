"""A corpus pipeline of five stages over ``documents``, each written and read again.

Toxic and poor documents go, one document of each group of near copies stays (the one with the
least id), the rest is mixed to source weights (a document taken twice is there twice) and
encoded.  ``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir).

Defined results: a document with a null or empty text is not toxic and fails the quality rules; of
rows equal in id and text one stays, of copies under several ids the one with the least id (null
last); a null source is a source of its own.  Without labels nothing is toxic and only the base
rules of quality decide.  Texts of any length are read whole, columns other than the five of
documents are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe, mixing, ngram_join, quality, toxicity
from weirflow.llm._common import scratch, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TYPED = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fewer entries than the operator remembers by itself: its workers have served the other stages as well.
MEMO = 80_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, TYPED).where(~F.col("toxic")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, trees, TYPED).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the least id."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return mixing.repeated(mixed).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, memo=MEMO)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: Models are trained here and bytes merged by rank, which SQL can't express; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Only the last one's table stays in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch() as keep:
            made = written(stage(spark, docs, sf_dir), f"stage{k}")
            keep(made)
        if before:
            before.drop()
        docs, before = made.frame, made
    return docs
