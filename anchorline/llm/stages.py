"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a frame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anchorline.llm import decontaminate, language, minhash, mixing, token_files
from anchorline.llm.frames import crc_held_out, table

TOKENIZER = "byte_bpe_50k.json"

#: Share of its tokens that each domain keeps in the mixture.
KEEP = {"clean": 1.0, "low": 0.5, "toxic": 0.1}
#: A language's share of the mixture follows this power of its share of the tokens, so that rare ones get less rare.
LANGUAGE_POWER = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: other languages, noise and texts without letters go. Documents without a
    ``lang``, or surely with a wrong one, get the language found; the mixture is balanced by it."""
    return language.keep_known(docs, language.fit_language(docs.where(~crc_held_out())), lang="lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their rates: languages are brought nearer to each other in size, then poor and toxic documents get
    rarer; some of a rare language come twice."""
    labels = table(spark, sf_dir, "labels").withColumn("domain", mixing.quality_domain())
    fitted, _ = mixing.fit_mixture(docs, labels, KEEP, balanced="lang", power=LANGUAGE_POWER)
    return fitted.drawn(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, described per document."""
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER))
