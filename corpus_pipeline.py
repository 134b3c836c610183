"""From documents to training sequences: quality rules, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents:

1. quality rules: documents that the base rules or their host's verdict reject go;
2. n-gram Jaccard join: of each group of near duplicates one row stays, that with the smallest id;
3. suffix-array dedup: what repeats, in strings of 200 bytes, is taken out of the texts; emptied documents go;
4. mixing: the documents that the weights take of 80 % of the tokens, within one epoch, whole;
5. packing: pieces of at most 2048 tokens, their ids and their place in sequences.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeprint.llm import common, mixing, ngram_join, packing, quality, suffix
from planeprint.llm.queries import tokenizer_path

#: Share of the tokens that reach the mixing stage which it keeps.
MIX_SHARE = 0.8
#: Bytes of a string that repeats: passages of over 50 words have more, and are to go as a whole.
PASSAGE = 200


_scratch = common.Scratch()


def owning(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, with scratch tables of its own. It first deletes those of the stage before, whose result is written by now."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.drop()
        with common.owned(_scratch):
            return stage(spark, docs, sf_dir)

    return run


@owning
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@owning
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


@owning
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs, PASSAGE).where(F.coalesce("text", F.lit("")) != "")


@owning
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX_SHARE)


@owning
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't say suffix dedup, components and packing on whole tables; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the shared folder and read again, and deleted once the
    next one is written. Packing reads its input while it is called, not later."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        if before:
            common.delete(spark, f"{folder}/{before}")
        docs, before = spark.read.schema(out.schema).parquet(f"{folder}/{name}"), name
    packed = STAGES[-1][1](spark, docs, sf_dir)
    common.delete(spark, folder)
    return packed
