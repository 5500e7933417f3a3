"""A cleaning pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syllabary.llm import line_chunks, mixing, near_dups, packing, quality
from syllabary.llm.common import WORD, Scratch, read

#: SQL has neither the hashed multinomials nor the tokenizer of these stages; tests hold them against plain Python instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; the target are the labelled ones of quality 1.

    Rows are judged where they lie and go on whole, so repeated and null doc_ids need no join.
    """
    trusted = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("trusted")).filter("trusted is not null")
    # Under names of their own, so that no column of docs can be taken for one of the verdict's; the text goes as it is called.
    names = [c if c == "text" else f"carried_{i}" for i, c in enumerate(docs.columns)]
    carried = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    judged = quality.judge(carried, quality.learn(docs, trusted), names)
    return judged.filter("kept").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines and repeated runs of lines of over 50 words; those left without a word, whose
    every line stands elsewhere, go."""
    left = line_chunks.remove_repeats(docs, runs_over=50)
    return left.filter((F.size("removed_lines") == 0) | F.col("text").rlike(WORD)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each near-duplicate group at a similarity of 0.8.

    Rows that share a doc_id are one group, of which the first by text hash stays; rows without one are in no group and stay.
    """
    groups = near_dups.near_duplicates(docs, percent=80)
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    # How many go grows with the input, so they are never broadcast.
    named = docs.filter("doc_id is not null").hint("merge").join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    place = max(docs.columns, key=len) + "_place"  # no column has this name
    first = named.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")))
    return first.filter(F.col(place) == 1).drop(place).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and each round in which it gives any."""
    return mixing.taken_texts(docs, mixing.Mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, sequence=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
