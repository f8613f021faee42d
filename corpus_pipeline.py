"""Corpus pipeline: quality, boilerplate lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on every row the stage before kept, and gives the columns of documents
but for the last, which gives packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackworks.llm import decontamination, lines, near_duplicates, packing, quality
from trackworks.llm.queries import tokenizer_path
from trackworks.llm.shared import own_name, stored

#: Documents with a lower quality score are rejected.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of a quality score under LEAST_QUALITY.

    Null, empty and very long texts, nulls in other columns and repeated rows are scored like any other; an empty table
    stays empty. Columns and their names stay as they are.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    q = own_name(docs, "quality")
    return quality.score_quality(docs, model, out=q).filter(F.col(f"`{q}`.score") >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's boilerplate lines out of all texts, exact copies counted once; n_chars follows.

    No row goes; a text may end empty. Null texts stay null, and so do their n_chars; repeated rows are exact copies, rows
    without a source a source of their own, lines and texts of any length are read whole; an empty table stays empty.
    """
    done = lines.without_boilerplate(docs, "source", copies_once=True)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id: five words, similarity 0.8.

    Null and empty texts link with nothing and stay, as do rows without an id; of rows that repeat an id, all stay or go.
    Whole texts of any length are compared; an empty table stays empty.
    """
    return near_duplicates.deduplicated(docs, percent=80, shingle=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents of which over half the words are such; n_chars follows.

    Null and empty texts stay, repeated rows are judged alike, whole texts of any length are read; an empty table stays
    empty.
    """
    done = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens: a row a piece, with its token ids.

    Null and empty texts are one end id; repeated rows are documents of their own; documents of over 2048 tokens are cut
    into pieces; an empty table gives an empty one.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0, payload="ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs


#: Tokenizing and fitted models aren't SQL; tests/llm has a brute-force version.
ORACLE_SQL = None
