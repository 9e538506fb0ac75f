"""Cleaning of a training corpus: documents in, token ids out, as a chain of stages over written tables.

Every stage takes the session, the documents that the stage before has kept and the folder of the given
tables, and returns a frame; ``run`` writes each result into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streetlens.llm.decontaminate import decontaminated
from streetlens.llm.jaccard_join import one_of_each_group
from streetlens.llm.pieces import encode_pieces
from streetlens.llm.quality import good_documents
from streetlens.llm.queries import part, table, tokenizer
from streetlens.llm.suffix_dedup import deduplicated
from streetlens.session import stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(docs, table(spark, sf_dir, "labels").filter(part(5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its shingles of five words."""
    return one_of_each_group(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that occur more than once."""
    return deduplicated(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a twentieth of benchmark passages."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with what tells that they decode to its text."""
    encoded = encode_pieces(docs, tokenizer("piece_bpe_32k.model"))
    return encoded.select("row.doc_id", "n_pieces", "ids", "ids_crc32", "round_trip")


STAGES = [
    ("quality_classifier", quality), ("jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", contaminated), ("sentence_pieces", pieces),
]

#: SQL has none of the models and string matches used here; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
