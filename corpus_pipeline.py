"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, whatever other columns there are and however they are named.  A
stage's rows are written and read again before the next.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.common import discard, scratch, table, texts, written
from lumenfold.llm.decontam import without_contaminated
from lumenfold.llm.exact_dedup import without_copies
from lumenfold.llm.jaccard import one_of_each
from lumenfold.llm.packing import pack
from lumenfold.llm.quality import good_documents
from lumenfold.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; null texts are empty, weigh nothing and stay, repeated rows are decided each."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays, null ones last; null texts are empty; of rows that tie in id and text one stays."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join, the smallest doc_id stays; null ids and texts without words stay, rows that tie go together."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none, null items have none, rows that tie go together."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; null texts are the end id alone, repeated rows are packed each."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models, tokenizers and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            left = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if hasattr(docs, "_written_to"):
            discard(docs)  # the stage's rows are written, so nothing reads those before it
        docs = left
    return STAGES[-1][1](spark, docs, sf_dir)
