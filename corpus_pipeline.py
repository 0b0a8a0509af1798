"""The corpus pipeline: quality, exact copies, near copies, mixture, packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.exact_dedup import drop_copies
from tallyforge.llm.mixing import take_mix
from tallyforge.llm.packing import pack
from tallyforge.llm.quality import keep_good
from tallyforge.llm.shared import spill
from tallyforge.llm.simhash_dedup import drop_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the cut of the classifier; the training labels of the table `labels` are all that it learns from.

    A null text is scored as the empty one. Equal texts are kept or dropped together, whatever their ids, so repeated rows stay repeated; a null id
    is scored like any other and is never a label. Without labels of both classes every row is kept. An empty table gives no rows. Columns
    beyond those of documents are dropped here, whatever their names.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the widths of their white space: the least id, null ids last.

    Among rows that repeat an id the first by file and row stays. Null and empty texts are one group; a text of white space alone is the group of
    one space. Texts are compared whole. An empty table gives no rows; all columns are kept, whatever their names.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose distinct five-word shingles are 0.8 alike or more: the least id, null ids last, then by file and row.

    Texts without words (null, empty, white space) are one group; a text of fewer than five words is one shingle. A similarity of 0.8 exactly is a
    link. An empty table gives no rows; all columns are kept, whatever their names.
    """
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all to twice.

    A null source is a source of its own, the last one. A text of no words has no mass: it is taken as often as whole copies of its source are, and
    never by a draw. Repeated rows, and null ids, are documents of their own. The same rows give the same mix. An empty table gives no rows; all
    columns are kept, whatever their names.
    """
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences of at most 1024 tokens.

    A null or empty text is one piece of the end token. A document that the mix takes twice is packed twice, and a null id is kept as null. A very
    long text is cut into full sequences and a rest. An empty table gives no rows; other columns are not read.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, keep_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to documents; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
