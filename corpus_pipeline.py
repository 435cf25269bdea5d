"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, pseudonyms, packing.

Each stage takes all that its predecessor kept, as a table in the shared folder, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreweave.llm import contamination, minhash, packing, pseudonyms, quality
from loreweave.llm.common import cut, discard, table
from loreweave.llm.queries import PSEUDONYM_KEY, tokenizer_path
from loreweave.sources.spread import spread

#: Stages on word shingles take five words and a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return minhash.drop_near_duplicates(docs, percent=PERCENT, width=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values get pseudonyms of their format."""
    return pseudonyms.mask(docs, PSEUDONYM_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Permutations under a key, a tokenizer and a space-filling curve are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again before the next."""
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, (docs, _) = docs, cut(docs, f"stage-{name}")
            discard(before)  # written by the stage before, and read by none any more
    return docs
