"""A corpus clean-up in five stages; each reads what the one before has written.

Every stage takes nulls in any column, empty and very long texts, repeated rows, columns
beside those of documents (left out) and empty tables (no rows).  A document whose text is
null or has no word goes with the rules, or with the stage that cuts its last word.  Rows
without an id are kept by the near-duplicate stage; rows that share an id stay or go
together there, and elsewhere each row is a document of its own.  Of near duplicates the
least id stays; of lines the first by id and line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, minhash, packing, quality_rules, substring_dedup
from ledgerloom.llm.base import durable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def documents(rows: DataFrame) -> DataFrame:
    """The columns of documents for rows whose text may have been cut; those without a word go."""
    return rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    rows = quality_rules.settled(quality_rules.ledger(docs, carry=COLUMNS[1:]))
    return quality_rules.apply_policy(rows).where("kept").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line is like."""
    return documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id; those without an id stay."""
    kept = minhash.near_duplicates(docs, size=SHINGLE).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words in windows that occur again."""
    return documents(substring_dedup.remove_repeats(docs.select(*COLUMNS), cut=True))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(durable(packing.token_pieces(docs)))


STAGES = [("quality rules", rules_stage), ("line dedup", lines_stage), ("near dedup", near_stage), ("substring dedup", substring_stage), ("packing", packing_stage)]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
