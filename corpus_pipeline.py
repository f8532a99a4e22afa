"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Quality rules take out the documents they reject, line dedup takes repeated lines out of texts, the Jaccard join keeps one
document of each group, mixing gives each pass over a source a row per document with the words taken, and the last stage
gives the ids of every text, with whether they decode to it.

A lost executor costs the tasks it ran: stages read and write tables in the shared folder.

What every stage does with odd rows: null and empty texts fail the base rules and go in the first; in the stages after it,
called on their own, they have no lines to lose, no links, nothing to mix (they are left out of the mix), and null or no ids.
Null languages and sources are values like others. Null doc_ids stay documents of their own in the rules, the Jaccard join
and the mix; line dedup takes them for one document, the last one of none. Repeated rows are judged, and may be taken, one by
one; of equal texts the Jaccard join keeps the row with the smallest doc_id. Texts of any length are worked on whole.
Columns beside doc_id, text, lang, source and n_chars pass through all stages but the last, whatever their names. Empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligo.llm import jaccard, lines, mixing, pieces, quality
from eligo.llm.common import table
from eligo.session import cut_lineage

ORACLE_SQL = None  # the covariance steps, the seeded draws and the piece search are not SQL; tests/llm has brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.filter_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.filter_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load()
    named = docs.select("doc_id", "lang", "source", "text")
    both = pieces.encode_and_decode(named, vocabulary)
    return both.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
                       F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
