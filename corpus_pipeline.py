"""Corpus pipeline: five stages over `documents`, each one operator of quillgraph.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, whatever they are named. Whole texts are read, however long, and an
empty table stays empty in every stage. Rows without a doc_id can't be named as duplicates or
as contaminated, so they pass those stages; rows that share a doc_id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.language_id import keep_identified
from quillgraph.llm.ngram_jaccard import jaccard_components
from quillgraph.llm.positional_index import contamination
from quillgraph.llm.sentencepiece_codec import encode_texts
from quillgraph.llm.shared import saved
from quillgraph.llm.substring_dedup import dedup_substrings
from quillgraph.session import release, saved_tables


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the ids, which are stored first: Spark then knows their size and how to join."""
    return docs.join(saved(ids.select("doc_id").distinct(), "dropped-ids"), "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null and blank texts, texts without letters and undecided texts go.

    Rows are judged by their text alone, so repeated rows fare alike. A null lang is only not learned from.
    """
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each class of linked documents.

    Null and blank texts link with nothing and stay. Equal texts tie by doc_id; equal rows, id
    included, stay together, as do rows without an id.
    """
    return _without(docs, jaccard_components(docs).filter("component_id <> doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that an earlier place has; n_chars follows the text.

    Untouched texts stay as they are, null and blank ones too; what is left of others is joined
    by single blanks and may be empty. Rows of one doc_id count one after another by their
    text, rows without an id after all others.
    """
    out = dedup_substrings(docs, min_words=20, carry=True, keep_untouched=True)
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))}
    return out.select(*[changed.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in passages of the benchmark.

    Null and blank texts have no words and stay. Of rows that share a doc_id all go if one does.
    """
    hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    return _without(docs, hits.filter((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, exact): SentencePiece ids of each document; null for a null text, none for an empty one."""
    return encode_texts(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]

# No SQL expresses the network of the first stage; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is stored in the shared folder before the next.

    With that, what the stages before it stored there goes.
    """
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(saved_tables(spark))
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since=since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
