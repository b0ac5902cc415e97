"""A corpus from raw documents to packed sequences: each stage is one operator of tidemark.llm.

run() writes each stage's rows as Parquet in the shared folder and reads them again for the next one.

All stages: an empty table gives no rows. Rows with a null doc_id are documents like others. Repeated rows stay as often as
they occur where one of them stays, in packing each with its own place. Texts are read whole, however long. Columns
beside doc_id, text and n_chars, whatever their names and types, go through all stages but the last as they are; n_chars is
set anew where a text is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, lines, neardup, packing, substrings
from tidemark.llm.common import scratch, set_aside, written

#: A text is in no language that was learned if its best one has less than this many times the share of the positive
#: cosines that it would have if all were equal.
LEAST_LEAD = 1.04


def least_score(languages: int) -> float:
    """The least score that keeps a document among so many languages; a single one is always clear."""
    return min(1.0, LEAST_LEAD / max(1, languages))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Null and empty texts, texts without letters, unclear ones and, from
    language.FEW_LETTERS letters on, those that are no nearer to any learned language than noise go. Of languages that are
    equally near the first by name counts, which decides nothing here. No labelled row: nothing is learned and all go."""
    prototypes = language.train(docs)
    rows, back = set_aside(docs, ["lang_pred", "score"])
    found = language.predict(rows, prototypes, rows.columns, language.noise(), language.train(docs, even=True))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least_score(len(prototypes)))).select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents that they leave without a line. Of equal runs the first by doc_id (null
    first), digest of the text and line stays."""
    rows, back = set_aside(docs, ["n_lines", "n_removed", "runs"])
    out = lines.without_runs(rows)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*back)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8. It is the one of the least doc_id; a group
    without any id stays, as do rows that share the kept id."""
    return neardup.one_of_each(docs, k=5, percent=80)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages go, and documents that they leave without text. Of equal passages the first by doc_id (null
    first), hash of the text and place stays."""
    out = substrings.remove_spans(docs, substrings.repeated_spans(docs))
    return out.where(F.col("text") != "").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest in sequences of 2048 tokens: a row for each piece. Of pieces of equal length it is open which takes which place."""
    return packing.op5(docs)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("substring_dedup", dedup_substrings), ("packing", pack)]
#: Language ID, near-duplicates and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other. What a stage writes for itself goes as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return docs
