"""Corpus preparation: quality rules, toxicity, near-duplicates, personal data, packing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import packing, pii, quality, text_dedup, toxicity
from millrace.llm.entry import WORD_BPE
from millrace.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the ratio of trusted to raw text keep, all their columns as they were.

    Null and empty texts fail the base rules; a score at the threshold passes; repeated rows and null ids are judged by
    their text like any other; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels), carry_row=True)
    return scored.where("kept").select("row.*")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 3, at its own threshold, does not predict toxic, all their columns as they were.

    A score at the threshold is toxic; null and empty texts score 0 and stay, repeated rows and null ids are judged by
    their text; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), carry_row=True)
    return scored.where("predicted = 0").select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near-duplicates.

    Rows are told apart by a number of their own, so that a repeated id loses no text and of rows that repeat id and
    text one stays. Texts without words all stay; null ids come last in their group.
    """
    row = next(name for n in range(len(docs.columns) + 1) if (name := f"_row{n}") not in docs.columns)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = text_dedup.near_duplicate_texts(numbered, row_col=row)
    dropped = written(found.where("not kept").select(row), "dropped")
    return numbered.join(dropped, row, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text (null for null).

    Every row gives one row, whatever its id; of overlapping spans the first is named; an empty table gives an empty one.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their places in sequences of 4096 tokens.

    Null and empty texts are one piece of the end id; repeated rows and null ids are packed like any other; an empty
    table gives no pieces.
    """
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", remove_toxic),
    ("near-duplicates", remove_near_duplicates),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

# Trained and hashed decisions have no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every stage's result is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
