"""The corpus pipeline: quality classifier, exact dedup, near-duplicate join, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltashelf.llm import common, exact_dedup, jaccard_join, packing, quality, secrets

def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose keys kf, kr are among those kept."""
    rows = common.placed(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(kept.select("kf", "kr").hint("merge"), ["kf", "kr"], "left_semi").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged by their metadata and the features of an empty text, very long ones whole;
    repeated rows are judged alike and all stay or go, so do ties at the bound; where the labels don't hold both
    classes, as in empty tables, every document stays; other columns, whatever their names, are kept as they are.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, carry=docs.columns)
    return scored.filter("keep").select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest doc_id stays (null ids last), of rows that repeat an id and a text one.

    Null and empty texts are equal to each other; other columns, whatever their names, are kept as they are.
    """
    docs = common.filed(docs, "stage-exact")
    return _rows(docs, exact_dedup.exact_dedup(docs).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest doc_id stays (null ids last); rows without words all stay.

    Other columns, whatever their names, are kept as they are.
    """
    docs = common.filed(docs, "stage-near")
    return _rows(docs, jaccard_join.join_similar(docs).filter("leads"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind in brackets; every document stays.

    Null and empty texts stay as they are, very long ones are searched whole; repeated rows stay repeated; where there
    is a column n_chars it counts the new text; other columns, whatever their names, are kept as they are.
    """
    clean = secrets.redact(docs, _path("byte_bpe_50k.tiktoken"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are one id each, very long ones are cut into full sequences first; repeated rows are packed
    each; an empty table gives an empty result; further columns play no part.
    """
    return packing.pack(docs, _path("byte_bpe_50k.json"), 1024, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: No SQL: the stages train a classifier and use tokenizers; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what was written of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
