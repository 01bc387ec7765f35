"""From raw documents to packed training sequences, in stages that are each written
before the next reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize, table
from tessella.llm.decontam import decontaminate
from tessella.llm.jaccard import jaccard_components
from tessella.llm.langid import fit, identify, lettered
from tessella.llm.packing import pack_documents
from tessella.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language can be told of, those without a letter, go; a missing
    lang becomes the predicted one, 'und' if there was nothing to learn from."""
    docs = docs.select(*COLUMNS)
    net = fit(docs)
    told = identify(docs, net, keep=REST)
    told = told.filter("lang_pred <> 'und'") if net is not None else told.mapInArrow(lettered, told.schema)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    docs = docs.select(*COLUMNS)
    kept = jaccard_components(docs).filter("kept").select("row_key")
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out; documents of which nothing is left go. Texts that
    lose nothing stay as they are."""
    cut = substring_dedup(docs.select(*COLUMNS), keep=("lang", "source"), verbatim=True)
    left = cut.filter("n_removed < n_words")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=REST)
    return found.filter(F.size("items") == 0).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins, as pack_documents() gives them; none for none."""
    return pack_documents(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("best_fit_packing", packed),
]

#: Neither the network nor the packing can be said in SQL; tests/llm/test_pipeline.py holds
#: every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next; no rows for no documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
