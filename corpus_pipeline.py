"""A training corpus from documents: language ID, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
documents, others and clashing ones included. run() writes each stage's rows to the shared folder and reads them back for the next.

Null and empty texts have no language and go first; a stage that gets them nevertheless keeps them (near copies: linked with nothing;
mixing: copied like others; packing: the end id alone). Null doc_ids are kept, and their exact copies go. Repeated rows go but for
one. Rows that share a doc_id but not the text are documents of their own. An empty table passes all stages and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import language_id, mixing, ngram_join, packing
from docgraph.llm.common import stored, table

#: A text whose windows give its best language less than this has no language that holds; clean texts have over 0.9.
LEAST_SCORE = 0.4
#: Near copies: words of a shingle, and the least Jaccard similarity as a fraction.
SHINGLE_WORDS, LIKENESS = 5, (80, 100)
#: Words that a worker of the last stage remembers, fewer than packing alone does: executors have grown by then.
REMEMBERED = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the learned languages stay; those without letters, or without a language that holds, go."""
    found = language_id.identify(docs, language_id.fit(docs))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, once; rows that share a doc_id and differ in text are
    judged one by one."""
    return ngram_join.survivors(docs, SHINGLE_WORDS, LIKENESS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by training sequence."""
    return packing.pack(docs, remembered=REMEMBERED).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: SQL has no trained classifier and no tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}", done=before)
            before = [docs]
    return docs
