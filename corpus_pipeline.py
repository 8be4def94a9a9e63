"""The corpus pipeline: language, near copies, repeated passages, mixture, packing.

Each stage takes the documents that its predecessor kept, as a table that was written and read again.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspar.llm import jaccard, language, mixing, packing, scratch, substring

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and the least similarity of near copies, in percent; op9's own numbers bind its query only.
NEAR = {"k": 5, "percent": 80}
_ended: list[str] = []


def _stage(run):
    """A stage deletes what earlier stages cut, whose results have been written by then; tables of others stay."""

    @wraps(run)
    def go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.bound_batches(spark)
        while _ended:
            scratch.release(_ended.pop())
        with scratch.scope() as mine:
            out = run(spark, docs, sf_dir)
        _ended.append(mine)
        return out

    return go


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; ``lang`` of the others is the predicted one.

    Without any labelled row there is no language, and every document goes.  Columns other than those of documents are left out.
    Ambiguous texts stay with their nearest language: uncertainty between two languages is no fault of a text."""
    model = language.fit(docs.where(~language.held_out()).select("doc_id", "text", "lang"))
    found = language.predict(docs.select(*COLUMNS), model)
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays, one without an id only if none has one; of equal rows one.

    Rows are told apart by id and text, so that an id which several texts share, or none, loses no document."""
    docs = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row_key"))
    found = jaccard.join(docs.select(F.col("row_key").alias("doc_id"), "text"), **NEAR)
    found = found.groupBy(F.col("doc_id").alias("row_key")).agg(F.min("component_id").alias("component_id"))
    ids = docs.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    keep = found.join(ids, "row_key").groupBy("component_id").agg(first).select("first.row_key")
    return docs.join(keep, "row_key").dropDuplicates(["row_key"]).select(*COLUMNS)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of smaller id has are cut out; a document that nothing is left of goes.

    Null and empty texts go; a null doc_id neither loses nor takes; rows of one doc_id don't lose words to each other; a text that
    loses nothing stays as it is, byte for byte."""
    kept = substring.dedup(docs.select(*COLUMNS)).where("n_words > n_removed")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks for; the last one is cut to the budget.

    A null source is a source of its own; texts without words are not taken; equal rows share what they take."""
    mixed = mixing.materialise(docs.select(*COLUMNS), mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: a row for each piece.  A null or empty text is the id 0 alone; repeated rows are packed separately."""
    return packing.pack(docs)


STAGES = [("language_id", identify), ("ngram_jaccard", near_copies), ("substring_dedup", passages), ("source_mixing", mixture), ("packing", packed)]
#: Trained codes and a tokenizer can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each on the written rows of the one before; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch.shared_dir(spark)}/marlspar-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            scratch.remove(spark, f"{base}/{k - 1}")
    while _ended:
        scratch.release(_ended.pop())
    return docs
