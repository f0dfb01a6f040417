"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is
written as Parquet and read back as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.hadoop import Files
from monthgrid.llm import decontam, lines, partenum, pieces, toxicity
from monthgrid.llm.arrowtools import shared_dir, working_tables


def toxicity_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at its threshold or over go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, toxicity.fold(F.col("__id")) != 1)
    return toxicity.drop_toxic(docs, model)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too large a share of their source's documents hold go; n_chars follows the text."""
    done = lines.drop_boilerplate(docs, host="source", text="text")
    return done.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def jaccard_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the least id stays."""
    return partenum.one_of_each(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids, and whether decoding gives the text back exactly."""
    both = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"), "exact")


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece_ids),
]

#: The trained first stage can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.  What passes between them lies in the shared folder: a stage's working tables go once
    its documents are written, and these go once the next stage's are.  The last stage's result is read from the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    files = Files(spark)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        place = f"{folder}/{k}-{name}"
        with working_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(place)
        if before:
            files.delete(before)
        docs, before = spark.read.parquet(place), place
    return STAGES[-1][1](spark, docs, sf_dir)
