"""From raw documents to packed sequences, in five stages; each is written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. Empty tables pass
through all stages, and null texts go with the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language, lines, packing, simhash
from docloom.llm.common import delete_table, scratch_scope, shared_dir
from docloom.llm.queries import table, word_tokenizer


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the nearest centroid rejects go, with those that have no letter."""
    model = language.train(docs.filter(language.learnable()))
    return language.identify(docs, model, prefix="__dl_").filter("not __dl_rejected").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated chunks of lines stay in one place; a document of which nothing is left goes."""
    done = lines.dedup_lines(docs).filter("text <> '' or __dl_removed = 0")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the least id of each class stays."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of tokens."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", drop_benchmark),
    ("pack", pack),
]

#: Centroids, fingerprints and token ids can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch_scope():
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
        if k:  # what the stage has read isn't needed any more
            delete_table(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
