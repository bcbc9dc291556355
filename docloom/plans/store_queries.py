"""Queries of sinks and streams: upserts, rollback, evolving tables, dead letters, and a stream that drops what it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import forms, stores
from docloom.plans.registry import query, table
from docloom.streaming import ingest


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS run_id FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 5 = 0")
def k1_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return stores.upsert(v.filter("id % 2 = 0").withColumn("run_id", F.lit("old")), v.filter("id % 5 = 0").withColumn("run_id", F.lit("new")), "id")


@query("SELECT o_orderkey % 1000 AS form_id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1")
def k6_row_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("form_id", F.col("o_orderkey") % 1000)
    return forms.best_readings(rows, ["form_id"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("form_id", F.col("o_totalprice").alias("price"))


@query("SELECT vec_id FROM embeddings WHERE label <> 1")
def k9_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return stores.delete_ids(v, v.filter("label = 1").select("vec_id"), "vec_id").select("vec_id")


@query("SELECT c_custkey AS form_id, c_name AS name, NULL::DOUBLE AS balance FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1")
def k5_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return stores.evolve(c.filter("form_id % 2 = 0").drop("balance"), c.filter("form_id % 2 = 1"))


@query("SELECT event_id, 'E_' || event_type AS code FROM events WHERE event_type IN ('error', 'click')")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.when(F.col("event_type").isin("error", "click"), F.array(F.lit("W_SLOW"), F.concat(F.lit("E_"), "event_type"))).otherwise(F.array(F.lit("W_SLOW")))
    return stores.dead_letters(table(spark, sf_dir, "events").withColumn("errors", codes))[1].select("event_id", "code")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed aggregate; batch and stream share the plan."""
    counted = ingest.windowed_counts(table(spark, sf_dir, "events"))
    return counted.select("event_type", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT doc_id, sha256(sha256(text) || '|' || source || '|1') AS ingest_key FROM documents QUALIFY row_number() OVER (PARTITION BY text, source ORDER BY doc_id) = 1")
def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, worked off once into a table; each ingest key stays once, with its least id."""
    from docloom.plans.shared import scratch_folder

    docs = table(spark, sf_dir, "documents")
    root = scratch_folder(spark, "stream")
    source = ingest.stream_rows(spark, f"{sf_dir}/documents.parquet*", docs.schema)
    keyed = ingest.keyed(source, "source").select("doc_id", "ingest_key")
    ingest.run_once(keyed, f"{root}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
    return spark.read.parquet(f"{root}/out").groupBy("ingest_key").agg(F.min("doc_id").alias("doc_id"))
