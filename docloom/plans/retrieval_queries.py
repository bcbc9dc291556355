"""Queries of tag-scoped retrieval: embeddings with tags by label and id, documents with tags by source and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.plans.registry import query, table

TAGS = "e AS (SELECT vec_id, embedding, ['l' || label] AS tag_label, ['c' || vec_id % 4, 'm' || vec_id % 3] AS tag_class FROM embeddings)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("label"), F.array(F.expr("'l' || label")), F.lit("class"), F.array(F.expr("'c' || vec_id % 4"), F.expr("'m' || vec_id % 3")))
    return retrieval.flatten_tags(table(spark, sf_dir, "embeddings").withColumn("tags", tags), "tags", ["label", "class"])


SEARCH = """q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id, list_dot_product(embedding::DOUBLE[], query::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(query::DOUBLE[], query::DOUBLE[])) AS score, tag_label, tag_class FROM e, q)"""


@query(f"WITH {TAGS}, {SEARCH} SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def l5_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k(tagged(spark, sf_dir), queries).withColumn("score", F.round("score", 9))


@query(f"""WITH {TAGS}, {SEARCH}, i AS (SELECT *, true AS scoped FROM s WHERE list_contains(tag_label, 'l1') AND (list_contains(tag_class, 'c0') OR list_contains(tag_class, 'm1')) AND query_id % 40 = 0),
  b AS (SELECT * FROM i UNION ALL SELECT *, false FROM s WHERE query_id NOT IN (SELECT query_id FROM i))
  SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 9) AS score, scoped FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM b) WHERE rank <= 10""")
def q6_q7_scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    vectors, scope = tagged(spark, sf_dir), retrieval.tag_filter({"label": ["l1"], "class": ["c0", "m1"]})
    even, odd = queries.filter("query_id % 40 = 0"), queries.filter("query_id % 40 <> 0")
    found = retrieval.scoped_top_k(vectors, even, scope).unionByName(retrieval.scoped_top_k(vectors, odd, F.lit(False)))
    return found.withColumn("score", F.round("score", 9))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN ['l' || label] ELSE ['l' || label, 'extra'] END AS label_tags, ['c' || vec_id % 4] AS class_tags FROM embeddings""")
def u7_q3_merge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.create_map(F.lit("label"), F.array(F.expr("'l' || label")))
    b = F.create_map(F.lit("label"), F.when(F.col("vec_id") % 3 == 0, F.array(F.expr("'l' || label"))).otherwise(F.array(F.lit("extra"), F.expr("'l' || label"))), F.lit("class"), F.array(F.expr("'c' || vec_id % 4")))
    merged = retrieval.flatten_tags(table(spark, sf_dir, "embeddings").withColumn("tags", retrieval.merge_tags(a, b)), "tags", ["label", "class"])
    return merged.select("vec_id", F.col("tag_label").alias("label_tags"), F.col("tag_class").alias("class_tags"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'industry' WHEN 'HOUSEHOLD' THEN 'home' ELSE c_mktsegment END AS value FROM customer")
def q5_j16_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("Machinery", "industry"), ("household", "home")], "alias string, canonical string")
    return retrieval.resolve_aliases(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("value")), aliases)


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ['HR', 'Policy'] WHEN 1 THEN ['HR'] ELSE []::VARCHAR[] END AS prefixes, CASE o_orderkey % 4 WHEN 2 THEN 'http://a.b what' WHEN 3 THEN 'what: ' || o_orderkey ELSE 'what ' || o_orderkey END AS text FROM orders WHERE o_orderkey % 4 <> 3
  UNION ALL SELECT o_orderkey, ['what'], o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 4 = 3""")
def q4_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'HR:Policy: what ' || o_orderkey WHEN 1 THEN 'HR: what ' || o_orderkey WHEN 2 THEN 'http://a.b what' ELSE 'what: ' || o_orderkey END")
    return table(spark, sf_dir, "orders").select("o_orderkey", retrieval.parse_prefix(asked).alias("p")).select("o_orderkey", "p.prefixes", "p.text")


@query("""WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'nation' ELSE 'stray' END AS layer, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE c_nationkey::VARCHAR END AS value FROM customer
  UNION ALL SELECT c_custkey, 'segment', 'OTHER' FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 'nation', 'x' FROM customer WHERE c_custkey % 6 = 1)
  SELECT id, layer, value, CASE WHEN layer = 'segment' AND value = 'OTHER' THEN 'E_TAG_VALUE_UNKNOWN' WHEN layer = 'nation' AND count(*) OVER (PARTITION BY id, layer) > 1 THEN 'E_TAG_TOO_MANY' END AS error FROM t WHERE layer <> 'stray'
  UNION ALL SELECT id, 'segment', NULL, 'E_TAG_REQUIRED' FROM (SELECT DISTINCT id FROM t) WHERE id NOT IN (SELECT id FROM t WHERE layer = 'segment')""")
def q1_validate_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    tags = c.select("id", F.expr("CASE id % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'nation' ELSE 'stray' END AS layer"), F.expr("CASE id % 3 WHEN 0 THEN c_mktsegment ELSE cast(c_nationkey AS string) END AS value"))
    tags = tags.unionByName(c.filter("id % 6 = 0").select("id", F.lit("segment").alias("layer"), F.lit("OTHER").alias("value"))).unionByName(c.filter("id % 6 = 1").select("id", F.lit("nation").alias("layer"), F.lit("x").alias("value")))
    layers = spark.createDataFrame([("segment", "user", True, True, True), ("nation", "user", False, False, False), ("kind", "auto", True, False, True)], "layer string, source string, multiple boolean, closed boolean, required boolean")
    return retrieval.validate_tags(tags, layers, c.select(F.lit("segment").alias("layer"), F.col("c_mktsegment").alias("value")).distinct())


@query("""SELECT doc_id, list_filter([CASE WHEN contains(text, '|') THEN 'has_table' END, CASE WHEN length(text) > 4000 THEN 'long' END, 'lang_' || lang], lambda x: x IS NOT NULL) AS tags FROM documents""")
def q2_auto_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = retrieval.auto_tags({"has_table": F.col("text").contains("|"), "long": F.length("text") > 4000, "": F.concat(F.lit("lang_"), "lang")})
    return table(spark, sf_dir, "documents").select("doc_id", tags.alias("tags"))
