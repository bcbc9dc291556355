"""Tag-scoped retrieval: tag layers, aliases, prefix queries, filters and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_tags(a: Column, b: Column) -> Column:
    """Tag sets map<layer, array<value>> joined layer by layer, values in order and once."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_distinct(F.concat(F.coalesce(x, empty), F.coalesce(y, empty))))


def flatten_tags(frame: DataFrame, tags: str, layers: list[str]) -> DataFrame:
    """A column tag_<layer> for each layer."""
    return frame.select("*", *(F.try_element_at(F.col(tags), F.lit(layer)).alias(f"tag_{layer}") for layer in layers))


def resolve_aliases(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """tags: id, value. Values that are aliases become their canonical ones (case aside)."""
    known = aliases.select(F.lower("alias").alias("a"), "canonical")
    met = tags.join(known, F.lower(tags["value"]) == known["a"], "left")
    return met.select(*[tags[c] for c in tags.columns if c != "value"], F.coalesce("canonical", "value").alias("value"))


def parse_prefix(query: Column) -> Column:
    """`LAYER:` words in front of a query as (prefixes, rest). A prefix is a name at once followed by a colon and no slash."""
    prefixes = F.regexp_extract(query, "^((?:[A-Za-z][A-Za-z0-9_-]*:(?!//))*)", 1)
    parts = F.filter(F.split(prefixes, ":"), lambda x: x != "")
    rest = F.trim(F.substr(query, F.length(prefixes) + 1, F.length(query)))
    return F.struct(parts.alias("prefixes"), rest.alias("text"))


def validate_tags(tags: DataFrame, layers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tags: id, layer, value. Unknown layers are dropped; `auto` layers are ignored; too many or unknown values are errors.

    layers: layer, source, multiple, closed, and if there is a column required, a layer without a value is an error of each id.
    """
    asked = layers.filter("source <> 'auto'")
    met = tags.join(asked, "layer").join(vocabulary.withColumn("known", F.lit(True)), ["layer", "value"], "left")
    n = F.count(F.lit(1)).over(Window.partitionBy("id", "layer"))
    error = F.when(F.col("closed") & F.col("known").isNull(), "E_TAG_VALUE_UNKNOWN").when(~F.col("multiple") & (n > 1), "E_TAG_TOO_MANY")
    found = met.select("id", "layer", "value", error.alias("error"))
    if "required" not in layers.columns:
        return found
    # The layers are few by nature: a row of each for every id.
    wanted = tags.select("id").distinct().join(F.broadcast(asked.filter("required").select("layer")), F.lit(True))
    missing = wanted.join(tags.select("id", "layer").distinct(), ["id", "layer"], "left_anti")
    return found.unionByName(missing.select("id", "layer", F.lit(None).cast("string").alias("value"), F.lit("E_TAG_REQUIRED").alias("error")))


def auto_tags(rules: dict[str, Column]) -> Column:
    """The tags whose condition holds, in the order of the rules; a rule may also be a column of tags itself."""
    return F.array_compact(F.array(*(F.when(rule, name) if name else rule for name, rule in rules.items())))


def tag_filter(wanted: dict[str, list[str]]) -> Column:
    """All layers must match, by any of their values."""
    out = F.lit(True)
    for layer, values in wanted.items():
        out = out & F.arrays_overlap(F.col(f"tag_{layer}"), F.array(*map(F.lit, values)))
    return out


def ambiguous_filter(layers: list[str], value: str) -> Column:
    """A tag that several layers know matches in any of them."""
    out = F.lit(False)
    for layer in layers:
        out = out | F.array_contains(F.col(f"tag_{layer}"), value)
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, most_queries: int = 20_000) -> DataFrame:
    """The k nearest vectors of each query by cosine. queries: query_id, query, a set of at most most_queries rows.

    The queries are few by contract and checked, so they go to every task. A task multiplies its vectors with blocks of them, keeps
    the k best of each query so far, and gives those at its end: what is shuffled doesn't grow with the vectors of a task.
    """
    rows = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError(f"more than {most_queries} queries; search in batches")
    spark, id_type, vec_type = vectors.sparkSession, queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {vec_type}, score double")
    asked = spark.sparkContext.broadcast(np.array([r["query"] for r in rows], dtype=np.float64).reshape(len(rows), -1))
    names = pa.array([r["query_id"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        best, at = np.full((len(q), k), -np.inf), np.zeros((len(q), k), dtype=np.int64)
        norms = np.sqrt((q * q).sum(axis=1))
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(ids), -1)
            v_norms = np.sqrt((v * v).sum(axis=1))
            for lo in range(0, len(q), 256):
                score = (q[lo : lo + 256] @ v.T) / np.maximum(norms[lo : lo + 256, None] * v_norms[None], 1e-300)
                every = np.concatenate((best[lo : lo + 256], score), axis=1)
                place = np.concatenate((at[lo : lo + 256], np.broadcast_to(ids, score.shape)), axis=1)
                cut = np.partition(every, every.shape[1] - k, axis=1)[:, every.shape[1] - k]
                for r in range(len(every)):
                    near = np.flatnonzero(every[r] >= cut[r])
                    near = near[np.lexsort((place[r, near], -every[r, near]))][:k]
                    best[lo + r, : len(near)], at[lo + r, : len(near)] = every[r, near], place[r, near]
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(at[i, j]), pa.array(best[i, j])], names=["query_id", "vec_id", "score"])

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null")
    found = found.mapInArrow(run, f"query_id {id_type}, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").cast(vec_type).alias("vec_id"), "score")


def scoped_top_k(vectors: DataFrame, queries: DataFrame, scope: Column, k: int = 10) -> DataFrame:
    """top_k within a scope; queries that find nothing there search everywhere."""
    inside = top_k(vectors.filter(scope), queries, k).withColumn("scoped", F.lit(True))
    missed = queries.join(inside.select("query_id").distinct(), "query_id", "left_anti")
    return inside.unionByName(top_k(vectors, missed, k).withColumn("scoped", F.lit(False)))
