"""Whole runs by format: scan, key, parse, chunk, embed, and a result record for each file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.ids import content_hash, ingest_key
from docloom.functions.text import fatal, merge_codes, warnings
from docloom.operators import chunking, models, stores
from docloom.sources import decode, files


@dataclass
class Processed:
    """chunks: uri, ingest_key, chunk_index, chunk, chunk_hash, id, vector, embed_error. results: a row per file, with ingest_key
    (empty if it was refused), errors, warnings, n_chunks, chunk_ids, dimension, and total and max_depth of what was parsed."""

    chunks: DataFrame
    results: DataFrame


def _parsed_json(text: Column) -> Column:
    f = decode.flattened(text)
    return F.struct(F.array_join(f["lines"], "\n").alias("text"), f["total_keys"].alias("total"), f["max_depth"].alias("max_depth"), f["truncated"].alias("truncated"), f["error"].alias("error"))


def _parsed_xml(text: Column) -> Column:
    x = decode.xml_lines(text)
    return F.struct(F.array_join(x["lines"], "\n").alias("text"), x["total_elements"].alias("total"), x["max_depth"].alias("max_depth"), x["truncated"].alias("truncated"), F.lit(None).cast("string").alias("error"))


def _parsed_html(text: Column) -> Column:
    return F.struct(decode.html_to_text(text).alias("text"), F.lit(0).alias("total"), F.lit(0).alias("max_depth"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"))


def _scan_text(text: Column, uri: Column) -> Column:
    return F.array_compact(F.array(F.when(text.isNull(), "E_PARSE_CORRUPT").when(F.length(text) == 0, "E_PARSE_EMPTY")))


#: What each format is scanned by, parsed by and chunked by.
FORMATS: dict[str, tuple[Callable, Callable, Callable]] = {
    "json": (files.scan_json, _parsed_json, chunking.line_chunks),
    "xml": (files.scan_xml, _parsed_xml, chunking.line_chunks),
    "html": (_scan_text, _parsed_html, chunking.paragraph_chunks),
}


def process(docs: DataFrame, kind: str, version: str = "1", tenant: str | None = None, make: Callable[[], models.Embedder] = models.HashingEmbedder, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, known: DataFrame | None = None) -> Processed:
    """Runs files (uri, text) of one format through all steps; a file that a step refuses has a result with its codes and no chunk.

    known: ingest keys of earlier runs, whose files are left out (W_ALREADY_INGESTED); null: nothing is.
    """
    scan, parse, chunk = FORMATS[kind]
    keyed = docs.select("uri", "text", scan(F.col("text"), F.col("uri")).alias("codes"))
    keyed = keyed.withColumn("ingest_key", F.when(F.size(fatal(F.col("codes"))) == 0, ingest_key(content_hash(F.col("text")), F.col("uri"), F.lit(version), F.lit(tenant))))
    keyed = keyed.withColumn("seen", F.lit(False)) if known is None else keyed.join(known.select("ingest_key").distinct().withColumn("seen", F.lit(True)), "ingest_key", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    parsed = keyed.withColumn("p", parse(F.when(F.col("ingest_key").isNotNull() & ~F.col("seen"), F.col("text"))))
    parsed = parsed.withColumn("p", F.when(F.col("ingest_key").isNotNull() & ~F.col("seen"), F.col("p")))
    more = F.array_compact(F.array(F.col("p.error"), F.when(F.col("p.truncated"), "W_TRUNCATED"), F.when(F.col("seen"), "W_ALREADY_INGESTED")))
    parsed = parsed.select("uri", "ingest_key", merge_codes(F.col("codes"), more).alias("codes"), F.col("p.text").alias("text"), F.col("p.total").alias("total"), F.col("p.max_depth").alias("max_depth"))
    chunks = chunking.with_ids(chunk(parsed.select("uri", "ingest_key", "text"), "text", size, overlap), "ingest_key")
    chunks = models.embed(chunks, make)
    made = chunks.groupBy("uri").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"]).alias("chunk_ids"),
        F.max(F.size("vector")).alias("dimension"),
        F.max("embed_error").alias("embed_error"),
    )
    met = parsed.drop("text").join(made, "uri", "left")
    codes = merge_codes(F.col("codes"), F.array_compact(F.array(F.col("embed_error"))))
    results = met.select(
        "uri", F.coalesce("ingest_key", F.lit("")).alias("ingest_key"), fatal(codes).alias("errors"), warnings(codes).alias("warnings"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.coalesce("dimension", F.lit(0)).alias("dimension"), "total", "max_depth",
    )
    return Processed(chunks, results)


def write(done: Processed, store: stores.ParquetStore, run_id: str, atomic: bool = False) -> stores.Written:
    """Chunks with a vector and the results of a run, by both sides or, atomic, by neither."""
    return stores.dual_write(store, done.chunks.filter("vector is not null"), done.results.withColumn("row_id", F.col("uri")), run_id, row_table="results", atomic=atomic)


def run_totals(results: DataFrame) -> DataFrame:
    """One row over a run's results: files, files with errors, chunks, and how often each code came.

    The results are read once: each file has a row without a code, which bears its numbers, and a row for each code.
    """
    codes = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.concat("errors", "warnings"), F.array().cast("array<string>")))
    each = results.select((F.size("errors") > 0).cast("long").alias("failed"), F.col("n_chunks").cast("long").alias("n_chunks"), F.explode(codes).alias("code"))
    counted = each.groupBy("code").agg(F.count(F.lit(1)).alias("count"), F.sum("failed").alias("failed"), F.sum("n_chunks").alias("chunks"))
    of_files = lambda name: F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col(name))), F.lit(0).cast("long"))
    entries = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "count"))))
    return counted.agg(of_files("count").alias("n_files"), of_files("failed").alias("n_failed"), of_files("chunks").alias("n_chunks"), F.map_from_entries(entries).alias("codes"))
