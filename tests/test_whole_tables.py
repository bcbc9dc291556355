"""Queries that SQL can't say, over whole tables against plain Python."""

import hashlib
import html
import re

from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.plans import registry


def bare(text):
    return re.sub(r"[\s.#]+", "", text)


def test_heading_chunks_hold_each_text_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = docs.withColumn("text", F.regexp_replace("text", "(?m)^(\\w+)$", "## $1"))
    texts = {r["doc_id"]: r["text"] for r in marked.collect()}
    found = {}
    for r in chunking.heading_aware_chunks(marked, size=100, overlap=0).collect():
        found.setdefault(r["doc_id"], {})[r["chunk_index"]] = r
    for doc, text in texts.items():
        own = [found.get(doc, {})[k] for k in range(len(found.get(doc, {})))]
        assert bare("".join(c["chunk"] for c in own)) == bare(text)
        assert all(len(c["chunk"]) <= 400 or "|" in c["chunk"] for c in own)
        assert all(c["chunk_hash"] == hashlib.sha256(c["chunk"].encode()).hexdigest() and 0 <= c["start"] < c["end"] for c in own)
        assert [c["start"] for c in own] == sorted(c["start"] for c in own)


def test_heading_chunks_are_led_by_the_end_of_the_one_before(spark, sf_dir):
    plain, led = {}, {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for into, overlap in ((plain, 0), (led, 10)):
        for r in chunking.heading_aware_chunks(docs, size=100, overlap=overlap).collect():
            into.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["chunk"]
    assert plain.keys() == led.keys() and sum(len(c) for c in plain.values()) > 300
    for doc, chunks in plain.items():
        for k in range(1, len(chunks)):
            assert led[doc][k].endswith(chunks[k]) and bare(led[doc][k])[: -len(bare(chunks[k]))] in bare(chunks[k - 1] + " ")


def test_query_of_heading_chunks_has_each_document(spark, sf_dir):
    found = registry.queries()["h3_h7_heading_chunks"](spark, sf_dir).select("doc_id").distinct().count()
    assert found == spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text rlike '\\\\S'").count()


def test_parsed_html_of_all_pages(spark, sf_dir):
    def plain(source):
        text = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>", "", source)
        text = re.sub(r"(?i)<br\b[^>]*>|</?p\b[^>]*>", "\n", text)
        return html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", text)).split()

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = {r["page_id"]: r["text"] for r in registry.queries()["t9_html_text_parsed"](spark, sf_dir).collect()}
    assert found.keys() == pages.keys() and all(found[i].split() == plain(pages[i]) for i in pages)
