"""Page operators: profiles, votes, offsets, headings, layout, headers and footers, and stitched tables.

A page is a row keyed by (doc, page), pages counted from 1.
"""

from __future__ import annotations

import difflib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import extraction_score, printable_ratio, quality_grade, word_count

SKIPPED = ("BLANK", "TOC", "VECTOR_ONLY")


def page_profile(pages: DataFrame) -> DataFrame:
    """pages: doc, page, text, image_coverage, n_images, n_tables, n_fonts, n_widgets, multi_column. Adds n_words, n_chars, printable, page_type."""
    p = pages.withColumn("n_words", word_count(F.col("text"))).withColumn("n_chars", F.length("text")).withColumn("printable", printable_ratio(F.col("text")))
    return p.withColumn("page_type", preliminary_type())


def preliminary_type() -> Column:
    """The first that holds: next to no text and no image, an image with little text, form fields, a table, columns, text."""
    return (
        F.when((F.col("n_chars") < 10) & (F.col("n_images") == 0), "BLANK")
        .when((F.col("n_chars") < 50) & (F.col("image_coverage") > 0.7), "SCANNED")
        .when(F.col("n_widgets") > 0, "FORM")
        .when(F.col("n_tables") >= 1, "TABLE_HEAVY")
        .when(F.col("multi_column"), "MIXED")
        .otherwise("TEXT")
    )


def page_vote(profile: DataFrame) -> DataFrame:
    """A class and confidence for each page; null class: borderline. Skippable pages (vote skip, 1.0) take no part.

    Tables, columns and form fields are signals of a complex page; two of the three text signals, or of their opposites, make a
    page text_native or scanned.
    """
    count = lambda *signals: sum((c.cast("int") for c in signals[1:]), signals[0].cast("int"))
    skipped = F.col("page_type").isin(*SKIPPED)
    n_complex = count(F.col("n_tables") >= 1, F.col("multi_column"), F.col("n_widgets") > 0)
    text = count(F.col("n_chars") >= 200, F.col("image_coverage") < 0.3, F.col("n_fonts") >= 1)
    scan = count(F.col("n_chars") < 50, F.col("image_coverage") > 0.7, F.col("n_fonts") == 0)
    sure = lambda yes: F.when(yes, 0.9).otherwise(0.7)
    kind = F.when(skipped, "skip").when(n_complex > 0, "complex").when(text >= 2, "text_native").when(scan >= 2, "scanned")
    confidence = F.when(skipped, 1.0).when(n_complex > 0, sure(n_complex >= 2)).when(text >= 2, sure(text == 3)).when(scan >= 2, sure(scan == 3)).otherwise(0.0)
    return profile.withColumn("vote", kind).withColumn("vote_confidence", confidence)


def document_vote(votes: DataFrame) -> DataFrame:
    """Pages that agree give their class and least confidence, those that don't make a document complex.

    A borderline page, or skippable pages alone, leave it open: complex with confidence 0.
    """
    real = F.coalesce("vote", F.lit("")) != "skip"
    g = votes.groupBy("doc").agg(
        F.count_if(F.col("vote").isNull()).alias("open"),
        F.count_if(real).alias("n"),
        F.count_distinct(F.when(real, F.col("vote"))).alias("kinds"),
        F.min(F.when(real, F.col("vote"))).alias("one"),
        F.min(F.when(real, F.col("vote_confidence"))).alias("least"),
    )
    undecided = (F.col("open") > 0) | (F.col("n") == 0)
    kind = F.when(~undecided & (F.col("kinds") == 1), F.col("one")).otherwise("complex")
    confidence = F.when(undecided, 0.0).when(F.col("kinds") == 1, F.col("least")).otherwise(0.9)
    return g.select("doc", kind.alias("pdf_type"), confidence.alias("confidence"))


def escalate(rule: DataFrame, accept: float = 0.8) -> DataFrame:
    """The tier that a rule's result goes on to: accepted by rule, or a language model's turn."""
    return rule.withColumn("tier", F.when(F.col("confidence") >= accept, "rule_based").otherwise("llm_basic"))


def type_distribution(profile: DataFrame) -> DataFrame:
    return profile.groupBy("doc", "page_type").count()


def document_quality(profile: DataFrame) -> DataFrame:
    """Coverage (pages with text), mean printable share, words per page with text, score and grade."""
    with_text = F.count_if(F.col("n_words") > 0)
    g = profile.groupBy("doc").agg(
        (with_text / F.count(F.lit(1))).alias("coverage"),
        F.avg("printable").alias("printable"),
        (F.sum("n_words") / F.greatest(with_text, F.lit(1))).alias("words_per_page"),
    )
    scored = g.withColumn("score", extraction_score(F.col("coverage"), F.col("printable"), F.col("words_per_page")))
    return scored.withColumn("grade", quality_grade(F.col("score")))


def page_offsets(pages: DataFrame, glue: int = 1) -> DataFrame:
    """Where each page starts in the text of its document; glue: characters between pages."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.length("text") + glue).over(before), F.lit(0)).cast("long"))


def diverse_pages(profile: DataFrame, most: int = 10) -> DataFrame:
    """At most `most` pages of a document: the first of each type, then the first others."""
    first = F.row_number().over(Window.partitionBy("doc", "page_type").orderBy("page")) > 1
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("later", "page"))
    return profile.withColumn("later", first).withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("later", "__rank")


def even_places(n: Column, k: int) -> Column:
    """k of the places 1 to n, spread evenly; halves round to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int") + 1)


def even_pages(pages: DataFrame, k: int = 5) -> DataFrame:
    """k pages spread evenly over a document (all of a shorter one); halves round to even."""
    n = pages.groupBy("doc").agg(F.max("page").alias("n"))
    chosen = n.select("doc", F.explode(F.when(F.col("n") <= k, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array_distinct(even_places(F.col("n"), k)))).alias("page"))
    return pages.join(chosen, ["doc", "page"], "left_semi")


def ocr_pages(profile: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """The pages that OCR reads: those of an explicit list, or all that aren't skippable."""
    return profile.filter(F.col("page").isin(chosen) if chosen is not None else ~F.col("page_type").isin(*SKIPPED))


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], value: str, default: int = 0) -> DataFrame:
    """rows with a value looked up by keys, `default` where there is none (pages of fields, offsets of headings)."""
    kind = dict(known.dtypes)[value]
    return rows.join(known.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default).cast(kind)))


def ocr_rollup(results: DataFrame, low: float = 0.7) -> DataFrame:
    """results: doc, page, confidence."""
    return results.groupBy("doc").agg(F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("confidence") < low).alias("low_pages"), F.array_sort(F.collect_list(F.when(F.col("confidence") < low, F.col("page")))).alias("low_page_numbers"))


def words_to_pages(words: DataFrame) -> DataFrame:
    """OCR words (doc, page, place, word, confidence 0 to 100, -1: none) as page texts with mean confidence.

    Words may come a page a row, too: doc, page, words (an array of place, word, confidence); nothing is shuffled then.
    """
    if "words" not in words.columns:
        words = words.filter("confidence >= 0 and trim(word) <> ''").groupBy("doc", "page").agg(F.collect_list(F.struct("place", "word", "confidence")).alias("words"))
    # What an explode gives isn't computed again where it is used.
    kept = words.select("doc", "page", F.explode(F.array(F.array_sort(F.filter("words", lambda x: (x["confidence"] >= 0) & (F.trim(x["word"]) != ""))))).alias("kept")).filter(F.size("kept") > 0)
    total = F.aggregate("kept", F.lit(0.0), lambda s, x: s + x["confidence"])
    return kept.select("doc", "page", F.array_join(F.transform("kept", lambda x: x["word"]), " ").alias("text"), (total / F.size("kept") / 100).alias("confidence"))


def merge_ocr(native: Column, ocr: Column, more: float = 1.2) -> Column:
    """A mixed page's text, with what OCR read added if it has many more words."""
    return F.when(word_count(ocr) > more * word_count(native), F.concat(native, F.lit("\n"), ocr)).otherwise(native)


def chunk_confidence(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """chunks: doc, chunk_index, pages (array). Mean OCR confidence over each chunk's pages."""
    each = chunks.select("doc", "chunk_index", F.explode("pages").alias("page")).join(results, ["doc", "page"])
    return each.groupBy("doc", "chunk_index").agg(F.avg("confidence").alias("confidence"))


def body_size(spans: DataFrame) -> DataFrame:
    """The font size with most characters; ties: the one seen first. spans: doc, place, size, text."""
    sizes = spans.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("place").alias("first"))
    return sizes.groupBy("doc").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body_size"))


def heading_levels(headings: DataFrame) -> DataFrame:
    """Larger sizes are higher levels, three at most."""
    return headings.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))), F.lit(3)))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Spans of one page that follow each other at about the same height (2) and size (0.5) become one heading."""
    by_place = Window.partitionBy("doc", "page").orderBy("place")
    new = (F.abs(F.col("y") - F.lag("y").over(by_place)) > 2) | (F.abs(F.col("size") - F.lag("size").over(by_place)) >= 0.5) | F.lag("y").over(by_place).isNull()
    grouped = spans.withColumn("part", F.sum(new.cast("int")).over(by_place))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    return grouped.groupBy("doc", "page", "part").agg(text.alias("text"), F.min_by("y", "place").alias("y"), F.min_by("size", "place").alias("size"))


def columns_of_page(blocks: DataFrame, gap: float = 0.10, full: float = 0.75, most: int = 3, least: int = 2) -> DataFrame:
    """Clusters of blocks' left edges, split at gaps over `gap` of the width; clusters under `least` blocks don't count.

    blocks: doc, page, place, x0, x1, y0, width. Result: doc, page, column_no, left, right, middle.
    """
    narrow = blocks.filter((F.col("x1") - F.col("x0")) < full * F.col("width"))
    by_x = Window.partitionBy("doc", "page").orderBy("x0", "place")
    split = narrow.withColumn("part", F.sum(F.coalesce(((F.col("x0") - F.lag("x0").over(by_x)) > gap * F.col("width")).cast("int"), F.lit(0))).over(by_x))
    clusters = split.groupBy("doc", "page", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("left"), F.max("x1").alias("right")).filter(F.col("n") >= least)
    ranked = clusters.withColumn("column_no", F.row_number().over(Window.partitionBy("doc", "page").orderBy("left")))
    return ranked.filter(F.col("column_no") <= most).select("doc", "page", "column_no", "left", "right", ((F.col("left") + F.col("right")) / 2).alias("middle"))


def reading_order(blocks: DataFrame, columns: DataFrame | None = None, full: float = 0.75) -> DataFrame:
    """Full-width blocks first from the top, then column by column; a block is in the column with the nearest middle.

    columns: as columns_of_page gives them; without, they are found on the way, and the blocks are read once and not joined.
    """
    middle = (F.col("x0") + F.col("x1")) / 2
    if columns is None:
        met = with_columns(blocks)
    else:
        met = blocks.join(columns.groupBy("doc", "page").agg(F.collect_list(F.struct("column_no", "middle")).alias("cols")), ["doc", "page"], "left")
    met = met.withColumn("is_full", (F.col("x1") - F.col("x0")) >= full * F.col("width"))
    nearest = F.array_min(F.transform("cols", lambda c: F.struct(F.abs(c["middle"] - middle).alias("d"), c["column_no"].alias("column_no"))))["column_no"]
    placed = met.withColumn("column_no", F.when(F.col("is_full"), 0).otherwise(F.coalesce(nearest, F.lit(1)))).drop("cols")
    order = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("is_full"), "column_no", "y0", "place"))
    return placed.withColumn("reading_order", order)


def with_columns(blocks: DataFrame, gap: float = 0.10, full: float = 0.75, most: int = 3, least: int = 2) -> DataFrame:
    """blocks with `cols`, the columns of their page (an array of column_no and middle), by windows alone; columns_of_page has the rules."""
    narrow = F.coalesce((F.col("x1") - F.col("x0")) < full * F.col("width"), F.lit(False))
    page, kind = Window.partitionBy("doc", "page"), Window.partitionBy("doc", "page", "__narrow")
    by_x = kind.orderBy("x0", "place")
    far = F.coalesce(((F.col("x0") - F.lag("x0").over(by_x)) > gap * F.col("width")).cast("int"), F.lit(0))
    upto = by_x.rowsBetween(Window.unboundedPreceding, 0)
    split = blocks.withColumn("__narrow", narrow).withColumn("__far", far).withColumn("__part", F.sum("__far").over(upto))
    of_part = Window.partitionBy("doc", "page", "__narrow", "__part")
    counted = split.withColumn("__n", F.count(F.lit(1)).over(of_part)).withColumn("__left", F.min("x0").over(of_part)).withColumn("__right", F.max("x1").over(of_part))
    clusters = F.collect_set(F.when(F.col("__narrow") & (F.col("__n") >= least), F.struct("__left", "__right"))).over(page)
    cols = F.transform(F.slice(F.array_sort(clusters), 1, most), lambda c, i: F.struct((i + 1).alias("column_no"), ((c["__left"] + c["__right"]) / 2).alias("middle")))
    return counted.withColumn("cols", cols).drop("__narrow", "__far", "__part", "__n", "__left", "__right")


def common_length(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence; masks: the places of each character in the other text, n: its length."""
    full = (1 << n) - 1
    rest = full
    for c in text:
        both = rest & masks.get(c, 0)
        rest = ((rest + both) | (rest - both)) & full
    return n - rest.bit_count()


class Alike:
    """Whether the matching-blocks ratio of a text and a fixed one is at least `ratio`; what bounds say can't be isn't matched."""

    def __init__(self, known: str, ratio: float):
        self.ratio, self.n = ratio, len(known)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(known):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.matcher = difflib.SequenceMatcher(None, "", known)

    def __call__(self, text: str) -> bool:
        total = len(text) + self.n
        if total and (2.0 * min(len(text), self.n) / total < self.ratio or 2.0 * common_length(self.masks, self.n, text) / total < self.ratio):
            return False
        self.matcher.set_seq1(text)
        return self.matcher.ratio() >= self.ratio


def near_length(a: Column, b: Column, ratio: float) -> Column:
    """Whether two texts' lengths leave a ratio possible."""
    total = F.length(a) + F.length(b)
    return (total == 0) | (2.0 * F.least(F.length(a), F.length(b)) / F.greatest(total, F.lit(1)) >= ratio)


def repeated_zones(zones: DataFrame, ratio: float = 0.7, samples: int = 5) -> DataFrame:
    """Header and footer texts that come back on nearly all of a document's sampled pages. zones: doc, page, zone, text.

    A document is sampled evenly: `samples` pages, so at most samples squared pairs of texts of a zone are compared.
    """

    @F.pandas_udf("array<struct<zone:string,text:string>>")
    def repeated(batch: pd.Series) -> pd.Series:
        def one(sample) -> list[dict]:
            n, others = len({x["page"] for x in sample}), {}
            for b in sample:
                alike = Alike(b["text"], ratio) if b["text"] is not None else None
                for a in sample:
                    if alike and a["text"] is not None and a["zone"] == b["zone"] and a["page"] != b["page"] and alike(a["text"]):
                        others.setdefault((a["zone"], a["text"]), set()).add(b["page"])
            return [{"zone": z, "text": t} for (z, t), pages in others.items() if len(pages) + 1 >= max(n - 1, 1)]

        return batch.map(one)

    by_doc = Window.partitionBy("doc")
    numbered = zones.filter("doc is not null").withColumn("__at", F.dense_rank().over(by_doc.orderBy("page"))).withColumn("__n", F.max("__at").over(by_doc))
    chosen = (F.col("__n") <= samples) | F.array_contains(even_places(F.col("__n"), samples), F.col("__at"))
    sampled = numbered.filter(chosen).groupBy("doc").agg(F.collect_list(F.struct(F.col("zone").cast("string").alias("zone"), F.col("__at").alias("page"), "text")).alias("sample"))
    return sampled.select("doc", F.explode(repeated("sample")).alias("x")).select("doc", "x.zone", "x.text")


def strip_lines(pages: DataFrame, patterns: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Pages less the lines that are like a pattern of their document.

    Only lines as long as a pattern can be like are sent to Python; the texts are cut where they are.
    """

    @F.pandas_udf("array<array<boolean>>")
    def like(lines: pd.Series, known: pd.Series) -> pd.Series:
        before, matchers, out = None, [], []
        for some, own in zip(lines, known):
            if some is None or own is None:
                out.append([[]])
                continue
            if before is None or before != list(own):
                before = list(own)
                matchers = [Alike(p, ratio) for p in before]
            out.append([[t is not None and any(m(t) for m in matchers) for t in some]])
        return pd.Series(out, dtype=object)

    known = patterns.groupBy("doc").agg(F.collect_set(F.trim("text")).alias("__known"))
    met = pages.join(known, "doc", "left").withColumn("__lines", F.split("text", "\n"))
    near = F.transform("__lines", lambda t: F.when(F.exists("__known", lambda p: near_length(F.trim(t), p, ratio)), F.trim(t)))
    # What an explode gives stays a column: neither the UDF nor its input may end up within a higher-order function.
    sent = met.select("*", F.explode(F.array(F.when(F.size("__known") > 0, near))).alias("__near"))
    found = sent.select(*pages.columns, "__lines", F.explode(like("__near", "__known")).alias("__gone"))
    kept = F.transform(F.filter(F.arrays_zip("__lines", "__gone"), lambda x: ~F.coalesce(x["__gone"], F.lit(False))), lambda x: x["__lines"])
    return found.withColumn("text", F.coalesce(F.array_join(kept, "\n"), F.lit(""))).select(pages.columns)


def stitch_tables(tables: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Numbers groups of tables that go on from page to page: adds continued and group_no. tables: doc, page, table_no, header (an array).

    A table continues the group before it if it is the first of the next page with tables, has as many columns as the group's
    first table, and a header that is like that table's (matching share of the two arrays). Whether a table goes on depends on where the
    group began, so a document's tables are walked in order, many documents a batch. Python gets one text per header, and compares
    two of them once; the tables themselves stay where they are.
    """

    @F.arrow_udf("array<struct<continued:boolean,group_no:bigint>>")
    def walk(headers: pa.Array, pages: pa.Array) -> pa.Array:
        sizes = headers.value_lengths().to_pylist()
        known = headers.flatten().dictionary_encode(null_encoding="encode")
        names = [[] if k is None else json.loads(k) for k in known.dictionary.to_pylist()]
        codes, at = known.indices.to_pylist(), pages.flatten().dictionary_encode(null_encoding="encode").indices.to_pylist()
        near: dict[tuple[int, int], bool] = {}

        def alike(a: list, b: list) -> bool:
            return len(a) == len(b) and (a == b or difflib.SequenceMatcher(None, a, b).ratio() >= threshold)

        continued, groups, i = [], [], 0
        for size in sizes:
            base, group = -1, 0
            for k in range(i, i + size):
                code, goes_on = codes[k], False
                if k > i and at[k] != at[k - 1]:
                    goes_on = near.get((base, code))
                    if goes_on is None:
                        goes_on = near[base, code] = alike(names[base], names[code])
                if not goes_on:
                    base, group = code, group + 1
                continued.append(goes_on)
                groups.append(group)
            i += size
        each = pa.StructArray.from_arrays([pa.array(continued, pa.bool_()), pa.array(groups, pa.int64())], names=["continued", "group_no"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), each)

    rest = [c for c in tables.columns if c not in ("doc", "page", "table_no")]
    placed = tables.filter("doc is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "table_no", F.to_json("header").alias("__key"), F.struct(*rest).alias("__rest")))).alias("t"))
    known = placed.withColumn("g", walk(F.col("t.__key"), F.col("t.page")))
    each = known.select("doc", F.explode(F.arrays_zip("t", "g")).alias("x"))
    return each.select("doc", "x.t.page", "x.t.table_no", *(F.col(f"x.t.__rest.`{c}`").alias(c) for c in rest), "x.g.continued", "x.g.group_no")


def stitched_rows(tables: DataFrame) -> DataFrame:
    """A row per group of stitch_tables: doc, group_no, pages, header, rows and n_tables. tables also has rows, an array of arrays.

    A continuation's first row goes where it repeats the header of the group's first table, white space and case aside.
    """
    same = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    grouped = tables.groupBy("doc", "group_no").agg(F.array_sort(F.collect_list(F.struct("page", "table_no", "header", "continued", "rows"))).alias("parts"))
    headed = grouped.withColumn("header", F.col("parts")[0]["header"])
    again = lambda x: x["continued"] & (F.size(x["rows"]) > 0) & F.coalesce(same(F.try_element_at(x["rows"], F.lit(1))) == same(F.col("header")), F.lit(False))
    cut = lambda x: F.when(again(x), F.slice(x["rows"], 2, F.greatest(F.size(x["rows"]) - 1, F.lit(0)))).otherwise(x["rows"])
    return headed.select("doc", "group_no", F.array_distinct(F.transform("parts", lambda x: x["page"])).alias("pages"), "header", F.flatten(F.transform("parts", cut)).alias("rows"), F.size("parts").cast("long").alias("n_tables"))


def widget_text(widgets: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The text of a page with form fields: its own text, and a block with a line per widget.

    widgets: doc, page, place, kind, name, value; pages: doc, page, text. Buttons are Yes or No, other widgets without a value
    (empty); signatures are left out, and a page with nothing else has no block.
    """
    marked = F.when(F.col("value").isin("Yes", "On", "/Yes", "/On"), "Yes").otherwise("No")
    value = F.when(F.col("kind").isin("checkbox", "radio"), marked).otherwise(F.coalesce(F.nullif("value", F.lit("")), F.lit("(empty)")))
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("(unnamed)"))
    lines = widgets.filter("kind <> 'signature'").withColumn("line", F.concat(name, F.lit(": "), value))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    blocks = lines.groupBy("doc", "page").agg(F.concat(F.lit("[Form Fields]\n"), body).alias("block"))
    if pages is None:
        return blocks.withColumnRenamed("block", "text")
    both = pages.select("doc", "page", F.nullif(F.trim("text"), F.lit("")).alias("text")).join(blocks, ["doc", "page"], "full")
    return both.select("doc", "page", F.concat_ws("\n", "text", "block").alias("text"))


def image_chunks(readings: DataFrame, least: int = 10) -> DataFrame:
    """Captions and OCR texts of images as chunks. readings: doc, caption, ocr (either may be null).

    A row per text that isn't empty: doc, method (caption, ocr), text, and W_CAPTION_SHORT for a caption under `least` characters.
    """
    both = readings.select("doc", F.explode(F.array(F.struct(F.lit("caption").alias("method"), F.trim("caption").alias("text")), F.struct(F.lit("ocr").alias("method"), F.trim("ocr").alias("text")))).alias("x")).select("doc", "x.*")
    short = (F.col("method") == "caption") & (F.length("text") < least)
    return both.filter("text <> ''").withColumn("warning", F.when(short, "W_CAPTION_SHORT"))
