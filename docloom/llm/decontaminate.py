"""Benchmark decontamination by spaced-seed hashing.

Texts become words (lower case, runs of other characters than letters and digits part them). Fixed masks pick six of eight
neighbouring words and ignore the others, so a substituted word under an ignored place leaves the hash alone. With these two
masks, whatever two of 13 neighbouring words are substituted, some seed is untouched (the tests go through all cases). Seeds
of all documents are joined with those of the benchmark; each hit names a diagonal, on which the words of the document and of
the item are compared one by one. A document holds an item if on some diagonal, in some run of W words of the item (W: 13, or
all words of a shorter item), at least 0.8 W words agree.

Items with fewer than W words have masks of their own: where k words may be substituted, the item is cut into k + 2 blocks, of
which two at least are untouched, and each mask keeps two blocks. Where none may be, the mask is the whole item.

Items without a word, and null texts, match nothing. Rows alike in id and text are one document. Of several items with one id
the one with most words matched counts. An empty table gives an empty result. Only DataFrame functions are used. The seeds, the
items and the hits are broadcast where their bytes, counted, allow it, and shuffled otherwise.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, maybe_broadcast
from docloom.llm.lines import _keys, bind

SPAN = 8
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 6, 7))
WORDS, AGREE = 13, 0.8


def short_masks(n: int, agree: float = AGREE) -> set[tuple[int, ...]]:
    """Masks, each from its first kept word on, of which one at some place is untouched by any substitution that leaves agree * n of n words."""
    blocks = n - math.ceil(n * agree - 1e-9) + 2
    cuts = [n * b // blocks for b in range(blocks + 1)]
    kept = ([*range(cuts[a], cuts[a + 1]), *range(cuts[b], cuts[b + 1])] for a, b in itertools.combinations(range(blocks), 2))
    return {tuple(i - k[0] for i in k) for k in kept if k}


def word_hashes(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(clean, " "), lambda w: F.xxhash64(w)))


def seeds(words: Column, masks: tuple[tuple[int, ...], ...], span: int) -> Column:
    """Seed hashes of all places, mask after mask; the seed of mask m at place i is number m * places + i."""

    def of_words(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - span)
        seed = lambda m, mask: lambda i: F.xxhash64(F.lit(m), *(h[i + k] for k in mask))
        each = [F.transform(places, seed(m, mask)) for m, mask in enumerate(masks)]
        return F.when(F.size(h) < span, F.array().cast("array<bigint>")).otherwise(F.concat(*each))

    return bind(words, of_words)


def _seed_rows(texts: DataFrame, ids: list[str], masks: tuple, span: int) -> DataFrame:
    """A row per seed: ids, seed, place. texts: ids, words."""
    both = texts.select(*ids, (F.size("words") - span + 1).alias("places"), F.posexplode(seeds(F.col("words"), masks, span)).alias("number", "seed"))
    return both.select(*ids, "seed", (F.col("number") % F.col("places")).alias("place"))


def best_run(agree: Column, width: Column) -> Column:
    """The most 1s in any `width` neighbours of an array of 0 and 1."""

    def of(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: F.aggregate(F.slice(a, i, width), F.lit(0), lambda s, x: s + x))
        return F.array_max(sums)

    return bind(agree, of)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, agree: float = AGREE) -> DataFrame:
    """A row per document and item that it holds: __dl_k1, __dl_k2 (the document's key), id, item, matched, window."""
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text)).alias("words")).filter(F.size("words") > 0)
    items = materialize(items.select("item", F.xxhash64("item", "words").alias("item_key"), "words").dropDuplicates(["item_key"]), "items")
    # Short items: a plan for each span of their masks, so a few at most.
    least = max(words, SPAN)
    short = sorted(r[0] for r in items.select(F.size("words")).distinct().filter(F.size("words") < least).collect())
    by_span: dict[int, tuple[set, set]] = {}
    for n in short:
        for mask in short_masks(min(n, words), agree):
            masks, lengths = by_span.setdefault(mask[-1] + 1, (set(), set()))
            masks.add(mask)
            lengths.add(n)
    plans = [(MASKS, SPAN, items.filter(F.size("words") >= least)), *((tuple(sorted(m)), span, items.filter(F.size("words").isin(*n))) for span, (m, n) in sorted(by_span.items()))]
    keys = ["__dl_k1", "__dl_k2"]
    texts = docs.select(*_keys(id_col, text_col), word_hashes(F.col(text_col)).alias("words"))
    found = None
    for masks, span, part in plans:
        known = materialize(_seed_rows(part, ["item_key"], masks, span).withColumnRenamed("place", "item_place").distinct(), "seeds")
        hits = _seed_rows(texts, keys, masks, span).join(maybe_broadcast(known, known.count(), 40), "seed")
        hits = hits.select(*keys, "item_key", (F.col("place") - F.col("item_place")).alias("diagonal"))
        found = hits if found is None else found.unionByName(hits)
    found = materialize(found.distinct(), "hits")
    wanted = found.groupBy(*keys).agg(F.collect_list(F.struct("item_key", "diagonal")).alias("found"))
    wanted = materialize(wanted, "wanted")
    n_wanted, n_found = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    held = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col), F.col(text_col).alias("text")).join(maybe_broadcast(wanted, n_wanted, 56 + 32 * n_found // max(1, n_wanted)), keys)
    held = held.select("id", *keys, word_hashes(F.col("text")).alias("doc_words"), "found").select("id", *keys, "doc_words", F.explode("found").alias("f"))
    n_items, n_words = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    met = held.select("id", *keys, "doc_words", "f.item_key", "f.diagonal").join(maybe_broadcast(items, n_items, 64 + 8 * n_words // max(1, n_items)), "item_key")
    width = F.least(F.lit(words), F.size("words"))

    def same(w: Column, k: Column) -> Column:
        at = k + F.col("diagonal")
        inside = (at >= 0) & (at < F.size("doc_words"))
        return F.when(inside & (F.try_element_at("doc_words", F.greatest(at, F.lit(0)) + 1) == w), 1).otherwise(0)

    scored = met.select("id", *keys, "item", width.alias("window"), F.transform("words", same).alias("agree"))
    scored = scored.select("id", *keys, "item", "window", best_run(F.col("agree"), F.col("window")).alias("matched"))
    good = scored.filter(F.col("matched") >= F.ceil(F.col("window") * agree - 1e-9))
    best = good.groupBy("id", *keys, "item").agg(F.max(F.struct("matched", "window")).alias("best"))
    return best.select("id", *keys, "item", F.col("best.matched").cast("long").alias("matched"), F.col("best.window").cast("long").alias("window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """Pairs of a document and a benchmark item it holds: id, item, matched, window."""
    pairs = overlaps(docs, benchmark, id_col, item_col=item_col, **options)
    return pairs.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "window")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item."""
    bad = materialize(overlaps(docs, benchmark, id_col, text_col, **options).select("__dl_k1", "__dl_k2").distinct(), "contaminated")
    keyed = docs.select(*[F.col(c) for c in docs.columns], *_keys(id_col, text_col))
    return keyed.join(maybe_broadcast(bad, bad.count(), 40), ["__dl_k1", "__dl_k2"], "left_anti").select(*docs.columns)


def _sql() -> str:
    seed = lambda mask: " || '~' || ".join(f"w[i + {k + 1}]" for k in mask)
    unions = lambda table, ids, place: " UNION ALL ".join(f"SELECT {ids}, {m} AS m, i AS {place}, {seed(mask)} AS s FROM (SELECT *, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM {table} WHERE len(w) >= {SPAN})" for m, mask in enumerate(MASKS))
    clean = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
    return f"""
WITH d AS (SELECT doc_id, md5(text) AS k, {clean} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, w FROM (SELECT item_id, {clean} AS w FROM benchmark WHERE text IS NOT NULL) WHERE w <> ['']),
ds AS ({unions("d", "doc_id, k", "dp")}), bs AS ({unions("b", "item_id, w", "bp")}),
short AS (
  SELECT doc_id, k, item_id, w, unnest(range(1 - len(w), len(dw))) AS diagonal FROM (SELECT doc_id, k, item_id, b.w, d.w AS dw FROM d JOIN b ON len(b.w) < {WORDS})
), hit AS (
  SELECT DISTINCT doc_id, k, item_id, w, dp - bp AS diagonal FROM ds JOIN bs USING (m, s) UNION SELECT * FROM short
), agree AS (
  SELECT hit.doc_id, hit.k, item_id, least({WORDS}, len(hit.w)) AS width,
    list_transform(range(0, len(hit.w)), lambda i: CASE WHEN i + diagonal >= 0 AND d.w[i + diagonal + 1] = hit.w[i + 1] THEN 1 ELSE 0 END) AS a
  FROM hit JOIN d USING (doc_id, k)
), best AS (
  SELECT doc_id, k, item_id, width, list_max(list_transform(range(0, len(a) - width + 1), lambda i: list_sum(a[i + 1:i + width]))) AS matched FROM agree
)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, arg_max(width, (matched, width))::BIGINT AS "window" FROM best
WHERE matched >= ceil(width * {AGREE} - 1e-9) GROUP BY doc_id, k, item_id
"""


SQL = _sql()
