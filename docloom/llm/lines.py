"""Line dedup by content-defined chunks of lines.

Rolling hashes over WINDOW line hashes cut a document into chunks: one ends after a line whose value is less than that of the
line before and no more than that of the line after. Boundaries depend on nearby lines alone, so they come out alike wherever
a passage of lines stands, and no chunk but that of a one-line document has a single line. CHUNKINGS parts of the hash give as
many chunkings, each with boundaries of its own, so that a repeated passage whose edges fall into a chunk of one of them has
whole chunks in another. A chunk of two or more lines that the corpus holds more than once, compared byte by byte, stays where
it stands first (by id, then by place); all lines of it are removed elsewhere. A line is thus removed only where an equal line
stands earlier, so the first of its kind always stays. Hashes of all chunks are counted first; only the texts of chunks whose
hash repeats are moved, once, to the first one's.

Chunks without a character other than white space stay. Null text stays null and has no lines, an empty text has one empty
line and loses nothing, rows alike in id and text count as one document (each row is returned), and an empty table gives an
empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, maybe_broadcast

WINDOW, CHUNKINGS, MIN_LINES = 2, 6, 2
#: Hexadecimal digits of the rolling hash that each chunking takes.
DIGITS = 3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(lines: Column, window: int, chunkings: int, min_lines: int) -> Column:
    """The different chunks of all chunkings: an array of (first line from 0, number of lines)."""

    def of_rolled(rolled: Column) -> Column:
        n = F.size(rolled)

        def of_digits(k: int) -> Column:
            def of_values(v: Column) -> Column:
                at = lambda i: F.element_at(v, i)
                least = lambda i: F.when(i.between(2, n - 2), (at(i) < at(i - 1)) & (at(i) <= at(i + 1))).otherwise(F.lit(False))
                ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | least(i))

                def spans(ended: Column) -> Column:
                    def span(end: Column, j: Column) -> Column:
                        first = F.when(j == 0, 0).otherwise(F.element_at(ended, F.greatest(j, F.lit(1))))
                        return F.struct(first.alias("first"), (end - first).alias("lines"))

                    return F.transform(ended, span)

                return bind(ends, spans)

            return bind(F.transform(rolled, lambda x: F.substring(x, 1 + DIGITS * k, DIGITS)), of_values)

        return F.filter(F.array_distinct(F.flatten(F.array(*(of_digits(k) for k in range(chunkings))))), lambda x: x["lines"] >= min_lines)

    def of_digests(digests: Column) -> Column:
        def roll(i: Column) -> Column:
            first = F.greatest(i - window + 1, F.lit(1))
            return F.md5(F.array_join(F.slice(digests, first, i - first + 1), ""))

        return bind(F.transform(F.sequence(F.lit(1), F.size(digests)), roll), of_rolled)

    return bind(F.transform(lines, F.md5), of_digests)


def chunks(text: Column, window: int = WINDOW, chunkings: int = CHUNKINGS, min_lines: int = MIN_LINES) -> Column:
    """The chunks of a text: an array of (first, lines, h: a hash of the lines)."""

    def of_lines(lines: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            one = lambda x: F.struct(x["first"].alias("first"), x["lines"].alias("lines"), F.xxhash64(F.slice(hashes, x["first"] + 1, x["lines"])).alias("h"))
            return F.transform(_spans(lines, window, chunkings, min_lines), one)

        return bind(F.transform(lines, lambda x: F.xxhash64(x)), of_hashes)

    return bind(F.split(text, "\n"), of_lines)


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("__dl_k1"), F.hash(F.col(text_col), F.col(id_col)).alias("__dl_k2")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunkings: int = CHUNKINGS, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with text_col less its repeated chunks, and the columns __dl_lines and __dl_removed (numbers of lines)."""
    keys = ["__dl_k1", "__dl_k2"]
    keyed = docs.select(*[F.col(c) for c in docs.columns], *_keys(id_col, text_col))
    each = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col), F.explode(chunks(F.col(text_col), window, chunkings, min_lines)).alias("c"))
    each = materialize(each.select("id", *keys, "c.*"), "chunks")
    place = F.struct("id", *keys, "first")
    twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).filter("n > 1").select("h", "kept")
    # Without texts up to here. Of each document only the chunks whose hash repeats are cut out and compared.
    found = each.join(twice, "h").select("id", *keys, F.struct("first", "lines", "h", place.eqNullSafe(F.col("kept")).alias("stays")).alias("w"))
    wanted = materialize(found.groupBy(*keys).agg(F.first("id").alias("id"), F.collect_set("w").alias("wanted")), "wanted")
    n, width = wanted.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("wanted")), F.lit(0))).first()
    texts = keyed.select(*keys, F.col(text_col).alias("text")).join(maybe_broadcast(wanted, n, 64 + 40 * int(width)), keys)

    def cut(lines: Column) -> Column:
        body = lambda w: F.array_join(F.slice(lines, w["first"] + 1, w["lines"]), "\n")
        return F.transform("wanted", lambda w: F.struct(w["first"].alias("first"), w["lines"].alias("lines"), w["h"].alias("h"), w["stays"].alias("stays"), body(w).alias("text")))

    seen = texts.select("id", *keys, F.explode(bind(F.split("text", "\n"), cut)).alias("c")).select("id", *keys, "c.*")
    seen = materialize(seen.filter(F.col("text").rlike("\\S")), "seen")
    first = seen.filter("stays").groupBy("h").agg(F.first("text").alias("first_text"))
    compared = seen.filter("not stays").join(first, "h", "left").withColumn("same", F.col("text").eqNullSafe(F.col("first_text")))
    compared = materialize(compared.select("id", *keys, "first", "lines", "h", "same", F.when(~F.col("same"), F.col("text")).alias("text")), "compared")
    gone = compared.filter("same").select(*keys, "first", "lines")
    others = compared.filter("not same")  # texts that share a hash with a different one: by themselves
    if others.limit(1).count():
        least = others.groupBy("h", "text").agg(F.min(place).alias("kept"))
        again = others.join(least, ["h", "text"]).filter(~place.eqNullSafe(F.col("kept")))
        gone = gone.unionByName(again.select(*keys, "first", "lines"))
    gone = gone.select(*keys, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("lines") - 1)).alias("line"))
    gone = materialize(gone.groupBy(*keys).agg(F.collect_set("line").alias("__dl_gone")), "removed")
    n, width = gone.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("__dl_gone")), F.lit(0))).first()
    keyed = keyed.join(maybe_broadcast(gone, n, 48 + 8 * int(width)), keys, "left")
    out = "__dl_out"

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dl_gone"))
        return F.struct(F.array_join(F.transform(kept, lambda i: lines[i]), "\n").alias("text"), F.size(lines).alias("lines"), F.size("__dl_gone").alias("removed"))

    whole = F.struct(F.col(text_col).alias("text"), F.size(F.split(text_col, "\n")).alias("lines"), F.lit(0).alias("removed"))
    done = keyed.withColumn(out, F.when(F.col("__dl_gone").isNull(), whole).otherwise(bind(F.split(F.col(text_col), "\n"), rest)))
    columns = [F.col(f"{out}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    removed = F.coalesce(F.col(f"{out}.removed"), F.lit(0))
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.col(f"{out}.lines"))
    return done.select(*columns, lines.cast("long").alias("__dl_lines"), removed.cast("long").alias("__dl_removed"))


#: The same for DuckDB over documents.
SQL = f"""
WITH lines AS (
  SELECT DISTINCT doc_id, md5(text) AS k, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), digests AS (SELECT *, list_transform(l, lambda x: md5(x)) AS d FROM lines),
rolled AS (
  SELECT *, list_transform(range(1, len(l) + 1), lambda i: md5(array_to_string(d[greatest(i - {WINDOW} + 1, 1):i], ''))) AS r FROM digests
), chunking AS (SELECT *, unnest(range(0, {CHUNKINGS})) AS c FROM rolled),
valued AS (SELECT doc_id, k, l, list_transform(r, lambda x: substr(x, 1 + {DIGITS} * c, {DIGITS})) AS v FROM chunking),
cuts AS (
  SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (i >= 2 AND i <= len(l) - 2 AND v[i] < v[i - 1] AND v[i] <= v[i + 1])) AS e FROM valued
), each AS (
  SELECT doc_id, k, l, e, unnest(range(1, len(e) + 1)) AS c FROM cuts
), span AS (
  SELECT DISTINCT doc_id, k, CASE WHEN c = 1 THEN 0 ELSE e[c - 1] END AS first, e[c] AS last FROM each
), part AS (
  SELECT doc_id, k, first, last, array_to_string(l[first + 1:last], chr(10)) AS t FROM span JOIN lines USING (doc_id, k) WHERE last - first >= {MIN_LINES}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, k, first) > 1 AS gone FROM part WHERE regexp_matches(t, '[^\t\n\f\r\x0B ]')
), removed AS (
  SELECT doc_id, k, list_distinct(flatten(list(range(first, last)))) AS g FROM ranked WHERE gone GROUP BY doc_id, k
)
SELECT documents.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  CASE WHEN g IS NULL THEN text ELSE
    array_to_string(list_transform(list_filter(range(0, len(string_split(text, chr(10)))), lambda i: NOT list_contains(g, i)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)) END AS text
FROM documents LEFT JOIN removed ON removed.doc_id = documents.doc_id AND removed.k = md5(documents.text)
"""
