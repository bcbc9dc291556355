"""Removal of word windows that repeat across a corpus, and of spans that a reference holds.

Within a corpus (`remove_repeats`), a window of `window` words goes when its word sequence starts anywhere else. An automaton
of every shard, streamed over every document, would cost shards x documents, so the corpus is matched through anchors: the
anchor of a window is the least hash among its runs of ANCHOR words, and equal windows have equal anchors. Consecutive windows
with one anchor make a context. Contexts whose anchor is found once are unique; contexts that are found twice as a whole are
repeated in full; only contexts that share an anchor but differ are compared window by window. Counting is by map-side sums,
and an anchor with very many different contexts is counted window by window in a distributed aggregate, never in one task.
Windows are equal where 64 bits of hash are, and only windows with one anchor (another 64 bits, of the same eight words) are
compared: with 10,000 different windows at each of 10,000,000,000 anchors, 0.03 false equalities are to be expected.

Against a reference of bounded size (`remove_reference_spans`), suffix automata of its shards are broadcast and each document
is streamed through them for matching statistics: the longest match that ends at each word.

Null text has no words, an empty or short document loses nothing, repeated rows count as found elsewhere, and an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import gram_hashes, materialize, mix, row_slices, text_buffers, trimmed, words

WINDOW = 35
ANCHOR = 8
#: Different contexts of one anchor that one task compares; beyond that they are counted as separate windows.
HOT_CONTEXTS = 20_000
#: Words of one reference shard, and of a whole reference that may be broadcast.
SHARD_WORDS = 50_000
MAX_REFERENCE_WORDS = 2_000_000

_KEY = "__dl_k1 long, __dl_k2 int"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and 96 bits of hash that stand for both; rows alike in both share a result."""
    return docs.select(
        F.col(id_col).alias("__dl_id"),
        F.col(text_col).alias("__dl_text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("__dl_k1"),
        F.hash(F.col(text_col), F.col(id_col)).alias("__dl_k2"),
    )


def contexts(hashes: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of words with row offsets: each context's anchor, hash, first window, number of windows, and whether it holds its anchor twice."""
    none = tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    n = len(hashes)
    if n < window:
        return none
    k = min(ANCHOR, window)
    at = np.arange(n - k + 1)
    grams = least = gram_hashes(hashes, at, at + k)
    width, have = window - k + 1, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if width > have:
        least = np.minimum(least[: have - width], least[width - have :])
    valid = np.zeros(n - window + 2, dtype=np.int32)
    lengths = np.diff(rows)
    long = lengths >= window
    np.add.at(valid, rows[:-1][long], 1)
    np.add.at(valid, rows[1:][long] - window + 1, -1)
    valid = np.cumsum(valid)[: n - window + 1] > 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    close = valid.copy()
    close[:-1] &= ~valid[1:] | begin[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(close)
    if not len(first):
        return none
    # Windows of one context can be equal only where its anchor stands in it twice.
    n_windows = last - first + 1
    several = np.flatnonzero(n_windows > 1)
    lengths = n_windows[several] + width - 1
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(several)), lengths)
    places = np.arange(len(of)) - (ends - lengths)[of] + first[several][of]
    again = np.zeros(len(first), dtype=bool)
    again[several] = np.bincount(of[grams[places] == least[first[several]][of]], minlength=len(several)) > 1
    return least[first], gram_hashes(hashes, first, last + window), first, n_windows, again


def _contexts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for lo, hi in row_slices(offsets):
                hashes, _, _, rows = words(data, offsets[lo : hi + 1])
                anchor, ctx, first, n, again = contexts(hashes, rows, window)
                doc = np.searchsorted(rows, first, side="right") - 1
                keys = [batch.column(c).slice(lo, hi - lo).take(pa.array(doc)) for c in (1, 2)]
                columns = [anchor.view(np.int64), ctx.view(np.int64), (first - rows[doc]).astype(np.int32), n.astype(np.int32), again]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], names=["__dl_k1", "__dl_k2", "anchor", "ctx", "first", "n", "again"])

    return run


def _windows(window: int):
    """For the contexts asked for of each document, the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("__dl_text"))
            wanted = batch.column("wanted")
            at = np.asarray(wanted.offsets)
            asked = {c: wanted.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "first", "n", "c", "hot")}
            at = at - at[0]
            for lo, hi in row_slices(offsets):
                hashes, _, _, rows = words(data, offsets[lo : hi + 1])
                part = slice(int(at[lo]), int(at[hi]))
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                first, n = asked["first"][part].astype(np.int64) + rows[doc], asked["n"][part].astype(np.int64)
                ends = np.cumsum(n)
                starts = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first, n)
                hashed = mix(gram_hashes(hashes, starts, starts + window), 7)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], ends * 8)).astype(np.int32)), pa.py_buffer(hashed)])
                keys = [batch.column(c).slice(lo, hi - lo).take(pa.array(doc)) for c in ("__dl_k1", "__dl_k2")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *(pa.array(asked[c][part]) for c in ("anchor", "first", "c", "hot")), blob], names=["__dl_k1", "__dl_k2", "anchor", "first", "c", "hot", "windows"]
                )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of anchor: for contexts found once, the windows that another context of their anchor has too."""
    fields, rest = ["__dl_k1", "__dl_k2", "anchor", "first", "c", "windows"], None

    def judge(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        k1, k2, anchor, first, c = (rows.column(x).to_numpy() for x in fields[:5])
        blob = rows.column("windows").combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        ends = np.frombuffer(blob.buffers()[1], dtype=np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64) // 8
        hashed = np.frombuffer(blob.buffers()[2], dtype=np.uint64)[ends[0] : ends[-1]]
        n, ends = np.diff(ends), ends - ends[0]
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashed, anchor[of]))
        a, h = anchor[of][order], hashed[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        found = np.bincount(group, weights=c[of][order])
        repeated = np.zeros(len(h), dtype=bool)
        repeated[order] = found[group] >= 2
        repeated &= c[of] == 1
        begin, close = repeated.copy(), repeated.copy()
        edge = np.zeros(len(h), dtype=bool)
        edge[ends[:-1][n > 0]] = True
        begin[1:] &= ~repeated[:-1] | edge[1:]
        close[:-1] &= ~repeated[1:] | edge[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(close)
        i = of[s]
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[i]), pa.array(k2[i]), pa.array((first[i] + s - ends[i]).astype(np.int32)), pa.array((e - s + 1).astype(np.int32))], names=["__dl_k1", "__dl_k2", "first", "n"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(fields)
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        anchors = rows.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on in the next batch
        if cut:
            yield judge(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield judge(rest)


def repeated_spans(keyed: DataFrame, window: int = WINDOW, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """The repeated windows of keyed documents: rows (__dl_k1, __dl_k2, first, n), n windows from word `first` on."""
    found = keyed.select("__dl_text", "__dl_k1", "__dl_k2").mapInArrow(trimmed(_contexts(window)), f"{_KEY}, anchor long, ctx long, first int, n int, again boolean")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("found"), F.max("again").alias("again"))
    anchors = materialize(anchors.filter("found > 1 or again").select("anchor"), "anchors")
    shared = materialize(found.join(anchors, "anchor"), "contexts")
    distinct = shared.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again"), F.min(F.struct("__dl_k1", "__dl_k2", "first", "n")).alias("at"))
    distinct = materialize(distinct, "distinct")
    full = shared.join(distinct.filter("c > 1").select("anchor", "ctx"), ["anchor", "ctx"]).select("__dl_k1", "__dl_k2", "first", "n")
    mixed = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("forms"), F.min("c").alias("least"), F.max("again").alias("self")).filter("least = 1 and (forms > 1 or self)")
    open_ = materialize(distinct.join(mixed, "anchor").select("anchor", F.least("c", F.lit(2)).alias("c"), "forms", "at.*"), "open")
    hot = (F.col("forms") > hot_contexts).alias("hot")
    wanted = open_.select("*", hot).groupBy("__dl_k1", "__dl_k2").agg(F.collect_list(F.struct("anchor", "first", "n", "c", "hot")).alias("wanted"))
    texts = keyed.select("__dl_text", "__dl_k1", "__dl_k2").join(wanted, ["__dl_k1", "__dl_k2"])
    # Rows alike in id and text give the same context twice; its count says so already.
    hashed = texts.dropDuplicates(["__dl_k1", "__dl_k2"]).mapInArrow(trimmed(_windows(window)), f"{_KEY}, anchor long, first int, c long, hot boolean, windows binary")
    # Written, so that the texts are joined once for both ways of comparing, and their shuffle files are gone before the next.
    hashed = materialize(hashed, "windows")
    partial = hashed.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    # Written by itself, so that the shuffled windows are gone before the spans of all documents are put together.
    spans = materialize(partial.mapInArrow(trimmed(_compare), f"{_KEY}, first int, n int"), "partial")
    result = full.unionByName(spans)
    heavy = hashed.filter("hot")
    if heavy.limit(1).count():
        count = F.expr("length(windows) div 8").cast("int")
        each = heavy.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
        each = each.select("__dl_k1", "__dl_k2", "anchor", "c", (F.col("first") + F.col("i")).alias("first"), F.expr("substring(windows, i * 8 + 1, 8)").alias("hash"))
        twice = each.groupBy("anchor", "hash").agg(F.sum("c").alias("found")).filter("found > 1").select("anchor", "hash")
        once = each.filter("c = 1").join(twice, ["anchor", "hash"]).select("__dl_k1", "__dl_k2", "first", F.lit(1).alias("n"))
        result = result.unionByName(once)
    return result


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("__dl_text"))
            spans = batch.column("spans")
            at = np.asarray(spans.offsets)
            at = at - at[0]
            flat = spans.flatten()
            first, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "n"))
            counts, removed, digests, kept = [], [], [], []
            for lo, hi in row_slices(offsets):
                _, begins, ends, rows = words(data, offsets[lo : hi + 1])
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                s = first[at[lo] : at[hi]] + rows[doc]
                e = s + n[at[lo] : at[hi]] + window - 1
                cover = np.zeros(len(begins) + 1, dtype=np.int64)
                np.add.at(cover, s, 1)
                np.add.at(cover, e, -1)
                keep = np.cumsum(cover)[:-1] == 0
                counts.append(np.diff(rows))
                removed.append(np.diff(np.concatenate(([0], np.cumsum(~keep)))[rows]))
                base, size = int(offsets[lo]), int(offsets[hi] - offsets[lo])
                # Bytes of kept words, and one space after each; the space after a row's last word is cut off below.
                mark = np.zeros(size + 2, dtype=np.int8)
                np.add.at(mark, begins[keep] - base, 1)
                within = (ends < offsets[lo + 1 : hi + 1][np.repeat(np.arange(hi - lo), np.diff(rows))])[keep]
                np.add.at(mark, ends[keep] - base + within, -1)
                inside = np.cumsum(mark[: size + 1], dtype=np.int8) > 0
                out = data[base : base + size].copy()
                out[ends[keep][within] - base] = 0x20
                after = np.concatenate(([0], np.cumsum(inside[:size])))[offsets[lo : hi + 1] - base]
                taken = out[inside[:size]]
                for i in range(hi - lo):
                    text = taken[after[i] : after[i + 1]].tobytes().rstrip(b" ")
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
            join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64)) if parts else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__dl_id"), join(counts), join(removed), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["__dl_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS, with_text: bool = True) -> DataFrame:
    """A row per document: id, n_words, n_removed, kept_sha256 and, with_text, kept_text (kept words joined by a space)."""
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, window, hot_contexts)
    by_doc = spans.groupBy("__dl_k1", "__dl_k2").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    by_doc = materialize(by_doc, "spans")
    joined = keyed.join(by_doc, ["__dl_k1", "__dl_k2"], "left").select("__dl_id", "__dl_text", F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,n:int>>)")).alias("spans"))
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = joined.mapInArrow(trimmed(_keep(window)), f"__dl_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return kept.select(F.col("__dl_id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


class SuffixAutomaton:
    """All substrings of a sequence of words, for the longest match that ends at each word of another sequence."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, word) -> None:
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[self.last] + 1)
        p = self.last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[p] + 1 == self.length[q]:
                self.link[new] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.link.append(self.link[q])
                self.length.append(self.length[p] + 1)
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
        self.last = new

    def add(self, sequence) -> None:
        """Adds a text of its own: nothing matches across texts."""
        for word in sequence:
            self.extend(word)
        self.extend(object())  # equals no word

    def matching_statistics(self, sequence) -> list[int]:
        state, length, out = 0, 0, []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append(length)
        return out


def reference_shards(texts: list[str | None], shard_words: int = SHARD_WORDS, max_words: int = MAX_REFERENCE_WORDS) -> list[list[list[str]]]:
    """Word lists of the texts in shards of about shard_words; a reference over max_words is refused, as it couldn't be broadcast."""
    shards, size, total = [[]], 0, 0
    for text in texts:
        found = _split(text)
        total += len(found)
        if total > max_words:
            raise ValueError(f"the reference has more than {max_words} words; find repeats within the corpus instead")
        if size and size + len(found) > shard_words:
            shards.append([])
            size = 0
        shards[-1].append(found)
        size += len(found)
    return shards


def _split(text: str | None) -> list[str]:
    return [w for w in (text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]


def remove_reference_spans(docs: DataFrame, reference: DataFrame, min_words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_REFERENCE_WORDS) -> DataFrame:
    """Removes from docs the maximal spans of min_words or more words that a reference of bounded size holds too.

    The size of the reference is checked before it is brought to the driver. A row per document: id, n_words, n_removed,
    kept_text.
    """
    spark = docs.sparkSession
    size = reference.agg(F.sum(F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\t-\\r]+"))).alias("n")).first()["n"] or 0
    if size > 2 * max_words:
        raise ValueError(f"the reference has about {size} words; at most {max_words} can be broadcast")
    shards = spark.sparkContext.broadcast(reference_shards([r[0] for r in reference.select(text_col).collect()], max_words=max_words))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in shards.value:
            automaton = SuffixAutomaton()
            for text in shard:
                automaton.add(text)
            automata.append(automaton)
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                found = _split(text)
                gone = np.zeros(len(found) + 1, dtype=np.int64)
                for automaton in automata:
                    for end, length in enumerate(automaton.matching_statistics(found)):
                        if length >= min_words:
                            gone[end + 1 - length] += 1
                            gone[end + 1] -= 1
                kept = np.cumsum(gone)[: len(found)] == 0
                out[0].append(len(found))
                out[1].append(int(len(found) - kept.sum()))
                out[2].append(" ".join(w for w, k in zip(found, kept, strict=True) if k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=[id_col, "n_words", "n_removed", "kept_text"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {id_type}, n_words long, n_removed long, kept_text string")
