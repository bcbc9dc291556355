"""Near-duplicate classes by SimHash fingerprints and random bit sampling.

A text's shingles (five lower-cased words; all words of a shorter text) give a 256-bit SimHash. Each table samples coordinates
of the fingerprint and groups texts that agree in all of them. The number of coordinates follows the number of texts, so that
chance buckets keep their size, and the number of tables follows from it, so that a pair at the threshold meets in some table
with probability `recall` at every size. A bucket over the cap is split by additional coordinates, in as many independent ways
as keep that probability; what is still over the cap is compared block against block, so no task grows with a bucket.

Within a bucket all pairs are compared by Hamming distance, and those within the limit by a parity bitmap of their shingle
sets: the bits in which two bitmaps differ are at most the shingles in which the sets differ, so a pair beyond what the
similarity allows is left out without a loss. The pairs that remain are edges, kept as one star for each bucket, and only the
connected components of all stars are looked at from there on. The sets of a component come together in one task (a large
component in pairs of blocks), where all pairs of it are verified by exact Jaccard similarity, nearest first; a pair already
joined by verified links can't change the result and is passed over. Classes are the connected components of verified links.

Texts with equal shingle sets are one node from the start, so thousands of copies cost what one does. A null text, and one
without a word, is a class of its own (equal texts without words are one class); a class is named by its least id, nulls
aside; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column_slices, gram_hashes, materialize, maybe_broadcast, mix, text_buffers, trimmed, words

SHINGLE = 5
SIMILARITY = 0.8
BITS = 256
#: Texts that share a bucket by chance, and texts of a bucket from which it is split by additional coordinates.
BUCKET, CAP = 2048, 16_384
RECALL = 0.995
EXTRA_BITS = 4
#: Bits of a set's parity bitmap.
PARITY = 1024
#: A block's shingles, with NODE_MASS more for each of its sets: what one task verifies, or half of it.
BLOCK_MASS, NODE_MASS = 2_000_000, 400

_BYTE_SIGNS = (2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the offsets of the rows."""
    hashes, _, _, rows = words(data, offsets)
    n = np.diff(rows)
    starts = np.arange(len(hashes))
    row = np.repeat(np.arange(len(n)), n)
    left = rows[1:][row] - starts
    whole = left >= size
    short = (n[row] < size) & (starts == rows[:-1][row])
    grams = np.zeros(len(hashes), dtype=np.uint64)
    grams[whole] = gram_hashes(hashes, starts[whole], starts[whole] + size)
    grams[short] = gram_hashes(hashes, starts[short], rows[1:][row[short]])
    used = whole | short
    grams, row = grams[used], row[used]
    at = np.searchsorted(row, np.arange(len(n) + 1))
    parts = [np.unique(grams[at[i] : at[i + 1]]) for i in range(len(n))]
    return (np.concatenate(parts) if parts else grams), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def fingerprints(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash of each set: an array (sets, BITS // 64) of uint64."""
    n, row = len(at) - 1, np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.zeros((n, BITS // 8), dtype=np.uint8)
    base = row * 256
    for j in range(BITS // 64):
        bytes_ = mix(grams, j + 1).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            counts = np.bincount(base + bytes_[:, b], minlength=256 * n).reshape(n, 256)
            out[:, 8 * j + b] = np.packbits(counts @ _BYTE_SIGNS > 0, axis=1)[:, 0] if n else 0
    return out.view(np.uint64)


def parities(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The parity bitmap of each set: an array (sets, PARITY // 64) of uint64; a bit says if an odd number of shingles fall on it."""
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    place = (mix(grams, 77) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(row * PARITY + place, minlength=n * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, PARITY), axis=1).view(np.uint64)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about half a megabyte and 1024 rows at most, with their shingle sets."""
    for lo, hi in column_slices(column, 1 << 19, 1024):
        yield lo, hi, *shingle_sets(*text_buffers(column.slice(lo, hi - lo)))


def _blobs(rows: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * size, size or 1, dtype=np.int32)[: len(rows) + 1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, grams, at in _slices(batch.column(2)):
            prints = fingerprints(grams, at)
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams, 99))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    *(pa.array(prints[:, j].view(np.int64)) for j in range(4)),
                    pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                    pa.array(np.diff(at).astype(np.int32)),
                    _blobs(parities(grams, at)),
                ],
                names=["id", "text_key", "f0", "f1", "f2", "f3", "signature", "n", "parity"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, grams, at in _slices(batch.column(1)):
            blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(grams)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), blob], names=["node", "set"])


def agreement(similarity: float) -> float:
    """The chance that a fingerprint bit of two sets of this Jaccard similarity agrees."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(bits: int, similarity: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(agreement(similarity) ** bits))))


def max_distance(similarity: float, bits: int = BITS) -> int:
    """A Hamming distance that a pair at the threshold exceeds about once in 200,000 times (4.5 standard deviations)."""
    p = 1 - agreement(similarity)
    return math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def max_difference(sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: float) -> np.ndarray:
    """The most shingles in which two sets of these sizes may differ at that Jaccard similarity."""
    return (sizes_a.astype(np.float64) + sizes_b) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _coordinates(seed: int, bits: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(BITS, size=bits, replace=False)


def _bucket_key(seed: int, bits: int):
    """SQL for `bits` sampled coordinates as one long."""
    chosen = _coordinates(seed, bits)
    return sum((F.shiftleft(F.getbit(F.col(f"f{c // 64}"), F.lit(int(c % 64))).cast("long"), i) for i, c in enumerate(chosen)), F.lit(0).cast("long"))


def _masks(tables: int, bits: int) -> np.ndarray:
    """The sampled coordinates of each table as masks of the fingerprint's words."""
    out = np.zeros((tables, BITS // 64), dtype=np.uint64)
    for t in range(tables):
        for c in _coordinates(1000 + t, bits):
            out[t, c // 64] |= np.uint64(1) << np.uint64(c % 64)
    return out


def _near(prints: np.ndarray, half: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of fingerprints within the Hamming limit, block by block; where half is 0 and 1, pairs of both kinds only."""
    n, limit, first = len(prints), max_distance(similarity), max_distance(similarity, 64)
    two = bool(half.any())
    heads, step = np.ascontiguousarray(prints[:, 0]), max(1, (1 << 18) // max(1, n))
    for lo in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(heads[lo : lo + step, None] ^ heads[None, lo:]) <= first)
        later = i < j
        i, j = i[later] + lo, j[later] + lo
        if two:
            apart = half[i] != half[j]
            i, j = i[apart], j[apart]
        close = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= limit
        yield i[close], j[close]


def _prints(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(f"f{j}").to_numpy().view(np.uint64) for j in range(4)], axis=1)


def buckets(nodes: DataFrame, bits: int, tables: int, similarity: float, cap: int, recall: float) -> DataFrame:
    """A row per node and group that is compared at once: f0 to f3, t (the table), g (the group) and half."""
    prints = ["f0", "f1", "f2", "f3"]
    at = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), _bucket_key(1000 + t, bits).alias("g")) for t in range(tables))))
    rows = nodes.select(*prints, at.alias("at")).select(*prints, "at.t", "at.g")

    def split(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
        """rows of groups within the cap; those of others with their number, if there are any."""
        crowded = materialize(rows.groupBy("t", "g").count().filter(F.col("count") > cap), name)
        n = crowded.count()
        if not n:
            return rows, None
        return rows.join(maybe_broadcast(crowded, n, 40), ["t", "g"], "left_anti"), rows.join(maybe_broadcast(crowded, n, 40), ["t", "g"])

    rows, over = split(rows, "crowded")
    done = rows.withColumn("half", F.lit(0))
    if over is not None:
        ways = tables_for(EXTRA_BITS, similarity, recall)
        extra = F.explode(F.array(*(F.xxhash64("g", F.lit(w), _bucket_key(900_000 + w, EXTRA_BITS)) for w in range(ways))))
        rows, over = split(materialize(over.select(*prints, "t", extra.alias("g")), "split"), "overfull")
        done = done.unionByName(rows.withColumn("half", F.lit(0)))
    if over is not None:
        # Block a of a group meets every block b >= a.
        blocks = F.ceil(F.col("count") / (cap / 2)).cast("int")
        over = over.withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash(*prints, F.lit(5)), F.col("blocks")))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met = over.select(*prints, "t", "g", "own", other.alias("other"))
        g = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
        done = done.unionByName(met.select(*prints, "t", g.alias("g"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("half")))
    return done.select(*prints, "t", "g", "half")


def meetings(rows: DataFrame, bits: int, tables: int, similarity: float) -> DataFrame:
    """The rows of buckets() with a fingerprint within the limit in their group; a pair counts in the first table where it meets."""
    masks = _masks(tables, bits)

    def link(table: pa.Table) -> pa.Table:
        prints, half, t = _prints(table), table.column("half").to_numpy(), table.column("t")[0].as_py()
        found = np.zeros(len(prints), dtype=bool)
        for i, j in _near(prints, half, similarity):
            fresh, differ = np.ones(len(i), dtype=bool), prints[i] ^ prints[j]
            for mask in masks[:t]:
                fresh &= (differ & mask).any(axis=1)
            found[i[fresh]] = found[j[fresh]] = True
        return table.filter(pa.array(found))

    return rows.groupBy("t", "g").applyInArrow(link, "f0 long, f1 long, f2 long, f3 long, t int, g long, half int").distinct()


def _labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least label reached over edges (i, j), labels being those of earlier edges; every label points to a root."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def stars(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join what each group's pairs within all limits join. rows: t, g, half, f0 to f3, node, n, parity."""

    def link(table: pa.Table) -> pa.Table:
        prints, half, sizes = _prints(table), table.column("half").to_numpy(), table.column("n").to_numpy()
        parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), dtype=np.uint64).reshape(len(prints), -1)
        labels = np.arange(len(prints))
        for i, j in _near(prints, half, similarity):
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            fit = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
            i, j = i[fit], j[fit]
            fit = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64) <= max_difference(sizes[i], sizes[j], similarity)
            labels = _labels(labels, i[fit], j[fit])
        names, led = table.column("node"), np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": names.take(pa.array(led)), "b": names.take(pa.array(labels[led]))})

    pairs = rows.groupBy("t", "g").applyInArrow(link, "a string, b string").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified_classes(sets: list[np.ndarray], half: np.ndarray, similarity: float) -> np.ndarray:
    """Labels of the connected components of the pairs with that Jaccard similarity; where half is 0 and 1, pairs of both kinds only."""
    n, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    parity, parent = parities(np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))), list(range(n))
    two, step = bool(half.any()), max(1, (1 << 16) // max(1, n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def judge(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        for k in np.argsort(apart, kind="stable").tolist():
            a, b = root(int(i[k])), root(int(j[k]))
            if a == b:
                continue
            x, y = sets[i[k]], sets[j[k]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                parent[max(a, b)] = min(a, b)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, n, step):
        fit = np.minimum(sizes[lo : lo + step, None], sizes[None, lo:]) >= similarity * np.maximum(sizes[lo : lo + step, None], sizes[None, lo:]) - 1e-9
        if two:
            fit &= half[lo : lo + step, None] != half[None, lo:]
        i, j = np.nonzero(fit)
        later = i < j
        i, j = i[later] + lo, j[later] + lo
        differ = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
        fit = differ <= max_difference(sizes[i], sizes[j], similarity)
        held.append((i[fit], j[fit], differ[fit] / (sizes[i[fit]] + sizes[j[fit]])))
        if sum(len(x[0]) for x in held) > 1 << 20:
            judge(*(np.concatenate(x) for x in zip(*held)))
            held = []
    if held:
        judge(*(np.concatenate(x) for x in zip(*held)))
    return np.array([root(i) for i in range(n)], dtype=np.int64)


def _judge(table: pa.Table, similarity: float) -> pa.Table:
    """Stars (a, b) of the verified classes of each component in a task, and whether it is in one block. table: g, component, half, single, node, set."""
    component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(component, kind="stable")
    bounds = np.flatnonzero(np.diff(component[order], prepend=-1, append=-2))
    half, blobs, left, right = table.column("half").to_numpy(), table.column("set"), [], []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = order[lo:hi]
        labels = verified_classes([np.frombuffer(blobs[int(i)].as_py(), dtype=np.uint64) for i in own], half[own], similarity)
        led = np.flatnonzero(labels != np.arange(len(own)))
        left.append(own[led])
        right.append(own[labels[led]])
    names, left = table.column("node"), np.concatenate(left)
    return pa.table({"a": names.take(pa.array(left)), "b": names.take(pa.array(np.concatenate(right))), "single": table.column("single").take(pa.array(left))})


def verified(edges: DataFrame, n_edges: int, nodes: DataFrame, texts: DataFrame, similarity: float, block_mass: int) -> DataFrame:
    """node, root: classes by links verified within the connected components of edges.

    nodes: node, n, and text_key and id_key of one row that has the text; texts: text_key, id_key, text, repeated rows allowed.
    """
    led = components(edges)
    whole = led.unionByName(led.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "component")
    row = ["text_key", "id_key"]
    members = materialize(nodes.select("node", "n", *row).join(maybe_broadcast(whole, 2 * n_edges, 104), "node"), "members")
    mass = members.groupBy("component").agg(F.sum(F.col("n") + NODE_MASS).alias("mass"))
    mass = materialize(mass.select("component", "mass", F.ceil(F.col("mass") / block_mass).cast("int").alias("blocks")), "masses")
    small, multi = mass.agg(F.sum(F.when(F.col("blocks") == 1, F.col("mass"))), F.sum((F.col("blocks") > 1).cast("int"))).first()
    groups = max(1, math.ceil((small or 0) / block_mass))
    sets = texts.join(maybe_broadcast(members.select(*row, "node"), 2 * n_edges, 120), row).select("node", "text").mapInArrow(trimmed(_sets), "node string, set binary")
    sets = materialize(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")
    placed = members.join(mass, "component").select("node", "component", "blocks", F.pmod(F.hash("node", F.lit(11)), F.col("blocks")).alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.select("node", "component", "blocks", "own", other.alias("other"))
    g = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")))
    half = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    tasks = placed.select("node", "component", g.alias("g"), half.alias("half"), (F.col("blocks") == 1).alias("single")).join(sets, "node")
    done = tasks.select("g", "component", "half", "single", "node", "set").groupBy("g").applyInArrow(lambda table: _judge(table, similarity), "a string, b string, single boolean")
    done = materialize(done, "links")
    classes = done.filter("single").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if multi:  # the blocks of a component are joined by what their pairs have in common
        classes = classes.unionByName(components(done.filter("not single").select("a", "b")))
    return classes


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, by alternating large and small stars."""
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct(), "large")
        # From here each row leads from a greater node to a smaller one.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "small")
        state = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state


def _text_key(text_col: str):
    return F.concat(F.lpad(F.hex(F.xxhash64(text_col)), 16, "0"), F.lpad(F.hex(F.hash(F.col(text_col), F.lit(1))), 8, "0"))


def _text_key(text_col: str):
    key = F.concat(F.lpad(F.hex(F.xxhash64(text_col)), 16, "0"), F.lpad(F.hex(F.hash(F.col(text_col), F.lit(1))), 8, "0"))
    return F.when(F.col(text_col).isNotNull(), key)


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, bucket: int, cap: int, recall: float, block_mass: int) -> DataFrame:
    """A row per document: id, text_key, root (names its class by a node; null text: null), class_id and class_size."""
    keyed = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"), F.lower(F.col(text_col)).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    prints = ["f0", "f1", "f2", "f3"]
    scanned = keyed.mapInArrow(trimmed(_scan), f"id {id_type}, text_key string, f0 long, f1 long, f2 long, f3 long, signature long, n int, parity binary")
    # A node is a shingle set; of texts without a word, the text.
    of_set = [*prints, "signature", "n"]
    node = F.when(F.col("n") > 0, F.concat(F.lpad(F.hex(F.xxhash64(*of_set)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(3), *of_set)), 16, "0"))).otherwise(F.col("text_key"))
    scanned = materialize(scanned.withColumn("node", F.when(F.col("text_key").isNotNull(), node)).drop("signature"), "fingerprints")
    firsts = [F.first(c).alias(c) for c in (*prints, "n", "parity")]
    row = F.struct("text_key", F.xxhash64("id").alias("id_key"))
    nodes = scanned.filter("node is not null").groupBy("node").agg(*firsts, F.min(row).alias("row"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.select("node", *prints, "n", "parity", "row.text_key", "row.id_key", "id", "copies"), "nodes")
    searched = nodes.filter("n > 0")
    bits = max(1, round(math.log2(max(2, searched.count() / bucket))))
    tables = tables_for(bits, similarity, recall)
    met = materialize(meetings(buckets(searched, bits, tables, similarity, cap, recall), bits, tables, similarity), "meetings")
    candidates = searched.select("node", "n", "parity", *prints).join(maybe_broadcast(met, met.count(), 72), prints)
    edges = materialize(stars(candidates, similarity), "edges")
    n_edges = edges.count()
    texts = keyed.select("text_key", F.xxhash64("id").alias("id_key"), "text")
    roots = verified(edges, n_edges, searched, texts, similarity, block_mass)
    named = nodes.select("node", "id", "copies").join(maybe_broadcast(roots, 2 * n_edges, 104), "node", "left")
    named = materialize(named.select("node", F.coalesce("root", "node").alias("root"), "id", "copies"), "classes")
    sizes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = named.select("node", "root").join(sizes, "root")
    out = scanned.filter("node is not null").select("id", "text_key", "node").join(classes, "node").select("id", "text_key", "root", "class_id", "class_size")
    alone = scanned.filter("node is null").select("id", "text_key", F.lit(None).cast("string").alias("root"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bucket: int = BUCKET, cap: int = CAP, recall: float = RECALL, block_mass: int = BLOCK_MASS
) -> DataFrame:
    """A row per document: id, node (a key of its text; null text: null), class_id (the least id of its class) and class_size."""
    found = _classes(docs, id_col, text_col, similarity, bucket, cap, recall, block_mass)
    return found.select(F.col("id").alias(id_col), F.col("text_key").alias("node"), "class_id", "class_size")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bucket: int = BUCKET, cap: int = CAP, recall: float = RECALL, block_mass: int = BLOCK_MASS
) -> DataFrame:
    """The rows of docs that stand for their class: of equal ones a single row, and all with null text.

    A class's least id stands for it (of texts with that id the one with the least key). What goes, and what is there more
    than once, is joined with docs; the texts of all others aren't moved.
    """
    found = _classes(docs, id_col, text_col, similarity, bucket, cap, recall, block_mass).filter("class_size > 1 and root is not null")
    found = materialize(found.select("text_key", F.xxhash64("id").alias("id_key"), "root", F.col("id").eqNullSafe(F.col("class_id")).alias("least")), "copies")
    stands = found.groupBy("root").agg(F.min(F.when(F.col("least"), F.col("text_key"))).alias("first"))
    rows = found.join(stands, "root").select("text_key", "id_key", (F.col("least") & (F.col("text_key") == F.col("first"))).alias("stays"))
    rows = rows.groupBy("text_key", "id_key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.filter("not stays or n > 1").select(F.col("text_key").alias("__dl_text"), F.col("id_key").alias("__dl_id"), F.col("stays").alias("__dl_stays")), "dropped")
    n = rows.count()
    keyed = docs.withColumn("__dl_text", _text_key(text_col)).withColumn("__dl_id", F.xxhash64(F.col(id_col)))
    others = keyed.join(maybe_broadcast(rows, n, 72), ["__dl_text", "__dl_id"], "left_anti").select(docs.columns)
    again = keyed.join(maybe_broadcast(rows.filter("__dl_stays"), n, 72), ["__dl_text", "__dl_id"])
    again = again.groupBy("__dl_text", "__dl_id").agg(F.first(F.struct(*docs.columns)).alias("__dl_first")).select("__dl_first.*")
    return others.unionByName(again)
