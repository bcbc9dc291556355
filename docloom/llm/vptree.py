"""Approximate nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors are spread over shards by hash; each shard gets a vantage-point tree over unit vectors (Euclidean distance, which
orders like the cosine), built once and written as one row. Queries come in large blocks; every block meets every shard, and
within a pair the queries go down the tree together, some at a time. At a node with vantage point v and radius mu, a query at
distance d whose k-th best is tau leaves a side out if the triangle inequality says that nothing within tau / factor can be
there. factor 1 leaves out only what cannot be nearer, so the search is exact; a larger factor searches less. Distances choose
what is looked at, with a margin for their rounding; the order among it is that of exact cosines of the original vectors, in
double precision.

Vectors that are null, empty, zero or hold a null or non-finite component take no part; neither do null ids. A query meets
candidates of its own length only. Components of any finite size are fine: a vector is scaled by a power of two before its
norm is taken, which changes no digit. Repeated ids are rows of their own (only a query's own id is left out of its
candidates); ties go to the smaller id; with fewer than k candidates all are returned, and empty tables give an empty result.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize

SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 16_384, 512
#: Queries that go down a tree together.
TOGETHER = 1024
FACTOR = 1.0
#: Distances within this of a bound aren't pruned: near 0, the rounding of a cosine is 1e-8 in a distance.
SLACK = 1e-7


@dataclass
class Tree:
    """A tree in arrays. Node i holds vectors order[lo[i]:hi[i]]; the first of them is its vantage point, if it has children."""

    order: np.ndarray
    lo: list[int]
    hi: list[int]
    inner: list[int]
    outer: list[int]
    radius: list[float]


def build(unit: np.ndarray, leaf: int = LEAF, seed: int = 0) -> Tree:
    rng, order = np.random.default_rng(seed), np.arange(len(unit))
    t = Tree(order, [0], [len(unit)], [-1], [-1], [0.0])
    todo = [0]
    while todo:
        i = todo.pop()
        lo, hi = t.lo[i], t.hi[i]
        if hi - lo <= leaf:
            continue
        at = lo + int(rng.integers(hi - lo))
        order[lo], order[at] = order[at], order[lo]
        rest = order[lo + 1 : hi]
        d = np.linalg.norm(unit[rest] - unit[order[lo]], axis=1)
        half = len(rest) // 2
        part = np.argpartition(d, half)
        order[lo + 1 : hi] = rest[part]
        t.radius[i] = float(d[part[half]])
        for name, a, b in (("inner", lo + 1, lo + 1 + half), ("outer", lo + 1 + half, hi)):
            getattr(t, name)[i] = len(t.lo)
            todo.append(len(t.lo))
            for column, x in (("lo", a), ("hi", b), ("inner", -1), ("outer", -1), ("radius", 0.0)):
                getattr(t, column).append(x)
    return t


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with those of y, all added in one order, so that a score depends on its two vectors alone."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def search(tree: Tree, vectors: np.ndarray, unit: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places of its k nearest vectors (-1: none), nearest first, and their cosines. own: the id that is left out."""
    n = len(queries)
    asked = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    reach, at, score = np.full(n, np.inf), np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf)

    def offer(q: np.ndarray, members: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(0, 2 - 2 * (asked[q] @ unit[members].T)))
        mine = np.where(own[q][:, None] == ids[members][None, :], np.inf, d)
        # Only what is within the k-th nearest of all so far, here or before, can be among the k.
        bound = reach[q]
        if len(members) >= k:
            bound = np.minimum(bound, np.partition(mine, k - 1, axis=1)[:, k - 1])
        rows, columns = np.nonzero(mine <= np.where(np.isfinite(bound), bound + SLACK, np.finfo(float).max)[:, None])
        if not len(rows):
            return d
        places = members[columns]
        scores = cosines(queries[q[rows]], vectors[places])
        for r, lo, hi in zip(*(x.tolist() for x in _runs(rows))):
            i = q[r]
            every = np.concatenate((score[i][at[i] >= 0], scores[lo:hi]))
            where = np.concatenate((at[i][at[i] >= 0], places[lo:hi]))
            best = np.lexsort((ids[where], -every))[:k]
            at[i, : len(best)], score[i, : len(best)] = where[best], every[best]
            if len(best) == k:
                reach[i] = math.sqrt(max(0.0, 2 - 2 * min(1.0, float(every[best[-1]]))))
        return d

    def visit(i: int, q: np.ndarray) -> None:
        if not len(q):
            return
        if tree.inner[i] < 0:
            offer(q, tree.order[tree.lo[i] : tree.hi[i]])
            return
        d = offer(q, tree.order[tree.lo[i] : tree.lo[i] + 1])[:, 0]
        inside = d < tree.radius[i]
        visit(tree.inner[i], q[inside])
        visit(tree.outer[i], q[~inside])
        far = np.abs(d - tree.radius[i]) <= reach[q] / factor + SLACK
        visit(tree.outer[i], q[inside & far])
        visit(tree.inner[i], q[~inside & far])

    for lo in range(0, n if len(unit) else 0, TOGETHER):
        visit(0, np.arange(lo, min(n, lo + TOGETHER)))
    return at, score


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of a sorted array, and where each begins and ends."""
    bounds = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
    return rows[bounds[:-1]], bounds[:-1], bounds[1:]


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def _packed(rows: DataFrame, key: str, out: str, with_tree: bool = False) -> DataFrame:
    """A row per vector length and key: ids and vectors as bytes, in the order of the ids, and their tree."""

    def pack(k: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        v = table.column("v").combine_chunks()
        v = np.asarray(v.flatten()).reshape(len(ids), -1)
        order = np.lexsort((*v.T[::-1], ids))
        ids, v = ids[order], v[order]
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
        tree = pickle.dumps(build(v / np.sqrt((v * v).sum(axis=1))[:, None], seed=k[1].as_py())) if with_tree else b""
        columns = {"dim": pa.array([k[0].as_py()], pa.int32()), key: pa.array([k[1].as_py()], pa.int64())}
        return pa.table(columns | {f"{out}_{name}": pa.array([x], pa.binary()) for name, x in (("ids", ids.tobytes()), ("vectors", v.tobytes()), ("tree", tree))})

    return rows.withColumn("dim", F.size("v")).groupBy("dim", key).applyInArrow(pack, f"dim int, {key} long, {out}_ids binary, {out}_vectors binary, {out}_tree binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, id_col, score: the k candidates with the largest cosine that the trees find."""
    rows, asked = _valid(vectors, id_col, vector_col), _valid(queries, id_col, vector_col)
    shards, blocks = max(1, math.ceil(rows.count() / shard_rows)), max(1, math.ceil(asked.count() / block_rows))
    index = materialize(_packed(rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))), "shard", "s", with_tree=True), "index")
    blocked = materialize(_packed(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks))), "block", "q").drop("q_tree"), "queries")
    pairs = index.join(blocked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))), ["dim", "shard"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0].as_py() for c in ("s_ids", "s_vectors", "s_tree", "q_ids", "q_vectors")}
        ids, own = np.frombuffer(row["s_ids"], dtype=np.int64), np.frombuffer(row["q_ids"], dtype=np.int64)
        v, q = np.frombuffer(row["s_vectors"]).reshape(len(ids), -1), np.frombuffer(row["q_vectors"]).reshape(len(own), -1)
        at, score = search(pickle.loads(row["s_tree"]), v, v / np.sqrt((v * v).sum(axis=1))[:, None], ids, q, own, k, factor)
        i, j = np.nonzero(at >= 0)
        query = i + (key[2].as_py() << 32)
        return pa.table({"dim": pa.array(np.full(len(i), key[0].as_py(), dtype=np.int32)), "query": pa.array(query), "query_id": pa.array(own[i]), "id": pa.array(ids[at[i, j]]), "score": pa.array(score[i, j])})

    found = pairs.groupBy("dim", "shard", "block").applyInArrow(run, "dim int, query long, query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
