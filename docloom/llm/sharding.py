"""Resharding by minimum-cost flow.

Old shards send bytes to new shards of given capacities. A byte that stays costs nothing, one that moves costs one (or what
a cost table says); the cheapest flow between the two sides is found by successive shortest paths over at most
old x new arcs, so the solver sees shard sizes and never rows. The flow is then carried out in blocks: rows of an old shard
are hashed into blocks of bounded size, laid end to end, and cut where the flows to the new shards end. A block that lies
within one flow goes there whole; a block with a cut in it is split row by row, largest row first, each row to the side with
the most room left, so that sizes come out near their targets without bias by row size. Only shards that lose rows or split
blocks need their files written again.

Null text counts as no bytes; every row has at least one byte (its end), so empty rows have a place too. Repeated rows are
rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, with_gapless_rank

#: About so many rows make a block.
BLOCK_ROWS = 50_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each supply to each capacity at the least total cost; all supply must fit."""
    if sum(supply) > sum(capacity):
        raise ValueError(f"{sum(supply)} units don't fit in {sum(capacity)}")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    supply, room = [*supply], [*capacity]
    potential = [0] * (n + m)
    while any(supply):
        far, back = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if supply[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            arcs = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in arcs:
                step = d + c + potential[u] - potential[v]
                if step < far[v]:
                    far[v], back[v] = step, u
                    heapq.heappush(heap, (step, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: far[v] + potential[v])
        limit = far[end]
        for v in range(n + m):
            potential[v] += min(far[v], limit)
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(supply[path[0]], room[end - n], *(flow[v][u - n] for u, v in zip(path, path[1:]) if u >= n))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        supply[path[0]] -= amount
        room[end - n] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def stay_or_move(old: int, new: int) -> list[list[int]]:
    """Cost 0 for a byte that keeps its shard, 1 for one that moves."""
    return [[int(i != j) for j in range(new)] for i in range(old)]


def plan_blocks(blocks: pd.DataFrame, flow: list[list[int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each (old shard, block) the bytes that go to each new shard. blocks: old_shard, block, bytes."""
    plan = {}
    for old, group in blocks.sort_values(["old_shard", "block"]).groupby("old_shard"):
        # What stays comes first, and the rest in the order of the new shards.
        targets = [(j, x) for j, x in sorted(enumerate(flow[int(old)]), key=lambda a: (a[0] != old, a[0])) if x]
        k, left = 0, targets[0][1] if targets else 0
        for block, size in zip(group["block"], group["bytes"], strict=True):
            parts, size = [], int(size)
            while size > 0:
                take = min(size, left)
                parts.append((targets[k][0], take))
                size, left = size - take, left - take
                if left == 0 and k + 1 < len(targets):
                    k, left = k + 1, targets[k + 1][1]
            plan[int(old), int(block)] = parts
    return plan


def reshard(rows: DataFrame, new_capacities: list[int] | int, old_shards: int, block_rows: int = BLOCK_ROWS, cost: list[list[int]] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds block int and shard int to rows that have old_shard int (0 to old_shards - 1) and size long (1 at least).

    new_capacities: bytes that each new shard can hold (their sum is at least the total), or a number of shards of even
    capacity. The result is a written table.
    """
    order = order or [c for c in rows.columns if c != "old_shard"]
    n = rows.count()
    blocks = max(1, -(-n // (block_rows * max(1, old_shards))))
    named = rows.withColumn("block", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    named = materialize(named, "blocks")
    # A row per block: the number of rows over block_rows and one for each old shard.
    sums = named.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).toPandas()
    old_bytes = [int(sums.loc[sums["old_shard"] == i, "bytes"].sum()) for i in range(old_shards)]
    capacities = even_capacities(sum(old_bytes), new_capacities) if isinstance(new_capacities, int) else new_capacities
    flow = min_cost_flow(old_bytes, capacities, cost or stay_or_move(old_shards, len(capacities)))
    plan = plan_blocks(sums, flow)
    whole = [(o, b, parts[0][0]) for (o, b), parts in plan.items() if len(parts) == 1]
    split = {k: parts for k, parts in plan.items() if len(parts) > 1}
    spark = rows.sparkSession
    target = spark.createDataFrame(pd.DataFrame(whole, columns=["old_shard", "block", "shard"]).astype("int32"), "old_shard int, block int, shard int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema) + ", shard int"

    def part_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        room = [(-size, shard) for shard, size in split[int(key[0]), int(key[1])]]
        heapq.heapify(room)
        block = block.sort_values(["size", *(c for c in order if c != "size")], ascending=False, na_position="last", kind="stable")
        shards = []
        for size in block["size"]:
            left, shard = room[0]
            heapq.heapreplace(room, (left + int(size), shard))
            shards.append(shard)
        return block.assign(shard=np.array(shards, dtype="int32"))

    kept = named.join(target, ["old_shard", "block"])
    keys = spark.createDataFrame(pd.DataFrame([*split], columns=["old_shard", "block"]).astype("int32"), "old_shard int, block int")
    parted = named.join(keys, ["old_shard", "block"], "left_semi").select(*named.columns).groupBy("old_shard", "block").applyInPandas(part_block, schema)
    return materialize(kept.select(*named.columns, "shard").unionByName(parted), "resharded")


def balanced_shards(docs: DataFrame, shards: int = 16, old_shards: int = 12, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Moves docs from old_shards shards by hash of the id to `shards` shards of even bytes.

    Columns: id, size, text_crc32, old_shard, block, shard and slot, a row's number in its shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(old_shards)).cast("int").alias("old_shard"),
    )
    placed = reshard(rows, shards, old_shards, block_rows, order=["size", id_col, "text_crc32"])
    return with_gapless_rank(placed, ["shard"], [id_col, "size", "text_crc32"], "slot", placed.count(), block_rows)


# A sharded dataset: folders of block files, and a manifest that says which shard each file belongs to.


def _files(spark: SparkSession):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return lambda p: (path(p).getFileSystem(conf), path(p))


def write_manifest(spark: SparkSession, root: str, version: int, shards: dict[int, list[str]]) -> None:
    """Writes manifest-<version>.json under another name first, so that readers see all of it or nothing."""
    fs, temp = _files(spark)(f"{root}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({"version": version, "shards": {str(k): sorted(v) for k, v in shards.items()}}).encode()))
    out.close()
    if not fs.rename(temp, _files(spark)(f"{root}/manifest-{version:06d}.json")[1]):
        raise OSError(f"version {version} of {root} was written by someone else")


def read_manifest(spark: SparkSession, root: str) -> dict:
    fs, path = _files(spark)(root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("manifest-"))
    text = "\n".join(r["value"] for r in spark.read.text(f"{root}/{names[-1]}").collect())
    found = json.loads(text)
    return {"version": found["version"], "shards": {int(k): v for k, v in found["shards"].items()}}


def _block_folders(spark: SparkSession, root: str, folder: str) -> Iterator[tuple[int, int, str]]:
    fs, path = _files(spark)(f"{root}/{folder}")
    for s in fs.globStatus(_files(spark)(f"{root}/{folder}/shard=*/block=*")[1]) or []:
        parent = s.getPath().getParent().getName()
        yield int(parent.split("=")[1]), int(s.getPath().getName().split("=")[1]), f"{folder}/{parent}/{s.getPath().getName()}"


def write_sharded(rows: DataFrame, root: str, shard_col: str, block_col: str) -> dict:
    """Writes rows as version 0 of a sharded dataset: a folder per shard and block."""
    spark = rows.sparkSession
    part = rows.withColumn("shard", F.col(shard_col)).withColumn("block", F.col(block_col))
    part.repartition("shard", "block").write.partitionBy("shard", "block").parquet(f"{root}/v0")
    shards: dict[int, list[str]] = {}
    for shard, _, folder in _block_folders(spark, root, "v0"):
        shards.setdefault(shard, []).append(folder)
    write_manifest(spark, root, 0, shards)
    return read_manifest(spark, root)


def read_shard(spark: SparkSession, root: str, shard: int) -> DataFrame:
    return spark.read.parquet(*(f"{root}/{f}" for f in read_manifest(spark, root)["shards"][shard]))


def _parting(plan: dict[tuple[int, int], list[tuple[int, int]]]):
    """For each block the rows with their new shards: the largest first, each to the shard with most room left."""

    def part_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        room = [(-x, shard) for shard, x in plan[int(key[0]), int(key[1])]]
        heapq.heapify(room)
        block = block.sort_values("size", ascending=False, kind="stable")
        to = []
        for x in block["size"]:
            left, shard = room[0]
            heapq.heapreplace(room, (left + int(x), shard))
            to.append(shard)
        return block.drop(columns=["old_shard", "size"]).assign(shard=np.array(to, dtype="int32"))

    return part_block


def _blocks(spark: SparkSession, root: str, files: list[tuple[int, int, str]], size: str) -> DataFrame:
    """The rows of block folders with old_shard, block and size, read at once."""
    rows = spark.read.option("mergeSchema", "true").parquet(*(f"{root}/{f}" for _, _, f in files))
    folder = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+/[^/]+)/[^/]+$", 1)
    known = spark.createDataFrame(files, "old_shard int, block int, __folder string")
    return rows.withColumn("__folder", folder).join(F.broadcast(known), "__folder").drop("__folder").withColumn("size", F.expr(size).cast("long"))


def rewrite_affected(spark: SparkSession, root: str, new_capacities: list[int] | int, size: str) -> dict:
    """Moves a sharded dataset to new capacities; size: SQL for the bytes of a row. Returns the new manifest with `rewritten`.

    Block files whose rows all go to one shard are renamed in the manifest alone; the others are written again by one job,
    parted by their new shards. Files of older manifests stay until someone deletes them, so a reader, or a run that died half
    way, isn't hurt.
    """
    manifest = read_manifest(spark, root)
    files = [(shard, k, f) for shard, fs in sorted(manifest["shards"].items()) for k, f in enumerate(sorted(fs))]
    sums = _blocks(spark, root, files, size).groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).toPandas()
    old = max(manifest["shards"]) + 1
    old_bytes = [int(sums.loc[sums["old_shard"] == i, "bytes"].sum()) for i in range(old)]
    capacities = even_capacities(sum(old_bytes), new_capacities) if isinstance(new_capacities, int) else new_capacities
    plan = plan_blocks(sums, min_cost_flow(old_bytes, capacities, stay_or_move(old, len(capacities))))
    shards: dict[int, list[str]] = {j: [] for j in range(len(capacities))}
    version = manifest["version"] + 1
    affected = [(s, k, f) for s, k, f in files if len(plan[s, k]) > 1]
    for s, k, f in files:
        if len(plan[s, k]) == 1:
            shards[plan[s, k][0][0]].append(f)
    if affected:
        rows = _blocks(spark, root, affected, size)
        schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name not in ("old_shard", "block", "size")) + ", block int, shard int"
        part, number = _parting(plan), {(s, k): i for i, (s, k, _) in enumerate(affected)}
        moved = rows.groupBy("old_shard", "block").applyInPandas(lambda key, block: part(key, block).assign(block=number[int(key[0]), int(key[1])]), schema)
        moved.write.partitionBy("shard", "block").parquet(f"{root}/v{version}")
        for shard, _, folder in _block_folders(spark, root, f"v{version}"):
            shards[shard].append(folder)
    write_manifest(spark, root, version, {k: v for k, v in shards.items() if v})
    return read_manifest(spark, root) | {"rewritten": [f for _, _, f in affected]}
