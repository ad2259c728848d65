"""Resharding by minimum-cost flow (operator 12): from old shards to new ones of near equal size, moving the fewest bytes.

1. The documents of each old shard are dealt into blocks by a hash; one aggregation gives the bytes and rows of every
   block.  There are ``BLOCKS`` of them at most in all old shards together, however many documents there are, so that
   the driver can hold them; a document larger than a block's share simply makes a large block.
2. Old shards with their bytes are sources, new shards with their capacities sinks; a byte costs what the
   cost matrix says, 0 where it stays and 1 elsewhere by default (say 2 across racks).  Successive shortest paths with potentials give
   the cheapest flow.
3. The flow is made of whole blocks: each old shard's blocks, the largest first, go where most of the flow is still
   open.  What whole blocks leave uneven is evened out by the steps that narrow the spread at the least cost: one block
   moves, or two change places.
4. Documents meet their block's destination by broadcast of the block table (proven size: ``BLOCKS`` rows) and get their
   slot from the block's first slot and their place in the block.  No document is dealt out by its shard.
5. ``rewrite`` applies a plan to stored shards: files without a leaving document stay as they are; only
   the others are written anew, next to the arriving documents.

Copies of a text are not held together: the law is equal bytes at the fewest moved bytes.

Defined cases: a null text counts 0 bytes, plus 1 for the row; a null old shard is a new document that belongs to no
shard yet, so that it costs one move anywhere; rows that share an id stand in any fixed order of their texts; a document larger than a
capacity makes its shard larger than the others; an empty table has no rows; only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import shared_table

#: Blocks of all old shards together; a bound on what the driver holds and what is broadcast (some 3 MB).
BLOCKS = 49_152
SHARDS, OLD_SHARDS = 16, 12


def capacities(total: int, shards: int) -> list[int]:
    """Whole capacities that are at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def cheapest_flow(supply: Sequence[int], capacity: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """Bytes from each source to each sink: all supply goes, no capacity is passed, the total cost is the least.

    Successive shortest paths (Dijkstra on reduced costs) over the shards; capacities must take all supply.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't take all bytes")
    flow = np.zeros((n, m), dtype=object)
    left, room, height = list(supply), list(capacity), [0] * (n + m)
    while any(left):
        far, came = [None] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        done = [False] * (n + m)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                edges = ((n + j, cost[u, j]) for j in range(m))
            else:
                edges = ((i, -cost[i, u - n]) for i in range(n) if flow[i, u - n])
            for v, c in edges:
                new = d + int(c) + height[u] - height[v]
                if not done[v] and (far[v] is None or new < far[v]):
                    far[v], came[v] = new, u
                    heapq.heappush(heap, (new, v))
        open_sinks = [j for j in range(m) if room[j]]
        end = n + min(open_sinks, key=lambda j: (far[n + j] + height[n + j], j))
        most = max(d for d in far if d is not None)
        height = [h + (most if d is None else d) for h, d in zip(height, far, strict=True)]
        path, v = [], end
        while came[v] >= 0:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end - n], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return flow


def packed(old: np.ndarray, size: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """A new shard for each block: the largest blocks first, to where most of their old shard's flow is still open."""
    out = np.zeros(len(old), np.int64)
    for i in range(flow.shape[0]):
        own = np.flatnonzero(old == i)
        heap = [(-int(x), j) for j, x in enumerate(flow[i])]
        heapq.heapify(heap)
        for b in own[np.argsort(-size[own], kind="stable")]:
            x, j = heap[0]
            out[b] = j
            heapq.heapreplace(heap, (x + int(size[b]), j))
    return out


def evened(old: np.ndarray, size: np.ndarray, shard: np.ndarray, capacity: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """Narrow what whole blocks have left uneven: the fullest and the emptiest shard pass one block or swap two.

    Each step lowers the sum of squared differences from the capacities, so it ends; of the steps that come nearest to half of the
    difference (within a hundredth of it), the cheapest is taken.
    """
    shard = shard.copy()
    over = np.bincount(shard, size, len(capacity)).astype(np.int64) - np.array(capacity, np.int64)
    tried: set[tuple[int, int]] = set()
    while True:
        pairs = [(int(over[a] - over[b]), int(a), int(b)) for a in np.argsort(-over)[:4] for b in np.argsort(over)[:4] if over[a] - over[b] > 1 and (a, b) not in tried]
        if not pairs:
            return shard
        gap, a, b = max(pairs)
        here, there = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        there = there[np.argsort(size[there], kind="stable")]
        # what block x of a, less block y of b (or nothing), comes nearest to half of the gap
        known = np.concatenate([[0], size[there]])
        want = size[here] - gap / 2
        at = np.clip(np.searchsorted(known, want), 1, len(known) - 1) if len(known) > 1 else np.zeros(len(here), np.int64)
        at = np.where(np.abs(known[np.maximum(at - 1, 0)] - want) <= np.abs(known[at] - want), np.maximum(at - 1, 0), at)
        moved = size[here] - known[at]
        miss = np.abs(moved - gap / 2)
        good = (moved > 0) & (moved < gap)
        if not good.any():
            tried.add((a, b))
            continue
        near = np.flatnonzero(good & (miss <= miss[good].min() + gap / 100))
        back = np.where(at[near] > 0, there[np.maximum(at[near] - 1, 0)] if len(there) else 0, -1)
        price = (cost[old[here[near]], b] - cost[old[here[near]], a]) * size[here[near]]
        if len(there):
            price = price + np.where(back >= 0, (cost[old[back], a] - cost[old[back], b]) * size[back], 0)
        k = int(np.lexsort((miss[near], price))[0])
        shard[here[near[k]]] = b
        if back[k] >= 0:
            shard[back[k]] = a
        over[a] -= moved[near[k]]
        over[b] += moved[near[k]]
        tried.clear()


def plan(blocks: list[tuple[int, int, int, int]], shards: int, cost: np.ndarray | None = None, old_shards: int | None = None) -> list[tuple[int, int, int, int]]:
    """(old, block, shard, first slot) for blocks (old, block, bytes, rows); old shard -1: not stored yet."""
    blocks = sorted(blocks)
    n = max([old_shards or 0, *(b[0] + 1 for b in blocks)])
    if cost is None:
        cost = 1 - np.eye(n, shards, dtype=np.int64)
    cost = np.vstack([cost, np.ones((1, shards), np.int64)])  # the last row: documents of no shard, which is also number -1
    old, size = np.array([b[0] if b[0] >= 0 else n for b in blocks], np.int64), np.array([b[2] for b in blocks], np.int64)
    supply = [int(size[old == i].sum()) for i in range(n + 1)]
    room = capacities(sum(supply), shards)
    shard = evened(old, size, packed(old, size, cheapest_flow(supply, room, cost)), room, cost)
    free, out = [0] * shards, []
    for (i, b, _, rows), k in zip(blocks, shard.tolist(), strict=True):
        out.append((i, b, k, free[k]))
        free[k] += rows
    return out


def reshard(docs: DataFrame, old: Column, shards: int = SHARDS, old_shards: int = OLD_SHARDS, id_col: str = "doc_id", text_col: str = "text", cost: np.ndarray | None = None, blocks: int = BLOCKS) -> DataFrame:
    """id, size, text_crc32, old_shard, shard, slot, moved for every document; ``old``: its shard until now, from 0 to ``old_shards`` - 1, or null."""
    text = F.col(text_col)
    here = F.coalesce(old.cast("int"), F.lit(-1))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        here.alias("old_shard"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks // (old_shards + 1))).cast("int").alias("block"),
    )
    rows = shared_table(rows)
    counted = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    made = plan([tuple(r) for r in counted.collect()], shards, cost, old_shards)  # ``blocks`` rows at most
    moves = F.broadcast(rows.sparkSession.createDataFrame(made, "old_shard int, block int, shard int, first long"))
    place = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("id", "text_crc32", "size"))
    found = rows.withColumn("place", place).join(moves, ["old_shard", "block"])
    stored = F.col("old_shard") >= 0
    return found.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.when(stored, F.col("old_shard")).alias("old_shard"), "shard",
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), (F.col("old_shard") != F.col("shard")).alias("moved"),
    )


# -- stored shards


def live_files(spark: SparkSession, root: str) -> dict[str, int]:
    """File -> shard of the layout's last generation; ``root`` holds data files and one small list of them a generation."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    lists = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.getPath().getName().startswith("files-"))
    return {r["file"]: r["shard"] for r in spark.read.schema("file string, shard int").json(f"{root}/{lists[-1]}").collect()} if lists else {}


def commit_files(spark: SparkSession, root: str, files: dict[str, int]) -> None:
    """A new generation: its list is written beside the others and then renamed, so that readers see the old one or the new one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    number = len([x for x in fs.listStatus(path) if x.getPath().getName().startswith("files-")])
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray("".join(json.dumps({"file": f, "shard": s}) + "\n" for f, s in sorted(files.items())).encode()))
    out.close()
    if not fs.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/files-{number:06d}.json")):
        raise OSError(f"generation {number} of {root} exists already")


def write_shards(docs: DataFrame, shard: str, root: str, keep: dict[str, int] | None = None) -> dict[str, int]:
    """Write ``docs``, without the column ``shard``, as files of their shards below ``root`` and commit them, with the files to ``keep``, as a generation."""
    spark = docs.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    docs.withColumn("_shard", F.col(shard)).drop(shard).sortWithinPartitions("_shard").write.partitionBy("_shard").parquet(f"{root}/{folder}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = dict(keep or {})
    for part in fs.listStatus(path):
        name = part.getPath().getName()
        if name.startswith("_shard="):
            files |= {f"{folder}/{name}/{x.getPath().getName()}": int(name[7:]) for x in fs.listStatus(part.getPath())}
    commit_files(spark, root, files)
    return files


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """The documents of the last generation with ``shard`` and ``_file``."""
    files = live_files(spark, root)
    known = F.broadcast(spark.createDataFrame([(f, s) for f, s in files.items()], "_file string, shard int"))  # one row for each file
    name = F.regexp_extract(F.input_file_name(), r"(data-[0-9a-f]+/_shard=[0-9]+/[^/]+)$", 1)
    rows = spark.read.parquet(*(f"{root}/{f}" for f in files)).withColumn("_file", name)
    return rows.join(known, "_file")


def rewrite(spark: SparkSession, root: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Bring stored shards to ``shards`` near equal ones; returns files kept, files rewritten and bytes of texts moved.

    Ids must be unique.  A file that no document leaves is kept; of the others, the staying documents are written to new files of
    their shard and the leaving ones to files of theirs.
    """
    now = read_shards(spark, root)
    files = live_files(spark, root)
    planned = shared_table(reshard(now, F.col("shard"), shards, max(files.values()) + 1, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("shard").alias("_to"), "size", "moved"))
    rows = now.join(planned, now[id_col] == planned["_id"])
    left = {r["_file"] for r in rows.where("moved").select("_file").distinct().collect()}  # names of files
    going = rows.where(F.col("_file").isin(*left)) if left else rows.limit(0)
    own = [c for c in now.columns if c not in ("_file", "shard")]
    write_shards(going.select(*(now[c] for c in own), "_to"), "_to", root, {f: s for f, s in files.items() if f not in left})
    return {"kept": len(files) - len(left), "rewritten": len(left), "moved": planned.where("moved").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]}
