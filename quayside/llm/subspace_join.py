"""Embedding near-dedup (operator 4): a subspace pigeonhole join.

Unit vectors with cosine ``LINK`` or more lie within squared distance 2 - 2 LINK.  A fixed random
rotation spreads that distance over ``BLOCKS`` blocks of neighbouring coordinates; by the pigeonhole
principle at least one block holds no more than its share of it, in proportion to its width.  Each block
is range-joined by itself: a grid over its first ``GRID`` coordinates, with cells four radii wide, has
each vector at home in one cell and as a guest in the others that its radius touches.  A pair is taken
in the first block within budget, so the union of the blocks' candidates holds each pair once from each
side, and it is verified by its cosine in double precision.

Cells are compared in tiles of about ``TILE`` vectors a side, so a crowded cell is many tasks.  Inside a
tile the rest of the block's coordinates are range-joined one after another: the first by a sorted search,
and only pairs within the radius in every coordinate have their block distance worked out.  A tile
yields, for each vector at home, the number of its links, and a forest that connects what it has linked;
it never yields pairs.  Equal vectors of one label are one representative with a multiplicity.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors
with a null label, link with nothing and are their own component; vectors of different length never
link; labels may be of any type that can be grouped and are equal by value; rows of one id are vectors of
their own, and components are named by the smallest id in them; ids may be of any type that sorts; a row with
a null id links with nothing and has a null component; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import U, components, join_hot, mix, shared_table, with_rows

LINK, BLOCKS, GRID, TILE, SLACK = 0.98, 8, 3, 1024, 1e-9


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cut_points(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def unit_rows(column: pa.ListArray, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of tiny or huge components survive
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = batch.column("embedding").value_lengths().to_numpy()
    for dim in np.unique(size).tolist():
        yield dim, batch.filter(pa.array(size == dim))


def cell_table(reps: DataFrame, link: float, blocks: int, grid: int) -> DataFrame:
    """(cell, block, id, home): the cells of each vector, one of them its home, for each block."""
    near = 2 - 2 * link

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dim(batch):
                x = unit_rows(part.column("embedding"), dim) @ rotation(dim)
                ids, label = part.column("id").to_numpy(), part.column("mark").to_numpy().view(U)
                for b, (lo, hi) in enumerate(cut_points(dim, blocks)):
                    radius = np.sqrt(near * (hi - lo) / dim + SLACK) + 1e-7
                    y = x[:, lo : min(hi, lo + grid)] / (4 * radius)
                    own, low, high = np.floor(y), np.floor(y - 0.25), np.floor(y + 0.25)
                    for sides in product((0, 1), repeat=y.shape[1]):
                        at = np.where(np.array(sides) == 0, low, high)
                        # where both ends fall into one cell, only the first choice counts
                        new = ((np.array(sides) == 0) | (low != high)).all(axis=1)
                        key = mix(label * U(0x9E3779B97F4A7C15) + U(dim * 1024 + b))
                        for j in range(y.shape[1]):
                            key = mix(key * U(0x9E3779B97F4A7C15) + at[:, j].astype(np.int64).view(U))
                        home = (at == own).all(axis=1)
                        n = int(new.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[new].view(np.int64)), pa.array(np.full(n, b, np.int32)), pa.array(ids[new]), pa.array(home[new])],
                            names=["cell", "block", "id", "home"],
                        )

    return reps.select("id", "mark", "embedding").mapInArrow(place, "cell long, block int, id long, home boolean")


def close_pairs(rows: np.ndarray, cols: np.ndarray, radius: float, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, column) that lie within ``radius`` in every coordinate; coordinate ``lead`` is searched first."""
    lead = min(lead, rows.shape[1] - 1)
    order = np.argsort(cols[:, lead], kind="stable")
    line = cols[order, lead]
    lo, hi = np.searchsorted(line, rows[:, lead] - radius), np.searchsorted(line, rows[:, lead] + radius, side="right")
    upto = np.append(0, np.cumsum(hi - lo))
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + 500_000, side="right")) - 1)
        n = hi[at:end] - lo[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - lo[at:end], n)]
        for k in (*range(lead + 1, rows.shape[1]), *range(lead)):
            near = np.abs(rows[i, k] - cols[j, k]) <= radius
            i, j = i[near], j[near]
        yield i, j
        at = end


def tile_links(tiles: DataFrame, link: float, blocks: int, grid: int) -> DataFrame:
    """(id, links, root) by tile: links found for a vector at home, or the root that it hangs on."""
    near = 2 - 2 * link

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        block, dim = tile["block"][0].as_py(), len(tile["embedding"][0])
        x = unit_rows(tile["embedding"].combine_chunks(), dim)
        rot, ids, times, row = x @ rotation(dim), tile["id"].to_numpy(), tile["times"].to_numpy(), tile["row"].to_numpy()
        cuts = cut_points(dim, blocks)
        fits = lambda d, lo, hi: d <= near * (hi - lo) / dim + SLACK
        r, c = np.flatnonzero(row), np.flatnonzero(~row)
        found, heads, tails = np.zeros(len(r), np.int64), [], []
        lo, hi = cuts[block]
        radius = np.sqrt(near * (hi - lo) / dim + SLACK) + 1e-7
        for i, j in close_pairs(rot[r, lo:hi], rot[c, lo:hi], radius, grid):
            i, j = r[i], c[j]
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            for s in range(0, len(i), 20_000):
                a, b = i[s : s + 20_000], j[s : s + 20_000]
                parts = (rot[a] - rot[b]) ** 2
                taken = fits(sum(parts[:, k] for k in range(lo, hi)), lo, hi)
                for p, q in cuts[:block]:  # the first block within budget counts
                    taken &= ~fits(sum(parts[:, k] for k in range(p, q)), p, q)
                a, b = a[taken], b[taken]
                linked = (x[a] * x[b]).sum(axis=1) >= link
                a, b = a[linked], b[linked]
                np.add.at(found, np.searchsorted(r, a), times[b])
                heads.append(a)
                tails.append(b)
        head, tail = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (heads, tails))
        # the least id reachable inside the tile, by repeated minima over its links
        names, number = np.unique(ids, return_inverse=True)
        u, v = number[head], number[tail]
        root = np.arange(len(names))
        while len(u):
            low = root.copy()
            np.minimum.at(low, u, root[v])
            np.minimum.at(low, v, root[u])
            low = low[low]
            if (low == root).all():
                break
            root = low
        hung = np.flatnonzero(root != np.arange(len(names)))
        some = found > 0
        return pa.table({
            "id": np.concatenate([ids[r][some], names[hung]]), "links": np.concatenate([found[some], np.zeros(len(hung), np.int64)]),
            "root": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), names[root[hung]]]), mask=np.concatenate([np.ones(some.sum(), bool), np.zeros(len(hung), bool)])),
        })

    return tiles.groupBy("cell", "x", "y").applyInArrow(compare, "id long, links long, root long")


def linked_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, link: float = LINK, blocks: int = BLOCKS, grid: int = GRID,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every vector."""
    v = vectors.select(F.col(id_col).alias("own"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    v = v.withColumn("payload", F.struct("embedding", "label"))
    v, same = with_rows(v, "own", "payload", "id")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("valid", F.coalesce(valid, F.lit(False)))
    plain = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))  # -0.0 and 0.0 are the same
    key = [F.xxhash64(plain).alias("h"), F.xxhash64(F.lit(1), plain, F.size("embedding")).alias("g")]
    keyed = v.where("valid").select("own", "id", "label", "embedding", *key)
    reps = keyed.groupBy("label", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.min_by("embedding", "id").alias("embedding"))
    reps = shared_table(reps.withColumn("mark", F.xxhash64("label")))
    cells = cell_table(reps.select(F.col("rep").alias("id"), "mark", "embedding"), link, blocks, grid)
    cells = shared_table(cells)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    placed = join_hot(cells, shared_table(sizes), "cell").withColumn("spot", F.xxhash64("id", F.lit(3)))
    count = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    one = lambda n: F.pmod("spot", count(n)).cast("int")
    rows = placed.where("home").select("cell", "block", "id", F.lit(True).alias("row"), one("homes").alias("x"), every("n").alias("y"))
    cols = placed.select("cell", "block", "id", F.lit(False).alias("row"), every("homes").alias("x"), one("n").alias("y"))
    tiles = rows.unionByName(cols).join(reps.select(F.col("rep").alias("id"), "times", "embedding"), "id")
    found = shared_table(tile_links(tiles, link, blocks, grid))
    links = found.where("root is null").groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("root is not null"), "id", "root").withColumnRenamed("node", "id")
    known = reps.select("label", "h", "g", F.col("rep").alias("id"), "times").join(links, "id", "left").join(parts, "id", "left")
    known = known.select("label", "h", "g", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.select("own", "label", "h", "g").join(known, ["label", "h", "g"]).select("own", "n_links", "component_id")
    if same:
        out = out.withColumn("component_id", F.col("component_id").cast(v.schema["own"].dataType))
    else:  # numbers of rows back to ids
        names = v.where("valid").select(F.col("id").alias("component_id"), F.col("own").alias("name")).distinct()
        out = out.join(names.hint("merge"), "component_id").select("own", "n_links", F.col("name").alias("component_id"))
    rest = v.where("not valid").select("own", F.lit(0).cast("long").alias("n_links"), F.col("own").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("own").alias(id_col), "n_links", "component_id", (F.col("own") == F.col("component_id")).alias("kept"))
