"""MinHash near-dedup (operator 10): DartMinHash signatures, banded joins, exact verification.

A document is a weighted set: a run of five words (lower-cased, split at white space) that occurs c
times weighs 1 + floor(log2 c), so that a line repeated hundreds of times doesn't outweigh the rest
(``weights`` may also be "count" or "set").  Weight ``w`` of an element is the unit cells 1..w, so two
documents' weighted Jaccard similarity is that of their sets of cells.  Each cell has hashed darts: a Poisson process of
ranks, drawn from the cell's hash alone.  A document throws the darts of its cells up to the rank at
which about ``k (ln k + 3)`` of them are expected; a dart hits one of ``k`` coordinates, and the
earliest dart of each coordinate is kept.  Two documents agree in a coordinate with a chance equal to
their similarity.  A document that leaves a coordinate empty throws on, to twice the rank.

Candidates come from bands of coordinates.  In each bucket every member is first compared with one
leader only; where verified links leave a bucket with more than one component, the members outside the
leader's component are compared with all others, in tiles of bounded size that yield links and no
pairs.  So no pair of a bucket whose answer could matter is missed, and a bucket of mutual copies
costs its size, not its square.  Candidates are verified exactly.

Defined cases: null or empty texts (or white space alone) have no shingles and link with nothing;
texts of one to four words have one shingle, all their words; equal texts that have a word are always
in one class; rows with a null id are left out (the stage keeps them); several rows of one id count as
one node that has all their links; ids that aren't whole numbers are numbered in their order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import (
    U, components, id_numbers, int_lists, join_hot, mix, numbered, rank_in_group, seeded, shared_table, shingles, slices, unit, word_hashes, words,
)

#: Words of a shingle, bands and coordinates of a band, and the similarity of a link.  At 0.8 a pair
#: misses every band with a chance of (1 - 0.8**6)**28, about 2 in 10,000.
SHINGLE, BANDS, ROWS, LINK = 5, 28, 6, 0.8
#: Rows and columns of a tile that one task compares.
TILE = 256


def cells(texts: pa.Array, shingle: int = SHINGLE, weights: str = "log") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's unit cells (shingle, occurrence): (offsets, hashes)."""
    offsets, codes, names = words(texts)
    offsets, h = shingles(offsets, word_hashes(names)[codes], shingle)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    nth = rank_in_group(h, doc)
    # cell m of a shingle exists if it occurs m times, 2**(m-1) times or, in a set, once at all
    if weights == "count":
        return offsets, mix(h + nth.astype(U) * U(0xD1B54A32D192ED03))
    count = nth + 1
    kept = count == 1 if weights == "set" else (count & nth) == 0
    step = np.log2(count[kept]).astype(U)
    sizes = np.bincount(doc[kept], minlength=len(offsets) - 1)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), mix(h[kept] + step * U(0xD1B54A32D192ED03))


def dart_signatures(offsets: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """k dart ids for each document; zeros for a document without cells."""
    weight = np.diff(offsets)
    out = np.zeros((len(weight), k), U)
    todo, expected = np.flatnonzero(weight > 0), k * (np.log(k) + 3)
    while len(todo):
        limit = np.zeros(len(weight))
        limit[todo] = expected / weight[todo]
        live = np.repeat(limit > 0, weight)
        x, doc = cell[live], np.repeat(np.arange(len(weight)), weight)[live]
        rank, keys, ranks, ids, nth = np.zeros(len(x)), [], [], [], 0
        while len(x):
            h = seeded(x, nth)
            rank = rank - np.log(unit(h))
            hit = rank <= limit[doc]
            x, doc, rank, h = x[hit], doc[hit], rank[hit], mix(h[hit])
            keys.append(doc * k + (h % U(k)).astype(np.int64))
            ranks.append(rank)
            ids.append(h)
            nth += 1
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(ids)
        best = np.full(len(weight) * k, np.inf)
        np.minimum.at(best, key, rank)
        won = rank == best[key]
        full = np.isfinite(best.reshape(-1, k)).all(axis=1)
        got = np.zeros(len(weight) * k, U)
        got[key[won]] = dart[won]
        done = todo[full[todo]]
        out[done] = got.reshape(-1, k)[done]
        todo, expected = todo[~full[todo]], expected * 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.zeros(parts.shape[:2], U)
    for j in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return seeded(key, 1) + np.arange(bands, dtype=U)


def signature_table(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, shingle: int, weights: str) -> DataFrame:
    """(id, digest of the text, band keys) of each document that has a shingle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                offsets, cell = cells(part.column("text"), shingle, weights)
                some = np.flatnonzero(np.diff(offsets) > 0)
                keys = band_keys(dart_signatures(offsets, cell, bands * rows)[some], bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(some)), part.column("digest").take(pa.array(some)),
                     int_lists(np.arange(len(some) + 1) * bands, keys.ravel().view(np.int64), pa.int64())],
                    names=["id", "digest", "bands"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.md5(text_col).alias("digest"))
    return src.where("id is not null").mapInArrow(sign, "id long, digest string, bands array<long>")


def bag_table(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int, weights: str) -> DataFrame:
    """(id, sorted cells) of the documents in ``ids``; two rows of one id join into one bag."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                offsets, cell = cells(part.column("text"), shingle, weights)
                yield pa.RecordBatch.from_arrays([part.column("id"), int_lists(offsets, cell.view(np.int64), pa.int64())], names=["id", "bag"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids.select("id").hint("merge"), "id", "left_semi")
    return src.mapInArrow(bag, "id long, bag array<long>")


def verified(pairs: DataFrame, bags: DataFrame, link: float) -> DataFrame:
    """The pairs (a, b) whose bags have a Jaccard similarity of ``link`` or more."""
    a = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    b = bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(a, "a").join(b, "b")
    n_a, n_b = F.size("bag_a"), F.size("bag_b")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    near = F.when(F.least(n_a, n_b) >= link * F.greatest(n_a, n_b), shared >= link * (n_a + n_b - shared))
    return both.where(near).select("a", "b").distinct()


def tiled(members: DataFrame, bags: DataFrame, link: float) -> DataFrame:
    """Links (a, b) of each bucket between the members outside its main component and all others.

    ``members``: band, id, component, outside, n members and ``outs`` members outside.  Both sides are
    dealt into tiles of about ``TILE`` rows; each pair of tiles is a task of its own.
    """
    spot = F.xxhash64("id", F.lit(7))
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), tiles(n) - 1))
    one = lambda n: F.pmod(spot, tiles(n)).cast("int")
    rows = members.where("outside").select("band", "id", "component", F.lit(True).alias("row"), one("outs").alias("x"), every("n").alias("y"))
    cols = members.select("band", "id", "component", F.lit(False).alias("row"), every("outs").alias("x"), one("n").alias("y"))

    def compare(tile: pa.Table) -> pa.Table:
        row = tile["row"].to_numpy()
        ids, part = tile["id"].to_numpy(), tile["component"].to_numpy()
        bag = tile["bag"].combine_chunks()
        size = pc.list_value_length(bag).to_numpy(zero_copy_only=False).astype(np.int64)
        _, cell, uses = np.unique(bag.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(row)), size)
        number = np.cumsum(uses > 1) - 1
        some = uses[cell] > 1
        owner, cell = owner[some], number[cell[some]]
        order = np.argsort(cell, kind="stable")
        owner, cell = owner[order], cell[order]
        r, c = np.flatnonzero(row), np.flatnonzero(~row)
        shared = np.zeros((len(r), len(c)), np.float32)
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
            lo, hi = np.searchsorted(cell, [at, at + 2048])
            has = np.zeros((len(row), 2048), np.float32)
            has[owner[lo:hi], cell[lo:hi] - at] = 1
            shared += has[r] @ has[c].T
        near = (shared >= link * (size[r][:, None] + size[c][None, :] - shared)) & (part[r][:, None] != part[c][None, :])
        i, j = np.nonzero(near)
        # one link from each row to each component joins the same rows as all of them
        _, first = np.unique(np.stack([i, part[c][j]], 1), axis=0, return_index=True) if len(i) else (None, i)
        return pa.table({"a": ids[r][i[first]], "b": ids[c][j[first]]})

    both = rows.unionByName(cols).join(bags, "id")
    return both.groupBy("band", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bands: int = BANDS, rows: int = ROWS,
    shingle: int = SHINGLE, link: float = LINK, weights: str = "log",
) -> DataFrame:
    """(id_col, class_id, kept): one row for each id; the class is the smallest linked id."""
    ids = id_numbers(docs, id_col)
    if ids is not None:
        texts = shared_table(docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).join(ids.hint("merge"), "own").drop("own"))
        found = near_duplicates(texts, "number", "text", bands=bands, rows=rows, shingle=shingle, link=link, weights=weights)
        found = found.join(ids.hint("merge"), "number").select("own", F.col("class_id").alias("number")).join(ids.toDF("class_id", "number").hint("merge"), "number")
        return found.select(F.col("own").alias(id_col), "class_id", (F.col("own") == F.col("class_id")).alias("kept"))
    signed = shared_table(signature_table(docs, id_col, text_col, bands, rows, shingle, weights))
    # What is known of a digest or a bucket is stored: joins with it then deal out both sides themselves and
    # can split the rows of one digest or bucket.
    first = shared_table(signed.groupBy("digest").agg(F.min("id").alias("rep")))
    copies = signed.select("id", "digest").join(first, "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = signed.join(first.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi")
    members = reps.select("id", F.explode("bands").alias("band"))
    crowd = shared_table(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    hot = shared_table(members.join(crowd, "band"))
    # The leader is the member that shares most buckets with others: among edited copies, the original.
    # The same leaders meet the same members in many bands, so their pairs fold into few.
    shares = hot.groupBy("id").agg(F.sum("n").alias("share"))
    order = F.struct("share", F.xxhash64("id").alias("o"), "id")
    ranked = hot.join(shares, "id").select("band", order.alias("m"))
    lead = shared_table(ranked.groupBy("band").agg(F.max("m").alias("m")).select("band", F.col("m.id").alias("lead")))
    hot = shared_table(hot.select("band", "id").join(lead, "band"))
    star = hot.where("id <> lead").select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
    bags = shared_table(bag_table(docs, hot.select("id").distinct(), id_col, text_col, shingle, weights))
    links = shared_table(verified(star, bags, link))
    # Buckets that the stars leave in more than one component.
    parts = components(links, "a", "b").withColumnRenamed("node", "id")
    placed = shared_table(hot.join(parts, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"), (F.col("id") == F.col("lead")).alias("leads")))
    # A large class is one component of a bucket, so its rows are summed before they are shuffled, and meet the facts where they are.
    share = placed.groupBy("band", "component").agg(F.count("*").alias("n"), F.max("leads").alias("leads"))
    main, outs = F.max(F.when(F.col("leads"), F.col("component"))), F.sum(F.when(F.col("leads"), 0).otherwise(F.col("n")))
    facts = shared_table(share.groupBy("band").agg(main.alias("main"), F.sum("n").alias("n"), outs.alias("outs")).where("outs > 0"))
    open_ = shared_table(join_hot(placed, facts, "band").withColumn("outside", F.col("component") != F.col("main")))
    edges = copies.unionByName(links).unionByName(tiled(open_, bags, link))
    found = components(edges, "a", "b").withColumnRenamed("node", "id")
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    out = ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("class_id"))
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents without the near duplicates: one of each class stays, the one of the smallest id.

    Rows with a null id stay; of several rows with one id all stay or go together.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("gone"))
    rows = numbered(docs)
    return rows.join(gone.hint("merge"), F.col(f"_{docs.columns.index(id_col)}") == F.col("gone"), "left_anti").toDF(*docs.columns)
