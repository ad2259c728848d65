"""Shared pieces of the corpus operators: hashing, tokens, shared tables, components.

Nothing here keeps rows on the driver.  Intermediate tables go to the folder named by
``spark.checkpoint.dir`` so that a lost executor costs a retry, not the job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U = np.uint64
#: Characters of text handled by one NumPy step; bounds a worker's memory, never the work.
SLICE_CHARS = 700_000


#: Shuffle files of a finished write go at its end, instead of whenever the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with more than 1 / HOT of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 2000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.  Only a local session may do without: it has one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at stored files, which go with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quayside-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables of ``shared_table`` that nothing reads any more."""
    for df in tables:
        jvm, found = df.sparkSession._jvm, df.inputFiles()
        if found:
            at = jvm.org.apache.hadoop.fs.Path(found[0]).getParent()
            if at.getName().startswith("quayside-"):
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def join_hot(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``facts``: one row for each key, with ``n``, how many rows have the key.

    Both are stored tables.  Keys with more than 1 / HOT of all rows, fewer than HOT of them, meet their facts
    where they are; all others are dealt out by key.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    often = F.broadcast(facts.where(hot))
    rest = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(facts.where(~hot).hint("merge"), key))


def with_rows(docs: DataFrame, id_col: str, payload: str, name: str) -> tuple[DataFrame, bool]:
    """``docs`` with a number of their own for different rows, in the order of ids, and whether the ids are it.

    The number of a null id is null.  Unique whole numbers are taken as they are.  Otherwise the different pairs of id and payload are numbered:
    each range of the ordered pairs by itself, after the sizes of the ranges before it.
    """
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
        if again.isEmpty():
            return docs.withColumn(name, F.col(id_col).cast("long")), True
    keyed = docs.withColumn("_tie", F.xxhash64(payload))
    pairs = keyed.select(F.col(id_col).alias("_own"), F.col("_tie").alias("_hash")).where("_own is not null").distinct()
    pairs = shared_table(pairs.repartitionByRange("_own", "_hash").withColumn("_part", F.spark_partition_id()))
    sizes = pairs.groupBy("_part").agg(F.count("*").alias("_n"))
    line = Window.orderBy("_part")  # one row for each range
    before = F.broadcast(sizes.select("_part", (F.sum("_n").over(line) - F.col("_n")).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_own", "_hash"))
    numbers = shared_table(pairs.join(before, "_part").select("_own", "_hash", (F.col("_before") + place).cast("long").alias(name)))
    found = keyed.join(numbers.hint("merge"), (F.col(id_col) == F.col("_own")) & (F.col("_tie") == F.col("_hash")), "left")
    return found.select(*(keyed[c] for c in docs.columns), name), False


def id_numbers(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(own, number) of the different ids that aren't null, numbered in their order; None for whole numbers, which stand for themselves."""
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return None
    return shared_table(in_order(docs.select(F.col(id_col).alias("own")).where("own is not null").distinct(), "own", name="number"))


def in_order(rows: DataFrame, *by: str, name: str = "_at") -> DataFrame:
    """``rows`` with their place, from 0 without gaps, in the order of ``by``: each range is numbered by itself,
    after the sizes of the ranges before it.  The ranges are stored; what is broadcast has one row for each of them."""
    cut = shared_table(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    part, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = cut.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    found = cut.withColumn("_part", part).join(F.broadcast(before), "_part")
    return found.select(*rows.columns, (F.col("_before") + within).alias(name))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns _0, _1, ..., so that no name clashes with an operator's own."""
    return docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x ^ U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``chars`` of text, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield batch.slice(at, end - at)
        at = end


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space words of each text: (offsets of texts, word numbers, dictionary of words).

    Null counts as empty.  ``offsets`` has one entry more than texts.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.utf8_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    coded = flat.filter(keep).dictionary_encode()
    return kept[offsets], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    if not len(dictionary):
        return np.zeros(0, U)
    return pd.util.hash_array(dictionary.to_numpy(zero_copy_only=False), categorize=False)


def shingles(offsets: np.ndarray, h: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words: (offsets of texts, hashes).

    A text of 1 to k-1 words has one shingle, all its words; an empty text has none.
    """
    n = np.diff(offsets)
    m = len(h)
    acc = np.zeros(m, U)
    odd = U(0x9E3779B97F4A7C15)
    for j in range(k):
        acc *= odd
        if j < m:
            acc[: m - j] += h[j:]
    acc = mix(acc)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    for i in np.flatnonzero((n > 0) & (n < k)):  # short texts: their own words only
        part = U(int(n[i]))
        for x in h[offsets[i] : offsets[i + 1]]:
            part = mix(np.array([part ^ x], U) * odd)[0]
        acc[offsets[i]] = part
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], count)
    return out, acc[at]


def by_plane(x: np.ndarray) -> bytes:
    """Numbers in few bytes: first all their first bytes, then all second ones, and so on, compressed."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def from_planes(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    flat = pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n // size).T).view(kind).ravel()


def rank_in_group(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for the first, second, third time that a value occurs in its group."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty(len(v), np.int64)
    out[order] = np.arange(len(v)) - start
    return out


def int_lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest id reachable over undirected edges; only nodes with edges.

    Alternates large-star and small-star steps.  Each takes a minimum by key (summed before the
    shuffle) and joins it back.  The minima are stored; a node with very many neighbours meets its
    minimum where its rows are (``join_hot``), so that no task gets all of them.
    """
    cur = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    cur = shared_table(cur)
    before = None
    while True:
        now = tuple(cur.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == before or not now[0]:
            return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = now
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = shared_table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_hot(both.where("v > u"), low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = shared_table(large.unionByName(low.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        least = shared_table(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = (
            large.join(least.hint("merge"), "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
        )
        new = shared_table(small.distinct())
        drop_shared(cur, low, large, least)
        cur = new
