"""A Merkle manifest of a dataset (operator 11): leaves for rows, a tree for each group, a tree over the groups.

The rows of a group stand in the order of their ids at places 0, 1, 2, ....  A node of level l begins at a place that
``FAN ** l`` divides and its digest stands in that row, so the node's siblings are found at fixed offsets: lag and
lead columns by ``FAN ** l`` and its multiples, masked by the node's slot in its run and by the run's length.  The first
child's row hashes the parent.  Runs never cross the borders of blocks of ``FAN ** LEVELS`` places, so the windows
are those of a block and no group, however large, meets in one task; the blocks' digests are the places of
the next tier.  A row's siblings of all levels of its block are then the last ones seen at or before it.  The tiers are climbed
once for the digests and gone down once for the siblings: a block is joined with the path of its own node, and
one deal by (group, block) serves its windows and that join.

Defined cases: a null value is hashed as ``-``, an empty text as ``0:``; rows without an id come first in their group, rows
that share an id stand in the order of their leaves, rows equal in all hashed columns are leaves of their own; a null group
comes before all others; an empty table has an empty manifest; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import in_order, join_hot, shared_table

#: Children of a node, and levels of a block.  A block has FAN ** LEVELS rows.
FAN, LEVELS = 3, 5
BLOCK = FAN**LEVELS
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of values one after another: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    told = (F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return F.sha2(F.concat(*told), 256)


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf upwards, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf makes with the siblings of its path."""
    return F.aggregate(path, leaf, lambda now, x: F.sha2(F.concat(x["left"], now, x["right"]), 256))


def climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, pos, n, node, ...) with ``block``, ``path`` inside the block, and ``up``.

    ``up`` is, in the first row of a block, the digest of the node that stands for the whole block.
    """
    run = Window.partitionBy("grp", "block").orderBy("pos")
    nodes = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("up", F.col("node"))
    for level in range(LEVELS):
        step = FAN**level
        count = F.expr(f"(n + {step - 1}) div {step}")
        at = F.expr(f"pos div {step}")
        slot = F.expr(f"(pos div {step}) % {FAN}")
        length = F.least(F.lit(FAN), count - at + slot)
        left = [F.when(slot >= k, F.lag("up", k * step).over(run)).otherwise("") for k in range(FAN - 1, 0, -1)]
        right = [F.when(slot + k < length, F.lead("up", k * step).over(run)).otherwise("") for k in range(1, FAN)]
        head = (F.col("pos") % step == 0) & (count > 1)
        nodes = nodes.withColumn(f"link{level}", F.when(head, F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))))
        first = F.when(F.col("pos") % (FAN * step) == 0, F.sha2(F.concat("up", F.col(f"link{level}.right")), 256))
        nodes = nodes.withColumn("up", F.when(count > 1, first).otherwise(F.col("up")))
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    links = [f"link{level}" for level in range(LEVELS)]
    path = F.array_compact(F.array(*(F.last(x, ignorenulls=True).over(so_far) for x in links)))
    return nodes.withColumn("path", path).drop(*links)


def tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes``, then the nodes that stand for their blocks, and so on up to one node a group; ``most``: the largest group's rows."""
    found = [nodes]
    while len(found) == 1 or most > 1:
        top = climbed(found[-1]).where(f"pos % {BLOCK} = 0")
        found.append(shared_table(top.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("up").alias("node"))))
        most = -(-most // BLOCK)
    return found


def gone_down(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier with ``path`` up to the root; ``above``: (grp, pos, path, ...) of the highest one."""
    for nodes in reversed(found[:-1]):
        high = above.withColumnRenamed("pos", "block").withColumnRenamed("path", "higher")
        above = climbed(nodes).join(high, ["grp", "block"]).withColumn("path", F.concat("path", "higher")).drop("higher", "block", "up", "node", "n")
    return above


def manifest(rows: DataFrame, carried: list[str]) -> DataFrame:
    """grp, pos, leaf, ``carried``, subroot, root, path of all rows of ``rows`` (grp, id, leaf, ``carried``).

    ``grp`` is a text without nulls whose order is that of the groups.
    """
    rows = in_order(rows.select("grp", "id", "leaf", *carried), "grp", "id", "leaf")
    groups = shared_table(rows.groupBy("grp").agg(F.count("*").alias("n"), F.min("_at").alias("_first")))
    most, n_groups = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    leaves = join_hot(rows, groups, "grp").select("grp", (F.col("_at") - F.col("_first")).alias("pos"), "n", F.col("leaf").alias("node"), "id", "leaf", *carried)
    low = tiers(leaves, most)
    subroots = in_order(low[-1].select(F.col("grp").alias("own"), "node"), "own")
    subroots = subroots.select(F.lit("").alias("grp"), F.col("_at").alias("pos"), F.lit(n_groups).alias("n"), "node", "own", F.col("node").alias("subroot"))
    high = tiers(subroots, n_groups)
    top = high[-1].select("node").first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    tree = gone_down(high, high[-1].select("grp", "pos", none.alias("path")))
    by_group = tree.select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", "subroot")
    return gone_down(low, by_group).withColumn("root", F.lit(top[0] if top else None).cast("string"))


def ordered_key(group: Column) -> Column:
    """A group's name as a key without nulls in the same order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def verified(docs: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "source", columns: list[str] = COLUMNS, text_col: str = "text") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified, levels of every row.

    The manifest is that of ``docs`` as they are.  Each row is then checked by its text as ``tampered`` gives it: its leaf made
    anew and folded with the siblings that the manifest holds.
    """
    now = digest(*(tampered if c == text_col else F.col(c) for c in columns))
    rows = docs.select(ordered_key(F.col(group_col)).alias("grp"), F.col(id_col).alias("id"), digest(*(F.col(c) for c in columns)).alias("leaf"), now.alias("now"))
    found = manifest(rows, ["now"]).withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return found.select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), F.size("path").alias("levels"),
    )


def newlines_deleted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without line feeds where 2 divides the CRC-32 of the decimal id; else as it is."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(text_col, "\n", "")).otherwise(F.col(text_col))
