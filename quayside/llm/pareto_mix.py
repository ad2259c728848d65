"""Mixing sources to target weights (operator 3): Pareto order sampling of whole documents.

Each source has a target in words: its weight's share of all words, at most ``MAX_COPIES`` times its
own words, the excess shared again by weight until no source is above.  With ratio = target / words,
every document of the source is taken floor(ratio) times for certain.  The rest of the target comes
from a sample without replacement: a document's inclusion probability is ratio - floor(ratio) times its
chance, by default its size over the source's mean size, from 1 / ``TILT`` to ``TILT``; documents rank by
their random odds u / (1 - u) divided by their inclusion odds p / (1 - p), with u from a hash of the id, and
the sample is the first of them whose words fill the remaining target.  The sample's size is fixed in words.

No source is sorted whole: words are summed by source and rank bin, and only the bin in which the sum
passes what is open is ranked row by row.  Documents of more words than are open are passed over, and the
ranking is gone down ``PASSES`` times; of the documents that then remain the one whose words come nearest
to what is still open joins if that brings the sum nearer to the target.  All random numbers come from
hashes, so reruns agree.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source of its own,
ranked last; sources without words have target 0; an empty table gives an empty result; rows of one id
in one source share their random number, and equal rows take their turn in any order; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import numbered, shared_table

MAX_COPIES, BINS, SEED, PASSES, TILT = 3, 4096, 29, 3, 2.0
#: Up to so many sources, what is known of each (a row of under 100 bytes) goes to every executor; beyond
#: it the joins by source are sort-merge joins, whose large partitions are split at run time.
FEW_SOURCES = 50_000
#: Fixed pattern of a word: a run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weight: Column, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, source_docs, target): one row for each source of ``sizes`` (the same without target).

    ``weight`` is computed over rows that also have ``place``: the source's place by code point from 0,
    null last.  A target is min(max_copies * source_size, level * weight), with the level at which all
    targets make up all words: the one that resharing every excess by weight ends at.
    """
    # one row for each source, so these windows hold sources only
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    t = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("w", weight.cast("double"))
    t = t.withColumn("cap", F.col("source_size") * max_copies)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    t = t.withColumn("turn", F.row_number().over(by_cap))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("turn", "level"))
    t = t.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    return t.select("source", "source_size", "source_docs", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def by_source(few: bool, sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if few else sources.hint("merge")


def ranked(docs: DataFrame, targets: DataFrame, few: bool, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """``docs`` (id, source, size, chance ``cw`` or null) with what their source takes, their rank ``q`` and its ``bin``."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-12)
    t = targets.select(F.col("source").alias("s"), "source_size", "source_docs", "target", whole.alias("certain"))
    t = t.withColumn("open", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size")))
    d = docs.join(by_source(few, t), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    some = F.col("source_size") > 0
    share = F.when(some, F.col("open") / F.col("source_size")).otherwise(F.lit(0.0))
    by_size = F.when(some, F.least(F.greatest(F.col("size") * F.col("source_docs") / F.col("source_size"), F.lit(1 / TILT)), F.lit(TILT))).otherwise(F.lit(1.0))
    p = F.least(F.greatest(share * F.coalesce("cw", by_size), F.lit(1e-9)), F.lit(1 - 1e-9))
    # 48 bits of a hash that SQL engines share
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    q = (u / (1 - u)) / (p / (1 - p))
    d = d.withColumn("q", q).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("int"))
    return d.select("id", "source", "size", "source_size", "target", "certain", "open", "q", "bin", F.lit(False).alias("in"))


def left_open(d: DataFrame) -> DataFrame:
    """(s, left): the words that a source's sample still lacks."""
    got = F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))
    return d.groupBy("source").agg((F.max("open") - got).alias("left")).select(F.col("source").alias("s"), "left")


def taken_further(d: DataFrame, few: bool) -> DataFrame:
    """One pass down the ranking: documents not yet in that fit what is left, as many as fill it, are in."""
    d = d.join(by_source(few, left_open(d)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("fits", ~F.col("in") & (F.col("left") > 0) & (F.col("size") <= F.col("left")))
    sums = d.where("fits").groupBy("source", "bin", "left").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    # bins of a source are at most ``BINS`` rows
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    edge = sums.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
    edge = edge.groupBy("source").agg(F.min(F.struct("bin", "before")).alias("e"))
    edge = edge.select(F.col("source").alias("s"), F.col("e.bin").alias("edge"), F.col("e.before").alias("before"))
    d = d.join(by_source(few, edge), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rim = F.col("fits") & F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))
    sure = F.col("in") | (F.col("fits") & F.coalesce(F.col("bin") < F.col("edge"), F.lit(True)))
    line = Window.partitionBy("source").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = d.where(~rim).withColumn("in", sure)
    outer = d.where(rim).withColumn("in", F.col("before") + F.sum("size").over(line) <= F.col("left"))
    return inner.unionByName(outer).drop("left", "fits", "edge", "before")


def mix(docs: DataFrame, weight: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        chance: Column | None = None, max_copies: int = MAX_COPIES) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) of every document.

    ``chance`` (default: by size) tilts the inclusion probabilities within a source.
    """
    d = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (chance if chance is not None else F.lit(None)).cast("double").alias("cw"),
    )
    d = shared_table(d)
    targets = shared_table(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")), weight, max_copies))
    few = targets.count() <= FEW_SOURCES
    took = ranked(d, targets, few)
    for _ in range(PASSES):
        took = shared_table(taken_further(took, few))
    # what the sample leaves open, and the document left out that comes nearest to it
    took = took.join(by_source(few, left_open(took).withColumnRenamed("left", "gap")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    off = F.abs(F.col("gap") - F.col("size"))
    out = (~F.col("in")) & (off < F.col("gap")) & (F.col("certain") < max_copies)
    best = took.where(out).groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "id")).alias("b")).select(F.col("source").alias("s"), F.col("b.id").alias("extra"))
    took = took.join(by_source(few, best), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    more = F.col("in") | F.coalesce(F.col("id") == F.col("extra"), F.lit(False))
    copies = (F.col("certain") + F.when(more, 1).otherwise(0)).cast("int")
    return took.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeating_weight() -> Column:
    """Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ..."""
    return F.col("place") % 3 + 1


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document as often as the mix takes it; columns and other values stay as they are.

    Documents that the mix leaves out go; rows with a null id stay once.
    """
    took = mix(docs, repeating_weight(), id_col, text_col, source_col).select(F.col(id_col).alias("id"), "copies")
    took = took.where("id is not null").groupBy("id").agg(F.max("copies").alias("copies"))
    rows = numbered(docs)
    own = rows.columns
    rows = rows.join(took.hint("merge"), F.col(own[docs.columns.index(id_col)]) == F.col("id"), "left")
    times = F.when(F.col("id").isNull(), 1).otherwise(F.col("copies"))
    return rows.select(*own, F.explode(F.array_repeat(F.lit(1), times)).alias("nth")).select(*own).toDF(*docs.columns)
