"""Document fingerprints (operator 6): closed syncmers, in DataFrame functions only.

A text's tokens are its lower-cased words: runs without ASCII white space.  In a run of more than
``TOKEN_CHARS`` characters, as in scripts without blanks, each character is a token, so no cut depends on
where the run begins.  A k-mer is ``K`` tokens; its inner s-mers are pairs of neighbouring tokens.  The k-mer is a closed
syncmer if its least hashed s-mer is its first or its last one, which depends on its own tokens alone:
an edit disturbs the syncmers that touch it and no others, so those of an untouched passage stay the
same wherever the passage moves.  A text in which no k-mer is closed has its least hashed k-mer instead.

A fingerprint lists anchors: all different syncmers, each as 16 hex digits, in the order of their first
places in the text, joined by blanks.  The likeness of two fingerprints is the share of common anchors
among all of both (the Jaccard similarity of the syncmers) times the share of common anchors that follow
their common neighbour in both texts: anchors match by position, not only by value.

Defined cases: null text counts as empty; texts of under K tokens have one anchor, the hash of all
their tokens; texts without a token have the empty fingerprint; two empty fingerprints have likeness 1,
an empty and another one 0; equal texts have equal fingerprints; the next document is the one of the
next smaller id, and of the least id the one of the greatest; a single document is its own next; rows
of one id follow each other in the order of their texts' hashes; rows with null ids come last; ids that
aren't whole numbers are numbered in their order; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import id_numbers, shared_table

K, TOKEN_CHARS = 5, 24
#: A word between blanks, else one character of a longer run.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,%d}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]" % TOKEN_CHARS
HASHES = "array<bigint>"


def with_value(value: Column, of) -> Column:  # noqa: ANN001
    """``of(value)`` as an array of hashes, with the value computed once."""
    return F.aggregate(F.array(value), F.lit(None).cast(HASHES), lambda _, x: of(x))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, as one expression."""
    return written(anchors(text))


def written(x: Column) -> Column:
    """Anchors as a fingerprint."""
    return F.array_join(F.transform(x, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " ")


def anchors(text: Column) -> Column:
    """The anchors of a text: hashes of its syncmers in the order of their first places."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return with_value(F.transform(tokens, lambda w: F.xxhash64(w)), anchored)


def anchored(h: Column) -> Column:
    """Anchors of an array of token hashes."""
    n = F.size(h)
    # s-mer i is the pair of tokens i and i+1
    pairs = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))

    def chosen(s: Column) -> Column:
        edge = lambda i: F.least(F.get(s, i), F.get(s, i + K - 2))
        inner = lambda i: F.least(*(F.get(s, i + j) for j in range(1, K - 2)))
        mer = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K)))
        closed = F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), n - K), lambda i: edge(i) <= inner(i)), mer))
        return F.when(F.size(closed) > 0, closed).otherwise(F.array(F.array_min(F.transform(F.sequence(F.lit(0), n - K), mer))))

    return F.when(n == 0, F.array().cast(HASHES)).when(n < K, F.array(F.xxhash64(h))).otherwise(with_value(pairs, chosen))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two texts by their anchors, 0 to 1."""
    by_hash = lambda x: F.array_sort(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def ordered(left: Column, right: Column) -> Column:
        # the same hashes on both sides, so sorting by hash puts them side by side; then each one's place in b by its place in a
        at = F.array_sort(F.zip_with(by_hash(left), by_hash(right), lambda x, y: F.struct(x["i"].alias("a"), y["i"].alias("b"))))
        places = F.transform(at, lambda x: x["b"].cast("long"))
        rising = with_value(places, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: (y > x).cast("long")))
        return F.aggregate(rising, F.lit(0).cast("long"), lambda n, x: n + x)

    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    kept = F.when(common > 1, ordered(F.array_intersect(a, b), F.array_intersect(b, a)) / (common - 1)).otherwise(F.lit(1.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(common == 0, 0.0).otherwise(common / union * kept)


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, tie, next_id, next_tie): the row of next smaller (id, tie); after the least, the greatest.

    Rows are dealt out by ranges of ids; each range finds its neighbours by itself, and the ends of the
    ranges, one row each, are joined over the ranges.
    """
    part = shared_table(ids.repartitionByRange("id", "tie").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("id", "tie")
    row = F.struct("id", "tie")
    part = part.withColumn("next", F.lag(row).over(inside))
    ends = part.groupBy("part").agg(F.max(row).alias("top"))
    line = Window.orderBy("part")  # one row for each range
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("top").over(line), F.max("top").over(everything)).alias("below"))
    part = part.join(F.broadcast(ends), "part").withColumn("next", F.coalesce("next", "below"))
    return part.select("id", "tie", F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) characters replaced by the first as
    many (or all) of the next document.
    """
    ids = id_numbers(docs, id_col)
    if ids is not None:
        texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).join(ids.hint("merge"), "own", "left").drop("own")
        found = fingerprints(texts, "number", "text").join(ids.hint("merge"), "number", "left")
        return found.select(F.col("own").alias(id_col), *found.columns[1:-1])
    text = F.coalesce(F.col(text_col), F.lit(""))
    # null ids sort below all others
    none = -(1 << 63)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = d.select("id", "tie", F.length("text").alias("n")).distinct()
    links = neighbours(rows.select("id", "tie"))
    wants = rows.join(links, ["id", "tie"]).select("next_id", "next_tie", F.col("id").alias("of"), F.col("tie").alias("of_tie"), F.floor(F.col("n") / 3).alias("m"))
    # Both sides of the two joins below are dealt out once, by the same exchange.
    base = d.select("id", "tie", "text").repartition("id", "tie")
    heads = base.join(wants, (F.col("id") == F.col("next_id")) & (F.col("tie") == F.col("next_tie")))
    # the whole next text travels: its anchors, of eight bytes that don't compress, would be more
    heads = heads.select("of", "of_tie", "m", F.col("text").alias("next_text"))
    heads = heads.dropDuplicates(["of", "of_tie"])
    e = base.join(heads, (F.col("id") == F.col("of")) & (F.col("tie") == F.col("of_tie")))
    n = F.length("text")
    e = e.select("id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), (n - F.col("m")).cast("int")), F.substring("next_text", F.lit(1), F.col("m").cast("int"))).alias("edited"), anchors(F.col("text")).alias("print"), anchors(F.col("next_text")).alias("next_print"))
    e = e.withColumn("edited_print", anchors(F.col("edited")))
    return e.select(
        F.when(F.col("id") != none, F.col("id")).alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
