"""Merging the documents of one side (B1-B5): the first document that states something wins.

"First" is always the smallest ``doc_seq`` (then position), never the order in which rows arrive.  Where
the input is already dealt out by ``shipment_id``, none of these shuffles it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside import rules as R
from quayside.functions.scalars import find_emails, label_for, literal_map, norm_text, normalize_for

SIDE = ["shipment_id", "side"]


def merge_side(fields: DataFrame) -> DataFrame:
    """B1: (shipment_id, side, field_key, raw, where, source, file)."""
    held = F.min_by(F.struct("raw", "where", "source", "file"), "doc_seq")
    return fields.groupBy(*SIDE, "field_key").agg(held.alias("h")).select(*SIDE, "field_key", "h.raw", "h.where", "h.source", "h.file")


def comparator_of(key: Column | str) -> Column:
    kinds = literal_map(R.COMPARATOR)
    return F.coalesce(F.try_element_at(kinds, F.col(key) if isinstance(key, str) else key), F.lit("text"))


def agrees(key: Column, x: Column, y: Column) -> Column:
    """Whether a field's own comparator takes two values as one; plain text where it can't read either."""
    kind = comparator_of(key)
    a, b = normalize_for(kind, x), normalize_for(kind, y)
    return F.when(a.isNull() | b.isNull(), norm_text(x) == norm_text(y)).otherwise(a == b)


def side_conflicts(fields: DataFrame) -> DataFrame:
    """B2: (shipment_id, side, field_key, label, values): the held value, then each one that disagrees with it."""
    order = Window.partitionBy(*SIDE, "field_key").orderBy("doc_seq")
    rows = fields.withColumn("held", F.first(F.struct(F.col("doc_seq").alias("seq"), "file", "raw")).over(order))
    odd = rows.where(F.col("doc_seq") > F.col("held.seq")).where(~agrees(F.col("field_key"), F.col("held.raw"), F.col("raw")))
    other = odd.groupBy(*SIDE, "field_key", "held", "raw").agg(F.min(F.struct(F.col("doc_seq").alias("seq"), "file")).alias("m"))
    value = F.struct(F.col("m.seq").alias("seq"), F.col("m.file").alias("file"), "raw")
    out = other.groupBy(*SIDE, "field_key", "held").agg(F.sort_array(F.collect_list(value)).alias("others"))
    return out.select(*SIDE, "field_key", label_for("field_key").alias("label"), F.concat(F.array("held"), "others").alias("values"))


def merge_directives(directives: DataFrame) -> DataFrame:
    """Each instruction of a side once."""
    same = F.upper(F.regexp_replace(F.concat("forbid_kind", F.lit(":"), F.coalesce("forbid_value", "raw")), rf"{R.WS}+", ""))
    first = Window.partitionBy(*SIDE, same).orderBy("doc_seq", "pos")
    return directives.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def merge_discovered(discovered: DataFrame) -> DataFrame:
    """Each free label of a side once."""
    first = Window.partitionBy(*SIDE, "label_key").orderBy("doc_seq", "pos")
    return discovered.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def merge_attributes(docs: DataFrame, warnings: DataFrame) -> DataFrame:
    """(shipment_id, side, emails, text, warnings) of each side."""
    said = warnings.groupBy(*SIDE, "doc_seq").agg(F.sort_array(F.collect_list(F.struct("pos", "message"))).alias("w"))
    rows = docs.select(*SIDE, "doc_seq", "file_name", "text", find_emails("text").alias("emails")).join(said, [*SIDE, "doc_seq"], "left")
    name = F.col("file_name")
    tagged = F.transform(F.coalesce("w", F.array()), lambda x: F.when(F.contains(x["message"], name), x["message"]).otherwise(F.concat(name, F.lit(": "), x["message"])))
    rows = rows.withColumn("w", F.when(F.col("w").isNull(), F.array().cast("array<string>")).otherwise(tagged))
    out = rows.groupBy(*SIDE).agg(F.sort_array(F.collect_list(F.struct("doc_seq", "text", "emails", "w"))).alias("d"))
    part = lambda field: F.transform("d", lambda x: x[field])
    return out.select(*SIDE, F.array_distinct(F.flatten(part("emails"))).alias("emails"), F.array_join(part("text"), "\n").alias("text"), F.flatten(part("w")).alias("warnings"))
