"""Reading spreadsheet cells into named fields (E11-E13 and the sheet variants of E5-E10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.scalars import classify_label, strip_notes
from quayside.operators.text_reader import FIELD, KEY, LABELLED, Reading, clean_party, first_readings, reg_and_phone, said_by, shape_scan, split_goods
from quayside.sources.shared import stored


def unmerge_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells without those that a merged range covers, save its upper left one.

    A sweep down each column of a sheet: a range adds one at its first row and takes one off after its last row, in each of its columns;
    a cell is covered if the running count, less the ranges whose corner it is, is above 0.  The work is that of a sort of the cells
    and the ranges' columns, however many ranges a sheet has.
    """
    on = [*KEY, "sheet_seq"]
    ranges = merges.where("r0 <= r1 and c0 <= c1").select(*on, "c0", F.col("r0").alias("_r0"), F.col("r1").alias("_r1"), F.explode(F.sequence("c0", "c1")).alias("col"))
    begin = F.struct(F.col("_r0").alias("row"), F.lit(1).alias("step"), (F.col("col") == F.col("c0")).cast("int").alias("corner"))
    end = F.struct((F.col("_r1") + 1).alias("row"), F.lit(-1).alias("step"), F.lit(0).alias("corner"))
    events = ranges.select(*on, "col", F.inline(F.array(begin, end)))
    # a cell comes after the events of its own row
    rows = cells.select(*on, "col", "row", F.lit(0).alias("step"), F.lit(0).alias("corner"), F.lit(1).alias("_cell"), F.struct(*cells.columns).alias("_c"))
    line = rows.unionByName(events.withColumns({"_cell": F.lit(0), "_c": F.lit(None).cast(rows.schema["_c"].dataType)}))
    column = Window.partitionBy(*on, "col")
    covered = F.sum("step").over(column.orderBy("row", "_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    corners = F.sum("corner").over(column.orderBy("row").rangeBetween(Window.currentRow, Window.currentRow))
    line = line.withColumns({"_covered": covered, "_corners": corners})
    return line.where("_cell = 1 and _covered - _corners <= 0").select("_c.*")


def sheet_text(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with the text of their cells, by row, column and sheet; '' without cells."""
    line = F.sort_array(F.collect_list(F.struct("row", "col", "sheet_seq", "text")))
    texts = cells.groupBy(*KEY).agg(F.array_join(F.transform(line, lambda x: x["text"]), "\n").alias("text"))
    return docs.drop("text").join(texts, KEY, "left").withColumn("text", F.coalesce("text", F.lit("")))


def grid_values(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """The value of each label cell, as ranked fields.

    The nearest cell below within two rows counts unless it is a label; otherwise the nearest to the
    right, at any distance, unless it is a label.  Both are windows over one deal by document.
    """
    rows = cells.repartition(*KEY).withColumn("label", classify_label("text"))
    cell = F.struct("row", "col", "sheet_seq", "text", F.col("label").isNotNull().alias("is_label"))
    down = Window.partitionBy(*KEY, "col").orderBy("row").rangeBetween(1, 2)
    across = Window.partitionBy(*KEY, "row").orderBy("col").rangeBetween(1, Window.unboundedFollowing)
    below = F.min_by(cell, F.struct("row", "sheet_seq")).over(down)
    right = F.min_by(cell, F.struct("col", "sheet_seq")).over(across)
    rows = rows.withColumns({"below": below, "right": right}).where("label is not null")
    value = F.when(~F.col("below.is_label"), F.col("below.text")).when(~F.col("right.is_label"), F.col("right.text"))
    # cells come sheet by sheet, row by row; the rank keeps that order in one number
    order = Window.partitionBy(*KEY).orderBy("sheet_seq", "row", "col")
    heading = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 40)
    found = rows.select(*KEY, F.col("label").alias("field_key"), strip_notes(value).alias("raw"), heading.alias("heading"), (F.row_number().over(order) + LABELLED).cast("long").alias("rank"))
    files = docs.select(*KEY, F.col("file_name").alias("file"))
    found = found.where("raw <> ''").join(files, KEY)
    where = F.concat("file", F.lit(" cell ("), "heading", F.lit(")"))
    return found.select(*KEY, "field_key", "raw", where.alias("where"), F.lit(None).cast("string").alias("source"), "file", "rank")


def read_grid(cells: DataFrame, merges: DataFrame, docs: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> Reading:
    """Spreadsheets: E11-E13, then shapes, registration, clean-ups; the cells and what is read of them are written once."""
    own = keep(unmerge_cells(cells, merges))
    names = own.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_set(F.struct("sheet_seq", "sheet"))), lambda x: x["sheet"]).alias("sheets"))
    read = sheet_text(own, docs)
    read = keep(read if "sheets" in docs.columns else read.join(names, KEY, "left"))
    found = grid_values(own, docs).unionByName(shape_scan(read, "xlsx")).unionByName(reg_and_phone(read, "xlsx"))
    fields = keep(split_goods(clean_party(first_readings(found), read, ("consignee", "notifyParty"))).select(*FIELD))
    return Reading(fields, read, said_by(read, fields, "xlsx"))
