"""Sources and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside import rules as R
from quayside.functions.scalars import trim
from quayside.operators.text_reader import KEY


def detect_format(file_name: Column | str, mime: Column | str) -> Column:
    """Docx, pdf, xlsx or image by extension, then by MIME type; null if neither tells."""
    name = F.lower(F.col(file_name) if isinstance(file_name, str) else file_name)
    kind = F.coalesce(F.col(mime) if isinstance(mime, str) else mime, F.lit(""))
    return (
        F.when(name.endswith(".docx"), "docx").when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.(?:xlsx|xlsm)\z"), "xlsx")
        .when(name.rlike(r"\.(?:jpg|jpeg|png|webp|bmp|tif|tiff|heic)\z"), "image")
        .when(kind == "application/pdf", "pdf").when(F.contains(kind, F.lit("wordprocessingml")), "docx")
        .when(F.contains(kind, F.lit("spreadsheetml")), "xlsx").when(kind.startswith("image/"), "image")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Submitted files under ``path``/<shipment>/<A or B>/<file>, without empty ones and without their content.

    A shipment's folder is its id in plain decimal digits; files of other folders have a null id.  ``folders.read_folders`` lists
    folders in tasks and takes filters, for file systems that pyarrow reaches.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    part = lambda n: F.regexp_extract("path", r"/([^/]+)/([AB])/([^/]+)\z", n)
    own = F.when(part(1).rlike(r"\A(?:0|-?[1-9][0-9]*)\z"), part(1))
    rows = files.select(own.try_cast("long").alias("shipment_id"), part(2).alias("side"), part(3).alias("file_name"), F.lit(None).cast("string").alias("mime"), F.col("length").alias("size_bytes"))
    return submitted(rows.where("side <> ''"))


def submitted(manifest: DataFrame) -> DataFrame:
    """A manifest's files that aren't empty, with ``doc_seq`` by file name (then size) within each side."""
    order = Window.partitionBy("shipment_id", "side").orderBy("file_name", "size_bytes")
    return manifest.where("size_bytes > 0").select("shipment_id", "side", (F.row_number().over(order) - 1).cast("int").alias("doc_seq"), "file_name", "mime", "size_bytes")


def admit(manifest: DataFrame, max_files: int = R.MAX_FILES, max_bytes: int = R.MAX_BYTES) -> DataFrame:
    """S3: (shipment_id, accepted, reason): the first reason against a shipment, side A before B.

    One row for each shipment of the manifest, also for one whose other side is empty; a null shipment id
    is turned down as such.
    """
    live = manifest.where("size_bytes > 0")
    form = detect_format("file_name", "mime")
    bad = F.when(F.col("size_bytes") > max_bytes, F.concat("file_name", F.lit(" is too large."))).when(form.isNull(), F.concat("file_name", F.lit(" is not a readable format.")))
    side = live.withColumn("bad", bad).groupBy("shipment_id", "side").agg(F.count("*").alias("n"), F.min(F.when(F.col("bad").isNotNull(), F.struct("doc_seq", "bad"))).alias("worst"))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = manifest.select("shipment_id").distinct().join(
        side.groupBy("shipment_id").agg(*(pick(s, c).alias(f"{c}_{s.lower()}") for s in "AB" for c in ("n", "worst"))).withColumnRenamed("shipment_id", "_id"),
        F.col("shipment_id").eqNullSafe(F.col("_id")), "left",
    ).drop("_id")
    reason = F.when(F.col("shipment_id").isNull(), "The shipment has no id.")
    for s in "AB":
        n, worst = F.coalesce(F.col(f"n_{s.lower()}"), F.lit(0)), F.col(f"worst_{s.lower()}")
        reason = reason.when(n == 0, f"Side {s} has no file.").when(n > max_files, f"Side {s} has more than {max_files} files.").when(worst.isNotNull(), worst["bad"])
    return both.select("shipment_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Text lines (key, line_no, text) with one line end for all systems."""
    return lines.select(*KEY, "line_no", F.regexp_replace("text", "\r\n?", "\n").alias("text"))


def clean_cells(cells: DataFrame) -> DataFrame:
    """Cells (key, sheet_seq, sheet, row, col, text), blanks and tabs collapsed, empty ones dropped."""
    text = trim(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"[ \t]+", " "))
    return cells.select(*KEY, "sheet_seq", "sheet", "row", "col", text.alias("text")).where("text <> ''")


def clean_items(items: DataFrame) -> DataFrame:
    """Positioned items (key, page, item_seq, x, y, w, s), blank ones dropped."""
    return items.select(*KEY, "page", "item_seq", "x", "y", F.coalesce("w", F.lit(0.0)).alias("w"), "s").where(trim("s") != "")


def clean_regions(regions: DataFrame) -> DataFrame:
    """Recognised regions (key, line_idx, pos, x, y, w, h, text, confidence), blank ones dropped."""
    return regions.select(*KEY, "line_idx", "pos", "x", "y", "w", "h", trim("text").alias("text"), "confidence").where("text <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return clean_lines(spark.read.parquet(path))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return clean_cells(spark.read.parquet(path))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return clean_items(spark.read.parquet(path))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return clean_regions(spark.read.parquet(path))
