"""From admitted documents of all four formats to what the whole job compares."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.grid_reader import read_grid
from quayside.operators.image_reader import read_images
from quayside.operators.page_reader import read_pages
from quayside.operators.text_reader import KEY, Reading, doc_warnings, extract_directives, read_text
from quayside.plans.reconcile import accepted, reconcile
from quayside.sources.intake import admit, detect_format
from quayside.sources.shared import stored

DOC = [*KEY, "file_name", "kind", "format", "text"]
Keep = Callable[[DataFrame], DataFrame]


class Paperwork(NamedTuple):
    """Documents with their text, fields, instructions and warnings of all formats."""

    docs: DataFrame
    fields: DataFrame
    directives: DataFrame
    warnings: DataFrame


def read_documents(docs: DataFrame, cells: DataFrame | None = None, merges: DataFrame | None = None, items: DataFrame | None = None, regions: DataFrame | None = None, readings: DataFrame | None = None, keep: Keep = stored) -> Paperwork:
    """Each document by the reader of its format: docx, xlsx, pdf, image.

    ``docs`` (key, file_name, kind, format, text): the text of docx documents, null for others.  ``cells`` and ``merges``, ``items``, and ``regions``
    with ``readings`` are the decoded inputs of the other formats; a format without its input is left out.
    """
    of = lambda style: docs.where(F.col("format") == style)
    texts = keep(of("docx").select(*DOC))
    fields = keep(read_text(texts))
    read = {"docx": Reading(fields, texts, doc_warnings(texts, fields))}
    if cells is not None:
        read["xlsx"] = read_grid(cells, merges, of("xlsx"), keep)
    if items is not None:
        read["pdf"] = read_pages(items, of("pdf"), keep)
    if regions is not None:
        read["image"] = read_images(regions, of("image"), readings, keep)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    # drafts in page form give no instructions
    directives = union(extract_directives(r.docs, style) for style, r in read.items() if style != "pdf")
    return Paperwork(union(r.docs.select(*DOC) for r in read.values()), union(r.fields for r in read.values()), directives, union(r.warnings for r in read.values()))


def whole_job(manifest: DataFrame, texts: DataFrame, keep: Keep = stored, **decoded: DataFrame) -> dict[str, DataFrame]:
    """Admission, reading by format and reconciling: all result tables of the shipments that admission lets in.

    ``manifest`` (key, file_name, kind, mime, size_bytes), ``texts`` (key, text) of docx documents, ``decoded`` as in ``read_documents``.
    """
    admitted = admit(manifest)
    own = manifest.where("size_bytes > 0").withColumn("format", detect_format("file_name", "mime"))
    docs = keep(accepted(own, admitted).join(texts.select(*KEY, "text"), KEY, "left").select(*DOC))
    let_in = docs.select("shipment_id").distinct()
    inside = {name: df if name == "readings" else df.join(let_in, "shipment_id", "left_semi") for name, df in decoded.items() if df is not None}
    read = read_documents(docs, keep=keep, **inside)
    return reconcile(read.docs, read.fields, read.directives, read.warnings, keep) | {"admitted": admitted, "warnings": read.warnings}
