"""Documents of all formats through the whole job, and the pairing of headings against a plain version."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import image_reader as I
from quayside.operators import review as A
from quayside.plans.front import read_documents, whole_job
from tests.test_jobs import DOC, DRAFT, INST

KEY = ["shipment_id", "side", "doc_seq"]
REGION = "shipment_id long, side string, doc_seq int, line_idx int, pos int, x double, y double, w double, h double, text string, confidence double"


def beside(line, at, width):
    edge, got = line["x"].iloc[at] + line["w"].iloc[at], []
    for r in line[line["x"] > line["x"].iloc[at]].sort_values("x", kind="stable").itertuples():
        if r.x - edge > width * I.NEAR or r.heading:
            break
        got.append(r.text)
        edge = r.x + r.w
    return " ".join(got)


def beneath(lines, n, x, w):
    got = []
    for line in lines[n + 1 : n + 6]:
        column = line[(line["x"] - x).abs() < max(60.0, w)]
        if column.empty or column["heading"].any():
            break
        text = " ".join(column["text"])
        if got or re.search("[A-Z0-9]{2}", text):
            got.append(text)
    return "\n".join(got)


def pairs_of(pdf):
    """E19 region by region."""
    pdf = pdf.sort_values(["line_idx", "pos"], kind="stable")
    width = max(1.0, float((pdf["x"] + pdf["w"]).max()))
    lines = [g for _, g in pdf.groupby("line_idx", sort=True)]
    out = []
    for n, line in enumerate(lines):
        for at, r in enumerate(line.itertuples()):
            if r.label:
                value = beside(line, at, width)
                if not value and line["heading"].sum() < 3:
                    value = beneath(lines, n, r.x, r.w)
                out.append((r.label, value or r.inline, r.text[:34], len(out)))
    return out


def test_pairs_equal_region_by_region(spark):
    r = random.Random(21)
    words = ["1.Exporter", "2. Consignee (Name)", "Vessel", "PORT OF LOADING", "ACME LTD", "lower case", "12", "N/M", "3.", "4.Box", "Marks and", "GOODS: BOLTS", "中文", "/ Aircraft etc."]
    rows = []
    for doc in range(120):
        for line in range(r.randrange(1, 9)):
            xs = [float(r.choice([0, 40, 41, 100, 130, 160, 400, 700])) for _ in range(r.randrange(1, 6))]
            for pos, x in enumerate(xs if r.random() < 0.3 else sorted(xs)):
                w = r.choice([None, 10.0, 60.0, 90.0, 250.0])
                rows.append((doc, "B", doc % 2, line * 2, pos, x, 1.0, w, 1.0, r.choice(words), 0.9))
    rows.append((500, None, None, 0, 0, None, 1.0, None, 1.0, "Exporter: ME INC", 0.9))
    regions = spark.createDataFrame(rows, REGION).repartition(5)
    bare = F.regexp_replace("text", I.BOX_NUMBER, "")
    inline = S.trim(F.regexp_replace(S.first_label(bare)["rest"], rf"^{I.R.PARENTHESES}{I.R.WS}*", ""))
    usable = inline.rlike("[A-Z0-9]{2}") & ~inline.rlike(r"^[/(,.:;-]")
    label = S.classify_label(bare)
    heading = F.col("text").rlike(rf"{I.BOX_NUMBER}[^\s\x{{3000}}]") | label.isNotNull()
    told = regions.withColumns({"label": F.coalesce(label, F.lit("")), "heading": heading, "inline": F.when(label.isNotNull() & usable, inline).otherwise(""), "x": F.coalesce("x", F.lit(0.0)), "w": F.coalesce("w", F.lit(0.0))})
    want = {}
    for key, pdf in told.toPandas().groupby(["shipment_id"]):
        want[key[0]] = pairs_of(pdf)
    got = {}
    for x in I.ocr_pairs(regions).collect():
        got.setdefault(x["shipment_id"], []).append((x["field_key"], x["raw"], x["what"], x["rank"]))
    assert len(want) > 100
    for key, pairs in want.items():
        assert sorted(got.get(key, []), key=lambda p: p[3]) == pairs, key
    assert I.ocr_pairs(regions.limit(0)).count() == 0


@pytest.fixture(scope="module")
def inputs(spark):
    k = lambda n, *rest: (n, "B", 0, *rest)
    texts = spark.createDataFrame([(1, "A", 0, INST), (2, "A", 0, INST), (3, "A", 0, INST), (4, "A", 0, INST)], "shipment_id long, side string, doc_seq int, text string")
    manifest = [(n, "A", 0, "i.docx", "SI", None, 10) for n in (1, 2, 3, 4)] + [k(1, "d.pdf", "BL", None, 10), k(2, "s.xlsx", "BL", None, 10), k(3, "c.jpg", "BL", None, 10), k(4, "bad.bin", "BL", None, 10)]
    manifest = spark.createDataFrame(manifest, "shipment_id long, side string, doc_seq int, file_name string, kind string, mime string, size_bytes long")
    cells = spark.createDataFrame(
        [k(2, 0, "S", 1, 1, "CONSIGNEE"), k(2, 0, "S", 2, 1, "SAMPLE IMPORTER SDN BHD"), k(2, 0, "S", 5, 1, "PACKAGES: see"), k(2, 1, "T", 9, 1, "999 CTNS"), k(4, 0, "S", 1, 1, "x")],
        "shipment_id long, side string, doc_seq int, sheet_seq int, sheet string, row int, col int, text string",
    )
    merges = spark.createDataFrame([k(2, 0, 1, 1, 1, 2)], "shipment_id long, side string, doc_seq int, sheet_seq int, r0 int, c0 int, r1 int, c1 int")
    items = spark.createDataFrame([k(1, 2, 0, 75.0, 655.0, 90.0, "SAMPLE IMPORTER SDN BHD"), k(1, 1, 1, 75.0, 310.0, 90.0, "ABCD1234567 / 40HQ / SEAL77")], "shipment_id long, side string, doc_seq int, page int, item_seq int, x double, y double, w double, s string")
    regions = spark.createDataFrame([k(3, 0, 0, 40.0, 1.0, 60.0, 9.0, "2.Consignee", 0.9), k(3, 0, 1, 105.0, 1.0, 150.0, 9.0, "SAMPLE IMPORTER SDN BHD", 0.9), k(3, 1, 0, 40.0, 1.0, 60.0, 9.0, "Gross Weight", 0.9), k(3, 1, 1, 105.0, 1.0, 700.0, 9.0, "not a weight", 0.9)], REGION)
    readings = spark.createDataFrame([k(3, 0.95, -1.5)], "shipment_id long, side string, doc_seq int, confidence double, corrected_by double")
    return manifest, texts, {"cells": cells, "merges": merges, "items": items, "regions": regions, "readings": readings}


def test_whole_job_over_all_formats(spark, inputs):
    manifest, texts, decoded = inputs
    out = whole_job(manifest, texts, **decoded)
    assert {r["shipment_id"]: r["accepted"] for r in out["admitted"].collect()} == {1: True, 2: True, 3: True, 4: False}
    verdicts = {(r["shipment_id"], r["field_key"]): r["verdict"] for r in out["field_results"].collect()}
    assert {n for n, _ in verdicts} == {1, 2, 3} and len(verdicts) == 63
    assert verdicts[1, "consignee"] == verdicts[2, "consignee"] == verdicts[3, "consignee"] == "mismatch"  # side A has a second line
    assert verdicts[1, "containerNo"] == "match" and verdicts[2, "packages"] == "mismatch"
    said = {}
    for r in out["warnings"].where("side = 'B'").orderBy("shipment_id", "pos").collect():
        said.setdefault(r["shipment_id"], []).append(r["message"])
    assert said[1][0] == "PDF has 2 pages; all pages were read as one form."
    assert said[2] == ["Workbook has 2 sheets (S, T); all were read as one form.", "s.xlsx: no discharge port or final destination found."]
    assert said[3] == ["c.jpg: the page was tilted -1.5° and was straightened before reading.", "c.jpg: discarded implausible readings for grossWeight (does not look like a grossWeight value)."]
    sides = {(r["shipment_id"], r["side"]): r["warnings"] for r in out["side_attributes"].collect()}
    assert all("d.pdf: " + m in sides[1, "B"] for m in said[1]) and sides[3, "B"] == said[3]
    tally = {r["shipment_id"]: r["mismatches"] for r in out["summary"].collect()}
    assert set(tally) == {1, 2, 3}


def test_doubt_reaches_the_review(spark, inputs):
    manifest, texts, decoded = inputs
    docs = manifest.where("shipment_id < 4").withColumn("format", F.when(F.col("file_name") == "i.docx", "docx").when(F.col("file_name") == "d.pdf", "pdf").when(F.col("file_name") == "s.xlsx", "xlsx").otherwise("image"))
    docs = docs.join(texts, KEY, "left")
    moved = decoded["items"].withColumn("y", F.col("y") + 30)
    read = read_documents(docs, **{**decoded, "items": moved, "cells": decoded["cells"].where("shipment_id = 2 and text <> 'CONSIGNEE'")})
    from quayside.operators.merge import merge_side

    need = {(r["shipment_id"], r["side"]): r for r in A.assess_side(merge_side(read.fields), read.docs, read.warnings).collect()}
    assert need[2, "B"]["doubtful"] == [0] and "consignee" in need[2, "B"]["missing"]  # no consignee cell found
    assert need[1, "A"]["doubtful"] == [] and set(read.docs.columns) == {*KEY, "file_name", "kind", "format", "text"}


def test_formats_without_input_are_left_out(spark):
    docs = spark.createDataFrame([(1, "A", 0, "i.docx", "SI", "docx", INST), (1, "B", 0, "d.pdf", "BL", "pdf", DRAFT)], DOC)
    read = read_documents(docs)
    assert {r["format"] for r in read.docs.collect()} == {"docx"} and isinstance(read.fields.count(), int)
    assert pd.DataFrame(read.warnings.collect()).empty
