"""Reading, merging and comparing small shipments, and what must not depend on row order."""

import pytest
from pyspark.sql import functions as F

from quayside.operators import compare as C
from quayside.operators import merge as M
from quayside.operators import text_reader as T
from quayside.plans.reconcile import accepted, reconcile
from quayside.sources.intake import admit, read_manifest, submitted
from quayside.sources.report import assemble_report, read_report, write_report

DOC = "shipment_id long, side string, doc_seq int, file_name string, kind string, format string, text string"
FIELD = "shipment_id long, side string, doc_seq int, field_key string, raw string, where string, source string, file string"

INST = """CONSIGNEE:
SAMPLE IMPORTER SDN BHD
LOT 5, JALAN BESAR
(202301043310 / MA0123456)
TEL: 03-388 8648


WEST PORT


DESCRIPTION: BOLTS 7318.15.00
1,000 CTNS  8,263.00 KGS  65.44 CBM
ABCD1234567
船公司:WHL  开航日期:2026-08-28
(email : a@b.com 只提供不显示在提单)
(提单不显示海关编码)"""
DRAFT = """ABCD1234567 / 40'HQ / SEAL77 / 999 CTNS / 8263.000KGS
CONTACT xa@b.com.my
HS CODE 7318.15.00
船公司: YML"""


def docs(spark, *rows):
    return spark.createDataFrame([(1, s, n, f, k, fmt, t) for s, n, f, k, fmt, t in rows], DOC)


def fields(spark, rows):
    return spark.createDataFrame([(i, s, n, k, v, "w", src, f"{s}{n}") for i, s, n, k, v, src in rows], FIELD)


def test_reading_an_instruction(spark):
    got = {r["field_key"]: r["raw"] for r in T.read_text(docs(spark, ("A", 0, "i.docx", "SI", "docx", INST))).collect()}
    assert got["consignee"] == "SAMPLE IMPORTER SDN BHD\nLOT 5, JALAN BESAR"
    assert got["consigneeRegNo"] == "202301043310 / MA0123456" and got["consigneePhone"] == "03-388 8648"
    assert got["portOfDischarge"] == got["placeOfDelivery"] == got["finalDestination"] == "WEST PORT"
    assert got["packages"] == "1,000 CTNS" and got["grossWeight"] == "8,263.00 KGS" and got["measurement"] == "65.44 CBM" and got["containerNo"] == "ABCD1234567"
    assert got["hsCodes"] == "73181500" and got["goods"].startswith("BOLTS")


def test_double_spacing(spark):
    text = "\n\n".join(["CONSIGNEE:", "SAMPLE IMPORTER", "LOT 5", "KLANG TOWN"]) + "\n\n\nOTHER"
    got = {r["field_key"]: r["raw"] for r in T.read_text(docs(spark, ("A", 0, "i.docx", "SI", "docx", text))).collect()}
    assert got["consignee"] == "SAMPLE IMPORTER\nLOT 5\nKLANG TOWN"


def test_free_pairs(spark):
    text = "船公司:WHL  开航日期:2026-08-28\nA one: x B two: y\nCONSIGNEE: z\nTEL: 12345\nLABEL: LABEL\nno pairs here"
    got = [(r["label"], r["value"]) for r in T.discover_pairs(docs(spark, ("A", 0, "f", "SI", "docx", text))).orderBy("pos").collect()]
    assert got[:2] == [("船公司", "WHL"), ("开航日期", "2026-08-28")] and all("CONSIGNEE" not in a and a != "LABEL" for a, _ in got)


def test_whole_job(spark):
    d = docs(spark, ("A", 0, "i.docx", "SI", "docx", INST), ("B", 0, "d.pdf", "BL", "pdf", DRAFT))
    f = T.read_text(d)
    out = reconcile(d, f, T.extract_directives(d), T.doc_warnings(d, f))
    verdicts = {r["directive"]["forbid"]["kind"]: r["verdict"] for r in out["directive_results"].collect()}
    assert verdicts == {"email": "violated", "hsCodes": "violated"}  # a@b.com is contained in xa@b.com.my
    by = {r["field_key"]: r["verdict"] for r in out["field_results"].collect()}
    assert by["packages"] == "mismatch" and by["grossWeight"] == "equivalent" and by["containerNo"] == "match" and by["shipper"] == "missing_on_b" and by["soNo"] == "absent_both"
    tally = out["summary"].first()
    assert tally["violations"] == 2 and tally["mismatches"] == 1
    assert [r["verdict"] for r in out["discovered_results"].orderBy("rank").collect()] == ["mismatch", "a_only"]
    found = out["findings"].orderBy("rank").collect()
    assert found[0]["total"] == len(found)
    report = assemble_report(out).first()
    assert len(report["fields"]) == 21 and report["fields"][0]["field_key"] == "shipper" and report["summary"]["mismatches"] == 1
    assert out["side_attributes"].where("side = 'A'").first()["emails"] == ["a@b.com"]


CASES = [
    ("consignee", "ACME\nKL, MALAYSIA", None, "ACME KL", None, "equivalent"), ("consignee", "ACME", None, "ACNE", None, "mismatch"), ("containerNo", "ABCD0000001", None, "ABCDOOOOOOI", "ocr", "equivalent"),
    ("containerNo", "ABCD0000001", None, "ABCDOOOOOOI", None, "mismatch"), ("portOfDischarge", "NORTH PORT", None, "PORT KLANG", None, "equivalent"), ("portOfDischarge", "NORTH PORT", None, "WEST PORT", None, "mismatch"),
    ("portOfDischarge", "ROTTERDAM", None, "Rotterdam", None, "match"), ("packages", "816 CTNS", None, "816CARTONS", None, "equivalent"), ("packages", "x", None, "y", None, "mismatch"),
    ("goods", "a | b", None, "b | a", None, "equivalent"), ("goods", "a, b", None, "b, a", None, "mismatch"), ("freightTerms", "X", None, " X ", None, "match"), ("sealNo", "中", None, "文", None, "equivalent"),
]


def test_verdict_ladder(spark):
    rows = [(i, s, 0, k, v, src) for i, (k, a, sa, b, sb, _) in enumerate(CASES) for s, v, src in (("A", a, sa), ("B", b, sb))]
    out = C.field_verdicts(C.destination_fallback(C.align_sides(M.merge_side(fields(spark, rows)))))
    got = {(r["shipment_id"], r["field_key"]): r["verdict"] for r in out.collect()}
    assert [got[i, c[0]] for i, c in enumerate(CASES)] == [c[5] for c in CASES]


def test_verdicts_are_symmetric(spark):
    rows = [(i, s, 0, k, v, src) for i, (k, a, sa, b, sb, _) in enumerate(CASES) for s, v, src in (("B", a, sa), ("A", b, sb))]
    out = C.field_verdicts(C.destination_fallback(C.align_sides(M.merge_side(fields(spark, rows)))))
    got = {(r["shipment_id"], r["field_key"]): r["verdict"] for r in out.collect()}
    assert [got[i, c[0]] for i, c in enumerate(CASES)] == [c[5] for c in CASES]


def test_destination_stands_in(spark):
    rows = [(1, "A", 0, "portOfDischarge", "WEST PORT", None), (1, "B", 0, "finalDestination", "PORT KELANG(W)", None)]
    out = {r["field_key"]: r for r in C.field_verdicts(C.destination_fallback(C.align_sides(M.merge_side(fields(spark, rows))))).collect()}
    assert out["portOfDischarge"]["verdict"] == "equivalent" and "B states this as finalDestination" in out["portOfDischarge"]["note"]
    assert out["finalDestination"]["verdict"] == "equivalent" and "A states this as portOfDischarge" in out["finalDestination"]["note"]


@pytest.mark.parametrize("parts", [1, 7])
def test_merge_ignores_row_order(spark, parts):
    rows = [(1, "A", n, "packages", v, None) for n, v in enumerate(["5 CTNS", "5CARTONS", "6 CTNS", "7 CTNS", "6 CTNS"])] + [(1, "A", 2, "grossWeight", "5 KGS", None)]
    f = fields(spark, rows[::-1]).repartition(parts)
    assert {r["field_key"]: r["raw"] for r in M.merge_side(f).collect()} == {"packages": "5 CTNS", "grossWeight": "5 KGS"}
    conflict = M.side_conflicts(f).first()
    assert [(v["file"], v["raw"]) for v in conflict["values"]] == [("A0", "5 CTNS"), ("A2", "6 CTNS"), ("A3", "7 CTNS")]


def test_one_exchange_by_shipment(spark):
    rows = [(1, "A", 0, "packages", "5 CTNS", None), (1, "B", 0, "packages", "5 CTNS", None)]
    plan = C.align_sides(M.merge_side(fields(spark, rows).repartition("shipment_id")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_internal_contradiction(spark):
    d = docs(spark, ("B", 0, "d.pdf", "BL", "pdf", DRAFT))
    f = fields(spark, [(1, "B", 0, "packages", "1000 CTNS", None), (1, "B", 0, "grossWeight", "8263 KGS", None)])
    issue = C.check_internal(d, f).collect()
    assert len(issue) == 1 and issue[0]["values"] == ["1000 CTNS", "999 CTNS"]


def test_admission(spark, tmp_path):
    rows = [(1, "A", 0, "a.docx", None, 10), (1, "B", 0, "b.pdf", None, 10), (2, "A", 0, "a.docx", None, 10), (3, "A", 0, "a.bin", "application/pdf", 10), (3, "B", 0, "x.bin", None, 10), (4, "B", 0, "b.pdf", None, 30_000_000), (5, "A", 0, "a.docx", None, 0)]
    rows += [(6, s, n, "f.png", None, 1) for s in "AB" for n in range(11)] + [(None, "A", 0, "a.docx", None, 10), (None, "B", 0, "a.docx", None, 10)]
    m = spark.createDataFrame(rows, "shipment_id long, side string, doc_seq int, file_name string, mime string, size_bytes long")
    got = {r["shipment_id"]: r["reason"] for r in admit(m).collect()}
    assert got == {1: None, 2: "Side B has no file.", 3: "x.bin is not a readable format.", 4: "Side A has no file.", 5: "Side A has no file.", 6: "Side A has more than 10 files.", None: "The shipment has no id."}
    d = spark.createDataFrame([(1, "A", 0, "f", "SI", "docx", "x"), (2, "A", 0, "f", "SI", "docx", "x")], DOC)
    assert [r["shipment_id"] for r in accepted(d, admit(m)).collect()] == [1]
    for path, text in (("7/A/i.docx", "x"), ("7/B/d.pdf", "y"), ("7/B/empty.pdf", "")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = read_manifest(spark, str(tmp_path)).orderBy("side").collect()
    assert [(r["shipment_id"], r["side"], r["doc_seq"], r["file_name"], r["size_bytes"]) for r in found] == [(7, "A", 0, "i.docx", 1), (7, "B", 0, "d.pdf", 1)]
    assert submitted(m).count() == len(rows) - 1


def test_report_sink(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "shipment_id")
    for fmt in ("parquet", "json"):
        write_report(df, str(tmp_path / fmt), fmt)
        assert read_report(spark, str(tmp_path / fmt)).count() == 3


def test_stream_of_documents(spark, tmp_path):
    from quayside.streaming.intake import document_stream, reconcile_stream, scan_stream

    docs(spark, ("A", 0, "i.docx", "SI", "docx", INST), ("B", 0, "d.pdf", "BL", "pdf", DRAFT)).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"))
    assert scan_stream(stream).isStreaming
    tallies = []

    def batch(df, _):
        f = T.read_text(df)
        tallies.extend(reconcile(df, f, T.extract_directives(df))["summary"].collect())

    folders = str(tmp_path / "check"), str(tmp_path / "known")
    reconcile_stream(stream, batch, *folders).awaitTermination()
    assert len(tallies) == 1 and tallies[0]["violations"] == 2


def test_a_shipment_may_come_in_two_batches(spark, tmp_path):
    from quayside.streaming.intake import document_stream, reconcile_stream

    seen = []
    folders = str(tmp_path / "check"), str(tmp_path / "known")
    for doc in (("A", 0, "i.docx", "SI", "docx", INST), ("B", 0, "d.pdf", "BL", "pdf", "first"), ("B", 0, "d.pdf", "BL", "pdf", DRAFT)):
        docs(spark, doc).write.mode("append").parquet(str(tmp_path / "in"))
        run = lambda df, n: seen.append((n, sorted((r["side"], r["text"]) for r in df.collect())))
        reconcile_stream(document_stream(spark, str(tmp_path / "in")), run, *folders).awaitTermination()
    assert seen == [(0, [("A", INST)]), (1, [("A", INST), ("B", "first")]), (2, [("A", INST), ("B", DRAFT)])]


def test_flagship_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).where(F.col("mismatches") > 0).count() > 0
