"""Decoded inputs (S4) and the review queue (A1-A5)."""

from quayside.operators import review as A
from quayside.sources import intake as S

KEY = "shipment_id long, side string, doc_seq int"


def test_decoded_inputs(spark, tmp_path):
    def stored(name, rows, schema):
        spark.createDataFrame(rows, f"{KEY}, {schema}").write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    lines = S.read_lines(spark, stored("l", [(1, "A", 0, 1, "a\r\nb\rc")], "line_no int, text string"))
    assert lines.first()["text"] == "a\nb\nc"
    cells = S.read_cells(spark, stored("c", [(1, "A", 0, 0, "S", 1, 1, " a \t b "), (1, "A", 0, 0, "S", 1, 2, " \n ")], "sheet_seq int, sheet string, row int, col int, text string"))
    assert [r["text"] for r in cells.collect()] == ["a b"]
    items = S.read_items(spark, stored("i", [(1, "A", 0, 1, 0, 1.0, 2.0, None, "x"), (1, "A", 0, 1, 1, 1.0, 2.0, 3.0, "　")], "page int, item_seq int, x double, y double, w double, s string"))
    assert [(r["s"], r["w"]) for r in items.collect()] == [("x", 0.0)]
    regions = S.read_regions(spark, stored("r", [(1, "A", 0, 0, 0, 1.0, 1.0, 1.0, 1.0, " t ", 0.9), (1, "A", 0, 0, 1, 1.0, 1.0, 1.0, 1.0, "", 0.9)], "line_idx int, pos int, x double, y double, w double, h double, text string, confidence double"))
    assert [r["text"] for r in regions.collect()] == ["t"]


def sides(spark):
    docs = spark.createDataFrame(
        [(1, "A", 0, "a", "SI", "docx", "text"), (1, "A", 1, "b", "SI", "docx", " "), (1, "B", 0, "c", "BL", "pdf", "text"), (2, "A", 0, "d", "SI", "docx", "t")],
        f"{KEY}, file_name string, kind string, format string, text string",
    )
    keys = [(1, "A", k) for k in ("consignee", "packages", "goods", "finalDestination")] + [(1, "B", "consignee")] + [(2, "A", k) for k in ("consignee", "packages", "goods", "portOfDischarge")]
    side = spark.createDataFrame([(i, s, k, "x", "w", None, "f") for i, s, k in keys], "shipment_id long, side string, field_key string, raw string, where string, source string, file string")
    said = spark.createDataFrame([(1, "A", 1, 0, 'Port "X" is not in the alias table, so'), (1, "A", 0, 0, "No CONSIGNEE block found in the SI.")], f"{KEY}, pos int, message string")
    return side, docs, said


def test_queue_and_answers(spark):
    side, docs, said = sides(spark)
    need = A.assess_side(side, docs, said)
    got = {(r["shipment_id"], r["side"]): (r["missing"], r["doubtful"]) for r in need.collect()}
    assert got == {(1, "A"): ([], [1]), (1, "B"): (["packages", "goods", "portOfDischarge"], []), (2, "A"): ([], [])}
    queue = A.review_queue(need, docs)
    assert {(r["side"], r["doc_seq"], tuple(r["asked"] or ())) for r in queue.collect()} == {("A", 1, ()), ("B", 0, ("packages", "goods", "portOfDischarge"))}
    responses = spark.createDataFrame([(1, "B", 1, "svc", '{"goods": " A\\\\nB ", "packages": " ", "shipper": "no", "portOfDischarge": "WEST PORT"}', None)], "shipment_id long, side string, queue_pos int, provider string, body string, error string")
    answers = A.parse_answers(responses, queue)
    assert {(r["field_key"], r["raw"]) for r in answers.collect()} == {("goods", "A\\nB"), ("portOfDischarge", "WEST PORT")}
    filled = A.fill_gaps(side, answers, queue)
    new = {r["field_key"]: r for r in filled.where("source = 'llm'").collect()}
    assert new["goods"]["raw"] == "A\nB" and new["goods"]["where"] == "read by svc" and filled.count() == side.count() + 2
    report = {r["shipment_id"]: r for r in A.assist_report(need, queue, responses, side, filled).collect()}
    assert report[1]["used"] and report[1]["docs"] == ["c"] and report[1]["filled"] == ["c: goods", "c: portOfDischarge"] and any("no text to send" in x for x in report[1]["reasons"])
    assert report[2]["reasons"] == [A.CLEAN]


def test_report_without_a_provider(spark):
    side, docs, said = sides(spark)
    need = A.assess_side(side, docs, said)
    report = {r["shipment_id"]: r for r in A.assist_report(need, A.review_queue(need, docs), None, side, side).collect()}
    assert report[1]["reasons"][-1] == A.NO_PROVIDER and report[2]["reasons"] == [A.CLEAN] and not report[1]["used"]
