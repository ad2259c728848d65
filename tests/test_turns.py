"""Asking document after document, reports in two steps, and merged ranges by a sweep."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import grid_reader as G
from quayside.operators import review as A
from quayside.sources.report import current_job, drop_reports, read_report, write_report

KEY = "shipment_id long, side string, doc_seq int"
CORE = ["consignee", "packages", "goods"]


def asked_one_by_one(wanted, doubtful, held, docs, answers):
    """The queue of one side, document by document: (file, keys asked)."""
    order = [d for d in docs if d[0] in doubtful] + [d for d in docs if d[0] not in doubtful and wanted]
    held, out = set(held), []
    for seq, text in order:
        if not text.strip():
            continue
        keys = [k for k in (wanted or CORE) if k not in held]
        if seq in doubtful and not keys:
            keys = CORE
        if keys:
            out.append((seq, keys))
            held |= {k for k in answers.get(seq, {}) if k in keys}
    return out


def test_what_is_answered_is_not_asked_again(spark):
    r = random.Random(12)
    docs, side, assessed, want, answers = [], [], [], {}, {}
    for n in range(60):
        own = [(k, r.choice(["text", "text", " "])) for k in range(r.randrange(1, 5))]
        held = [k for k in [*CORE, "portOfDischarge"] if r.random() < 0.4]
        missing = [k for k in CORE if k not in held] + (["portOfDischarge"] if "portOfDischarge" not in held else [])
        doubtful = [k for k, _ in own if r.random() < 0.4]
        docs += [(n, "B", k, f"f{k}", "BL", "pdf", t) for k, t in own]
        side += [(n, "B", key, "x", "w", None, "f") for key in held]
        reasons = ["some"] if missing or doubtful else []
        assessed.append((n, "B", missing, doubtful, reasons))
        answers[n] = {k: {key: "v" for key in [*CORE, "portOfDischarge", "shipper"] if r.random() < 0.4} for k, _ in own}
        want[n] = asked_one_by_one(missing, doubtful, held, own, answers[n]) if reasons else []
    docs = spark.createDataFrame(docs, f"{KEY}, file_name string, kind string, format string, text string")
    side = spark.createDataFrame(side, "shipment_id long, side string, field_key string, raw string, where string, source string, file string")
    assessed = spark.createDataFrame(assessed, "shipment_id long, side string, missing array<string>, doubtful array<int>, reasons array<string>")
    body = spark.createDataFrame([(n, k, str(a).replace("'", '"')) for n, own in answers.items() for k, a in own.items()], "shipment_id long, doc_seq int, body string")

    def ask(questions):
        return questions.join(body, ["shipment_id", "doc_seq"]).withColumns({"provider": F.lit("svc"), "error": F.lit(None).cast("string")})

    queue, responses = A.ask_in_turn(side, assessed, docs, ask)
    got = {}
    for x in queue.where("asked is not null").orderBy("shipment_id", "queue_pos").collect():
        got.setdefault(x["shipment_id"], []).append((x["doc_seq"], x["asked"]))
    assert got == {n: w for n, w in want.items() if w}
    assert any(len(w) > 1 for w in want.values()) and responses.count() == sum(map(len, want.values()))
    filled = A.fill_gaps(side, A.parse_answers(responses, queue), queue)
    assert filled.groupBy("shipment_id", "field_key").count().where("count > 1").isEmpty()


def test_failed_calls_leave_their_keys_open(spark):
    docs = spark.createDataFrame([(1, "B", k, f"f{k}", "BL", "pdf", "t") for k in range(3)], f"{KEY}, file_name string, kind string, format string, text string")
    side = spark.createDataFrame([], "shipment_id long, side string, field_key string, raw string, where string, source string, file string")
    assessed = spark.createDataFrame([(1, "B", ["goods", "packages"], [], ["x"])], "shipment_id long, side string, missing array<string>, doubtful array<int>, reasons array<string>")

    def ask(questions):
        body = F.when(F.col("doc_seq") == 1, '{"goods": "g"}').when(F.col("doc_seq") == 2, '{"packages": "5 CTNS"}')
        return questions.withColumns({"provider": F.lit("svc"), "body": body, "error": F.when(F.col("doc_seq") == 0, "busy")})

    queue, responses = A.ask_in_turn(side, assessed, docs, ask)
    assert [x["asked"] for x in queue.orderBy("queue_pos").collect()] == [["goods", "packages"], ["goods", "packages"], ["packages"]]
    report = A.assist_report(assessed.select("shipment_id", "side", "missing", "doubtful", "reasons"), queue, responses, side, A.fill_gaps(side, A.parse_answers(responses, queue), queue)).first()
    assert report["used"] and report["docs"] == ["f1", "f2"] and report["filled"] == ["f1: goods", "f2: packages"] and any("busy" in x for x in report["reasons"])


def test_a_failed_report_leaves_the_first(spark, tmp_path):
    path = str(tmp_path / "r")
    one, two = (spark.range(n).withColumnRenamed("id", "shipment_id") for n in (3, 5))
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    first = write_report(one, path, job="a")
    assert first == "a" and read_report(spark, path).count() == 3
    bad = two.withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        write_report(bad, path, job="b")
    assert read_report(spark, path).count() == 3 and current_job(spark, path) == ("a", "parquet")
    write_report(two, path, "json", job="b")  # the job runs again
    assert read_report(spark, path).count() == 5
    drop_reports(spark, path)
    assert read_report(spark, path).count() == 5 and sorted(x.name for x in (tmp_path / "r").iterdir() if x.name.startswith("job=")) == ["job=b"]


def test_sweep_equals_every_cell_against_every_range(spark):
    r = random.Random(17)
    cells = [(n % 7, "A", 0, n % 2, "S", r.randrange(1, 9), r.randrange(1, 9), f"t{n}") for n in range(500)] + [(None, "A", 0, 0, "S", 1, 1, "no id"), (1, "A", 0, 0, "S", None, 1, "no row")]
    ranges = []
    for n in range(60):
        r0, c0 = r.randrange(1, 8), r.randrange(1, 8)
        ranges.append((n % 7, "A", 0, n % 2, r0, c0, r0 + r.randrange(-1, 3), c0 + r.randrange(0, 3)))
    ranges += [ranges[0], (6, "A", 0, 0, 1, 1, 1, 1)]
    got = G.unmerge_cells(
        spark.createDataFrame(cells, f"{KEY}, sheet_seq int, sheet string, row int, col int, text string"), spark.createDataFrame(ranges, f"{KEY}, sheet_seq int, r0 int, c0 int, r1 int, c1 int")
    )
    inside = lambda c, m: None not in (c[0], c[5]) and (c[0], c[3]) == (m[0], m[3]) and m[4] <= c[5] <= m[6] and m[5] <= c[6] <= m[7] and (c[5], c[6]) != (m[4], m[5])
    want = [c for c in cells if not any(inside(c, m) for m in ranges)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) < len(cells)
    assert got.columns == ["shipment_id", "side", "doc_seq", "sheet_seq", "sheet", "row", "col", "text"]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hash") == 1


def test_a_large_sheet_ends_in_a_sorts_time(spark):
    cells = spark.range(200_000).select(F.lit(1).cast("long").alias("shipment_id"), F.lit("A").alias("side"), F.lit(0).alias("doc_seq"), F.lit(0).alias("sheet_seq"), F.lit("S").alias("sheet"), (F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.lit("x").alias("text"))
    ranges = cells.where("row % 2 = 0 and col % 4 = 0").select("shipment_id", "side", "doc_seq", "sheet_seq", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row").alias("r1"), (F.col("col") + 1).alias("c1"))
    assert G.unmerge_cells(cells, ranges).count() == 200_000 - ranges.count()
