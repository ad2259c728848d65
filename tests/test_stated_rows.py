"""Rows of a report without storing verdicts, and maps of destinations only beside each row."""

from quayside import rules as R
from quayside.operators import compare as C
from quayside.operators import merge as M
from quayside.plans import catalog
from tests.test_jobs import fields


def test_rows_that_a_side_states_or_needs(spark):
    rows = [
        (1, "A", 0, "goods", "BOLTS | NUTS", None), (1, "B", 0, "goods", "NUTS | BOLTS", None), (1, "A", 0, "finalDestination", "PENANG", None), (1, "B", 0, "portOfDischarge", "GEORGETOWN PENANG", None),
        (1, "A", 0, "shipper", "ACME", "ocr"), (1, "B", 0, "shipper", "ACNE CHINA", None), (2, "B", 0, "marks", "N/M", None), (2, "A", 0, "packages", "none", None), (2, "B", 0, "packages", "5 CTNS", None), (3, "A", 0, "soNo", "77", None),
    ]
    aligned = C.align_sides(M.merge_side(fields(spark, rows)))
    held = {k for x in aligned.select("map_a", "map_b").collect() for m in x for k in m or {}}
    assert held == {"finalDestination", "portOfDischarge"}
    stood = C.destination_fallback(aligned)
    every = C.field_verdicts(stood).collect()
    assert len(every) == 3 * len(R.FIELD_SPECS)
    assert sorted(map(str, C.field_verdicts(stood, absent=False).collect())) == sorted(str(x) for x in every if x["verdict"] != "absent_both")


def test_report_rows_store_nothing(spark):
    names = lambda: {t.name for t in spark.catalog.listTables()}
    before = names()
    assert catalog.c9_report_rows(spark, "/root/testdata/sf0.001").count() > 0
    assert names() == before
