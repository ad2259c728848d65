"""Documents of a stream in keyed state."""

from pyspark.sql import functions as F

from quayside.operators import text_reader as T
from quayside.plans.reconcile import reconcile
from quayside.streaming.intake import document_stream, reconcile_by_state
from tests.test_jobs import DOC, DRAFT, INST


def test_state_gives_all_documents_of_touched_shipments(spark, tmp_path):
    seen, check = [], str(tmp_path / "check")
    batches = [
        [(1, "A", 0, "i.docx", "SI", "docx", INST), (2, "A", 0, "i.docx", "SI", "docx", "other"), (None, "A", 0, "n.docx", "SI", "docx", "no id")],
        [(1, "B", 0, "d.pdf", "BL", "pdf", "first"), (3, "A", 0, None, None, "docx", None)],
        [(1, "B", 0, "d.pdf", "BL", "pdf", DRAFT)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, DOC).write.mode("append").parquet(str(tmp_path / "in"))
        run = lambda df, n: seen.append(sorted((r["shipment_id"] or 0, r["side"], r["text"] or "") for r in df.collect()))
        reconcile_by_state(document_stream(spark, str(tmp_path / "in")), run, check).awaitTermination()
    assert seen == [[(0, "A", "no id"), (1, "A", INST), (2, "A", "other")], [(1, "A", INST), (1, "B", "first"), (3, "A", "")], [(1, "A", INST), (1, "B", DRAFT)]]


def test_the_whole_job_runs_on_state(spark, tmp_path):
    spark.createDataFrame([(1, "A", 0, "i.docx", "SI", "docx", INST), (1, "B", 0, "d.pdf", "BL", "pdf", DRAFT)], DOC).write.parquet(str(tmp_path / "in"))
    tallies = []

    def batch(df, _):
        f = T.read_text(df)
        tallies.extend(reconcile(df, f, T.extract_directives(df), keep=lambda x: x)["summary"].where(F.col("violations") > 0).collect())

    reconcile_by_state(document_stream(spark, str(tmp_path / "in")), batch, str(tmp_path / "check")).awaitTermination()
    assert len(tallies) == 1 and tallies[0]["violations"] == 2
