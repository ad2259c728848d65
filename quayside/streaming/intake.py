"""Reading text documents as they arrive (Structured Streaming).

Scans that need one document alone run on the stream itself; merging and comparing need all documents of
a shipment and run in each micro-batch on the shipments that it touches, their earlier documents included.
Those are kept in keyed state by shipment (``known_documents``), so that the work of a micro-batch follows the shipments
that it touches and not what has come before, or in a shared folder that other jobs may read too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quayside.functions.scalars import find_emails, find_hs_codes, printed_text
from quayside.operators.text_reader import KEY, reg_and_phone, shape_scan

BUCKETS = 256
DOCS = "shipment_id long, side string, doc_seq int, file_name string, kind string, format string, text string"


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Documents written as parquet under ``path``, as a stream."""
    return spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scan_stream(docs: DataFrame) -> DataFrame:
    """Shape fields of each document on a stream (E5, E6): no state, no shuffle."""
    return shape_scan(docs).unionByName(reg_and_phone(docs))


def printed_stream(docs: DataFrame) -> DataFrame:
    """(key, file_name, codes, emails) that each document prints, on a stream."""
    printed = printed_text("text")
    return docs.select(*KEY, "file_name", find_hs_codes(printed).alias("codes"), find_emails(printed).alias("emails"))


class Keeper(StatefulProcessor):
    """The documents of one shipment: each one's latest text by side and place, and all of them whenever one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.docs = handle.getMapState("docs", "side string, doc_seq int", "file_name string, kind string, format string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                self.docs.updateValue((r.side, None if pd.isna(r.doc_seq) else int(r.doc_seq)), tuple(None if pd.isna(v) else v for v in (r.file_name, r.kind, r.format, r.text)))
        found = [(key[0], *at, *doc) for at, doc in self.docs.iterator()]
        yield pd.DataFrame(found, columns=["shipment_id", "side", "doc_seq", "file_name", "kind", "format", "text"])

    def close(self) -> None:
        pass


def known_documents(docs: DataFrame) -> DataFrame:
    """On a stream: all documents, old and new, of the shipments that new documents belong to (needs the RocksDB state store).

    State is keyed by shipment and holds a document once, as it came last; admission bounds a shipment to twenty documents.
    A null shipment id is a shipment of its own.
    """
    return docs.groupBy("shipment_id").transformWithStateInPandas(Keeper(), DOCS, "Append", "None")


STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reconcile_by_state(docs: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``batch`` with all documents, old and new, of the shipments that each micro-batch touches; they are kept in state.

    The state goes with the checkpoint folder, which lets the stream resume.  A micro-batch that is run again gives the same documents.
    """
    spark = docs.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # a stream takes the settings that hold when it starts

    def settle(rows: DataFrame, number: int) -> None:
        rows.persist()  # state is worked out once, however often ``batch`` reads it
        try:
            batch(rows, number)
        finally:
            rows.unpersist()

    try:
        return known_documents(docs).writeStream.foreachBatch(settle).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def reconcile_stream(docs: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, store: str) -> StreamingQuery:
    """Call ``batch`` with all documents, old and new, of the shipments that each micro-batch touches.

    Documents are kept under ``store``, a shared folder, by micro-batch and by ``BUCKETS`` parts of the shipment
    ids, so a batch that is run again replaces what it has written, and a batch reads back the parts that it
    touches.  A document that comes again counts as it came last.  The checkpoint folder lets the stream resume.
    """

    def settle(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        part = F.pmod(F.xxhash64("shipment_id"), F.lit(BUCKETS)).cast("int")
        new.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")
        known = spark.read.schema(f"{DOCS}, batch long, part int").parquet(store).where(F.col("batch") <= number)
        fresh = known.where(F.col("batch") == number)
        parts = [r["part"] for r in fresh.select("part").distinct().collect()]  # BUCKETS at most
        touched = fresh.select("shipment_id").distinct()
        last = Window.partitionBy(*KEY).orderBy(F.desc("batch"))
        rows = known.where(F.col("part").isin(parts)).join(touched, "shipment_id", "left_semi")
        batch(rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").select(*new.columns), number)

    return docs.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
