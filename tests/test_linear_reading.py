"""Reading texts takes time in proportion to them, and finds in each text's own row what groupings found before."""

import random
import re
import time

from pyspark.sql import functions as F

from quayside import rules as R
from quayside.functions import scalars as S
from quayside.operators import compare as C
from quayside.operators import text_reader as T
from tests.test_jobs import DOC


def test_long_runs_of_blanks_and_address_characters(spark):
    n = 200_000
    texts = ["x" + " " * n + "x", "a" * n, "a" * n + " b@c.com", "1" * n + " KGS", "\n".join(["a" * 1000] * 200)]
    docs = spark.createDataFrame([(i, "A", 0, "f", "SI", "docx", t) for i, t in enumerate(texts)], DOC).repartition(1)
    began = time.perf_counter()
    trimmed = {x["i"]: x["t"] for x in docs.select(F.col("shipment_id").alias("i"), S.trim("text").alias("t")).collect()}
    assert [trimmed[i] for i in range(len(texts))] == texts
    assert {tuple(x["e"]) for x in docs.where("shipment_id <> 2").select(S.find_emails("text").alias("e")).collect()} == {()}
    assert {tuple(x["runs"]) for x in C.document_facts(docs).collect()} == {(), ("b@c.com",)}
    assert time.perf_counter() - began < 60


def test_blanks_are_those_of_the_pattern(spark):
    chars = [chr(i) for i in range(0xD800) if i] + [chr(i) for i in range(0xE000, 0x10000)] + ["😀"]
    rows = spark.createDataFrame([(c,) for c in chars], "c string")
    own = "^[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]\\z"
    got = rows.select("c", F.col("c").rlike(own).alias("want"), F.col("c").rlike(f"^{R.WS}\\z").alias("is"), (S.trim("c") == "").alias("cut"))
    assert got.where("want <> is or want <> cut").collect() == [] and got.where("want").count() == len(R.BLANKS)


def test_values_stand_at_borders(spark):
    """The patterns with their border looked at last against those with it first."""
    before = {
        R.WEIGHT: rf"(?i){R.BEFORE}[\d,]+(?:\.\d+)?{R.WS}*KGS?{R.AFTER}", R.VOLUME: rf"(?i){R.BEFORE}[\d,]+(?:\.\d+)?{R.WS}*(?:CBM|M3){R.AFTER}",
        R.PACKAGES: rf"(?i){R.BEFORE}\d[\d,]*{R.WS}*(?:{R._UNIT}){R.AFTER}", R.CONTAINER: rf"{R.BEFORE}[A-Z]{{4}}\d{{7}}{R.AFTER}",
        R.CONTAINER_TYPE: rf"(?i){R.BEFORE}(?:\d{{2}}'?{R.WS}?(?:GP|HQ|HC|RF|NOR|OT|FR)|\d{{2}}FT){R.AFTER}", R.EMAIL: r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+",
        R.HS: rf"{R.BEFORE}\d{{4}}(?:{R.WS}|\.)?\d{{2}}(?:{R.WS}|\.)?\d{{2}}(?:(?:{R.WS}|\.)?\d{{2}})?{R.AFTER}",
    }
    r = random.Random(3)
    parts = ["1", "12", ",", ".", ".5", " ", "\n", "KG", "kgs", "CBM", "m3", "CTNS", "ROLL", "ABCD", "1234567", "X", "_", "中", "😀", "40", "'", "HQ", "20FT", "7318", "00", "a@b.c", "+", "@d.e", "-"]
    rows = spark.createDataFrame([("".join(r.choice(parts) for _ in range(r.randrange(1, 12))),) for _ in range(6000)], "t string")
    for now, was in before.items():
        assert rows.where(~F.regexp_extract_all("t", F.lit(now), F.lit(0)).eqNullSafe(F.regexp_extract_all("t", F.lit(was), F.lit(0)))).collect() == [], now


def test_pairs_are_found_in_their_row(spark, tmp_path):
    text = "Agent: X  Ref: 77\n1. Agent : Y\nTEL: 5\nCONSIGNEE: Z\n船公司：WHL  开航日期: 2026-08-28\nx: y"
    spark.createDataFrame([(i, "A", n, "f", "SI", "docx", text) for i in range(3) for n in range(2)] + [(9, "A", 0, "f", "SI", "docx", None)], DOC).write.parquet(str(tmp_path / "d"))
    found = T.discover_pairs(spark.read.parquet(str(tmp_path / "d")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Window|Sort", plan)
    want = [(0, "AGENT", "Agent", "X"), (1, "REF", "Ref", "77"), (2, "船公司", "船公司", "WHL"), (3, "开航日期", "开航日期", "2026-08-28")]
    for i in range(3):
        for n in range(2):
            rows = found.where((F.col("shipment_id") == i) & (F.col("doc_seq") == n)).orderBy("pos").collect()
            assert [(x["pos"], x["label_key"], x["label"], x["value"]) for x in rows] == want
    assert found.where("shipment_id = 9").count() == 0
