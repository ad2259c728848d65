"""Normalisers and scalar checks: tables of inputs and expected values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside import rules as R
from quayside.functions import scalars as S

CASES = {
    S.norm_text: [("a.b,c;d:e'f\"g`h(i)[j] - k//l", "A B C D E F G H I J K L"), ("x　y z", "X Y Z"), ("A & B #1 中", "A & B #1 中"), ("", ""), (None, None), ("ß", "SS")],
    S.norm_id: [("abcd-123 4567", "ABCD1234567"), ("中文", ""), (None, None)],
    S.norm_phone: [("03-388 8648", "33888648"), ("+603-388 8648", "6033888648"), ("000", ""), ("x", "")],
    S.norm_number: [("8263.00", "8263"), ("8,263.000 KGS", "8263"), ("65.4400", "65.44"), ("-2.5", "-2.5"), ("0.0005", "0.001"), ("none", None), ("1.23456785E7", "1.235"), ("12345678.5", "12345678.5"), ("-0.0004", "0")],
    S.norm_packages: [("816 CTNS", "816 CARTON"), ("816cartons", "816 CARTON"), ("1,000 PLT", "1000 PALLET"), ("007 foo", "7 FOO"), ("0 BAG", "0 BAG"), ("12", None), ("x", None)],
    S.norm_vessel: [("MV DEMO V.001E", "MV DEMO 001E"), ("MV DEMO 001E", "MV DEMO 001E"), ("MV DEMO VOY 2", "MV DEMO 2"), ("MV DEMO V001E", "MV DEMO V001E")],
    S.norm_list: [("b | a", "A | B"), ("b, a", "B A"), ("a|a||", "A | A"), ("", "")],
    S.canonical_port: [
        ("north port", "PORT KLANG (NORTH PORT), MALAYSIA"), ("PORT KELANG(N), Malaysia", "PORT KLANG (NORTH PORT), MALAYSIA"), ("Rotterdam", None), ("SINGAPORE", "SINGAPORE"), ("Shanghai, CN ", "SHANGHAI, CHINA"),
    ],
    S.fold_ocr: [("SAMPLE C0 LTD", "SAMPLECOLTD"), ("012568 3479", "OIZSBG3479".replace("SBG", "SGB")), ("858", "BSB"), ("838", "B3B")],
    S.address_key: [("LOT 1, MALAYSIA", "LOT1"), ("X PRCHINA", "XPR"), ("CHINA", "CHINA"), ("A MALAYSIA CHINA", "AMALAYSIA")],
    S.label_for: [("portOfLoading", "Port of loading"), ("hsCodes", "HS codes"), ("someNewKey", "Some new key")],
    S.classify_label: [
        ("CONSIGNEE: x", "consignee"), ("FREIGHT PREPAID", "freightTerms"), ("SHIPPER'S LOAD", "shipper"), ("G.W. 5", "grossWeight"), ("GW5", None), ("CBM", "measurement"), ("CBMS", None),
        ("发货人: A", "shipper"), ("PORT OF  DISCHARGE", "portOfDischarge"), ("hello", None), ("  pol ", "portOfLoading"),
    ],
    S.label_key: [("Carrier (船公司)", "CARRIER"), ("船公司", "船公司"), ("a-b 1", "AB1")],
    S.printed_text: [("x (a@b.com 只提供不显示在提单) y", "x  y"), ("(keep) （提单不显示海关编码）", "(keep) "), ("(a) (b 不显示)", "(a) ")],
    S.strip_notes: [("  a \t\n\n\nb (不显示)", "a\nb")],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_table(spark, function):
    rows = [(i, a, b) for i, (a, b) in enumerate(CASES[function])]
    df = spark.createDataFrame(rows, "i int, given string, want string").withColumn("got", function("given"))
    assert [(r["given"], r["got"]) for r in df.orderBy("i").collect()] == [(a, b) for _, a, b in rows]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()["x"]


def test_codes_and_addresses(spark):
    assert one(spark, S.find_hs_codes("v"), "7318.15.00 7318 16 00 73181500 9912.34.56 0012.34.56 重73181700 1234567 7318.15") == ["73181500", "73181600", "73181700"]
    assert one(spark, S.find_emails("v"), "a@b.com, A@b.com a@b.com x@y") == ["a@b.com", "A@b.com"]


def test_port_relation(spark):
    rows = [("NORTH PORT", "PORT KLANG", "compatible"), ("NORTH PORT", "WEST PORT", "different"), ("x", "PENANG", "unknown"), ("Penang", "PENANG PORT", "same"), (None, "PENANG", "unknown")]
    df = spark.createDataFrame(rows, "a string, b string, want string").withColumn("got", S.port_relation("a", "b"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_implausible(spark):
    rows = [
        ("grossWeight", "12 KGS", None), ("grossWeight", "x", "does not look like a grossWeight value"), ("portOfDischarge", "FROM NINGBO TO KLANG", "reads as a routing sentence, not a port"),
        ("portOfLoading", "X" * 46, "too long to be a port name"), ("goods", "quantity, of xx", "reads as lowercase prose rather than a typed value"),
        ("goods", "see Notes", "reads as printed form wording, not a value"), ("goods", "  ", "empty"), ("goods", "BOLTS", None), ("consigneePhone", "03 (388) 8648", None), ("containerNo", "ABCD1234567", None),
    ]
    df = spark.createDataFrame(rows, "k string, v string, want string").withColumn("got", S.implausible("k", "v"))
    assert [(r["v"], r["got"]) for r in df.collect()] == [(v, w) for _, v, w in rows]


def test_separators_of_lists(spark):
    assert one(spark, S.norm_list("v", "[,\n]"), "nuts, bolts\nnuts") == "BOLTS | NUTS | NUTS"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB1.,-/ ()\n　Vv中", max_size=20), min_size=1, max_size=20))
def test_normalisers_are_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for f in (S.norm_text, S.norm_id, S.norm_phone, S.norm_vessel, S.fold_ocr):
        assert df.withColumn("a", f("v")).withColumn("b", f("a")).where("a <> b").count() == 0


def test_every_comparator_has_a_normaliser(spark):
    kinds = sorted(set(R.COMPARATOR.values()))
    df = spark.createDataFrame([(k,) for k in kinds], "k string").withColumn("v", S.normalize_for("k", F.lit("NORTH PORT 5 CTNS")))
    assert all(r["v"] is not None or r["k"] == "port" for r in df.collect())
