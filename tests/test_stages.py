"""One-pass reading, one-match labels and staged jobs against plain versions, and what their plans hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quayside import rules as R
from quayside.functions import scalars as S
from quayside.operators import compare as C
from quayside.operators import text_reader as T
from quayside.plans.reconcile import answered, compared, concluded, inputs, reconcile, review
from quayside.sources.shared import drop_stored, stored
from tests.test_jobs import DOC, DRAFT, INST

WS = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def plain(pattern):
    """A rule's pattern for Python: white space as Python's class, code points as escapes."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern.replace(R.WS, WS))


LABELS = [(key, re.compile(f"(?:{plain(p)})", re.I)) for key, p in R.LABELS]


def label_of(text):
    """The ordered chain: each label's own pattern in turn."""
    for key, pattern in LABELS:
        m = pattern.match(text)
        if m:
            return key, re.sub(rf"^{WS}*[:：]?{WS}*", "", text[m.end() :]).strip()
    return None


HEADS = [
    "SHIPPER", "Products  consigned from", "exporter", "CNEE", "Product consigned to", "NOTIFY", "Notify Party", "notifyparty", "PLACE OF RECEIPT", "POL", "PORT OF LOADING", "POD", "Port of Discharge", "卸货港", "PLACE OF DELIVERY",
    "FINAL DESTINATION", "目的地", "OCEAN VESSEL", "VESSEL'S NAME", "VESSELNAME", "船名航次", "船名", "DESC", "DESCRIPTION", "GOODS", "KIND OF PACKAGES", "NO. OF PKGS", "NO OF CONTAINERS", "NUMBER OF PACKAGES", "件数", "GROSS WEIGHT",
    "G.W.", "G.W.5", "GW", "GWx", "CBM", "CBMs", "MEASUREMENT", "MARK", "MARKS AND NUMBERS", "唛头", "FREIGHT", "运费", "CONTAINER", "CONTAINER NO", "箱号", "SEAL", "SEAL NUMBER", "封号", "D/R NO", "S/O NO", "B/L NO", "BOOKING NO", "提单号",
    "REMARK", "X SHIPPER", "", "POLAND", "PODIUM", "GOODS FREIGHT", "SEALED",
]


def test_one_match_finds_label_and_end(spark):
    r = random.Random(7)
    texts = [h + sep + v for h in HEADS for sep in ("", ":", " : ", "：", "  ", "\t", ": :") for v in ("", "A b", "SHIPPER: x", "\x01y")]
    texts += ["".join(r.choice(["SHIP", "PER", "PORT", " OF ", "LOADING", ":", "POL", " ", "船名", "航次", "NO", "\x01"]) for _ in range(6)) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x["i"]: x for x in rows.select("i", S.first_label("t", same_line=False).alias("l"), S.is_label("t").alias("is"), S.classify_label("t").alias("k"), S.strip_label("t", S.classify_label("t"), False).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = label_of(t.strip())
        assert (None if got[i]["l"] is None else tuple(got[i]["l"])) == want, t
        assert got[i]["is"] == (want is not None) and got[i]["k"] == (want[0] if want else None) and got[i]["s"] == (want[1] if want else t.strip())


def blocks_of(text):
    """E1-E3 line by line."""
    lines = [x.strip() for x in text.split("\n")]
    kept = [[i + 1, x] for i, x in enumerate(lines) if x]
    for k, row in enumerate(kept):
        row.append((kept[k + 1][0] if k + 1 < len(kept) else len(lines) + 1) - row[0] - 1)
    gaps = [g for _, _, g in kept[:-1]]
    wide = sum(g == 1 for g in gaps) >= len(gaps) * 0.5 and any(g >= 2 for g in gaps)
    found, own = [], None
    for k, (number, x, _) in enumerate(kept):
        label = label_of(x)
        if label or k == 0 or kept[k - 1][2] >= (2 if wide else 1):
            own = (label[0], number, [label[1]]) if label else None
            found += [own] if own else []
        elif own:
            own[2].append(x)
    blocks = [(key, n, "\n".join(v for v in parts if v)) for key, n, parts in found]
    return kept, 2 if wide else 1, [b for b in blocks if b[2]]


def test_blocks_equal_line_by_line(spark):
    r = random.Random(11)
    heads = ["CONSIGNEE:", "SHIPPER: ACME", "POL", "GOODS : x", "VESSEL", "plain", "more words", "NORTH PORT", "  spaced  ", ""]
    texts = ["\n".join(r.choice(heads) + ("" if r.random() < 0.5 else "\n" * r.randrange(1, 4)) for _ in range(r.randrange(0, 14))) for _ in range(150)]
    texts += ["", "\n\n", " ", "CONSIGNEE", "\n\n".join(["CONSIGNEE:", "A", "B", "C"]) + "\n\n\nD", "x\n" * 3000 + "CONSIGNEE: y\n" + "z\n" * 3000, None]
    docs = spark.createDataFrame([(i, "A", 0, "f", "SI", "docx", t) for i, t in enumerate(texts)], DOC)
    entries, gaps, blocks = {}, {}, {}
    for x in T.line_entries(docs).collect():
        entries.setdefault(x["shipment_id"], []).append([x["line_no"], x["text"], x["gap_after"]])
    for x in T.block_break_gap(docs).collect():
        gaps[x["shipment_id"]] = x["break_gap"]
    for x in T.labelled_blocks(docs).collect():
        blocks.setdefault(x["shipment_id"], []).append((x["field_key"], x["rank"], x["raw"]))
    for i, t in enumerate(texts):
        kept, gap, own = blocks_of(t or "")
        assert sorted(entries.get(i, [])) == kept and gaps.get(i, 1) == gap and sorted(blocks.get(i, []), key=lambda b: b[1]) == own, t


def parts_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|Single|range|Round)", plan)), plan.count("FileScan"), plan.count("Python")


def test_text_is_read_without_exchange(spark, tmp_path):
    spark.createDataFrame([(1, "A", 0, "i.docx", "SI", "docx", INST)], DOC).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert parts_of(T.read_text(docs)) == (0, 1, 0)
    # the first reading of a key wins, as with the groupings of the long form
    found = T.labelled_blocks(docs).unionByName(T.bare_port_lines(docs)).unionByName(T.shape_scan(docs)).unionByName(T.reg_and_phone(docs))
    long = T.split_goods(T.clean_party(T.first_readings(found), docs)).select(*T.FIELD)
    assert {tuple(x) for x in T.read_text(docs).collect()} == {tuple(x) for x in long.collect()}


@pytest.fixture(scope="module")
def paperwork(spark):
    texts = [("A", 0, "i.docx", "SI", "docx", INST), ("B", 0, "d.pdf", "BL", "pdf", DRAFT)]
    docs = spark.createDataFrame([(k, *t) for k in range(40) for t in texts if k % 5 or t[0] == "A"], DOC)
    kept = stored(docs)
    return kept, stored(T.read_text(kept)), T.extract_directives(kept)


def test_stages_scan_nothing_twice(spark, paperwork):
    docs, fields, directives = paperwork
    read = inputs(docs, fields, directives)
    results = {k: stored(df) for k, df in compared(read).items()}
    for name, df in compared(read).items():
        exchanges, scans, python = parts_of(df)
        assert exchanges == 0 and scans <= 2 and python == 0, name
    tally = concluded(results)["summary"]
    assert parts_of(tally)[0] <= 1 and parts_of(tally)[1] == 4
    asked = review(docs, fields, T.doc_warnings(docs, fields))
    report = answered(asked, asked["queue"].select("shipment_id", "side", "queue_pos", F.lit("svc").alias("provider"), F.lit('{"goods": "x"}').alias("body"), F.lit(None).cast("string").alias("error")))["report"]
    assert parts_of(report)[1] < 10


def test_stages_equal_one_plan(spark, paperwork):
    docs, fields, directives = paperwork
    staged, one = (reconcile(docs, fields, directives, keep=keep) for keep in (stored, lambda df: df))
    for name in one:
        order = sorted(one[name].columns)
        assert sorted(map(repr, staged[name].select(order).collect())) == sorted(map(repr, one[name].select(order).collect())), name


def test_stored_tables_go(spark):
    kept = stored(spark.range(5).withColumnRenamed("id", "shipment_id"))
    assert kept.count() == 5
    drop_stored(kept)
    with pytest.raises(Exception):
        kept.collect()


def test_address_runs_equal_containment(spark):
    r = random.Random(3)
    mails = ["a@b.com", "x.y+z@c-d.org", "A@B.COM", "q@w.e"]
    texts = ["".join(r.choice([*mails, "x", ".", "@", " ", "<", "中", "K", "-", "\n", "(提单不显示 a@b.com)"]) for _ in range(r.randrange(0, 9))) for _ in range(200)]
    docs = spark.createDataFrame([(i, "B", 0, "d.pdf", "BL", "pdf", t) for i, t in enumerate(texts)], DOC)
    said = [(i, "A", 0, n, f"no-email-{n}", "raw", "m", "email", mail, "w", "i.docx") for i in range(len(texts)) for n, mail in enumerate(mails)]
    directives = spark.createDataFrame(said, "shipment_id long, side string, doc_seq int, pos int, id string, raw string, meaning string, forbid_kind string, forbid_value string, where string, file string")
    printed = {x["shipment_id"]: x["p"] for x in docs.select("shipment_id", F.lower(S.printed_text("text")).alias("p")).collect()}
    got = {(x["shipment_id"], x["pos"]): x["verdict"] for x in C.check_directives(directives, docs).collect()}
    for i in range(len(texts)):
        for n, mail in enumerate(mails):
            assert got[i, n] == ("violated" if mail.lower() in printed[i] else "ok"), (texts[i], mail)


def test_facts_hold_no_text(paperwork):
    assert C.document_facts(paperwork[0]).columns == ["shipment_id", "side", "doc_seq", "file_name", "codes", "runs", "recap"]


def test_large_numbers(spark):
    cases = {
        "99999999999999999 KGS": "100000000000000000", "9007199254740": "9007199254740", "8,263.000": "8263", "0.0005": "0.001", "-0": "0", "-1.0005": "-1",
        "1000000000000.125": "1000000000000.125", "1" + "0" * 21: "1e+21", "9" * 400: None, "no": None,
    }
    wide = ["12345678901234567890", "123" + "0" * 20, "9007199254740993.5"]  # as many digits as the platform prints
    rows = spark.createDataFrame([(t,) for t in [*cases, *wide]], "t string")
    got = {x["t"]: x["n"] for x in rows.select("t", S.norm_number("t").alias("n")).collect()}
    assert all(float(got[t]) == float(t) * 1000 / 1000 for t in wide) and "e+" in got[wide[1]]
    got = {t: n for t, n in got.items() if t in cases}
    assert got == cases
