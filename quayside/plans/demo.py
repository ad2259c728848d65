"""Two-sided paperwork derived from the sales tables, by SQL that Spark and DuckDB read alike.

An order is a shipment.  Side A has an instruction and, for every third order, a packing list; side B has a
draft for orders with line items.  Values are spelt differently on the sides, and wrong at co-prime moduli.
Forms by position (pages, sheets, certificates) are derived from customers and orders in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.shared import parts_of

BASE = """
SELECT o.o_orderkey AS k, c.c_name AS cname, coalesce(l.n, 0) AS n
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def pad(x: str, n: int) -> str:
    return f"lpad({s(x)}, {n}, '0')"


def off(m: int) -> str:
    """1 for every m-th order: a planted error."""
    return f"CASE WHEN k % {m} = 0 THEN 1 ELSE 0 END"


LOT = f"'LOT ' || {s('k % 97')}"
PACKS, WEIGHT, VOLUME, BOX_NO = "(k % 900 + 1)", "(1000 + k % 1000)", "(k % 60 + 1)", f"'ABCD' || {pad('k % 10000000', 7)}"
VOYAGE = f"{s('100 + k % 50')} || 'E'"
PORT_A = "CASE k % 4 WHEN 0 THEN 'NORTH PORT' WHEN 1 THEN 'WEST PORT' WHEN 2 THEN 'NANSHA' ELSE 'PENANG' END"
PORT_B = (
    "CASE WHEN k % 31 = 0 THEN 'ROTTERDAM' WHEN k % 29 = 0 THEN 'PORT KLANG' WHEN k % 4 = 0 THEN 'PORT KELANG(N)' "
    "WHEN k % 4 = 1 THEN 'PORT KELANG (W), MALAYSIA' WHEN k % 4 = 2 THEN 'NANSHA PORT, CHINA' ELSE 'GEORGETOWN PENANG' END"
)
NL = "chr(10)"
#: side, doc_seq, file, field key, value, condition, source
_A, _P, _B = ("A", 0, "inst.docx"), ("A", 1, "pack.docx"), ("B", 0, "draft.pdf")
ROWS = [
    (*_A, "consignee", f"cname || ' SDN. BHD.' || {NL} || {LOT} || ', JALAN BESAR' || {NL} || 'SELANGOR, MALAYSIA'", "true", "NULL"),
    (*_A, "portOfDischarge", PORT_A, "k % 6 <> 5", "NULL"),
    (*_A, "finalDestination", PORT_A, "k % 6 = 5", "NULL"),
    (*_A, "portOfLoading", "'NANSHA'", "true", "NULL"),
    (*_A, "packages", f"{s(PACKS)} || ' CTNS'", "true", "NULL"),
    (*_A, "grossWeight", f"'1,' || {pad('k % 1000', 3)} || '.00 KGS'", "true", "NULL"),
    (*_A, "measurement", f"{s(VOLUME)} || '.5 CBM'", "true", "NULL"),
    (*_A, "containerNo", BOX_NO, "k % 5 <> 0", "NULL"),
    (*_A, "goods", "'BOLTS | NUTS'", "true", "NULL"),
    (*_A, "vesselVoyage", f"'MV DEMO EXPRESS V.' || {VOYAGE}", "true", "NULL"),
    (*_A, "consigneePhone", f"'03-' || {pad('k % 10000000', 7)}", "true", "NULL"),
    (*_A, "freightTerms", "'FREIGHT PREPAID'", "true", "NULL"),
    (*_A, "hsCodes", "'73181500'", "true", "NULL"),
    (*_P, "packages", f"{s(f'{PACKS} + {off(11)}')} || ' CARTONS'", "k % 3 = 0", "NULL"),
    (*_P, "grossWeight", f"CASE WHEN k % 22 = 0 THEN 'N/A' ELSE {s(WEIGHT)} || '.0 KG' END", "k % 3 = 0", "NULL"),
    (*_P, "hsCodes", "CASE WHEN k % 33 = 0 THEN '73181600' ELSE '73181500' END", "k % 3 = 0", "NULL"),
    (*_P, "marks", "'N/M'", "k % 3 = 0", "NULL"),
    (*_B, "shipper", "'DEMO EXPORTER LTD'", "n > 0", "NULL"),
    (*_B, "consignee", f"cname || ' SDN BHD ' || {LOT} || CASE WHEN k % 17 = 0 THEN '9' ELSE '' END || ' JALAN BESAR SELANGOR'", "n > 0", "NULL"),
    (*_B, "portOfDischarge", PORT_B, "n > 0 AND k % 7 <> 0", "NULL"),
    (*_B, "finalDestination", PORT_B, "n > 0 AND k % 7 = 0", "NULL"),
    (*_B, "portOfLoading", "'NANSHA, GUANGZHOU'", "n > 0", "NULL"),
    (*_B, "packages", f"{s(f'{PACKS} + {off(19)}')} || 'CARTONS'", "n > 0", "NULL"),
    (*_B, "grossWeight", f"{s(f'{WEIGHT} + {off(23)}')} || '.000KGS'", "n > 0", "NULL"),
    (*_B, "measurement", f"{s(VOLUME)} || '.500CBM'", "n > 0", "NULL"),
    (*_B, "containerNo", f"CASE WHEN k % 13 = 0 THEN replace({BOX_NO}, '0', 'O') ELSE 'ABCD-' || {pad('k % 10000000', 7)} END", "n > 0", "CASE WHEN k % 13 = 0 THEN 'ocr' END"),
    (*_B, "goods", "'NUTS | BOLTS'", "n > 0", "NULL"),
    (*_B, "vesselVoyage", f"'MV DEMO EXPRESS ' || {VOYAGE}", "n > 0", "NULL"),
    (*_B, "consigneePhone", f"'+603 ' || {pad('k % 10000000', 7)}", "n > 0", "NULL"),
    (*_B, "sealNo", f"'SEAL' || {pad('k % 100000', 5)}", "n > 0", "NULL"),
    (*_B, "freightTerms", "'Freight Prepaid'", "n > 0 AND k % 2 = 0", "NULL"),
]
_STRUCTS = ", ".join(
    f"struct_pack(stated := ({when}), side := '{side}', doc_seq := {seq}, field_key := '{key}', raw := {raw}, source := CAST({source} AS VARCHAR), file := '{file}')"
    for side, seq, file, key, raw, when, source in ROWS
)
#: DuckDB: the long fields, all of an order's values in one pass over the base
FIELDS = f"SELECT k AS shipment_id, x.side, x.doc_seq, x.field_key, x.raw, x.source, x.file FROM (SELECT k, unnest([{_STRUCTS}]) AS x FROM base) WHERE x.stated"

MAIL = f"'ops' || {s('k % 10')} || '@demo.com'"
INSTRUCTION = [
    "'SHIPPING INSTRUCTION'", "''", "'CONSIGNEE: ' || cname || ' SDN. BHD.'", f"{LOT} || ', JALAN BESAR'",
    f"'(20230100' || {pad('k % 10000', 4)} || ' / JM' || {pad('k % 1000000', 6)} || ')'", f"'TEL: 03-' || {pad('k % 10000000', 7)}", "''",
    "CASE WHEN k % 2 = 0 THEN 'PORT OF DISCHARGE: WEST PORT' ELSE 'NORTH PORT' END", "''", "'DESCRIPTION: BOLTS 7318.15.00'", "'NUTS 7318 16 00'", "''",
    f"'SUM ' || {s(PACKS)} || ' CTNS, ' || {s(WEIGHT)} || '.00 KGS, ' || {s(VOLUME)} || '.5 CBM'", BOX_NO, "'FREIGHT PREPAID'",
    f"'船公司: WHL  开航日期: 2026-08-' || {pad('k % 28 + 1', 2)}",
    f"CASE WHEN k % 31 = 0 THEN '(email : ' || {MAIL} || ' 只提供不显示在提单)' WHEN k % 7 = 0 THEN '(提单不显示海关编码)' WHEN k % 41 = 0 THEN '(唛头不要显示)' ELSE '' END",
]
DRAFT = [
    "'BILL OF LADING'", f"{BOX_NO} || ' / 40' || chr(39) || 'HQ / SEAL' || {pad('k % 100000', 5)} || ' / ' || {s(PACKS)} || ' CTNS / ' || {s(WEIGHT)} || '.000KGS'",
    "'NUTS AND BOLTS'", "CASE WHEN k % 37 = 0 THEN 'HS CODE 7318.15.00' ELSE 'NO CODES' END", f"CASE WHEN k % 2 = 0 THEN 'CONTACT ' || {MAIL} ELSE '' END",
    "'船公司: ' || CASE WHEN k % 5 = 0 THEN 'YML' ELSE 'WHL' END",
]


def joined(lines: list[str]) -> str:
    return f" || {NL} || ".join(lines)


DOCS = f"""
SELECT k AS shipment_id, 'A' AS side, 0 AS doc_seq, 'inst.docx' AS file_name, 'SI' AS kind, 'docx' AS format, {joined(INSTRUCTION)} AS text FROM base
UNION ALL SELECT k, 'A', 1, 'pack.docx', 'SI', 'docx', 'PACKING LIST ' || {s(PACKS)} || ' CTNS' FROM base WHERE k % 3 = 0
UNION ALL SELECT k, 'B', 0, 'draft.pdf', 'BL', 'pdf', {joined(DRAFT)} FROM base WHERE n > 0
"""

#: sheet cells of each order's confirmation: row, column, text, condition
CELL_ROWS = [
    (1, 1, "'SHIPPER'", "true"), (1, 2, "'SHIPPER'", "true"), (1, 3, "'SHIPPER'", "true"), (2, 1, "'DEMO EXPORTER LTD'", "true"), (3, 1, "'PORT OF LOADING'", "true"),
    (3, 2, "'NANSHA'", "true"), (4, 1, "'CONSIGNEE'", "true"), (5, 1, "cname", "true"), (7, 1, "'FINAL DESTINATION'", "true"), (7, 4, "'NORTH PORT'", "k % 2 = 0"),
    (10, 1, "'PORT KELANG(W)'", "true"), (12, 1, f"{s(PACKS)} || ' CTNS'", "true"),
]
CELLS = " UNION ALL ".join(
    f"SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, 0 AS sheet_seq, 'S1' AS sheet, {r} AS \"row\", {c} AS \"col\", {t} AS text FROM base WHERE {w}" for r, c, t, w in CELL_ROWS
)
MERGES = "SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, 0 AS sheet_seq, 1 AS r0, 1 AS c0, 1 AS r1, 3 AS c1 FROM base"

#: page items of each customer's draft: x, y, text
CUSTOMERS = "SELECT c_custkey AS k, c_name AS cname FROM {customer}"
ITEM_ROWS = [
    (410, 770, f"'SO' || {pad('k', 6)}"), (75, 735, "'DEMO EXPORTER LTD'"), (75, 727, "'NANSHA CITY'"), (75, 655, "cname"), (75, 647, f"{LOT} || ' JALAN BESAR'"),
    (75, 575, "'SAME AS CONSIGNEE'"), (205, 515, "'NANSHA'"), (75, 492, f"'MV DEMO ' || {VOYAGE}"), (205, 492, "'NANSHA, CHINA'"), (75, 470, "'PORT KELANG(N)'"), (235, 470, "'PORT KELANG(N)'"),
    (400, 470, "'PORT KLANG'"), (75, 450, "'N/M'"), (210, 450, f"{s(PACKS)} || ' CTNS'"), (210, 440, "'BOLTS'"), (210, 430, "'NUTS'"), (400, 450, f"{s(WEIGHT)} || '.000KGS'"),
    (475, 450, f"{s(VOLUME)} || '.500CBM'"), (75, 310, f"{BOX_NO} || ' / 40HQ / SEAL' || {pad('k % 100000', 5)}"), (75, 160, "'FREIGHT PREPAID'"),
]
SHIFT = "(k % 9 - 4) * 3"
ITEMS = " UNION ALL ".join(
    f"SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, 1 AS page, {n} AS item_seq, CAST({x} AS DOUBLE) AS x, CAST({y} + {SHIFT} AS DOUBLE) AS y, CAST(4 * length({t}) AS DOUBLE) AS w, {t} AS s FROM base"
    for n, (x, y, t) in enumerate(ITEM_ROWS)
)
PAGES = "SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, 'draft.pdf' AS file_name, 'BL' AS kind, 'pdf' AS format FROM base"

#: certificate regions of each customer: line, position, x, width, text
REGION_ROWS = [
    (0, 0, 40, 60, "'1.Exporter'"), (0, 1, 105, 150, "'DEMO EXPORTER LTD'"), (0, 2, 700, 100, "'REF 77'"), (1, 0, 40, 90, "'2.Consignee (name, address)'"), (2, 0, 42, 200, "cname"),
    (3, 0, 42, 180, f"{LOT} || ' JALAN'"), (4, 0, 40, 80, "'3.Vessel'"), (4, 1, 130, 90, f"'MV DEMO ' || {VOYAGE}"), (5, 0, 40, 120, "'Port of Discharge'"),
    (5, 1, 170, 90, "CASE WHEN k % 4 = 0 THEN 'from nansha to klang by sea' ELSE 'PORT KLANG' END"), (6, 0, 40, 300, f"'(' || {s(PACKS)} || ') CARTONS OF BOLTS 10 KGS HS CODE: 7318.15'"),
    (7, 0, 40, 300, "'(20) CARTONS OF NUTS 12.5 KGS HS CODE: 7318.16'"), (8, 0, 40, 300, f"'TOTAL: FIFTY (' || {s(f'{PACKS} + 20')} || ') CARTONS'"),
]
REGIONS = " UNION ALL ".join(
    f"SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, {i} AS line_idx, {p} AS pos, CAST({x} AS DOUBLE) AS x, CAST({20 * i} AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w, CAST(18 AS DOUBLE) AS h, {t} AS text, CAST(0.95 AS DOUBLE) AS confidence FROM base"
    for i, p, x, w, t in REGION_ROWS
)


#: inputs as a decoder may leave them: mixed line ends, tabs, blank cells, items and regions
_ENDS = "CASE k % 3 WHEN 0 THEN chr(13) || chr(10) || 'more' WHEN 1 THEN chr(13) || 'more' ELSE '' END"
ROUGH_LINES = f"SELECT k AS shipment_id, 'A' AS side, 0 AS doc_seq, 1 AS line_no, cname || {_ENDS} AS text FROM base UNION ALL SELECT k, 'A', 0, 2, CASE WHEN k % 2 = 0 THEN '' ELSE {PORT_A} END FROM base"
ROUGH_CELLS = " UNION ALL ".join(
    f"SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, 0 AS sheet_seq, 'S1' AS sheet, {r} AS \"row\", 1 AS \"col\", {t} AS text FROM base"
    for r, t in enumerate(("' ' || cname || chr(9) || ' ' || chr(9) || 'LTD  '", f"{PORT_A} || {_ENDS}", "CASE WHEN k % 4 = 0 THEN chr(9) || '  ' ELSE 'x' || chr(9) || 'y' END"), 1)
)
ROUGH_ITEMS = " UNION ALL ".join(
    f"SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, 1 AS page, {n} AS item_seq, CAST({n} AS DOUBLE) AS x, CAST(k % 700 AS DOUBLE) AS y, CASE WHEN k % 5 <> {n} THEN CAST(4 AS DOUBLE) END AS w, {t} AS s FROM base"
    for n, t in enumerate(("cname", "CASE WHEN k % 2 = 0 THEN '  ' ELSE 'N/M' END", "''"))
)
ROUGH_REGIONS = " UNION ALL ".join(
    f"SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, {n} AS line_idx, 0 AS pos, CAST(1 AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS y, CAST(3 AS DOUBLE) AS w, CAST(4 AS DOUBLE) AS h, {t} AS text, CAST(k % 100 AS DOUBLE) / 100 AS confidence FROM base"
    for n, t in enumerate(("'  ' || cname || ' '", "CASE WHEN k % 3 = 0 THEN ' ' ELSE '1.Exporter ' END"))
)
#: a ruled page of SIDE x SIDE pixels for each supplier: its lines rise by the supplier's angle, every 9th page has few
SIDE, _ANGLE, _GAP = 120, "((k % 65) - 32) * 0.25", "CASE WHEN k % 9 = 0 THEN 12 ELSE 6 END"
_INK = f"pmod(CAST(y - round(x * tan(radians({_ANGLE})), 0) AS INT), {_GAP}) = 0"
SCANS = f"""SELECT s_suppkey AS shipment_id, 'B' AS side, 0 AS doc_seq, {SIDE} AS width, {SIDE} AS height, unhex(array_join(transform(sequence(0, {SIDE * SIDE - 1}),
  i -> CASE WHEN {_INK.replace('k %', 's_suppkey %').replace('(y -', f'(i div {SIDE} -').replace('round(x *', f'round((i % {SIDE}) *')} THEN '00' ELSE 'FF' END), '')) AS grey FROM {{supplier}}"""
SCANS_CTE = f"""WITH pixels AS (SELECT s_suppkey AS k, i // {SIDE} AS y, i % {SIDE} AS x FROM supplier, range({SIDE * SIDE}) t(i)),
ink AS MATERIALIZED (SELECT * FROM pixels WHERE {_INK.replace('pmod(CAST', '((CAST').replace('AS INT), ', f'AS INT) % ({_GAP}) + ({_GAP})) % (').replace(') = 0', ')) = 0', 1)})"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCANS, supplier=table(spark, sf_dir, "supplier"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str = "k") -> DataFrame:
    """Rows dealt out by their key to a fixed number of tasks.

    They are a few bytes each, so partitions sized by bytes would be few; what is made of them, a shipment's texts and their reading, costs
    time.  Whatever is grouped by the same key afterwards stays where it is.
    """
    return rows.repartition(parts_of(rows.sparkSession), key)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.sql(BASE, **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")}))


def derived(spark: SparkSession, sf_dir: str, sql: str, of: str = "orders") -> DataFrame:
    """A derived table; the derivation's base is its own query."""
    rows = base(spark, sf_dir) if of == "orders" else dealt(spark.sql(CUSTOMERS, customer=table(spark, sf_dir, "customer")))
    return spark.sql(sql.replace("FROM base", "FROM {base}").replace('"', "`"), base=rows)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long fields of all documents, each order's value in one pass over the derivation's base."""
    rows = base(spark, sf_dir)
    entries = ", ".join(
        f"CASE WHEN {when} THEN named_struct('side', '{side}', 'doc_seq', {seq}, 'field_key', '{key}', 'raw', {raw}, 'source', CAST({source} AS STRING), 'file', '{file}') END"
        for side, seq, file, key, raw, when, source in ROWS
    )
    out = rows.select(F.col("k").alias("shipment_id"), F.explode(F.expr(f"array_compact(array({entries}))")).alias("f"))
    return out.select("shipment_id", "f.side", "f.doc_seq", "f.field_key", "f.raw", F.lit("derived").alias("where"), "f.source", "f.file")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DOCS)


#: label and a spelling of it; the last is none
HEADINGS = [
    ("shipper", "Exporter"), ("consignee", "CNEE"), ("consignee", "Products consigned to"), ("notifyParty", "NOTIFY PARTY"), ("placeOfReceipt", "PLACE OF RECEIPT"), ("portOfLoading", "POL"),
    ("portOfDischarge", "卸货港"), ("placeOfDelivery", "PLACE OF DELIVERY"), ("finalDestination", "FINAL DESTINATION"), ("vesselVoyage", "OCEAN VESSEL"), ("goods", "COMMODITY"), ("packages", "NO. OF PKGS"),
    ("grossWeight", "GROSS WEIGHT"), ("measurement", "CBM"), ("marks", "MARKS AND NUMBERS"), ("freightTerms", "FREIGHT"), ("containerNo", "CONTAINER NO"), ("sealNo", "封号"), ("soNo", "BOOKING NO"), (None, "REMARK"),
]


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order one line with a heading, and a value behind it in one of three ways."""
    k = F.col("k")
    names = F.array(*(F.lit(text) for _, text in HEADINGS))
    gap = F.when(k % 3 == 0, ": ").when(k % 3 == 1, "：").otherwise(" ")
    text = F.concat(F.element_at(names, (k % len(HEADINGS)).cast("int") + 1), gap, F.lit("V"), k.cast("string"))
    return base(spark, sf_dir).select(k.alias("shipment_id"), F.lit(100).alias("line_no"), text.alias("text"))


#: what is wrong with the pages, sheets and certificates of the warnings' queries: (step, condition, message), in DuckDB's SQL
SAID_PDF = [
    (0, "k % 5 = 0", "'This PDF has no text layer — it is probably a pure scan. Field extraction needs a text-based PDF (OCR it first).'"),
    (1, "k % 5 <> 0 AND k % 4 = 0", "'PDF has 2 pages; all pages were read as one form.'"),
    # the place with most clearance is one point above where the form was filled in
    (2, f"k % 5 <> 0 AND abs({SHIFT} + 1) > 2", f"'This B/L sits ' || CAST(-({SHIFT} + 1) AS VARCHAR) || 'pt down from the expected form layout; the boxes were realigned to fit. Check a few values against the PDF.'"),
    (3, "k % 5 <> 0 AND k % 7 = 0", "'1 block(s) on the B/L were not read into any field: \"STRAY\".'"),
    (4, "k % 5 = 0 OR k % 6 = 0", "'No container number (4 letters + 7 digits) found on the B/L.'"),
    (5, "k % 5 = 0 OR k % 8 = 0", "'Consignee box read as empty — check the B/L layout matches the expected form.'"),
]
_NOWHERE = "k % 5 = 0 OR k % 2 = 1"
SAID_XLSX = [
    (0, "k % 5 <> 0 AND k % 4 = 0", "'Workbook has 2 sheets (S1, S2); all were read as one form.'"),
    (1, "k % 5 = 0", "'This spreadsheet has no readable cells.'"),
    (2, "k % 5 = 0 OR k % 3 = 0", "'conf.xlsx: no consignee cell found.'"),
    (3, _NOWHERE, "'conf.xlsx: no discharge port or final destination found.'"),
    (4, f"NOT ({_NOWHERE}) AND k % 14 = 0", "'Port \"ROTTERDAM\" is not in the alias table, so it is compared as plain text.'"),
]
_LOW = "cert.jpeg: recognition confidence is 85%. Check the values against the picture, or supply the source PDF or spreadsheet instead."
SAID_IMAGE = [
    (0, "k % 5 = 0", "'cert.jpeg: the page was tilted 1.5° and was straightened before reading.'"),
    (1, "k % 10 = 0", "'cert.jpeg: no text could be recognised in this image.'"),
    (1, "k % 10 <> 0 AND k % 4 = 1", "'cert.jpeg: the page is only 340px across, far too small to read reliably. Re-photograph it larger, or supply the source PDF or spreadsheet.'"),
    (1, "k % 10 <> 0 AND k % 4 = 2", "'cert.jpeg: the page is only 650px across. Values may be misread — check them against the picture.'"),
    (1, "k % 10 <> 0 AND k % 4 IN (0, 3) AND k % 3 = 0", f"'{_LOW}'"),
    (2, "k % 10 <> 0 AND k % 6 <> 1", "'cert.jpeg: no single gross weight is stated; 10 + 12.5 were added to give 22.5 KGS.'"),
    (2, "k % 10 <> 0 AND k % 6 = 1", "'cert.jpeg: the per-item weights could not be read as a complete set, so no gross weight is reported. Read it off the document, or supply the source file.'"),
    (3, "k % 10 <> 0 AND k % 9 = 0", "'cert.jpeg: 2 commodity lines are present but only 1 could be read (NUTS). Check the description against the document.'"),
    (4, "k % 10 <> 0 AND k % 4 = 0", "'cert.jpeg: discarded implausible readings for portOfDischarge (reads as a routing sentence, not a port).'"),
    (5, "k % 10 = 0 OR k % 7 = 0", "'cert.jpeg: no consignee could be located.'"),
]


def told(said: list[tuple[int, str, str]], of: str) -> str:
    """DuckDB: the warnings of each document, in the order of their steps."""
    rows = " UNION ALL ".join(f"SELECT k, {step} AS step, {message} AS message FROM base WHERE {when}" for step, when, message in said)
    return f"{cte(of=of)} SELECT k AS shipment_id, CAST(row_number() OVER (PARTITION BY k ORDER BY step) - 1 AS INT) AS pos, message FROM ({rows})"


def faulty_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of which some have no text, a second page, a stray block, no container or no consignee."""
    items, docs = derived(spark, sf_dir, ITEMS, "customer"), derived(spark, sf_dir, PAGES, "customer")
    k, n = F.col("shipment_id"), F.col("item_seq")
    left = (k % 5 != 0) & ~((k % 6 == 0) & (n == 18)) & ~((k % 8 == 0) & n.isin(3, 4))
    second = F.when((k % 4 == 0) & (n == 19), 2).otherwise(F.col("page"))
    stray = items.where((k % 5 != 0) & (k % 7 == 0) & (n == 0)).withColumns({"item_seq": F.lit(20), "x": F.lit(500.0), "y": F.lit(620.0), "w": F.lit(20.0), "s": F.lit("STRAY")})
    return items.where(left).withColumn("page", second).unionByName(stray), docs


def faulty_cells(cells: DataFrame) -> DataFrame:
    """Sheets of which some are empty, have a second sheet, no consignee or an unknown port."""
    k = F.col("shipment_id")
    left = cells.where((k % 5 != 0) & ~((k % 3 == 0) & F.col("row").isin(4, 5)))
    text = F.when((k % 14 == 0) & (F.col("text") == "NORTH PORT"), "ROTTERDAM").otherwise(F.col("text"))
    second = left.where((k % 4 == 0) & (F.col("row") == 12)).withColumns({"sheet_seq": F.lit(1), "sheet": F.lit("S2"), "row": F.lit(30), "text": F.lit("EXTRA")})
    return left.withColumn("text", text).unionByName(second)


def faulty_regions(regions: DataFrame) -> DataFrame:
    """Certificates of which some have no text, are narrow, lack a consignee, a weight or a name of goods."""
    k, line = F.col("shipment_id"), F.col("line_idx")
    wide = (line == 0) & (F.col("pos") == 2)
    left = regions.where((k % 10 != 0) & ~((k % 7 == 0) & line.isin(2, 3) & (F.col("x") < 60)) & ~((k % 4 == 1) & wide))
    text = F.when((k % 6 == 1) & (line == 7), F.regexp_replace("text", "12.5 KGS ", "")).when((k % 9 == 0) & (line == 6), F.regexp_replace("text", "OF BOLTS ", "OF ")).otherwise(F.col("text"))
    return left.withColumns({"x": F.when((k % 4 == 2) & wide, 550.0).otherwise(F.col("x")), "text": text})


def cte(*names: str, of: str = "orders", fields: list[str] | None = None) -> str:
    """DuckDB: WITH base and the named derived tables; ``fields``: the long fields of these keys only."""
    if fields:
        few = [r for r in _STRUCTS.split(", struct_pack(") if any(f"field_key := '{k}'" in r for k in fields)]
        own = ", ".join(r if r.startswith("struct_pack(") else f"struct_pack({r}" for r in few)
        return f"{cte(*names, of=of)}, fields AS MATERIALIZED ({FIELDS.replace(_STRUCTS, own)})"
    known = {"fields": FIELDS, "docs": DOCS, "cells": CELLS, "merges": MERGES, "items": ITEMS, "regions": REGIONS,
             "rough_lines": ROUGH_LINES, "rough_cells": ROUGH_CELLS, "rough_items": ROUGH_ITEMS, "rough_regions": ROUGH_REGIONS}
    start = (BASE if of == "orders" else CUSTOMERS).replace("{", "").replace("}", "")
    return f"WITH base AS MATERIALIZED ({start})" + "".join(f", {n} AS MATERIALIZED ({known[n]})" for n in names)
