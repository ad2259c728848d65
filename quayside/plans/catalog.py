"""The registered queries of the paperwork operators and their DuckDB twins.

Each query applies its operator to whole tables: to paperwork derived from the sales tables, or to the
texts of ``documents``, ``pages`` and ``conversations``.  Arrays leave as joined strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import rules as R
from quayside.functions import scalars as S
from quayside.operators import compare as C
from quayside.operators import grid_reader as G
from quayside.operators import image_reader as I
from quayside.operators import merge as M
from quayside.operators import page_reader as P
from quayside.operators import quality as Q
from quayside.operators import review as A
from quayside.operators import text_reader as T
from quayside.plans import demo as D
from quayside.plans import twins as X
from quayside.plans.reconcile import answered, compared, concluded, inputs, reconcile, review
from quayside.sources import folders as L
from quayside.sources import intake as N
from quayside.sources.intake import admit, detect_format
from quayside.sources.report import assemble_report
from quayside.sources.shared import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["shipment_id", "side", "doc_seq"]


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def scalar_on_fields(name: str, sql: str, made) -> None:  # noqa: ANN001
    """A normaliser, a function of no arguments that makes its column, over every raw value of the derived fields."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.fields(spark, sf_dir).select(*KEY, "field_key", made().alias("value"))

    query.__name__ = name
    register(f"{D.cte('fields')} SELECT shipment_id, side, doc_seq, field_key, {sql} AS value FROM fields")(query)


scalar_on_fields("n01_norm_text", X.norm_text("raw"), lambda: S.norm_text("raw"))
scalar_on_fields("n02_norm_id", X.norm_id("raw"), lambda: S.norm_id("raw"))
scalar_on_fields("n03_norm_phone", X.norm_phone("raw"), lambda: S.norm_phone("raw"))
scalar_on_fields("n04_norm_number", X.norm_number("raw"), lambda: S.norm_number("raw"))
scalar_on_fields("n05_norm_packages", X.norm_packages("raw"), lambda: S.norm_packages("raw"))
scalar_on_fields("n06_norm_vessel", X.norm_vessel("raw"), lambda: S.norm_vessel("raw"))
scalar_on_fields("n07_norm_list", X.norm_list("raw"), lambda: S.norm_list("raw"))
scalar_on_fields("n08_canonical_port", X.canonical_port("raw"), lambda: S.canonical_port("raw"))
scalar_on_fields("n10_normalize_for", X.normalize_for(X.comparator("field_key"), "raw"), lambda: S.normalize_for(M.comparator_of("field_key"), "raw"))
scalar_on_fields("n11_fold_ocr", X.fold_ocr("raw"), lambda: S.fold_ocr("raw"))
_FLAT = f"replace({X.norm_text('raw')}, ' ', '')"
scalar_on_fields("n12_address_key", X.address_key(_FLAT), lambda: S.address_key("raw"))
_SPACED = "trim(lower(regexp_replace(field_key, '([A-Z])', ' \\1', 'g')))"
scalar_on_fields("n15_label_for", f"coalesce({X.label('field_key')}, upper(left({_SPACED}, 1)) || substr({_SPACED}, 2))", lambda: S.label_for("field_key"))


@register(f"""{D.cte(fields=R.PORT_FIELDS)}, known(bare, port) AS (VALUES {X.ALIASES}), inside(terminal, port) AS (VALUES {X.INSIDE}),
f AS (SELECT shipment_id, side, field_key, {X.norm_id('raw')} AS whole, {X.norm_id(X.CUT_COUNTRY.format('raw'))} AS cut FROM fields WHERE field_key IN ('portOfLoading', 'portOfDischarge', 'finalDestination')),
p AS (SELECT f.shipment_id, f.side, f.field_key, coalesce(w.port, c.port) AS port FROM f LEFT JOIN known w ON w.bare = f.whole LEFT JOIN known c ON c.bare = f.cut)
SELECT a.shipment_id, a.field_key, CASE WHEN a.port IS NULL OR b.port IS NULL THEN 'unknown' WHEN a.port = b.port THEN 'same' WHEN i.port IS NOT NULL THEN 'compatible' ELSE 'different' END AS relation
FROM p a JOIN p b ON a.shipment_id = b.shipment_id AND a.field_key = b.field_key AND a.side = 'A' AND b.side = 'B'
LEFT JOIN inside i ON (a.port = i.terminal AND b.port = i.port) OR (b.port = i.terminal AND a.port = i.port)""")
def n09_port_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.fields(spark, sf_dir).where(F.col("field_key").isin("portOfLoading", "portOfDischarge", "finalDestination"))
    a, b = (f.where(F.col("side") == s).select("shipment_id", "field_key", F.col("raw").alias(f"raw_{s}")) for s in "AB")
    return a.join(b, ["shipment_id", "field_key"]).select("shipment_id", "field_key", S.port_relation("raw_A", "raw_B").alias("relation"))


@register(f"SELECT doc_id, array_to_string({X.hs_codes('text')}, ',') AS codes FROM documents")
def n13_find_hs_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.find_hs_codes("text"), ",").alias("codes"))


@register(f"SELECT doc_id, array_to_string({X.emails('text')}, ',') AS emails FROM documents")
def n14_find_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.find_emails("text"), ",").alias("emails"))


_LINE_LABEL = "CASE line_no WHEN 3 THEN 'consignee' WHEN 8 THEN CASE WHEN k % 2 = 0 THEN 'portOfDischarge' END WHEN 10 THEN 'goods' WHEN 15 THEN 'freightTerms' END"


@register(f"""{D.cte()} SELECT k AS shipment_id, line_no, {_LINE_LABEL} AS label,
  CASE line_no WHEN 3 THEN cname || ' SDN. BHD.' WHEN 8 THEN 'WEST PORT' WHEN 10 THEN 'BOLTS 7318.15.00' WHEN 15 THEN 'PREPAID' END AS value
  FROM base, (VALUES (3), (8), (10), (15)) AS l(line_no) WHERE ({_LINE_LABEL}) IS NOT NULL
  UNION ALL SELECT k, 100, label, 'V' || k::VARCHAR FROM base JOIN (VALUES {', '.join(f'({n}, {X.q(key)})' for n, (key, _) in enumerate(D.HEADINGS) if key)}) h(n, label) ON k % {len(D.HEADINGS)} = h.n""")
def n16_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each instruction, and for each order a heading, all labels in turn."""
    lines = T.lines_of(D.docs(spark, sf_dir).where("file_name = 'inst.docx'")).select("shipment_id", "line_no", "text")
    lines = lines.unionByName(D.headings(spark, sf_dir)).select("shipment_id", "line_no", S.first_label("text").alias("l"))
    return lines.where("l is not null").select("shipment_id", "line_no", F.col("l.key").alias("label"), F.col("l.rest").alias("value"))


@register(f"""{D.cte('docs')} SELECT shipment_id, doc_seq, side, {X.printed('text')} AS printed, trim(regexp_replace({X.printed('text')}, '\\n{{2,}}', chr(10), 'g'), ' ' || chr(10)) AS stripped FROM docs""")
def n17_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).select("shipment_id", "doc_seq", "side", S.printed_text("text").alias("printed"), S.strip_notes("text").alias("stripped"))


@register("SELECT doc_id, regexp_replace(upper(replace(regexp_replace(text, '[（(][^）)]*[）)]', '', 'g'), 'ß', 'SS')), '[^A-Z0-9一-鿿]', '', 'g') AS label_key FROM documents")
def n18_label_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each whole text, taken as a label."""
    return D.table(spark, sf_dir, "documents").select("doc_id", S.label_key(F.col("text")).alias("label_key"))


@register(r"""SELECT doc_id, CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 'empty'
  WHEN regexp_matches(text, '\b(?:Overleaf|criterion|see\s+Notes?|FOB\)|Signature|Declaration|hereby|Certification|Importing\s+Country|applied|quantity,|numbers?\s+on)\b', 'i') THEN 'reads as printed form wording, not a value'
  WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 6 AND length(regexp_replace(text, '[^a-z]', '', 'g')) > 0.6 * length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
  THEN 'reads as lowercase prose rather than a typed value' END AS reason FROM documents""")
def n19_implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", S.implausible(F.lit("goods"), "text").alias("reason"))


# -- sources and admission

_MANIFEST = """SELECT l_orderkey AS shipment_id, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS side, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_shipdate, l_returnflag, l_linestatus) - 1 AS INT) AS doc_seq,
  'f' || CAST(l_partkey AS STRING) || CASE l_partkey % 6 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsm' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.bin' ELSE '' END AS file_name,
  CASE l_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' END AS mime,
  CASE WHEN l_suppkey % 10 = 0 THEN CAST(0 AS BIGINT) WHEN l_suppkey % 17 = 0 THEN CAST(30000000 AS BIGINT) ELSE l_suppkey * 1000 END AS size_bytes FROM {lineitem}"""
_FORMAT = """CASE WHEN lower(file_name) LIKE '%.docx' THEN 'docx' WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' WHEN lower(file_name) LIKE '%.xlsm' THEN 'xlsx' WHEN lower(file_name) LIKE '%.jpeg' THEN 'image'
  WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE '%spreadsheetml%' THEN 'xlsx' WHEN mime LIKE 'image/%' THEN 'image' END"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MANIFEST, lineitem=D.table(spark, sf_dir, "lineitem"))


@register(f"WITH m AS ({_MANIFEST.replace('{lineitem}', 'lineitem')}) SELECT shipment_id, side, doc_seq, {_FORMAT} AS format FROM m")
def s1_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select(*KEY, detect_format("file_name", "mime").alias("format"))


@register(f"""WITH m AS ({_MANIFEST.replace('{lineitem}', 'lineitem')}),
x AS (SELECT *, CASE WHEN size_bytes > 26214400 THEN file_name || ' is too large.' WHEN ({_FORMAT}) IS NULL THEN file_name || ' is not a readable format.' END AS bad FROM m WHERE size_bytes > 0),
s AS (SELECT m.shipment_id, sd.side, count(x.file_name) AS n, arg_min(x.bad, x.doc_seq) FILTER (x.bad IS NOT NULL) AS worst
  FROM (SELECT DISTINCT shipment_id FROM m) m CROSS JOIN (VALUES ('A'), ('B')) sd(side) LEFT JOIN x ON x.shipment_id = m.shipment_id AND x.side = sd.side GROUP BY ALL),
r AS (SELECT *, CASE WHEN n = 0 THEN 'Side ' || side || ' has no file.' WHEN n > 10 THEN 'Side ' || side || ' has more than 10 files.' ELSE worst END AS reason FROM s)
SELECT shipment_id, bool_and(reason IS NULL) AS accepted, coalesce(max(CASE WHEN side = 'A' THEN reason END), max(CASE WHEN side = 'B' THEN reason END)) AS reason FROM r GROUP BY shipment_id""")
def s3_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit(manifest(spark, sf_dir))


@register(f"""WITH m AS ({_MANIFEST.replace('{lineitem}', 'lineitem')}) SELECT shipment_id, side,
  CAST(row_number() OVER (PARTITION BY shipment_id, side ORDER BY file_name, size_bytes) - 1 AS INT) AS doc_seq, file_name, mime, size_bytes FROM m WHERE size_bytes > 0""")
def s2_read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.submitted(manifest(spark, sf_dir).drop("doc_seq"))


@register("""WITH f AS (SELECT c_custkey AS k, unnest([{'side': 'A', 'n': 0, 'file_name': 'inst.docx', 'size': 10 + c_custkey % 90}, {'side': 'A', 'n': 1, 'file_name': 'pack.XLSX', 'size': c_custkey % 4},
  {'side': 'B', 'n': 2, 'file_name': 'draft ' || (c_custkey % 5)::VARCHAR || '.pdf', 'size': 1 + c_custkey % 7}]) AS d FROM customer)
SELECT k AS shipment_id, d.side AS side, CAST(row_number() OVER (PARTITION BY k, d.side ORDER BY d.file_name) - 1 AS INT) AS doc_seq, d.file_name AS file_name, d.size::BIGINT AS size_bytes FROM f WHERE d.size > 0""")
def s2_read_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files laid out as folders of shipments, listed by the data source."""
    k = F.col("c_custkey")
    file = lambda side, name, size: F.struct(F.lit(side).alias("side"), name.alias("file_name"), F.repeat(F.lit("x"), size.cast("int")).cast("binary").alias("content"))
    three = F.array(file("A", F.lit("inst.docx"), 10 + k % 90), file("A", F.lit("pack.XLSX"), k % 4), file("B", F.concat(F.lit("draft "), (k % 5).cast("string"), F.lit(".pdf")), 1 + k % 7))
    path = shared_folder(spark)
    L.lay_out(D.dealt(D.table(spark, sf_dir, "customer"), "c_custkey").select(k.alias("shipment_id"), F.explode(three).alias("d")).select("shipment_id", "d.*"), path)
    return L.read_folders(spark, path).drop("mime")


def decoded(spark: SparkSession, sf_dir: str, sql: str, of: str, clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A reader's cleaning over a derived table."""
    return clean(D.derived(spark, sf_dir, sql, of))


@register(f"""{D.cte('rough_lines')} SELECT shipment_id, side, doc_seq, line_no, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') AS text FROM rough_lines""")
def s4_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, D.ROUGH_LINES, "orders", N.clean_lines)


@register(f"""{D.cte('rough_cells')}, c AS (SELECT * EXCLUDE (text), trim(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[ ' || chr(9) || ']+', ' ', 'g'), ' ' || chr(10)) AS text FROM rough_cells)
SELECT * FROM c WHERE text <> ''""")
def s4_read_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, D.ROUGH_CELLS, "orders", N.clean_cells)


@register(f"""{D.cte('rough_items', of='customer')} SELECT shipment_id, side, doc_seq, page, item_seq, x, y, coalesce(w, 0) AS w, s FROM rough_items WHERE trim(s) <> ''""")
def s4_read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, D.ROUGH_ITEMS, "customer", N.clean_items)


@register(f"""{D.cte('rough_regions', of='customer')}, c AS (SELECT shipment_id, side, doc_seq, line_idx, pos, x, y, w, h, trim(text) AS text, confidence FROM rough_regions) SELECT * FROM c WHERE text <> ''""")
def s4_read_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, D.ROUGH_REGIONS, "customer", N.clean_regions)


# -- reading text

def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.docs(spark, sf_dir).where("file_name = 'inst.docx'")


_GAPS = "CASE line_no WHEN 1 THEN 1 WHEN 6 THEN 1 WHEN 8 THEN 1 WHEN 11 THEN 1 ELSE 0 END"
_LAST = "CASE WHEN k % 31 = 0 OR k % 7 = 0 OR k % 41 = 0 THEN 17 ELSE 16 END"


@register(f"""{D.cte()} SELECT k AS shipment_id, line_no, CASE WHEN line_no = 16 AND ({_LAST}) = 16 THEN 1 ELSE {_GAPS} END AS gap_after
  FROM base, (SELECT CAST(x AS INT) AS line_no FROM range(1, 18) t(x)) WHERE line_no NOT IN (2, 7, 9, 12) AND line_no <= {_LAST}""")
def e1_line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.line_entries(instructions(spark, sf_dir)).select("shipment_id", "line_no", "gap_after")


@register("SELECT o_orderkey AS shipment_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS break_gap FROM orders o JOIN customer ON o_custkey = c_custkey")
def e2_block_break_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth instruction is written with double spacing."""
    spaced = F.when(F.col("shipment_id") % 4 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return T.block_break_gap(instructions(spark, sf_dir).withColumn("text", spaced)).select("shipment_id", "break_gap")


_REG = "'20230100' || lpad((k % 10000)::VARCHAR, 4, '0') || ' / JM' || lpad((k % 1000000)::VARCHAR, 6, '0')"
_TEL = "'03-' || lpad((k % 10000000)::VARCHAR, 7, '0')"
_LOT = "'LOT ' || (k % 97)::VARCHAR || ', JALAN BESAR'"
_READ = [
    ("consignee", f"cname || ' SDN. BHD.' || chr(10) || {_LOT}", "true"), ("consigneeRegNo", _REG, "true"), ("consigneePhone", _TEL, "true"),
    ("portOfDischarge", "CASE WHEN k % 2 = 0 THEN 'WEST PORT' ELSE 'NORTH PORT' END", "true"), ("placeOfDelivery", "'NORTH PORT'", "k % 2 = 1"), ("finalDestination", "'NORTH PORT'", "k % 2 = 1"),
    ("goods", "'BOLTS, NUTS'", "true"), ("hsCodes", "'73181500, 73181600'", "true"), ("packages", "(k % 900 + 1)::VARCHAR || ' CTNS'", "true"),
    ("grossWeight", "(1000 + k % 1000)::VARCHAR || '.00 KGS'", "true"), ("measurement", "(k % 60 + 1)::VARCHAR || '.5 CBM'", "true"),
    ("containerNo", "'ABCD' || lpad((k % 10000000)::VARCHAR, 7, '0')", "true"), ("freightTerms", "'PREPAID'", "true"),
]


def planted(rows: list[tuple[str, str, str]], of: str = "orders") -> str:
    return D.cte(of=of) + " " + " UNION ALL ".join(f"SELECT k AS shipment_id, '{k}' AS field_key, {v} AS raw FROM base WHERE {w}" for k, v, w in rows)


_BLOCK = [
    ("consignee", f"cname || ' SDN. BHD.' || chr(10) || {_LOT} || chr(10) || '(' || {_REG} || ')' || chr(10) || 'TEL: ' || {_TEL}", "true"), ("portOfDischarge", "'WEST PORT'", "k % 2 = 0"),
    ("goods", "'BOLTS 7318.15.00' || chr(10) || 'NUTS 7318 16 00'", "true"),
    ("freightTerms", f"'PREPAID' || chr(10) || '船公司: WHL  开航日期: 2026-08-' || lpad((k % 28 + 1)::VARCHAR, 2, '0')", "true"),
]


@register(planted(_BLOCK))
def e3_labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.labelled_blocks(instructions(spark, sf_dir)).select("shipment_id", "field_key", "raw")


@register(planted([(k, "'NORTH PORT'", "k % 2 = 1") for k in R.DESTINATION]))
def e4_bare_port_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bare_port_lines(instructions(spark, sf_dir)).select("shipment_id", "field_key", "raw")


_PLACE = {"grossWeight": "SI line 13 (gross weight)", "measurement": "SI line 13 (measurement)", "packages": "SI line 13 (packages)", "containerNo": "SI line 14 (container no.)", "freightTerms": "SI line 15 (freight terms)"}
_SHAPED = [(k, v if k != "freightTerms" else "'FREIGHT PREPAID'", w) for k, v, w in _READ if k in _PLACE]


@register(f"SELECT *, CASE field_key {' '.join(f'WHEN {X.q(k)} THEN {X.q(v)}' for k, v in _PLACE.items())} END AS place FROM ({planted(_SHAPED)})")
def e5_shape_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shape_scan(instructions(spark, sf_dir)).select("shipment_id", "field_key", "raw", F.col("where").alias("place"))


@register(planted([("consigneeRegNo", _REG, "true"), ("consigneePhone", _TEL, "true")]))
def e6_reg_and_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reg_and_phone(instructions(spark, sf_dir)).select("shipment_id", "field_key", "raw")


_READ_TEXT = [(k, v if k != "freightTerms" else next(b for n, b, _ in _BLOCK if n == k), w) for k, v, w in _READ]


@register(planted([r for r in _READ_TEXT if r[0] in ("consignee", "goods", "hsCodes")]))
def e7_e8_clean_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = instructions(spark, sf_dir)
    found = T.first_readings(T.labelled_blocks(docs))
    out = T.split_goods(T.clean_party(found, docs))
    return out.where("field_key in ('consignee', 'goods', 'hsCodes')").select("shipment_id", "field_key", "raw")


@register(planted(_READ_TEXT))
def e_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E8 together."""
    return T.read_text(instructions(spark, sf_dir)).select("shipment_id", "field_key", "raw")


_MAIL = "'ops' || (k % 10)::VARCHAR || '@demo.com'"


@register(f"""{D.cte()} SELECT k AS shipment_id, kind AS forbid_kind, CASE WHEN kind = 'email' THEN {_MAIL} END AS forbid_value,
  CASE kind WHEN 'email' THEN 'no-email-0' WHEN 'hsCodes' THEN 'no-hs-0' ELSE 'suppress-0' END AS id, 'SI line 17' AS place FROM (SELECT *, {X._OUT} AS kind FROM base) WHERE kind IS NOT NULL""")
def e9_extract_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extract_directives(instructions(spark, sf_dir)).select("shipment_id", "forbid_kind", "forbid_value", "id", F.col("where").alias("place"))


@register(f"""{D.cte()} SELECT k AS shipment_id, 1 AS doc_seq, v.pos, CASE v.pos WHEN 0 THEN 'No CONSIGNEE block found in the SI.'
  ELSE 'No discharge port found in the SI — no label, and no line matching a known port name.' END AS message FROM base, (VALUES (0), (1)) v(pos) WHERE k % 3 = 0""")
def e10_doc_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.docs(spark, sf_dir).where("side = 'A'")
    return T.doc_warnings(docs, T.read_text(docs)).select("shipment_id", "doc_seq", "pos", "message")


@register(D.told(D.SAID_PDF, "customer"))
def e10_page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every warning of positioned pages."""
    items, docs = D.faulty_pages(spark, sf_dir)
    return P.read_pages(items, docs).warnings.select("shipment_id", "pos", "message")


@register(D.told(D.SAID_XLSX, "orders"))
def e10_sheet_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every warning of spreadsheets."""
    cells, merges, docs = sheet(spark, sf_dir)
    return G.read_grid(D.faulty_cells(cells), merges, docs).warnings.select("shipment_id", "pos", "message")


@register(D.told(D.SAID_IMAGE, "customer"))
def e10_image_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every warning of recognised certificates."""
    regions, docs = certificates(spark, sf_dir)
    k = F.col("shipment_id")
    readings = docs.select(*KEY, F.when(k % 3 == 0, 0.85).otherwise(0.95).alias("confidence"), F.when(k % 5 == 0, 1.5).otherwise(0.0).alias("corrected_by"))
    return I.read_images(D.faulty_regions(regions), docs, readings).warnings.select("shipment_id", "pos", "message")


@register(f"""{D.cte()} SELECT k AS shipment_id, 'A' AS side, pos, CASE pos WHEN 0 THEN '船公司' ELSE '开航日期' END AS label, CASE pos WHEN 0 THEN 'WHL' ELSE '2026-08-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') END AS value
  FROM base, (VALUES (0), (1)) v(pos) UNION ALL SELECT k, 'B', 0, '船公司', CASE WHEN k % 5 = 0 THEN 'YML' ELSE 'WHL' END FROM base WHERE n > 0""")
def e27_discover_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.discover_pairs(D.docs(spark, sf_dir)).select("shipment_id", "side", "pos", "label", "value")


# -- grids, pages, certificates

def sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = D.base(spark, sf_dir).select(F.col("k").alias("shipment_id"), F.lit("B").alias("side"), F.lit(0).alias("doc_seq"), F.lit("conf.xlsx").alias("file_name"), F.lit("BL").alias("kind"), F.lit("xlsx").alias("format"))
    return D.derived(spark, sf_dir, D.CELLS), D.derived(spark, sf_dir, D.MERGES), docs


@register(f"""{D.cte('cells', 'merges')} SELECT c.shipment_id, c."row", c."col", c.text FROM cells c ANTI JOIN merges m ON c.shipment_id = m.shipment_id AND c."row" BETWEEN r0 AND r1 AND c."col" BETWEEN c0 AND c1
  AND NOT (c."row" = r0 AND c."col" = c0)""")
def e11_unmerge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, merges, _ = sheet(spark, sf_dir)
    return G.unmerge_cells(cells, merges).select("shipment_id", "row", "col", "text")


@register(f"""{D.cte('cells')} SELECT shipment_id, string_agg(text, chr(10) ORDER BY "row", "col") AS text FROM cells GROUP BY shipment_id""")
def e12_sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _, docs = sheet(spark, sf_dir)
    return G.sheet_text(cells, docs).select("shipment_id", "text")


_GRID = [("shipper", "'DEMO EXPORTER LTD'", "true"), ("portOfLoading", "'NANSHA'", "true"), ("consignee", "cname", "true"), ("finalDestination", "'NORTH PORT'", "k % 2 = 0")]


@register(planted(_GRID))
def e13_grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, merges, docs = sheet(spark, sf_dir)
    return G.grid_values(G.unmerge_cells(cells, merges), docs).select("shipment_id", "field_key", "raw")


@register(planted([*_GRID, ("packages", "(k % 900 + 1)::VARCHAR || ' CTNS'", "true")]))
def e_read_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11-E13 and the sheet variants of E5-E8."""
    return G.read_grid(*sheet(spark, sf_dir))[0].select("shipment_id", "field_key", "raw")


def pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return D.derived(spark, sf_dir, D.ITEMS, "customer"), D.derived(spark, sf_dir, D.PAGES, "customer")


_PAGE = [
    ("soNo", "'SO' || lpad(k::VARCHAR, 6, '0')", "true"), ("shipper", "'DEMO EXPORTER LTD' || chr(10) || 'NANSHA CITY'", "true"),
    ("consignee", "cname || chr(10) || 'LOT ' || (k % 97)::VARCHAR || ' JALAN BESAR'", "true"), ("notifyParty", "'SAME AS CONSIGNEE'", "true"), ("placeOfReceipt", "'NANSHA'", "true"),
    ("vesselVoyage", "'MV DEMO ' || (100 + k % 50)::VARCHAR || 'E'", "true"), ("portOfLoading", "'NANSHA, CHINA'", "true"), ("portOfDischarge", "'PORT KELANG(N)'", "true"),
    ("placeOfDelivery", "'PORT KELANG(N)'", "true"), ("finalDestination", "'PORT KLANG'", "true"), ("marks", "'N/M'", "true"), ("packages", "(k % 900 + 1)::VARCHAR || ' CTNS'", "true"),
    ("goods", "'BOLTS, NUTS'", "true"), ("grossWeight", "(1000 + k % 1000)::VARCHAR || '.000KGS'", "true"), ("measurement", "(k % 60 + 1)::VARCHAR || '.500CBM'", "true"),
    ("containerNo", "'ABCD' || lpad((k % 10000000)::VARCHAR, 7, '0')", "true"), ("containerType", "'40HQ'", "true"), ("sealNo", "'SEAL' || lpad((k % 100000)::VARCHAR, 5, '0')", "true"),
    ("freightTerms", "'FREIGHT PREPAID'", "true"),
]


@register(planted(_PAGE, "customer"))
def e14_e18_read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted values come back whatever the page's shift, across or down."""
    items, docs = pages(spark, sf_dir)
    across = (F.col("shipment_id") % 7 - 3) * 3
    return P.read_pages(items.withColumn("x", F.col("x") + across), docs)[0].select("shipment_id", "field_key", "raw")


_BOXED = " UNION ALL ".join(f"SELECT {n} AS ord, '{b}' AS box, {x0} AS x0, {x1} AS x1, {y0} AS y0, {y1} AS y1" for n, (b, x0, x1, y0, y1) in enumerate(R.BOXES))


@register(f"""{D.cte('items', of='customer')}, boxes AS ({_BOXED}) SELECT i.shipment_id, i.item_seq, arg_min(b.box, b.ord) AS box FROM items i
  LEFT JOIN boxes b ON i.x + 1 >= x0 AND i.x + 1 < x1 AND i.y >= y0 AND i.y < y1 GROUP BY ALL""")
def e17_assign_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = pages(spark, sf_dir)
    points = items.select(*KEY, F.col("item_seq").alias("block"), (F.col("x") + 1).alias("x"), "y", F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    return P.assign_boxes(points).select("shipment_id", F.col("block").alias("item_seq"), "box")


@register(f"""{D.cte('items', of='customer')}, boxes AS ({_BOXED}), s AS (SELECT c.k AS shipment_id, b.ord, b.box, count(i.x) AS n_items, min(i.x) - any_value(x0) AS l, any_value(x1) - max(i.x + i.w) AS r,
  any_value(y1) - max(i.y) AS t, min(i.y) - any_value(y0) AS u FROM base c CROSS JOIN boxes b LEFT JOIN items i ON i.shipment_id = c.k AND i.x >= x0 AND i.x < x1 AND i.y >= y0 AND i.y < y1 GROUP BY ALL)
  SELECT shipment_id, ord, box, n_items, CASE WHEN n_items > 0 THEN least(l, r, t, u) END AS slack, CASE WHEN n_items > 0 THEN least(l, r, t, u) < 7.8 END AS tight FROM s""")
def q3_box_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.box_slack(*pages(spark, sf_dir)).select("shipment_id", "ord", "box", "n_items", "slack", "tight")


@register("SELECT c_custkey AS shipment_id, s AS shift, n::BIGINT AS n_changed, changed FROM customer, (VALUES (1, 0, ''), (2, 0, ''), (3, 0, ''), (4, 2, 'consignee, shipper')) v(s, n, changed)")
def q2_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: small drifts change nothing; an address 30 pt higher stands in the shipper's box."""
    shifts = [(1, 3.0, "page"), (2, -6.0, "page"), (3, 7.8, "consignee"), (4, 30.0, "consignee")]
    return Q.drift_report(*pages(spark, sf_dir), shifts).select("shipment_id", "shift", "n_changed", "changed")


def certificates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = D.derived(spark, sf_dir, D.PAGES, "customer").withColumns({"file_name": F.lit("cert.jpeg"), "format": F.lit("image")})
    return D.derived(spark, sf_dir, D.REGIONS, "customer"), docs


_PAIRS = [
    ("shipper", "'DEMO EXPORTER LTD'", "true"), ("consignee", "cname || chr(10) || 'LOT ' || (k % 97)::VARCHAR || ' JALAN'", "true"),
    ("vesselVoyage", "'MV DEMO ' || (100 + k % 50)::VARCHAR || 'E'", "true"), ("portOfDischarge", "'PORT KLANG'", "k % 4 <> 0"),
]
_TOTALS = [("packages", "(k % 900 + 21)::VARCHAR || ' CARTONS'", "true"), ("grossWeight", "'22.5 KGS'", "true")]
_NAMES = [("goods", "'BOLTS, NUTS'", "true")]
_CODES = [("hsCodes", "'731815, 731816'", "true")]


@register(planted([*_PAIRS, ("portOfDischarge", "'from nansha to klang by sea'", "k % 4 = 0")], "customer"))
def e19_ocr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ocr_pairs(certificates(spark, sf_dir)[0]).select("shipment_id", "field_key", "raw")


@register("SELECT c_custkey AS shipment_id, 'portOfDischarge (reads as a routing sentence, not a port)' AS rejected FROM customer WHERE c_custkey % 4 = 0")
def e20_filter_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.filter_plausible(I.ocr_pairs(certificates(spark, sf_dir)[0]))[1].select("shipment_id", "rejected")


@register(planted(_TOTALS, "customer"))
def e21_certificate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.certificate_totals(I.page_text(*certificates(spark, sf_dir)))[0].select("shipment_id", "field_key", "raw")


@register(planted(_NAMES, "customer"))
def e22_certificate_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.certificate_goods(I.page_text(*certificates(spark, sf_dir)))[0].select("shipment_id", "field_key", "raw")


@register(planted(_CODES, "customer"))
def e23_image_hs_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.image_hs_codes(I.page_text(*certificates(spark, sf_dir))).select("shipment_id", "field_key", "raw")


@register(planted([*_PAIRS, *_TOTALS, *_NAMES, *_CODES], "customer"))
def e_read_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E19-E23 together."""
    return I.read_images(*certificates(spark, sf_dir))[0].select("shipment_id", "field_key", "raw")


_QUALITY = "SELECT c_custkey AS shipment_id, CAST(800 AS DOUBLE) AS page_width, CASE WHEN c_custkey % 5 = 0 THEN 'cert.jpeg: the page was tilted 1.5° and was straightened before reading.' ELSE '' END AS turned, CASE WHEN c_custkey % 3 = 0 THEN 'cert.jpeg: recognition confidence is 85%. Check the values against the picture, or supply the source PDF or spreadsheet instead.' ELSE '' END AS low FROM customer"


@register(f"SELECT shipment_id, page_width, turned || CASE WHEN turned <> '' AND low <> '' THEN chr(10) ELSE '' END || low AS message FROM ({_QUALITY})")
def e24_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, docs = certificates(spark, sf_dir)
    k = F.col("shipment_id")
    readings = docs.select(*KEY, F.when(k % 3 == 0, 0.85).otherwise(0.95).alias("confidence"), F.when(k % 5 == 0, 1.5).otherwise(0.0).alias("corrected_by"))
    return I.page_quality(regions, docs, readings).select("shipment_id", "page_width", "message")


@register("""WITH p AS (SELECT c_custkey AS k, (c_custkey % 9 - 4) * 0.2::DOUBLE AS skew, 0.9::DOUBLE AS c1, 0.9 + (c_custkey % 5 - 2) * 0.01::DOUBLE AS c2, 10 AS n1, 6 + c_custkey % 5 AS n2 FROM customer)
  SELECT k AS shipment_id, abs(skew) >= 0.4 AND c2 >= c1 - 0.01 AND n2 >= n1 * 0.8 AS use_second FROM p""")
def e25_pick_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shipment_id"), F.lit("B").alias("side"), F.lit(0).alias("doc_seq"))
    k = F.col("shipment_id")
    first = c.select(*KEY, ((k % 9 - 4) * 0.2).alias("skew"), F.lit(0.9).alias("confidence"), F.lit(10).alias("n_lines"))
    second = c.select(*KEY, (F.lit(0.9) + (k % 5 - 2) * 0.01).alias("confidence"), (F.lit(6) + k % 5).alias("n_lines"))
    return I.pick_reading(first, second).select("shipment_id", "use_second")


# -- merging

@register(f"{D.cte('fields')}, {X.SIDE} SELECT shipment_id, side, field_key, raw, nullif(source, '') AS source, file FROM side_fields")
def b1_merge_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_side(D.fields(spark, sf_dir)).select("shipment_id", "side", "field_key", "raw", "source", "file")


@register(f"{D.cte('fields')}, {X.CONFLICTS} SELECT * FROM conflicts")
def b2_side_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.side_conflicts(D.fields(spark, sf_dir))
    return found.select("shipment_id", "side", "field_key", "label", F.array_join(F.transform("values", lambda v: F.concat(v["file"], F.lit(": "), v["raw"])), "; ").alias("vals"))


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instructions of every order's first document, repeated by its second."""
    found = T.extract_directives(instructions(spark, sf_dir))
    again = found.where("shipment_id % 3 = 0").withColumns({"doc_seq": F.lit(1), "file": F.lit("pack.docx"), "raw": F.upper("raw"), "forbid_value": F.upper("forbid_value")})
    return found.unionByName(again)


@register(f"""{D.cte()} SELECT k AS shipment_id, 'A' AS side, 0 AS doc_seq, kind FROM (SELECT *, {X._OUT} AS kind FROM base) WHERE kind IS NOT NULL""")
def b3_merge_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_directives(directives(spark, sf_dir)).select("shipment_id", "side", "doc_seq", F.col("forbid_kind").alias("kind"))


_TWICE = "SELECT k AS shipment_id, side, label FROM base, (VALUES ('A', '船公司'), ('A', '开航日期'), ('B', '船公司')) v(side, label) WHERE side = 'A' OR n > 0"


@register(f"{D.cte()} {_TWICE}")
def b4_merge_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.discover_pairs(D.docs(spark, sf_dir))
    again = found.unionByName(found.withColumn("doc_seq", F.col("doc_seq") + 5))
    return M.merge_discovered(again).where("doc_seq < 5").select("shipment_id", "side", "label")


@register(f"""{D.cte('docs')} SELECT shipment_id, side, array_to_string({X.emails("string_agg(text, chr(10) ORDER BY doc_seq)")}, ',') AS emails, length(string_agg(text, chr(10) ORDER BY doc_seq)) AS n_text, md5(string_agg(text, chr(10) ORDER BY doc_seq)) AS text_md5,
  CASE WHEN side = 'A' AND shipment_id % 3 = 0 THEN 'pack.docx: No CONSIGNEE block found in the SI.|pack.docx: No discharge port found in the SI — no label, and no line matching a known port name.' ELSE '' END AS warnings
  FROM docs GROUP BY shipment_id, side""")
def b5_merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.docs(spark, sf_dir)
    side_a = docs.where("side = 'A'")
    out = M.merge_attributes(docs, T.doc_warnings(side_a, T.read_text(side_a)))
    return out.select("shipment_id", "side", F.array_join("emails", ",").alias("emails"), F.length("text").cast("long").alias("n_text"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("warnings", "|").alias("warnings"))


# -- comparing

def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is derived stands by shipment already."""
    return C.align_sides(M.merge_side(D.fields(spark, sf_dir)))


@register(f"""{D.cte('fields')}, specs(ord, field_key) AS (VALUES {', '.join(f'({n}, {X.q(s[0])})' for n, s in enumerate(R.FIELD_SPECS))}),
held AS (SELECT shipment_id, field_key, arg_min(raw, doc_seq) FILTER (side = 'A') AS a, arg_min(raw, doc_seq) FILTER (side = 'B') AS b FROM fields GROUP BY ALL)
SELECT s.shipment_id, c.ord, c.field_key, h.a, h.b FROM (SELECT DISTINCT shipment_id FROM fields) s CROSS JOIN specs c LEFT JOIN held h USING (shipment_id, field_key)""")
def c1_align_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir).select("shipment_id", "ord", "field_key", F.col("a.raw").alias("a"), F.col("b.raw").alias("b"))


@register(f"{D.cte('fields')}, {X.SIDE}, {X.ALIGNED} SELECT shipment_id, field_key, a, b, substituted FROM aligned WHERE field_key IN {X._FAMILY}")
def c2_destination_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.destination_fallback(aligned(spark, sf_dir)).where(F.col("field_key").isin(*R.DESTINATION))
    return rows.select("shipment_id", "field_key", F.col("a.raw").alias("a"), F.col("b.raw").alias("b"), "substituted")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.field_verdicts(C.destination_fallback(aligned(spark, sf_dir)))


_JUDGED = f"{D.cte('fields')}, {X.SIDE}, {X.ALIGNED}, {X.VERDICTS}"


@register(f"{_JUDGED} SELECT shipment_id, ord, field_key, verdict FROM judged")
def c3_field_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("shipment_id", "ord", "field_key", "verdict")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.check_directives(M.merge_directives(directives(spark, sf_dir)), D.docs(spark, sf_dir))


@register(f"{D.cte()}, {X.DIRECTIVES} SELECT shipment_id, side, kind, verdict FROM directives")
def c4_check_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("shipment_id", "side", F.col("directive.forbid.kind").alias("kind"), "verdict")


def internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.check_internal(D.docs(spark, sf_dir), D.fields(spark, sf_dir))


@register(f"{D.cte()}, {X.INTERNAL} SELECT shipment_id, label, boxed, printed FROM internal")
def c5_check_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return internal(spark, sf_dir).select("shipment_id", "label", F.get("values", F.lit(0)).alias("boxed"), F.get("values", F.lit(1)).alias("printed"))


@register(f"""{D.cte()} SELECT k AS shipment_id, label, CASE WHEN label = '开航日期' OR n = 0 THEN 'a_only' WHEN k % 5 = 0 THEN 'mismatch' ELSE 'match' END AS verdict,
  CASE WHEN label = '船公司' THEN 1 ELSE 2 END AS rank FROM base, (VALUES ('船公司'), ('开航日期')) v(label)""")
def c6_match_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_discovered(M.merge_discovered(T.discover_pairs(D.docs(spark, sf_dir)))).select("shipment_id", "label", "verdict", "rank")


def read(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The first stage of the derived paperwork: what is derived stands by shipment already."""
    return inputs(D.docs(spark, sf_dir), D.fields(spark, sf_dir), directives(spark, sf_dir), lambda df: stored(df, dealt=True))


_TALLY = f"""{_JUDGED}, {X.CONFLICTS}, {X.DIRECTIVES}, {X.INTERNAL},
votes AS (SELECT shipment_id, verdict AS v FROM judged UNION ALL SELECT shipment_id, 'violation' FROM directives WHERE verdict = 'violated' UNION ALL SELECT shipment_id, 'violation' FROM internal
  UNION ALL SELECT shipment_id, 'violation' FROM conflicts)"""


@register(f"""{_TALLY} SELECT shipment_id, count(*) FILTER (v = 'mismatch') AS mismatches, count(*) FILTER (v IN ('missing_on_a', 'missing_on_b')) AS missing, count(*) FILTER (v = 'equivalent') AS equivalent,
  count(*) FILTER (v = 'match') AS matches, count(*) FILTER (v = 'violation') AS violations FROM votes GROUP BY shipment_id""")
def c7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: for each shipment, how many fields disagree, lack, match, and what is violated."""
    return concluded(compared(read(spark, sf_dir)))["summary"]


_FOUND = """found AS (SELECT shipment_id, 'conflict' AS kind, label || ' — documents on ' || side || ' disagree with each other' AS title FROM conflicts
  UNION ALL SELECT shipment_id, 'field', label || ' — ' || CASE verdict WHEN 'mismatch' THEN 'Mismatch' WHEN 'missing_on_b' THEN 'Missing on B' ELSE 'Missing on A' END FROM judged WHERE verdict IN ('mismatch', 'missing_on_b', 'missing_on_a')
  UNION ALL SELECT shipment_id, 'directive', CASE WHEN verdict = 'violated' THEN 'Instruction not followed' ELSE 'Instruction not understood' END FROM directives WHERE verdict <> 'ok'
  UNION ALL SELECT shipment_id, 'internal', label || ' — draft.pdf disagrees with itself' FROM internal)"""


@register(f"{_TALLY}, {_FOUND} SELECT *, count(*) OVER (PARTITION BY shipment_id) AS total FROM found")
def c8_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = {name: stored(df) for name, df in compared(read(spark, sf_dir)).items()}
    return concluded(results)["findings"].select("shipment_id", "kind", "title", "total")


@register(f"{_JUDGED} SELECT shipment_id, ord, label, CASE verdict {' '.join(f'WHEN {X.q(k)} THEN {X.q(v)}' for k, v in R.VERDICT_LABELS.items())} END AS verdict_label FROM judged WHERE verdict <> 'absent_both'")
def c9_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = C.field_verdicts(C.destination_fallback(aligned(spark, sf_dir)), absent=False)
    return C.report_rows(stated, show_all=True).select("shipment_id", "ord", "label", "verdict_label")


def results(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return reconcile(D.docs(spark, sf_dir), D.fields(spark, sf_dir), directives(spark, sf_dir))


_WHOLE = f"{_JUDGED}, {X.CONFLICTS}, {X.DIRECTIVES}, {X.INTERNAL}"


@register(f"""{_WHOLE} SELECT shipment_id, told.n AS n_fields, coalesce(said.n, 0) AS n_directives, coalesce(own.n, 0) AS n_internal, coalesce(odd.n, 0) AS n_conflicts, told.mismatches,
  told.t AS fields, coalesce(odd.t, '') AS conflicts, coalesce(said.t, '') AS directives, coalesce(own.t, '') AS internal
  FROM (SELECT shipment_id, count(*) AS n, count(*) FILTER (verdict = 'mismatch') AS mismatches,
    string_agg(label || ': ' || coalesce(a, '-') || ' / ' || coalesce(b, '-') || ': ' || verdict, '; ' ORDER BY ord) AS t FROM judged GROUP BY ALL) told
  LEFT JOIN (SELECT shipment_id, count(*) AS n, string_agg(side || ' ' || label || ': ' || vals, '; ' ORDER BY side, field_key) AS t FROM conflicts GROUP BY ALL) odd USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) AS n, string_agg(side || ' ' || kind || ': ' || verdict, '; ') AS t FROM directives GROUP BY ALL) said USING (shipment_id)
  LEFT JOIN (SELECT shipment_id, count(*) AS n, string_agg(label || ': ' || boxed || ' / ' || printed, '; ' ORDER BY label) AS t FROM internal GROUP BY ALL) own USING (shipment_id)""")
def c10_s5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job, as one nested row for each shipment: the sizes of its lists and what they say."""
    report = assemble_report(results(spark, sf_dir))
    size = lambda c, name: F.size(c).cast("long").alias(name)
    raw = lambda v: F.coalesce(v["raw"], F.lit("-"))
    line = {
        "fields": lambda x: F.concat(x["label"], F.lit(": "), raw(x["a"]), F.lit(" / "), raw(x["b"]), F.lit(": "), x["verdict"]),
        "conflicts": lambda x: F.concat(x["side"], F.lit(" "), x["label"], F.lit(": "), F.array_join(F.transform(x["values"], lambda v: F.concat(v["file"], F.lit(": "), v["raw"])), "; ")),
        "directives": lambda x: F.concat(x["side"], F.lit(" "), x["directive"]["forbid"]["kind"], F.lit(": "), x["verdict"]),
        "internal": lambda x: F.concat(x["label"], F.lit(": "), F.array_join(x["values"], " / ")),
    }
    told = [F.array_join(F.transform(name, said), "; ").alias(name) for name, said in line.items()]
    return report.select("shipment_id", size("fields", "n_fields"), size("directives", "n_directives"), size("internal", "n_internal"), size("conflicts", "n_conflicts"), F.col("summary.mismatches").alias("mismatches"), *told)


# -- review

def reviewed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The review of the fields read from the texts: the text reader finds nothing in packing lists' headings."""
    docs = D.docs(spark, sf_dir)
    doubt = docs.where("shipment_id % 5 = 0 and doc_seq = 0").select(*KEY, F.lit(0).alias("pos"), F.concat("file_name", F.lit(": no consignee cell found.")).alias("message"))
    return review(docs, T.read_text(docs), doubt)


_ASSESSED = f"""{D.cte()}, sides AS (SELECT k, 'A' AS side, '' AS missing FROM base UNION ALL SELECT k, 'B', 'consignee,goods,portOfDischarge' FROM base WHERE n > 0)"""


@register(f"""{_ASSESSED} SELECT k AS shipment_id, side, missing, CASE WHEN missing <> '' THEN 'B: rules found no consignee, goods, portOfDischarge.' ELSE '' END || CASE WHEN missing <> '' AND k % 5 = 0 THEN '|' ELSE '' END ||
  CASE WHEN k % 5 = 0 THEN CASE side WHEN 'A' THEN 'A: inst.docx was read with doubt.' ELSE 'B: draft.pdf was read with doubt.' END ELSE '' END AS reasons FROM sides""")
def a1_assess_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir)["assessed"].select("shipment_id", "side", F.array_join("missing", ",").alias("missing"), F.array_join("reasons", "|").alias("reasons"))


@register(f"""{_ASSESSED} SELECT k AS shipment_id, side, 1 AS queue_pos, 0 AS doc_seq, CASE WHEN missing <> '' THEN missing ELSE 'consignee,packages,goods' END AS asked FROM sides WHERE missing <> '' OR k % 5 = 0""")
def a2_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir)["queue"].select("shipment_id", "side", "queue_pos", "doc_seq", F.array_join("asked", ",").alias("asked"))


@register(f"""{_ASSESSED}, b AS (SELECT k, doc_seq FROM base, (VALUES (0), (1)) d(doc_seq) WHERE n > 0)
SELECT k AS shipment_id, 'B' AS side, doc_seq + 1 AS queue_pos, doc_seq, CASE WHEN doc_seq = 1 AND k % 11 <> 0 THEN 'consignee,portOfDischarge' ELSE 'consignee,goods,portOfDischarge' END AS asked FROM b
UNION ALL SELECT k, side, 1, 0, 'consignee,packages,goods' FROM sides WHERE side = 'A' AND k % 5 = 0""")
def a2_ask_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each draft stands there twice; the first one's answer gives the goods, but for every 11th order, whose call fails."""
    docs = D.docs(spark, sf_dir)
    docs = stored(docs.unionByName(docs.where("side = 'B'").withColumns({"doc_seq": F.lit(1), "file_name": F.lit("again.pdf")})))
    doubt = docs.where("shipment_id % 5 = 0 and doc_seq = 0").select(*KEY, F.lit(0).alias("pos"), F.concat("file_name", F.lit(": no consignee cell found.")).alias("message"))
    found = review(docs, T.read_text(docs), doubt)
    k = F.col("shipment_id")

    def ask(questions: DataFrame) -> DataFrame:
        fails = (k % 11 == 0) & (F.col("doc_seq") == 0)
        return questions.withColumns({"provider": F.lit("svc"), "body": F.when(~fails, F.lit('{"goods": "NUTS"}')), "error": F.when(fails, "busy")})

    queue, _ = A.ask_in_turn(found["side_fields"], found["assessed"], docs, ask)
    return queue.select("shipment_id", "side", "queue_pos", "doc_seq", F.array_join("asked", ",").alias("asked"))


def asked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The review with the responses of a service that is busy for every 11th order."""
    found = reviewed(spark, sf_dir)
    k = F.col("shipment_id")
    body = F.when(k % 11 != 0, F.concat(F.lit('{"goods": " NUTS\\\\nBOLTS ", "consignee": "", "shipper": "X", "portOfDischarge": "PORT '), k.cast("string"), F.lit('"}')))
    responses = found["queue"].where("side = 'B'").select("shipment_id", "side", "queue_pos", F.lit("svc").alias("provider"), body.alias("body"), F.when(k % 11 == 0, "busy").alias("error"))
    return found | answered(found, responses)


_ANSWERS = "FROM base WHERE n > 0 AND k % 11 <> 0"


@register(f"""{D.cte()} SELECT k AS shipment_id, 'goods' AS field_key, 'NUTS' || chr(92) || 'nBOLTS' AS raw {_ANSWERS} UNION ALL SELECT k, 'portOfDischarge', 'PORT ' || k::VARCHAR {_ANSWERS}""")
def a3_parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir)["answers"].select("shipment_id", "field_key", "raw")


@register(f"""{D.cte()} SELECT k AS shipment_id, 'goods' AS field_key, 'NUTS' || chr(10) || 'BOLTS' AS raw, 'llm' AS source {_ANSWERS} UNION ALL SELECT k, 'portOfDischarge', 'PORT ' || k::VARCHAR, 'llm' {_ANSWERS}
  UNION ALL SELECT k, 'goods', 'BOLTS, NUTS', NULL FROM base UNION ALL SELECT k, 'portOfDischarge', CASE WHEN k % 2 = 0 THEN 'WEST PORT' ELSE 'NORTH PORT' END, NULL FROM base""")
def a4_fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir)["filled"].where("field_key in ('goods', 'portOfDischarge')").select("shipment_id", "field_key", "raw", "source")


@register(f"""{D.cte()} SELECT k AS shipment_id, n > 0 AND k % 11 <> 0 AS used, CASE WHEN n > 0 THEN 'svc' ELSE 'none' END AS provider, CASE WHEN n > 0 AND k % 11 <> 0 THEN 'draft.pdf' ELSE '' END AS docs,
  CASE WHEN n > 0 AND k % 11 <> 0 THEN 'draft.pdf: goods|draft.pdf: portOfDischarge' ELSE '' END AS filled,
  CASE WHEN n = 0 AND k % 5 <> 0 THEN {X.q(A.CLEAN)} ELSE concat_ws('|', CASE WHEN k % 5 = 0 THEN 'A: inst.docx was read with doubt.' END, CASE WHEN n > 0 THEN 'B: rules found no consignee, goods, portOfDischarge.' END,
    CASE WHEN n > 0 AND k % 5 = 0 THEN 'B: draft.pdf was read with doubt.' END, CASE WHEN n > 0 AND k % 11 = 0 THEN 'draft.pdf: model call failed (busy). Rules-only result shown.' END) END AS reasons, (CASE WHEN n = 0 AND k % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END +
  CASE WHEN n > 0 THEN 1 ELSE 0 END + CASE WHEN n > 0 AND k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN n > 0 AND k % 11 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_reasons FROM base""")
def a5_assist_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir)["report"].select("shipment_id", "used", "provider", F.array_join("docs", "|").alias("docs"), F.array_join("filled", "|").alias("filled"), F.array_join("reasons", "|").alias("reasons"), F.size("reasons").cast("long").alias("n_reasons"))


_PROBED = ", ".join(f"({X.q(k)})" for k in Q.PROBED)


@register(f"""{D.cte('fields')}, wanted AS (SELECT field_key, raw AS want FROM fields WHERE side = 'A' AND doc_seq = 0 AND shipment_id = (SELECT min(k) FROM base)),
got AS (SELECT shipment_id, field_key, raw FROM fields WHERE side = 'B'), grid AS (SELECT DISTINCT g.shipment_id, p.field_key FROM got g, (VALUES {_PROBED}) p(field_key)),
x AS (SELECT grid.*, got.raw, coalesce(want, '') AS want FROM grid LEFT JOIN got USING (shipment_id, field_key) LEFT JOIN wanted USING (field_key)),
y AS (SELECT shipment_id, coalesce(raw, '') = '' AS absent, {X.normalize_for(X.comparator('field_key'), 'want')} IS NOT DISTINCT FROM {X.normalize_for(X.comparator('field_key'), 'raw')} OR {X.fold_ocr('want')} = {X.fold_ocr('raw')} AS same FROM x),
z AS (SELECT shipment_id, count(*) FILTER (NOT absent AND same) AS n_right, count(*) FILTER (absent) AS n_absent, count(*) FILTER (NOT absent AND NOT same) AS n_wrong FROM y GROUP BY shipment_id)
SELECT shipment_id::VARCHAR AS condition, n_right, n_absent, n_wrong, CASE WHEN n_wrong = 0 THEN 'safe' WHEN shipment_id % 2 = 1 THEN 'wrong, but warned' ELSE 'wrong and silent' END AS verdict FROM z""")
def q1_score_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's draft as a probe of the first order's instruction."""
    fields = D.fields(spark, sf_dir)
    first = D.base(spark, sf_dir).agg(F.min("k").alias("k0"))
    base = fields.where("side = 'A' and doc_seq = 0").join(F.broadcast(first), F.col("shipment_id") == F.col("k0"))
    probes = fields.where("side = 'B'").select(F.col("shipment_id").cast("string").alias("condition"), "field_key", "raw", (F.col("shipment_id") % 2).alias("n_warnings"))
    return Q.score_extraction(base, probes, 0).select("condition", "n_right", "n_absent", "n_wrong", "verdict")


# -- tilt of scans

@register(f"""{D.SCANS_CTE}, angles AS (SELECT n, tan(radians(-8 + n * 0.25)) AS slope FROM range(65) t(n)),
bands AS (SELECT k, n, floor(y - x * slope + 0.5) AS band, count(*) AS c FROM ink CROSS JOIN angles GROUP BY ALL),
scored AS (SELECT k, n, sum(c * c) AS score FROM bands GROUP BY ALL),
best AS (SELECT k, arg_max(n, struct_pack(s := score, first := -n)) AS n FROM scored GROUP BY k),
sizes AS (SELECT k, count(*) AS ink FROM ink GROUP BY k)
SELECT k AS shipment_id, 'B' AS side, 0 AS doc_seq, CASE WHEN ink < 2000 THEN 0.0::DOUBLE ELSE -8 + n * 0.25::DOUBLE END AS skew FROM best JOIN sizes USING (k)""")
def e26_estimate_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tilt of a ruled scan for each supplier."""
    return I.estimate_skew(D.scans(spark, sf_dir))
