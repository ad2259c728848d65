"""Reading text documents into named fields (E1-E10) and free label-value pairs.

Documents come as rows (shipment_id, side, doc_seq, file_name, kind, format, text).  Fields leave in the
long form (shipment_id, side, doc_seq, field_key, raw, where, source, file, rank): within one document
the smallest rank of a key wins.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside import rules as R
from quayside.functions.scalars import (
    canonical_port, find_emails, find_hs_codes, first_label, label_key, label_start, let, norm_id, strip_notes, trim,
)

KEY = ["shipment_id", "side", "doc_seq"]
FIELD = [*KEY, "field_key", "raw", "where", "source", "file"]
#: Order in which a document's readings of one key count.
LABELLED, BARE_PORT, SHAPE, REGISTRATION = 0, 1_000_000_000, 2_000_000_000, 3_000_000_000
RANKED = "array<struct<field_key:string,raw:string,where:string,rank:bigint>>"


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, line_no from 1, text) of every line."""
    return docs.select(*KEY, F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(*KEY, (F.col("pos") + 1).alias("line_no"), "text")


def entries(text: Column) -> Column:
    """E1 in a document's row: an array of (line_no, text, gap_after): non-blank lines, trimmed, and the blank lines that follow."""

    def gaps(lines: Column) -> Column:
        kept = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), trim(x).alias("text"))), lambda x: x["text"] != "")

        def with_gap(kept: Column) -> Column:
            after = F.concat(F.slice(F.transform(kept, lambda x: x["line_no"]), F.lit(2), F.size(kept)), F.array(F.size(lines) + 1))
            rows = F.zip_with(kept, after, lambda x, y: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), (y - x["line_no"] - 1).alias("gap_after")))
            return F.slice(rows, F.lit(1), F.size(kept))

        return let(kept, with_gap)

    return let(F.split(text, "\n"), gaps)


def break_gap(rows: Column) -> Column:
    """E2 in a document's row: how many blank lines end a block: 2 for double-spaced documents, else 1."""

    def judged(gaps: Column) -> Column:
        single, wide = F.size(F.filter(gaps, lambda g: g == 1)), F.exists(gaps, lambda g: g >= 2)
        return F.when((single >= F.size(gaps) * 0.5) & wide, 2).otherwise(1)

    # the last line's gap ends the document, not a block
    return let(F.transform(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: x["gap_after"]), judged)


def blocks(rows: Column) -> Column:
    """E3 in a document's row: an array of (field_key, raw, where, rank), one for each labelled block with a value.

    A block starts at a label or after a break; only those that start at a label have a value.  Each block is a slice of the lines, so
    the work is in proportion to the lines.
    """

    def cut(lines: Column, gap: Column) -> Column:
        # (line, its label or null, the lines' gap before)
        before = F.concat(F.array(F.lit(1 << 30)), F.transform(lines, lambda x: x["gap_after"]))
        marked = F.zip_with(lines, before, lambda x, g: F.struct(x.alias("line"), first_label(x["text"], same_line=False).alias("label"), g.alias("before")))
        return let(F.slice(marked, F.lit(1), F.size(lines)), lambda marked: sliced(marked, gap))

    def sliced(marked: Column, gap: Column) -> Column:
        begins = F.filter(F.transform(marked, lambda m, i: F.when(m["label"].isNotNull() | (m["before"] >= gap), i + 1)), lambda i: i.isNotNull())

        def each(begins: Column) -> Column:
            ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(marked) + 1))
            spans = F.zip_with(begins, ends, lambda i, j: F.struct(F.element_at(marked, i).alias("head"), F.slice(marked, i + 1, j - i - 1).alias("rest")))
            spans = F.filter(F.slice(spans, F.lit(1), F.size(begins)), lambda b: b["head"]["label"].isNotNull())
            return F.transform(spans, valued)

        return F.when(F.size(begins) > 0, let(begins, each)).otherwise(F.array().cast(RANKED))

    def valued(b: Column) -> Column:
        head = b["head"]
        parts = F.concat(F.array(head["label"]["rest"]), F.transform(b["rest"], lambda m: m["line"]["text"]))
        raw = strip_notes(F.array_join(F.filter(parts, lambda v: v != ""), "\n"))
        heading = F.substring_index(F.substring_index(head["line"]["text"], ":", 1), "：", 1)
        where = F.concat(F.lit("SI line "), head["line"]["line_no"], F.lit(" ("), trim(heading), F.lit(")"))
        return F.struct(head["label"]["key"].alias("field_key"), raw.alias("raw"), where.alias("where"), head["line"]["line_no"].cast("long").alias("rank"))

    return F.filter(let(rows, lambda lines: let(break_gap(lines), lambda gap: cut(lines, gap))), lambda f: f["raw"] != "")


def bare_ports(rows: Column, stated: Column) -> Column:
    """E4 in a document's row: if ``stated`` has no discharge port, the first short line that is a port's name, for each destination key."""
    names = F.array(*(F.lit("".join(ch for ch in a.upper() if ch.isascii() and ch.isalnum())) for group in R.PORTS for a in group))
    first = F.get(F.filter(rows, lambda x: (F.length(x["text"]) <= 40) & F.array_contains(names, norm_id(x["text"]))), F.lit(0))

    def named(line: Column) -> Column:
        where = F.concat(F.lit("SI line "), line["line_no"], F.lit(" (unlabelled port)"))
        return F.array(*(F.struct(F.lit(k).alias("field_key"), line["text"].alias("raw"), where.alias("where"), F.lit(BARE_PORT).cast("long").alias("rank")) for k in R.DESTINATION))

    lacks = ~F.exists(stated, lambda f: f["field_key"] == "portOfDischarge")
    return let(F.when(lacks, first), lambda line: F.when(line.isNotNull(), named(line)).otherwise(F.array().cast(RANKED)))


def line_entries(docs: DataFrame) -> DataFrame:
    """(key, line_no, text, gap_after)."""
    return docs.select(*KEY, F.inline(entries(F.col("text"))))


def block_break_gap(docs: DataFrame) -> DataFrame:
    """(key, break_gap) of documents that have a line."""
    rows = docs.select(*KEY, entries(F.col("text")).alias("_e")).where(F.size("_e") > 0)
    return rows.select(*KEY, break_gap(F.col("_e")).alias("break_gap"))


def _listed(docs: DataFrame, found: Column, source: Column | None = None) -> DataFrame:
    """An array of (field_key, raw, where, rank) in each document's row as fields in the long form."""
    rows = docs.select(*KEY, F.col("file_name").alias("file"), F.inline(found))
    return rows.select(*KEY, "field_key", "raw", "where", (F.lit(None) if source is None else source).cast("string").alias("source"), "file", "rank")


def labelled_blocks(docs: DataFrame) -> DataFrame:
    """Values of labelled lines and the lines that belong to them, as ranked fields."""
    return _listed(docs, blocks(entries(F.col("text"))))


def bare_port_lines(docs: DataFrame) -> DataFrame:
    """In documents without a labelled discharge port, the first short line that is a port's name fills the destination keys."""
    return _listed(docs, let(entries(F.col("text")), lambda rows: bare_ports(rows, blocks(rows))))


def line_at(text: Column, pattern: str) -> Column:
    """Number of the line, from 1, in which a pattern's first match begins."""
    before = F.substring(text, F.lit(1), F.greatest(F.regexp_instr(text, F.lit(pattern)) - 1, F.lit(0)))
    return let(before, lambda before: F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def shapes(style: str = "docx") -> Column:
    """E5 in a document's row: an array of (field_key, raw, where, rank)."""
    known = [
        ("grossWeight", R.WEIGHT, "gross weight"), ("measurement", R.VOLUME, "measurement"), ("packages", R.PACKAGES, "packages"),
        ("containerNo", R.CONTAINER, "container no."), ("freightTerms", R.FREIGHT, "freight terms"),
    ]
    if style == "image":  # certificates state weight and packages otherwise
        known = [s for s in known if s[0] not in ("grossWeight", "packages")]
    if style != "docx":
        known.append(("containerType", R.CONTAINER_TYPE, "container type"))

    def shape(n: int, key: str, pattern: str, what: str) -> Column:
        def shaped(found: Column) -> Column:
            raw = trim(found)
            if key == "containerType":
                raw = F.regexp_replace(F.upper(raw), R.WS, "")
            where = F.concat(F.lit("SI line "), line_at(F.col("text"), pattern), F.lit(f" ({what})")) if style == "docx" else F.concat("file_name", F.lit(f" ({what})"))
            # where it stands is looked for only if it is there
            return F.when(found != "", F.struct(F.lit(key).alias("field_key"), strip_notes(raw).alias("raw"), where.alias("where"), F.lit(SHAPE + n).cast("long").alias("rank")))

        return let(F.regexp_extract("text", pattern, 0), shaped)

    return F.filter(F.array(*(shape(n, *s) for n, s in enumerate(known))), lambda f: f["raw"] != "")


def shape_scan(docs: DataFrame, style: str = "docx") -> DataFrame:
    """E5: values known by their shape, anywhere in the text.  Styles: docx, xlsx, image."""
    return _listed(docs, shapes(style), F.lit("ocr") if style == "image" else None)


def registration(text: Column) -> Column:
    """The registration number as 'a / b', or ''."""

    def numbers(found: Column) -> Column:
        # the pattern looks at nothing outside its match, so that the match alone has the same groups
        a, b = F.regexp_extract(found, R.REGISTRATION, 1), F.regexp_extract(found, R.REGISTRATION, 2)
        return F.when(found != "", F.concat(a, F.lit(" / "), b)).otherwise("")

    return let(F.regexp_extract(text, R.REGISTRATION, 0), numbers)


def phone(text: Column) -> Column:
    return trim(F.regexp_extract(text, R.PHONE, 1))


def contacts(style: str = "docx") -> Column:
    """E6 in a document's row: an array of (field_key, raw, where, rank)."""
    text = F.col("text")
    names = ["SI consignee block (registration no.)", "SI consignee block (tel/fax)"]
    where = [F.lit(n) for n in names] if style == "docx" else [F.concat("file_name", F.lit(f" ({n})")) for n in ("registration no.", "tel/fax")]
    rows = [
        F.struct(F.lit(key).alias("field_key"), raw.alias("raw"), w.alias("where"), F.lit(REGISTRATION + n).cast("long").alias("rank"))
        for n, (key, raw, w) in enumerate((("consigneeRegNo", registration(text), where[0]), ("consigneePhone", phone(text), where[1])))
    ]
    return F.filter(F.array(*rows), lambda f: f["raw"] != "")


def reg_and_phone(docs: DataFrame, style: str = "docx") -> DataFrame:
    """Registration number and phone of the whole text."""
    return _listed(docs, contacts(style), F.lit("ocr") if style == "image" else None)


def printed_number(text: Column) -> Column:
    """The first registration number as a text prints it, with its brackets, or ''."""
    return trim(F.regexp_extract(text, R.REGISTRATION, 0))


def without_contacts(raw: Column, number: Column) -> Column:
    """Lines that aren't a phone line and don't hold the registration number ``number``."""
    kept = F.filter(F.split(raw, "\n"), lambda x: ~trim(x).rlike(R.PHONE_LINE) & ~((number != "") & F.contains(x, number)))
    return trim(F.array_join(kept, "\n"))


def clean_party(fields: DataFrame, docs: DataFrame, keys: tuple[str, ...] = ("consignee",)) -> DataFrame:
    """Party names without contact lines; a value of which nothing would be left stays.

    What is joined to a document's fields is its registration number, not its text.
    """
    numbers = docs.select(*KEY, printed_number(F.col("text")).alias("_number"))
    cut = without_contacts(F.col("raw"), F.col("_number"))
    raw = F.when(F.col("field_key").isin(*keys) & (cut != ""), cut).otherwise(F.col("raw"))
    return fields.join(numbers, KEY).withColumn("raw", raw).drop("_number")


def goods_names(raw: Column) -> Column:
    names = F.transform(F.split(raw, "\n"), lambda x: trim(F.regexp_replace(F.regexp_replace(x, R.HS, ""), rf"{R.WS}{{2,}}", " ")))
    return F.array_join(F.filter(names, lambda x: x != ""), ", ")


def goods_and_codes(key: Column, raw: Column) -> Column:
    """E8 of one field: an array of (field_key, raw); goods give their names and, if they hold any, their tariff codes."""
    codes = F.array_join(find_hs_codes(raw), ", ")
    one = lambda k, v: F.struct(k.alias("field_key"), v.alias("raw"))
    both = let(codes, lambda c: F.when(c != "", F.array(one(F.lit("goods"), goods_names(raw)), one(F.lit("hsCodes"), c))).otherwise(F.array(one(F.lit("goods"), goods_names(raw)))))
    return F.when(key == "goods", both).otherwise(F.array(one(key, raw)))


def split_goods(fields: DataFrame) -> DataFrame:
    """Tariff codes out of the goods into a field of their own."""
    out = fields.withColumn("_x", F.explode(goods_and_codes(F.col("field_key"), F.col("raw"))))
    out = out.withColumns({"field_key": F.col("_x.field_key"), "raw": F.col("_x.raw")}).drop("_x")
    return out.where("field_key <> 'hsCodes' or raw <> ''")


def first_readings(fields: DataFrame) -> DataFrame:
    """The reading of smallest rank for each key of a document."""
    best = F.min_by(F.struct("raw", "where", "source", "file"), "rank")
    return fields.groupBy(*KEY, "field_key").agg(best.alias("b")).select(*KEY, "field_key", "b.raw", "b.where", "b.source", "b.file")


def extract_directives(docs: DataFrame, style: str = "docx") -> DataFrame:
    """Instructions to keep something off, as (key, pos, id, raw, meaning, forbid_kind, forbid_value, where, file)."""
    found = docs.select(*KEY, "file_name", "text", F.posexplode(F.regexp_extract_all("text", F.lit(R.PARENTHESES), F.lit(0))).alias("n", "raw"))
    found = found.where(F.col("raw").rlike("|".join(R.SUPPRESS)))
    inner = F.expr("substring(raw, 2, length(raw) - 2)")
    email = F.get(find_emails(inner), F.lit(0))
    hs = F.upper(inner).rlike("|".join(w.upper() for w in R.HS_WORDS))
    kind = F.when(email.isNotNull(), "email").when(hs, "hsCodes").otherwise("literal")
    found = found.withColumns({"forbid_kind": kind, "forbid_value": F.when(kind == "email", email)})
    if style == "image":
        found = found.where("forbid_kind <> 'literal'")
    if style != "docx":  # such sheets repeat one note in several places
        same = Window.partitionBy(*KEY, F.upper(F.regexp_replace(inner, rf"{R.WS}+", ""))).orderBy("n")
        found = found.withColumn("_r", F.row_number().over(same)).where("_r = 1").drop("_r")
    pos = F.row_number().over(Window.partitionBy(*KEY).orderBy("n")) - 1
    found = found.withColumn("pos", pos)
    name = F.create_map(*(F.lit(x) for x in ("email", "no-email-", "hsCodes", "no-hs-", "literal", "suppress-")))
    meaning = (
        F.when(F.col("forbid_kind") == "email", F.concat(F.lit("Do not show the email address "), "forbid_value", F.lit(" on the B/L.")))
        .when(F.col("forbid_kind") == "hsCodes", "Do not print HS / customs codes on the B/L.")
        .otherwise("An instruction to keep something off the B/L, not understood automatically.")
    )
    at = F.expr("length(substring_index(text, raw, 1))")
    if style == "docx":
        before = F.substring("text", F.lit(1), at)
        where = F.concat(F.lit("SI line "), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)
    else:
        where = F.concat("file_name", F.lit(" (instruction)"))
    return found.select(
        *KEY, "pos", F.concat(F.element_at(name, F.col("forbid_kind")), F.col("pos").cast("string")).alias("id"), "raw", meaning.alias("meaning"),
        "forbid_kind", "forbid_value", where.alias("where"), F.col("file_name").alias("file"),
    )


class Reading(NamedTuple):
    """What a reader makes of documents: their fields, the documents with their text, and (key, pos, message) of its warnings."""

    fields: DataFrame
    docs: DataFrame
    warnings: DataFrame


PORT_KEYS = {"docx": R.DESTINATION[:1], "xlsx": ["portOfDischarge", "finalDestination"], "image": ["portOfDischarge", "finalDestination", "placeOfDelivery"], "pdf": []}


def said_by(docs: DataFrame, fields: DataFrame, style: str, more: Iterable[tuple[int, DataFrame]] = ()) -> DataFrame:
    """(key, pos, message): all warnings of a reading, in the order of the reader's steps.

    ``more``: (step, (key, message)) of what the steps themselves have told.  ``docs`` may have ``n_pages`` (pdf) and ``sheets`` (xlsx), the
    names of a workbook's sheets.
    """
    needed = ["consignee", "containerNo", *R.DESTINATION]
    held = fields.where(F.col("field_key").isin(*needed)).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field_key", "raw"))).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    port = F.coalesce(*map(get, PORT_KEYS[style])) if PORT_KEYS[style] else F.lit(None).cast("string")
    file, text = F.col("file_name"), F.coalesce(F.col("text"), F.lit(""))
    unknown = F.when(port.isNotNull() & canonical_port(port).isNull(), F.concat(F.lit('Port "'), port, F.lit('" is not in the alias table, so it is compared as plain text.')))
    pages = F.col("n_pages") if "n_pages" in docs.columns else F.lit(None).cast("int")
    sheets = F.col("sheets") if "sheets" in docs.columns else F.lit(None).cast("array<string>")
    lacks = {
        "docx": [
            F.when(get("consignee").isNull(), "No CONSIGNEE block found in the SI."),
            F.when(port.isNull(), "No discharge port found in the SI — no label, and no line matching a known port name.").otherwise(unknown),
        ],
        "xlsx": [
            F.when(F.size(sheets) > 1, F.concat(F.lit("Workbook has "), F.size(sheets).cast("string"), F.lit(" sheets ("), F.array_join(sheets, ", "), F.lit("); all were read as one form."))),
            F.when(text == "", "This spreadsheet has no readable cells."),
            F.when(get("consignee").isNull(), F.concat(file, F.lit(": no consignee cell found."))),
            F.when(port.isNull(), F.concat(file, F.lit(": no discharge port or final destination found."))).otherwise(unknown),
        ],
        "image": [None, None, None, None, None, F.when(get("consignee").isNull(), F.concat(file, F.lit(": no consignee could be located."))), unknown],
        "pdf": [
            F.when(text == "", "This PDF has no text layer — it is probably a pure scan. Field extraction needs a text-based PDF (OCR it first)."),
            F.when(pages > 1, F.concat(F.lit("PDF has "), pages.cast("string"), F.lit(" pages; all pages were read as one form."))),
            None, None,
            F.when(get("containerNo").isNull(), "No container number (4 letters + 7 digits) found on the B/L."),
            F.when(get("consignee").isNull(), "Consignee box read as empty — check the B/L layout matches the expected form."),
        ],
    }[style]
    told = F.array(*(F.struct(F.lit(step).alias("step"), said.alias("message")) for step, said in enumerate(lacks) if said is not None))
    rows = docs.join(held, KEY, "left").withColumn("_own", F.filter(told, lambda x: x["message"].isNotNull()))
    more = list(more)
    if not more:
        return rows.select(*KEY, F.posexplode("_own").alias("pos", "_w")).select(*KEY, "pos", "_w.message")
    steps = more[0][1].select(*KEY, F.lit(more[0][0]).alias("step"), "message")
    for step, df in more[1:]:
        steps = steps.unionByName(df.select(*KEY, F.lit(step).alias("step"), "message"))
    by_doc = steps.groupBy(*KEY).agg(F.collect_list(F.struct("step", "message")).alias("_more"))
    every = F.sort_array(F.concat("_own", F.coalesce("_more", F.array().cast("array<struct<step:int,message:string>>"))))
    return rows.join(by_doc, KEY, "left").select(*KEY, F.posexplode(every).alias("pos", "_w")).select(*KEY, "pos", "_w.message")


def doc_warnings(docs: DataFrame, fields: DataFrame, style: str = "docx") -> DataFrame:
    """(key, pos, message): what a reading lacks."""
    return said_by(docs, fields, style)


def text_fields() -> Column:
    """E1-E8 in a document's row (text, file_name): an array of (field_key, raw, where, rank), the first reading of each key."""
    text = F.col("text")
    found = let(entries(text), lambda rows: let(blocks(rows), lambda own: F.concat(own, bare_ports(rows, own), shapes(), contacts())))

    def first_of_each(found: Column, number: Column) -> Column:
        # in the order of their ranks already
        keys = F.transform(found, lambda f: f["field_key"])
        first = let(keys, lambda keys: F.filter(found, lambda f, i: F.array_position(keys, f["field_key"]) == i + 1))
        return F.flatten(F.transform(first, lambda f: cleaned(f, number)))

    def cleaned(f: Column, number: Column) -> Column:
        cut = let(without_contacts(f["raw"], number), lambda cut: F.when(cut != "", cut).otherwise(f["raw"]))
        parts = goods_and_codes(f["field_key"], F.when(f["field_key"] == "consignee", cut).otherwise(f["raw"]))
        return F.transform(parts, lambda p: F.struct(p["field_key"].alias("field_key"), p["raw"].alias("raw"), f["where"].alias("where"), f["rank"].alias("rank")))

    return let(found, lambda found: let(printed_number(text), lambda number: first_of_each(found, number)))


def read_text(docs: DataFrame) -> DataFrame:
    """E1-E8 together: one row for each field of each text document, out of the document's own row: no exchange, no join."""
    return _listed(docs, text_fields()).select(*FIELD)


def discover_pairs(docs: DataFrame) -> DataFrame:
    """(key, pos, label_key, label, value, file): explicit pairs that no curated field covers.

    A document's pairs are found, judged and told apart in its own row; a label counts once, where it stands first.
    """
    pattern = rf"[^:：]{{2,32}}?{R.WS}*[:：]{R.WS}*[^:：]{{1,60}}?(?={R.WS}{{2,}}[^\s\x{{3000}}]+{R.WS}*[:：]|\z)"
    word = f"[A-Za-z{R.CJK}]"
    begins_label = lambda c: F.regexp_instr(trim(c), F.lit(label_start(R.LABELS))) > 0

    def split(pair: Column) -> Column:
        # a match holds one colon
        before = F.substring_index(F.substring_index(pair, ":", 1), "：", 1)
        label = F.regexp_replace(trim(before), rf"^(?:{R.WS}|[\d.、)(\"'（])+", "")
        return F.struct(label.alias("label"), trim(F.substring(pair, F.length(before) + 2, F.length(pair))).alias("value"))

    def judged(p: Column) -> Column:
        label, value = p["label"], p["value"]
        good = F.length(label).between(2, 32) & F.length(value).between(1, 60) & label.rlike(word) & value.rlike(f"[A-Za-z0-9{R.CJK}]")
        good = good & ~begins_label(label) & ~trim(label).rlike(R.NOISE) & ~begins_label(value)
        keyed = lambda key: F.when((key != "") & (key != label_key(value)), F.struct(key.alias("label_key"), label.alias("label"), value.alias("value")))
        return F.when(good, let(label_key(label), keyed))

    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(":")) | F.contains(x, F.lit("：")))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(0))))
    pairs = F.filter(F.transform(F.transform(found, split), judged), lambda p: p.isNotNull())
    once = lambda pairs: let(F.transform(pairs, lambda p: p["label_key"]), lambda keys: F.filter(pairs, lambda p, i: F.array_position(keys, p["label_key"]) == i + 1))
    rows = docs.select(*KEY, F.col("file_name").alias("file"), F.posexplode(let(pairs, once)).alias("pos", "_p"))
    return rows.select(*KEY, "pos", "_p.label_key", "_p.label", "_p.value", "file")
