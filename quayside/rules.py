"""Rule tables of the paperwork jobs.

Everything in this module is a fixed value that results depend on: names, order and patterns.  Each is a
default of the function that uses it, so a caller extends a table by passing a longer one.
"""

from __future__ import annotations

#: key, label, comparator, required on A, required on B; in report order.
FIELD_SPECS = [
    ("shipper", "Shipper", "text", False, True),
    ("consignee", "Consignee", "text", True, True),
    ("consigneeRegNo", "Consignee registration no.", "id", False, False),
    ("consigneePhone", "Consignee tel / fax", "phone", False, False),
    ("notifyParty", "Notify party", "text", False, True),
    ("placeOfReceipt", "Place of receipt", "port", False, False),
    ("vesselVoyage", "Ocean vessel / voyage", "vessel", False, True),
    ("portOfLoading", "Port of loading", "port", False, True),
    ("portOfDischarge", "Port of discharge", "port", True, True),
    ("placeOfDelivery", "Place of delivery", "port", False, False),
    ("finalDestination", "Final destination", "port", False, False),
    ("containerNo", "Container no.", "id", False, True),
    ("sealNo", "Seal no.", "id", False, True),
    ("containerType", "Container type", "id", False, False),
    ("packages", "No. of packages", "packages", True, True),
    ("grossWeight", "Gross weight", "number", True, True),
    ("measurement", "Measurement (CBM)", "number", True, True),
    ("goods", "Description of goods", "list", True, True),
    ("freightTerms", "Freight terms", "text", False, False),
    ("marks", "Marks and numbers", "text", False, False),
    ("soNo", "S/O no.", "id", False, False),
]
EXTRA_LABELS = {"hsCodes": "HS codes"}
COMPARATOR = {key: comparator for key, _, comparator, _, _ in FIELD_SPECS}
LABEL = {key: label for key, label, _, _, _ in FIELD_SPECS} | EXTRA_LABELS

#: The names a destination goes by, in the order in which one stands in for another.
DESTINATION = ["portOfDischarge", "placeOfDelivery", "finalDestination"]

#: Spellings of each port; the first is the canonical one.
PORTS = [
    ["PORT KLANG, MALAYSIA", "PORT KLANG", "PORT KELANG", "PELABUHAN KLANG", "KLANG", "PORT KLANG MALAYSIA", "PORT KELANG MALAYSIA"],
    ["PORT KLANG (NORTH PORT), MALAYSIA", "NORTH PORT", "NORTHPORT", "PORT KELANG(N)", "PORT KELANG (N)", "PORT KLANG(N)", "PORT KLANG (N)",
     "PORT KELANG NORTH", "PORT KLANG NORTH PORT", "NORTH PORT, PORT KLANG", "NORTH PORT PORT KELANG"],
    ["PORT KLANG (WEST PORT), MALAYSIA", "WEST PORT", "WESTPORT", "PORT KELANG(W)", "PORT KELANG (W)", "PORT KLANG(W)", "PORT KLANG (W)", "PORT KLANG WEST PORT"],
    ["NANSHA, CHINA", "NANSHA", "NANSHA PORT", "NANSHA, GUANGZHOU", "GUANGZHOU NANSHA"],
    ["SHEKOU, CHINA", "SHEKOU", "SHEKOU PORT", "SHENZHEN SHEKOU"],
    ["YANTIAN, CHINA", "YANTIAN", "YANTIAN PORT", "SHENZHEN YANTIAN"],
    ["SHANGHAI, CHINA", "SHANGHAI", "SHANGHAI PORT"],
    ["NINGBO, CHINA", "NINGBO", "NINGBO PORT"],
    ["PASIR GUDANG, MALAYSIA", "PASIR GUDANG", "PASIR GUDANG PORT", "JOHOR PASIR GUDANG"],
    ["TANJUNG PELEPAS, MALAYSIA", "TANJUNG PELEPAS", "PTP", "PORT TANJUNG PELEPAS"],
    ["PENANG, MALAYSIA", "PENANG", "PENANG PORT", "GEORGETOWN PENANG"],
    ["SINGAPORE", "SINGAPORE PORT", "SIN"],
]
#: terminal -> the port it lies in
TERMINALS = {
    "PORT KLANG (NORTH PORT), MALAYSIA": "PORT KLANG, MALAYSIA",
    "PORT KLANG (WEST PORT), MALAYSIA": "PORT KLANG, MALAYSIA",
}

#: unit spelling -> canonical unit
UNITS = {
    "CTN": "CARTON", "CTNS": "CARTON", "CARTON": "CARTON", "CARTONS": "CARTON", "CTS": "CARTON",
    "PKG": "PACKAGE", "PKGS": "PACKAGE", "PACKAGE": "PACKAGE", "PACKAGES": "PACKAGE",
    "PLT": "PALLET", "PLTS": "PALLET", "PALLET": "PALLET", "PALLETS": "PALLET",
    "BAG": "BAG", "BAGS": "BAG", "ROLL": "ROLL", "ROLLS": "ROLL", "PCS": "PIECE", "PIECE": "PIECE", "PIECES": "PIECE",
    "CASE": "CASE", "CASES": "CASE", "DRUM": "DRUM", "DRUMS": "DRUM", "BALE": "BALE", "BALES": "BALE",
}

#: Tried in this order; only the first that fits is taken off.
COUNTRIES = [
    "MALAYSIA", "CHINA", "SINGAPORE", "INDONESIA", "THAILAND", "VIETNAM", "PHILIPPINES", "INDIA", "HONGKONG", "TAIWAN",
    "KOREA", "JAPAN", "CAMBODIA", "MYANMAR", "BRUNEI", "PRCHINA", "PEOPLESREPUBLICOFCHINA",
]

# Patterns are Java regular expressions.  WS is the white space of the source system, which is wider than
# Java's \s; BEFORE and AFTER stand for a word border that counts Chinese characters as non-words.  A pattern tried at every place of a
# text looks at its own first character before it looks back for a border, and white space is told from ASCII and few ranges first.
WS = r"[\s\x{A0}-\x{FEFF}&&[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
WS_LINE = r"[\s\x{A0}-\x{FEFF}&&[\t\x0B\f \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
#: The characters of WS.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = "[A-Za-z0-9_]"
BEFORE, AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"
CJK = r"\x{4E00}-\x{9FFF}"

#: Labels as they begin a line or cell; the first that fits wins.
LABELS = [
    ("shipper", rf"SHIPPER|PRODUCTS?{WS}+CONSIGNED{WS}+FROM|EXPORTER|发货人|托运人"),
    ("consignee", rf"CONSIGNEE|CNEE|PRODUCTS?{WS}+CONSIGNED{WS}+TO|收货人"),
    ("notifyParty", rf"NOTIFY(?:{WS}*PARTY)?|通知人"),
    ("placeOfReceipt", rf"PLACE{WS}+OF{WS}+RECEIPT|收货地"),
    ("portOfLoading", rf"PORT{WS}+OF{WS}+LOADING|POL|装货港|起运港"),
    ("portOfDischarge", rf"PORT{WS}+OF{WS}+DISCHARGE|POD|卸货港"),
    ("placeOfDelivery", rf"PLACE{WS}+OF{WS}+DELIVERY|交货地"),
    ("finalDestination", rf"FINAL{WS}+DESTINATION|目的地"),
    ("vesselVoyage", rf"OCEAN{WS}+VESSEL|VESSEL(?:'?S)?{WS}*(?:NAME)?|船名航次|船名"),
    ("goods", rf"DESCRIPTION|DESC|COMMODITY|GOODS|KIND{WS}+OF{WS}+PACKAGES|品名|货名|包装类型"),
    ("packages", rf"NO\.?{WS}*OF{WS}+(?:CONTAINERS?|PACKAGES?|P'?KGS?)|NUMBER{WS}+OF{WS}+PACKAGES|箱数|件数"),
    ("grossWeight", rf"GROSS{WS}*WEIGHT|G\.?W(?:\.(?=[A-Za-z0-9_])|{AFTER})|毛重"),
    ("measurement", rf"MEASUREMENT|CBM{AFTER}|尺码|体积"),
    ("marks", rf"MARKS?(?:{WS}+AND{WS}+NUMBERS?)?|唛头"),
    ("freightTerms", r"FREIGHT|付款方式|运费"),
    ("containerNo", rf"CONTAINER(?:{WS}*(?:NO|NUMBER))?|柜号|箱号"),
    ("sealNo", rf"SEAL(?:{WS}*(?:NO|NUMBER))?|封号|铅封"),
    ("soNo", rf"D/R{WS}*NO|S/O{WS}*NO|B/L{WS}*NO|BOOKING{WS}*NO|提单号|工作编号"),
]

#: Words that make a parenthetical an instruction to keep something off, and words for tariff codes.
SUPPRESS = ["不显示在提单", "不显示于提单", "提单不显示", "不打在提单", "不要显示", "不显示"]
ONLY_PROVIDED = "只提供"
HS_WORDS = ["海关编码", "海关编号", "HS编码", "HS CODE", "HSCODE", "税则号"]

_UNIT = r"CTNS?|CARTONS?|PKGS?|PACKAGES?|PLTS?|PALLETS?|BAGS?|ROLLS?|PCS"
#: Values with a shape of their own.
WEIGHT = rf"(?i)[\d,](?<!{WORD}[\d,])[\d,]*+(?:\.\d++)?+{WS}*+KGS?{AFTER}"
VOLUME = rf"(?i)[\d,](?<!{WORD}[\d,])[\d,]*+(?:\.\d++)?+{WS}*+(?:CBM|M3){AFTER}"
PACKAGES = rf"(?i)\d(?<!{WORD}\d)[\d,]*+{WS}*+(?:{_UNIT}){AFTER}"
PACKAGES_START = rf"(?i)^\d[\d,]*{WS}*(?:{_UNIT}){AFTER}"
CONTAINER = rf"[A-Z]{{4}}\d{{7}}(?<!{WORD}[A-Z]{{4}}\d{{7}}){AFTER}"
FREIGHT = rf"(?i)FREIGHT{WS}+(?:PREPAID|COLLECT)"
FREIGHT_PAGE = rf"(?i)FREIGHT{WS}+(?:PREPAID|COLLECT|PAYABLE{WS}+AT{WS}+[A-Za-z0-9_]+)"
CONTAINER_TYPE = rf"(?i)\d(?<!{WORD}\d)\d(?:'?{WS}?(?:GP|HQ|HC|RF|NOR|OT|FR)|FT){AFTER}"
SEAL_LINE = rf"[A-Z]{{4}}\d{{7}}{WS}*/{WS}*[^/\n]*/{WS}*([A-Z0-9-]{{5,15}})"
WEIGHT_PAGE = rf"(?i)[\d,]+\.?\d*{WS}*KGS?{AFTER}"
VOLUME_PAGE = rf"(?i)[\d,]+\.?\d*{WS}*CBM{AFTER}"
REGISTRATION = rf"\(?{WS}*(\d{{9,14}}){WS}*/{WS}*([A-Z]{{1,3}}\d{{5,10}}-?[A-Z]?){WS}*\)?"
PHONE = rf"(?i)(?:TEL|FAX|PHONE|HP)[^\n:：]*[:：]{WS_LINE}*([+\d][\d ()+\-]{{6,}})"
PHONE_LINE = rf"(?i)^(?:TEL|FAX|PHONE|HP){AFTER}"
HS = rf"\d(?<!{WORD}\d)\d{{3}}(?:{WS}|\.)?\d{{2}}(?:{WS}|\.)?\d{{2}}(?:(?:{WS}|\.)?\d{{2}})?{AFTER}"
EMAIL = r"[A-Za-z0-9_.+-]++@[A-Za-z0-9_-]++\.[A-Za-z0-9_.-]+"
PARENTHESES = r"[（(][^）)]*[）)]"
RECAP = rf"(?i)(?:^|{WS}|/)(?:[A-Z]{{4}}\d{{7}})?{WS}*/{WS}*\d{{2}}'?{WS}?(?:GP|HQ|HC|RF|NOR)"
RECAP_VALUES = [
    ("grossWeight", "Gross weight", rf"(?i)[\d,]+(?:\.\d+)?{WS}*KGS?{AFTER}", "number"),
    ("measurement", "Measurement", rf"(?i)[\d,]+(?:\.\d+)?{WS}*CBM{AFTER}", "number"),
    ("packages", "No. of packages", rf"(?i)\d[\d,]*{WS}*(?:{_UNIT}){AFTER}", "packages"),
]

#: Boxes of the page form, in page points from the lower left; earlier boxes win.
BOXES = [
    ("soNo", 400, 580, 745, 800), ("shipper", 70, 400, 668, 744), ("consignee", 70, 400, 588, 667), ("notifyParty", 70, 400, 528, 587),
    ("preCarriage", 70, 198, 504, 527), ("placeOfReceipt", 198, 400, 504, 527), ("vesselVoyage", 70, 198, 482, 503), ("portOfLoading", 198, 400, 482, 503),
    ("portOfDischarge", 70, 228, 459, 481), ("placeOfDelivery", 228, 390, 459, 481), ("finalDestination", 390, 580, 459, 481), ("marks", 70, 200, 332, 458),
    ("description", 200, 390, 332, 458), ("grossWeight", 390, 465, 332, 458), ("measurement", 465, 580, 332, 458), ("containerSeal", 70, 420, 290, 331),
    ("totalInWords", 70, 580, 250, 289), ("freightTerms", 70, 260, 138, 182),
]
#: Where each boxed value is said to come from.
BOX_NAMES = {
    "soNo": "B/L S/O No.", "shipper": "B/L box 1 (Shipper)", "notifyParty": "B/L box 3 (Notify Party)", "placeOfReceipt": "B/L box 5 (Place of Receipt)",
    "vesselVoyage": "B/L box 6 (Ocean Vessel / Voy No.)", "portOfLoading": "B/L box 7 (Port of Loading)", "portOfDischarge": "B/L box 9 (Place of Discharge)",
    "placeOfDelivery": "B/L box 9 (Place of Delivery)", "finalDestination": "B/L box 10 (Final Destination)", "marks": "B/L box 11 (Marks and Numbers)",
}
BASELINE_TOLERANCE, COLUMN_GAP, ROW_GAP = 3.0, 12.0, 13.0
BOILERPLATE = [
    rf"(?i)SHIPPER'?S{WS}+LOAD", rf"(?i)COUNT{WS}*&?{WS}*SEAL", r"(?i)S\.?T\.?C\.?", rf"(?i)SAID{WS}+TO{WS}+CONTAIN",
    rf"(?i)^\(?\d+{WS}*\*{WS}*\d+'?(?:GP|HQ|RF|NOR)?\)?{WS}*CONTAINERS?", r"(?i)^N/M\z", rf"(?i)^NO{WS}+MARKS?\z",
    rf"(?i)^\d[\d,]*{WS}*(?:{_UNIT})\z", rf"(?i)FREIGHT{WS}+(?:PRE)?PAID", rf"(?i)FREIGHT{WS}+COLLECT",
]

#: What a recognised value has to look like.
SHAPES = {
    "grossWeight": rf"(?i)\d[\d,]*(?:\.\d+)?{WS}*(?:KGS?|MT|LBS?|TONS?){AFTER}", "measurement": rf"(?i)\d[\d,]*(?:\.\d+)?{WS}*(?:CBM|M3){AFTER}",
    "packages": rf"(?i)\d[\d,]*{WS}*[A-Z]{{2,}}", "containerNo": r"^[A-Z]{4}\d{7}\z", "sealNo": r"(?i)^[A-Z0-9-]{5,15}\z",
    "containerType": r"(?i)^\d{2}'?(?:GP|HQ|HC|RF|NOR|OT|FR)\z|^\d{2}FT\z", "consigneeRegNo": rf"(?i)\d{{9,14}}{WS}*/{WS}*[A-Z]{{1,3}}\d{{5,10}}",
    "consigneePhone": rf"(?:\d(?:{WS}|[()+.-])*){{7,}}", "freightTerms": rf"(?i)^FREIGHT{WS}+(?:PREPAID|COLLECT|PAYABLE)", "soNo": r"(?i)^[A-Z0-9][A-Z0-9/-]{4,}\z",
}
FURNITURE = (
    rf"(?i){BEFORE}(?:(?:Overleaf|criterion|see{WS}+Notes?|Signature|Declaration|hereby|Certification|Importing{WS}+Country|applied|numbers?{WS}+on){AFTER}"
    r"|(?:FOB\)|quantity,)(?=[A-Za-z0-9_]))"
)
FREE_TEXT = ["shipper", "consignee", "notifyParty", "goods", "marks", "portOfDischarge", "placeOfDelivery", "finalDestination", "portOfLoading", "placeOfReceipt", "vesselVoyage"]
PORT_FIELDS = ["portOfDischarge", "placeOfDelivery", "finalDestination", "portOfLoading", "placeOfReceipt"]
ROUTING = rf"(?i){BEFORE}FROM{AFTER}|{BEFORE}TO{AFTER}|{BEFORE}BY{WS}+(?:SEA|AIR|RAIL|ROAD){AFTER}"

#: Labels of free label-value pairs that are form furniture.
NOISE = (
    rf"(?i)^(?:TEL|FAX|E[-_ ]?MAIL|PHONE|HP|ATTN|SEE|DATE|PLACE|ISSUED|FROM|TO){AFTER}"
    r"|^(?:NOTE|REMARK|SIGNATURE|VERIFICATION|COUNTRY|DECLARATION|CERTIF|HTTP|WWW\.)|HEREBY|OVERLEAF"
    rf"|^HS{WS}*CODE|^TOTAL|^EMAIL|^DESCRIPTION"
)

CORE = ["consignee", "packages", "goods"]
DOUBT = r"not read into any field|realigned|not in the alias table|read as empty|no consignee"
VERDICT_LABELS = {
    "match": "Match", "equivalent": "Same value", "mismatch": "Mismatch", "missing_on_b": "Missing on B",
    "missing_on_a": "Missing on A", "not_specified": "Not stated on A", "absent_both": "Not stated",
}
ACTIONABLE = ["mismatch", "missing_on_b", "missing_on_a"]
MAX_FILES, MAX_BYTES = 10, 25 * 1024 * 1024
