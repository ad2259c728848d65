"""DuckDB expressions with the meaning of the scalar functions, for the queries' SQL twins."""

from __future__ import annotations

from quayside import rules as R


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(names: list[str]) -> str:
    return "(" + ", ".join(map(q, names)) + ")"


def norm_text(x: str) -> str:
    marks = ".,;:''\"`()[]-/"
    return rf"trim(regexp_replace(translate(upper(replace({x}, 'ß', 'SS')), '{marks}', '{' ' * 13}'), '\s+', ' ', 'g'))"


def norm_id(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def norm_phone(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^0-9]', '', 'g'), '^0+', '')"


def plain_number(v: str) -> str:
    fixed = f"CAST(CAST(floor({v} * 1000 + 0.5) AS DECIMAL(28,0)) * CAST(0.001 AS DECIMAL(4,3)) AS VARCHAR)"
    return rf"regexp_replace({fixed}, '\.?0+$', '')"


def norm_number(x: str) -> str:
    found = rf"regexp_extract(replace({x}, ',', ''), '-?[0-9]+(?:\.[0-9]+)?')"
    return f"CASE WHEN {found} <> '' THEN {plain_number(f'CAST({found} AS DOUBLE)')} END"


def norm_packages(x: str) -> str:
    pattern = r"'([0-9][0-9,]*)\s*([A-Z]+)'"
    unit = f"regexp_extract(upper({x}), {pattern}, 2)"
    count = f"regexp_replace(regexp_replace(replace(regexp_extract(upper({x}), {pattern}, 1), ',', ''), '^0+', ''), '^$', '0')"
    groups: dict[str, list[str]] = {}
    for name, canonical in R.UNITS.items():
        groups.setdefault(canonical, []).append(name)
    known = " ".join(f"WHEN {unit} IN {any_of(names)} THEN {q(c)}" for c, names in groups.items())
    return f"CASE WHEN {unit} <> '' THEN {count} || ' ' || (CASE {known} ELSE {unit} END) END"


def norm_vessel(x: str) -> str:
    return f"array_to_string(list_filter(string_split({norm_text(x)}, ' '), lambda t: t NOT IN ('', 'V', 'VOY', 'VOYAGE', 'VSL')), ' ')"


def norm_list(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(list_transform(string_split({norm_text(x)}, '|'), lambda t: trim(t)), lambda t: t <> '')), ' | ')"


#: (spelling without marks, canonical name) of all ports, and (terminal, its port)
ALIASES = ", ".join(f"({q(b)}, {q(g[0])})" for g in R.PORTS for b in dict.fromkeys("".join(ch for ch in a.upper() if ch.isascii() and ch.isalnum()) for a in g))
INSIDE = ", ".join(f"({q(t)}, {q(p)})" for t, p in R.TERMINALS.items())
CUT_COUNTRY = r"regexp_replace({}, ',\s*(MALAYSIA|CHINA|SINGAPORE|MY|CN)\s*$', '', 'i')"


def canonical_port(x: str) -> str:
    def known(key: str) -> str:
        bare = lambda a: "".join(ch for ch in a.upper() if ch.isascii() and ch.isalnum())
        return "CASE " + " ".join(f"WHEN {key} IN {any_of([bare(a) for a in g])} THEN {q(g[0])}" for g in R.PORTS) + " END"

    cut = rf"regexp_replace({x}, ',\s*(MALAYSIA|CHINA|SINGAPORE|MY|CN)\s*$', '', 'i')"
    return f"coalesce({known(norm_id(x))}, {known(norm_id(cut))})"


def normalize_for(kind: str, x: str) -> str:
    made = {"text": norm_text, "id": norm_id, "phone": norm_phone, "number": norm_number, "packages": norm_packages, "list": norm_list, "vessel": norm_vessel, "port": canonical_port}
    return f"CASE {kind} " + " ".join(f"WHEN {q(k)} THEN {f(x)}" for k, f in made.items()) + " END"


def port_relation(x: str, y: str) -> str:
    """Of two canonical names."""
    inside = " OR ".join(f"({a} = {q(t)} AND {b} = {q(p)})" for t, p in R.TERMINALS.items() for a, b in ((x, y), (y, x)))
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN 'unknown' WHEN {x} = {y} THEN 'same' WHEN {inside} THEN 'compatible' ELSE 'different' END"


def fold_ocr(x: str) -> str:
    return f"regexp_replace(translate(upper({x}), '012568', 'OIZSGB'), '[^A-Z0-9]', '', 'g')"


def address_key(flat: str) -> str:
    """Of a text without blanks."""
    cut = " ".join(f"WHEN length({flat}) > {len(c)} AND ends_with({flat}, {q(c)}) THEN left({flat}, length({flat}) - {len(c)})" for c in R.COUNTRIES)
    return f"CASE {cut} ELSE {flat} END"


def distinct(items: str) -> str:
    """A list's items once each, in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def hs_codes(x: str) -> str:
    found = rf"list_transform(regexp_extract_all({x}, '\b\d{{4}}[\s.]?\d{{2}}[\s.]?\d{{2}}(?:[\s.]?\d{{2}})?\b'), lambda c: regexp_replace(c, '[^0-9]', '', 'g'))"
    return distinct(f"list_filter({found}, lambda c: left(c, 2) BETWEEN '01' AND '97')")


def emails(x: str) -> str:
    return distinct(rf"regexp_extract_all({x}, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+')")


def comparator(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(c)}" for k, _, c, _, _ in R.FIELD_SPECS) + " ELSE 'text' END"


def label(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.LABEL.items()) + " END"


def printed(x: str) -> str:
    markers = "|".join([*R.SUPPRESS, R.ONLY_PROVIDED])
    return f"regexp_replace({x}, '[（(][^）)]*(?:{markers})[^）)]*[）)]', '', 'g')"


SPECS = "(VALUES " + ", ".join(f"({n}, {q(k)}, {q(l)}, {q(c)}, {a}, {b})" for n, (k, l, c, a, b) in enumerate(R.FIELD_SPECS)) + ") AS specs(ord, field_key, label, comparator, ra, rb)"  # noqa: E741

#: side_fields: the value of the first document
SIDE = "side_fields AS MATERIALIZED (SELECT shipment_id, side, field_key, arg_min(raw, doc_seq) AS raw, arg_min(coalesce(source, ''), doc_seq) AS source, arg_min(file, doc_seq) AS file FROM fields GROUP BY ALL)"

_FAMILY = any_of(R.DESTINATION)


def _other(side: str) -> str:
    """The first other destination of a side."""
    rank = " ".join(f"WHEN {q(k)} THEN {n}" for n, k in enumerate(R.DESTINATION))
    return f"(SELECT arg_min(struct_pack(k := f.field_key, raw := f.raw, source := f.source), CASE f.field_key {rank} END) FROM side_fields f WHERE f.shipment_id = p.shipment_id AND f.side = '{side}' AND f.field_key IN {_FAMILY} AND f.field_key <> p.field_key)"


#: aligned: every shipment and spec with both values, a destination of the other name standing in
ALIGNED = f"""ships AS (SELECT DISTINCT shipment_id FROM fields),
pairs AS (
  SELECT s.shipment_id, c.*, a.raw AS a0, b.raw AS b0, a.source AS sa, b.source AS sb FROM ships s CROSS JOIN {SPECS.replace('AS specs', 'AS c')}
  LEFT JOIN side_fields a ON a.shipment_id = s.shipment_id AND a.side = 'A' AND a.field_key = c.field_key
  LEFT JOIN side_fields b ON b.shipment_id = s.shipment_id AND b.side = 'B' AND b.field_key = c.field_key),
stand AS (
  SELECT p.*, CASE WHEN p.field_key IN {_FAMILY} AND a0 IS NULL AND b0 IS NOT NULL THEN {_other('A')} END AS oa,
    CASE WHEN p.field_key IN {_FAMILY} AND b0 IS NULL AND a0 IS NOT NULL THEN {_other('B')} END AS ob FROM pairs p),
aligned AS (
  SELECT shipment_id, ord, field_key, label, comparator, ra, rb, coalesce(a0, oa.raw) AS a, coalesce(b0, ob.raw) AS b, coalesce(sa, oa.source) AS sa, coalesce(sb, ob.source) AS sb,
    coalesce('A states this as ' || oa.k, 'B states this as ' || ob.k, '') AS substituted FROM stand)"""

_ADDRESS = lambda x: f"CASE WHEN ocr THEN {fold_ocr(x)} ELSE replace({norm_text(x)}, ' ', '') END"
VERDICTS = f"""normed AS (
  SELECT *, {normalize_for('comparator', 'a')} AS an, {normalize_for('comparator', 'b')} AS bn, {norm_text('a')} AS ta, {norm_text('b')} AS tb,
    coalesce(sa = 'ocr', false) OR coalesce(sb = 'ocr', false) AS ocr FROM aligned),
keyed AS (SELECT *, {_ADDRESS('a')} AS fa, {_ADDRESS('b')} AS fb FROM normed),
judged AS (
  SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN CASE WHEN ra OR rb THEN 'missing_on_b' ELSE 'absent_both' END
    WHEN b IS NULL THEN 'missing_on_b' WHEN a IS NULL THEN CASE WHEN ra THEN 'missing_on_a' ELSE 'not_specified' END
    WHEN an IS NULL OR bn IS NULL THEN CASE WHEN ta = tb THEN 'match' ELSE 'mismatch' END
    WHEN an <> bn THEN CASE WHEN comparator = 'port' AND {port_relation('an', 'bn')} = 'compatible' THEN 'equivalent' WHEN ocr AND {fold_ocr('a')} = {fold_ocr('b')} THEN 'equivalent'
      WHEN comparator = 'text' AND {address_key('fa')} <> '' AND {address_key('fa')} = {address_key('fb')} THEN 'equivalent' ELSE 'mismatch' END
    WHEN trim(a) = trim(b) THEN 'match' ELSE 'equivalent' END AS verdict FROM keyed)"""

_SAME = "CASE WHEN x IS NULL OR y IS NULL THEN tx = ty ELSE x = y END"
CONFLICTS = f"""ranked AS (
  SELECT *, first_value(raw) OVER w AS held, first_value(file) OVER w AS held_file, row_number() OVER w AS nth FROM fields WINDOW w AS (PARTITION BY shipment_id, side, field_key ORDER BY doc_seq)),
compared AS (
  SELECT *, {normalize_for(comparator('field_key'), 'held')} AS x, {normalize_for(comparator('field_key'), 'raw')} AS y, {norm_text('held')} AS tx, {norm_text('raw')} AS ty FROM ranked WHERE nth > 1),
odd AS (SELECT shipment_id, side, field_key, held, held_file, raw, min(doc_seq) AS seq, arg_min(file, doc_seq) AS file FROM compared WHERE NOT ({_SAME}) GROUP BY ALL),
conflicts AS (
  SELECT shipment_id, side, field_key, {label('field_key')} AS label, held_file || ': ' || held || '; ' || string_agg(file || ': ' || raw, '; ' ORDER BY seq, file, raw) AS vals
  FROM odd GROUP BY shipment_id, side, field_key, held, held_file)"""

_OUT = "CASE WHEN k % 31 = 0 THEN 'email' WHEN k % 7 = 0 THEN 'hsCodes' WHEN k % 41 = 0 THEN 'literal' END"
#: results of the planted instructions: the draft prints codes at 37 and addresses on even orders
DIRECTIVES = f"""directives AS (
  SELECT k AS shipment_id, 'A' AS side, kind, CASE WHEN n = 0 OR kind = 'literal' THEN 'unchecked'
    WHEN kind = 'email' THEN CASE WHEN k % 2 = 0 THEN 'violated' ELSE 'ok' END WHEN k % 37 = 0 THEN 'violated' ELSE 'ok' END AS verdict
  FROM (SELECT *, {_OUT} AS kind FROM base) WHERE kind IS NOT NULL)"""
#: the draft's recap line has the right values, its boxes wrong ones at 19 and 23
INTERNAL = """internal AS (
  SELECT k AS shipment_id, 'Gross weight' AS label, (1000 + k % 1000 + 1)::VARCHAR || '.000KGS' AS boxed, (1000 + k % 1000)::VARCHAR || '.000KGS' AS printed FROM base WHERE n > 0 AND k % 23 = 0
  UNION ALL SELECT k, 'No. of packages', (k % 900 + 2)::VARCHAR || 'CARTONS', (k % 900 + 1)::VARCHAR || ' CTNS' FROM base WHERE n > 0 AND k % 19 = 0)"""
