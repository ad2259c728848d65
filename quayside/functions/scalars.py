"""Normalisers and scalar checks (N1-N19): column in, column out, built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside import rules as R


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(pairs: dict[str, str]) -> Column:
    """A map of fixed texts, as one parsed expression: a call for each entry would cost more than the job's planning."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in pairs.items()) + ")")


def trim(c: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(col(c), F.lit(R.BLANKS))


def norm_text(c: Column | str) -> Column:
    """Upper case, punctuation and dash or slash runs to single blanks."""
    return F.trim(F.regexp_replace(F.upper(col(c)), rf"(?:{R.WS}|[.,;:'\"`()\[\]/-])+", " "))


def norm_id(c: Column | str) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", "")


def norm_phone(c: Column | str) -> Column:
    """Digits without leading zeros."""
    return F.regexp_replace(F.regexp_replace(col(c), "[^0-9]", ""), "^0+", "")


def plain_number(x: Column) -> Column:
    """A double as its shortest decimal text, rounded to three places with ties upwards; from 1e21 on with an exponent.

    Where a thousandth of it can't be told any more, the double itself is the value.
    """
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.?0+$", ""), "^-0$|^$", "0")
    fixed = (F.floor(x * 1000 + 0.5).cast("decimal(38,0)") / 1000).cast("decimal(38,3)")
    large = x * 1000 / 1000
    powered = F.regexp_replace(F.regexp_replace(large.cast("string"), r"\.0E", "E"), "E", "e+")
    size = F.abs(x)
    return F.when(size < 9e12, tidy(fixed)).when(size < 1e21, tidy(large.try_cast("decimal(38,3)"))).when(size < float("inf"), powered)


def norm_number(c: Column | str) -> Column:
    """The first number, canonical; null without one, or if no double can hold it."""
    found = F.regexp_extract(F.translate(col(c), ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return F.when(found != "", plain_number(found.try_cast("double")))


def norm_packages(c: Column | str, units: dict[str, str] = R.UNITS) -> Column:
    """N5: '<count> <UNIT>' with the unit's canonical name; null without a count and a unit."""
    pattern = rf"([0-9][0-9,]*){R.WS}*([A-Z]+)"
    text = F.upper(col(c))
    count, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    digits = F.regexp_replace(F.regexp_replace(F.translate(count, ",", ""), "^0+", ""), "^$", "0")
    known = literal_map(units)
    return F.when(unit != "", F.concat_ws(" ", digits, F.coalesce(F.try_element_at(known, unit), unit)))


def norm_vessel(c: Column | str) -> Column:
    """N1 without the tokens that only mark a voyage."""
    return F.array_join(F.filter(F.split(norm_text(c), " "), lambda t: (t != "") & ~t.isin("V", "VOY", "VOYAGE", "VSL")), " ")


def norm_list(c: Column | str, separators: str | None = None) -> Column:
    """Sorted parts.  After N1 only ``|`` separates; ``separators`` splits the raw text instead."""
    parts = F.split(norm_text(c), r" *\| *") if separators is None else F.transform(F.split(col(c), separators), norm_text)
    return F.array_join(F.array_sort(F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")), " | ")


def port_map(ports: list[list[str]]) -> Column:
    pairs = {"".join(ch for ch in alias.upper() if ch.isascii() and ch.isalnum()): group[0] for group in ports for alias in group}
    return literal_map(pairs)


def canonical_port(c: Column | str, ports: list[list[str]] = R.PORTS) -> Column:
    """The canonical name, with or without a country at the end; null if unknown."""
    known = port_map(ports)
    bare = F.regexp_replace(col(c), rf"(?i),{R.WS}*(?:MALAYSIA|CHINA|SINGAPORE|MY|CN){R.WS}*\z", "")
    return F.coalesce(F.try_element_at(known, norm_id(c)), F.try_element_at(known, norm_id(bare)))


def same_port(x: Column, y: Column) -> Column:
    """Whether one of two canonical names is a terminal of the other."""
    inside = literal_map(R.TERMINALS)
    return F.coalesce((F.try_element_at(inside, x) == y) | (F.try_element_at(inside, y) == x), F.lit(False))


def port_relation(a: Column | str, b: Column | str) -> Column:
    """Same, compatible (one is the other's terminal), different or unknown."""
    x, y = canonical_port(a), canonical_port(b)
    return F.when(x.isNull() | y.isNull(), "unknown").when(x == y, "same").when(same_port(x, y), "compatible").otherwise("different")


def normalize_for(comparator: Column | str, c: Column | str) -> Column:
    """The normaliser of a comparator; null where it can't read the value."""
    k = col(comparator)
    return (
        F.when(k == "text", norm_text(c)).when(k == "id", norm_id(c)).when(k == "phone", norm_phone(c)).when(k == "number", norm_number(c))
        .when(k == "packages", norm_packages(c)).when(k == "list", norm_list(c)).when(k == "vessel", norm_vessel(c)).when(k == "port", canonical_port(c))
    )


def fold_ocr(c: Column | str) -> Column:
    """Digits that recognition confuses with letters become those letters."""
    return F.regexp_replace(F.translate(F.upper(col(c)), "012568", "OIZSGB"), "[^A-Z0-9]", "")


def flat_address(c: Column | str, ocr: Column | None = None) -> Column:
    """N1 without blanks, or N11 where ``ocr`` holds."""
    flat = F.replace(norm_text(c), F.lit(" "), F.lit(""))
    return flat if ocr is None else F.when(ocr, fold_ocr(c)).otherwise(flat)


def without_country(flat: Column | str) -> Column:
    """A flat address without the first listed country that ends it."""
    flat = col(flat)
    out = None
    for name in R.COUNTRIES:
        fits = flat.endswith(name) & (F.length(flat) > len(name))
        cut = F.substring(flat, F.lit(1), F.length(flat) - len(name))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(flat)


def address_key(c: Column | str, ocr: Column | None = None) -> Column:
    """A text without blanks and without one country at its end."""
    return without_country(flat_address(c, ocr))


def find_hs_codes(c: Column | str) -> Column:
    """Tariff codes of eight or ten digits in chapters 01 to 97, each once, in order."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit(R.HS), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    chapter = lambda x: F.substring(x, 1, 2)
    return F.array_distinct(F.filter(found, lambda x: (chapter(x) >= "01") & (chapter(x) <= "97")))


def find_emails(c: Column | str) -> Column:
    """E-mail addresses, each once, in order."""
    return F.when(~F.contains(col(c), F.lit("@")), F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(col(c), F.lit(R.EMAIL), F.lit(0))))


def label_for(key: Column | str) -> Column:
    """A field's label, or its key in words."""
    known = literal_map(R.LABEL)
    spaced = F.trim(F.lower(F.regexp_replace(col(key), "([A-Z])", " $1")))
    return F.coalesce(F.try_element_at(known, col(key)), F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced))))


#: Stands between the groups of a label match; no label has it.
_MARK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it, inside other lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_label(c: Column | str, same_line: bool = True, labels: list[tuple[str, str]] = R.LABELS) -> Column:
    """(key, rest): the field whose label begins the trimmed text, and the text after the label and an optional colon.

    One match finds both.  The labels are the groups of one alternation, which tries them in their declared order; the match is
    replaced by all groups with a mark between them, so the number of marks before the label is the label's number.
    Without a label both are null; most texts have none, which a look at their beginning tells.
    """
    gap = R.WS_LINE if same_line else R.WS
    n = len(labels)
    one_of = "|".join(f"({pattern})" for _, pattern in labels)
    pattern = rf"(?i)^(?:(?:{one_of}){gap}*[:：]?{gap}*([\s\S]*)|[\s\S]*)\z"
    groups = _MARK.join(f"${k}" for k in range(1, n + 2))
    names = F.array(*(F.lit(key) for key, _ in labels))

    def taken(told: Column) -> Column:
        label = F.ltrim(told, F.lit(_MARK))
        number = F.length(told) - F.length(label)
        rest = F.substring(label, F.instr(label, _MARK) + n - number, F.length(label))
        return F.when(label != "", F.struct(F.element_at(names, number + 1).alias("key"), trim(rest).alias("rest")))

    return let(trim(c), lambda text: F.when(F.regexp_instr(text, F.lit(label_start(labels))) > 0, let(F.regexp_replace(text, pattern, groups), taken)))


def label_start(labels: list[tuple[str, str]]) -> str:
    """For ``regexp_instr`` inside lambdas: ``rlike`` decodes its pattern again for each text there."""
    return "(?i)^(?:" + "|".join(f"(?:{p})" for _, p in labels) + ")"


def classify_label(c: Column | str, labels: list[tuple[str, str]] = R.LABELS) -> Column:
    """The field whose label begins the text; null if none does."""
    return first_label(c, labels=labels)["key"]


def is_label(c: Column | str, labels: list[tuple[str, str]] = R.LABELS) -> Column:
    return trim(c).rlike(label_start(labels))


def strip_label(c: Column | str, key: Column | str, same_line: bool = True, labels: list[tuple[str, str]] = R.LABELS) -> Column:
    """The text after its label and an optional colon, if its label is that of ``key``; else the text."""
    found = first_label(c, same_line, labels)
    return F.coalesce(F.when(found["key"] == col(key), found["rest"]), trim(c))


def _marked(markers: list[str]) -> str:
    return rf"[（(][^）)]*?(?:{'|'.join(markers)})[^）)]*[）)]"


def is_instruction(c: Column | str) -> Column:
    """Whether a parenthetical tells to keep something off."""
    return col(c).rlike("|".join([*R.SUPPRESS, R.ONLY_PROVIDED]))


def printed_text(c: Column | str) -> Column:
    """Text without instruction parentheticals."""
    bracket = F.contains(col(c), F.lit("(")) | F.contains(col(c), F.lit("（"))
    return F.when(~bracket, col(c)).otherwise(F.regexp_replace(col(c), _marked([*R.SUPPRESS, R.ONLY_PROVIDED]), ""))


def strip_notes(c: Column | str) -> Column:
    """``printed_text`` without blanks before line ends and without empty lines, trimmed."""

    def tidied(x: Column) -> Column:
        lines = F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{2,}", "\n")
        return trim(F.when(F.contains(x, F.lit("\n")), lines).otherwise(x))

    return let(col(c), lambda x: let(printed_text(x), tidied))


def label_key(c: Column | str) -> Column:
    """A label's key: no parentheticals, upper case, letters, digits and Chinese characters."""
    return F.regexp_replace(F.upper(F.regexp_replace(col(c), R.PARENTHESES, "")), rf"[^A-Z0-9{R.CJK}]", "")


def implausible(key: Column | str, c: Column | str) -> Column:
    """Why a recognised value can't be one of its field; null if it can."""
    k, v = col(key), trim(c)
    out = F.when(v == "", "empty").when(v.rlike(R.FURNITURE), "reads as printed form wording, not a value")
    for name, shape in R.SHAPES.items():
        out = out.when((k == name) & ~v.rlike(shape), f"does not look like a {name} value")
    port = k.isin(*R.PORT_FIELDS)
    out = out.when(port & v.rlike(R.ROUTING), "reads as a routing sentence, not a port").when(port & (F.length(v) > 45), "too long to be a port name")
    letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    lower = F.length(F.regexp_replace(v, "[^a-z]", ""))
    prose = k.isin(*R.FREE_TEXT) & (letters >= 6) & (lower > 0.6 * letters)
    return out.when(prose, "reads as lowercase prose rather than a typed value")
