"""Column functions over loosely typed cells. All are built-in expressions: no Python in tasks. Those over arrays (``let`` among them) are evaluated outside generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions import vocab

# Patterns of numbers and financial years.
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
FY = r"(?i)(?:fy|f\.y\.|financial\s*year)?\s*(\d{2,4})[-/](\d{2,4})"
_GROUPED = r"[+-]?(?:\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    """The match, or null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_match(c: Column, table: list[tuple[str, str]]) -> Column:
    """The name of the first pattern of ``table`` (pattern, name) that occurs in ``c``; null without one."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for p, name in table])


def parse_numeric(c: Column) -> Column:
    """First number in a cell, commas left out: ``G10`` is 10, ``2024-25`` is 2024, no digits null."""
    return _found(F.regexp_replace(F.trim(c), ",", ""), NUMBER).try_cast("double")


def leading_number(c: Column) -> Column:
    """The first word of a cell, all but digits, dots and minus signs left out, as a number: ``1,250 MT`` is 1250, ``n/a`` null."""
    return F.regexp_replace(F.split(F.trim(c), r"\s+")[0], r"[^\d.\-]", "").try_cast("double")


def numeric_and_unit(c: Column) -> Column:
    """struct(value, unit): a number with any grouping commas, and what stands around it, cleaned, as its unit."""
    s = F.trim(c)
    number = _found(s, _GROUPED)
    strip = lambda x: F.regexp_replace(x, r"^[ \t\r\n:=\-\[\]()]+|[ \t\r\n:=\-\[\]()]+$", "")
    at = F.position(number, s)
    before, after = strip(F.substring(s, F.lit(1), at - 1)), strip(F.substring(s, at + F.length(number), F.length(s)))
    before = F.when(~before.isin("", "n", "n.", "-"), before)
    unit = F.nullif(F.concat_ws(" ", before, F.nullif(after, F.lit(""))), F.lit(""))
    value = F.regexp_replace(number, ",", "").try_cast("double")
    return F.struct(value.alias("value"), F.when(value.isNotNull(), unit).alias("unit"))


def normalize_numeric(c: Column) -> Column:
    """struct(value, unit) of the first run of digits, commas and dots; ``N.A. 45`` has none, its first run being a dot."""

    def found(s: Column, run: Column) -> Column:
        value = F.regexp_replace(run, ",", "").try_cast("double")
        rest = F.trim(F.substring(s, F.position(run, s) + F.length(run), F.length(s)))
        return let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNotNull() & (rest != ""), rest).alias("unit")))

    return let(F.trim(c), lambda s: let(F.regexp_extract(s, r"[-+]?[\d,.]+(?:[eE][-+]?\d+)?", 0), lambda run: found(s, F.nullif(run, F.lit("")))))


def normalized_unit(unit: Column) -> Column:
    """The base name of a unit. The value is not scaled; see ``unit_scale``."""
    return first_match(F.lower(unit), vocab.UNITS)


def unit_scale(unit: Column) -> Column:
    """Opt-in factor to the base unit of tonnes (1 where the unit is none of them)."""
    u = F.lower(unit)
    return F.when(u.rlike(vocab.UNITS[0][0]), 1.0).when(u.rlike(vocab.UNITS[1][0]), 1e-3).when(u.rlike(vocab.UNITS[2][0]), 1e-6).when(u.rlike(vocab.UNITS[3][0]), 1e-9).otherwise(1.0)


def _groups(c: Column) -> Column:
    return F.struct(_found(c, FY, 1).alias("a"), _found(c, FY, 2).alias("b"))


def _years(m: Column) -> Column:
    start = F.when(F.length(m["a"]) == 2, m["a"].cast("int") + 2000).otherwise(m["a"].cast("int"))
    short = F.floor(start / 100).cast("int") * 100 + m["b"].cast("int")
    end = F.when(F.length(m["b"]) == 2, F.when(short < start, short + 100).otherwise(short)).otherwise(m["b"].cast("int"))
    return F.when(m["a"].isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def financial_year(c: Column) -> Column:
    """struct(start, end) of a financial year's first ``YYYY-YY`` or ``YY/YY``, in four digits; null without one."""
    return let(_groups(c), _years)


def format_financial_year(fy: Column) -> Column:
    """``YYYY-YY`` of struct(start, end)."""
    return let(fy, lambda y: F.when(y.isNotNull(), F.concat_ws("-", y["start"].cast("string"), F.lpad((y["end"] % 100).cast("string"), 2, "0"))))


def is_financial_year(c: Column, start: int, end: int) -> Column:
    """Whether a cell's financial year is that one: two comparisons of the digits found, without parsing them."""
    a = [str(start)] + ([f"{start - 2000:02d}"] if 2000 <= start < 2100 else [])
    short = start // 100 * 100 + end % 100
    b = [str(end)] + ([f"{end % 100:02d}"] if end == (short + 100 if short < start else short) else [])
    return _found(c, FY, 1).isin(*a) & _found(c, FY, 2).isin(*b)


def financial_year_of(text: str) -> tuple[int, int] | None:
    """(start, end) of a plain text, by the same rule."""
    m = re.search(FY, text, re.ASCII)
    if not m:
        return None
    a, b = m[1], m[2]
    start = int(a) + 2000 if len(a) == 2 else int(a)
    short = start // 100 * 100 + int(b)
    return start, (short + 100 if short < start else short) if len(b) == 2 else int(b)


def normalize_financial_year(c: Column) -> Column:
    """``YYYY-YY`` of the first match, taken as it stands (no check of the century)."""
    long = lambda m: F.when(F.length(m["a"]) == 2, F.concat(F.lit("20"), m["a"])).otherwise(m["a"])
    return let(_groups(F.trim(c)), lambda m: F.when(m["a"].isNotNull(), F.concat(long(m), F.lit("-"), F.right(m["b"], F.lit(2)))))


# Date patterns in the order in which they are tried, each with the shape a cell must have.
DATES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{4,9} \d{4}$", "MMMM yyyy"), (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
]


def normalize_date(c: Column) -> Column:
    """ISO date of a cell in one of seven forms, day before month; a month alone is its first day; null otherwise."""
    s = F.trim(c)
    return F.coalesce(*[F.when(s.rlike(shape), F.date_format(F.try_to_timestamp(F.initcap(s) if "M " in p or p.startswith("MMM") else s, F.lit(p)), "yyyy-MM-dd")) for shape, p in DATES])


def concept(name: Column) -> Column:
    """Field concept of a raw column name, or null."""
    n = F.lower(F.trim(name))
    return F.coalesce(*[F.when(n.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(c)) for c, patterns in vocab.CONCEPTS.items()])


def normalize_cell(value: Column, concept_: Column) -> Column:
    """struct(original, value, unit, normalized_unit) of a cell under its concept."""
    measured = concept_.isin(*vocab.MEASURED)

    def cell(raw: Column, number: Column) -> Column:
        out = (
            F.when(raw == "", F.lit(None).cast("string"))
            .when(measured, number["value"].cast("string"))
            .when(concept_ == "financial_year", F.coalesce(normalize_financial_year(raw), raw))
            .when(concept_ == "reporting_period", F.coalesce(normalize_financial_year(raw), normalize_date(raw), raw))
            .otherwise(F.trim(F.regexp_replace(raw, r"\s+", " ")))
        )
        return F.struct(raw.alias("original"), out.alias("value"), number["unit"].alias("unit"), F.when(number["unit"].isNotNull(), normalized_unit(number["unit"])).alias("normalized_unit"))

    # each is found once, though it is named often
    return let(F.trim(F.coalesce(value, F.lit(""))), lambda raw: let(F.when(measured, normalize_numeric(raw)), lambda number: cell(raw, number)))


def coordinate(c: Column) -> Column:
    """A coordinate with comma or dot; null where it is no number."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def rank_tokens(text: Column) -> Column:
    """Lower-case tokens for ranking: letters, digits, ``_-.``; outer dots, stop words and single characters left out; repeats kept."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([a-zA-Z0-9_\-\.]+)"), 1), lambda w: F.trim(w, F.lit(".")))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(vocab.RANK_STOP))


def topic_tokens(text: Column) -> Column:
    """Lower-case words of three letters or more for topics; two compound terms are joined first."""
    joined = F.regexp_replace(F.regexp_replace(text, r"(?i)\bopen[- ]cast\b", "opencast"), r"(?i)\bnon[- ]coking\b", "non-coking")
    words = F.regexp_extract_all(F.lower(joined), F.lit(r"([a-zA-Z][a-zA-Z\-]{2,})"), 1)
    return F.filter(words, lambda w: ~w.isin(vocab.TOPIC_STOP))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(text), 256)


def document_fingerprint(text: Column, tables: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.coalesce(F.to_json(tables), F.lit(""))), 256)


def clean_value(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^[n=\s?₹]+", "")


def is_coking(c: Column) -> Column:
    s = F.lower(c)
    return s.contains("coking") & ~s.contains("non")


def fixed(value: Column, digits: int) -> Column:
    """A number with so many places, ties of its exact value to even, without grouping."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def file_size(size: Column) -> Column:
    """Bytes for people: B, KB, MB, GB."""
    of = lambda power, name: F.concat(fixed(size / 1024.0**power, 1), F.lit(f" {name}"))
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024**2, of(1, "KB")).when(size < 1024**3, of(2, "MB")).otherwise(of(3, "GB"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r".*[/\\]", ""), r"[^A-Za-z0-9._\- ]", "_")


def signature_ok(extension: Column, content: Column) -> Column:
    """Whether a file's first bytes fit its extension; text must hold no NUL in its first kilobyte."""
    begins = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    e = F.lower(extension)
    return (
        F.when(e == "pdf", begins("25504446"))
        .when(e == "png", begins("89504E470D0A1A0A"))
        .when(e.isin("jpg", "jpeg"), begins("FFD8FF"))
        .when(e.isin("xlsx", "docx"), begins("504B0304"))
        .when(e.isin("txt", "csv"), ~F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*?00"))
        .otherwise(F.lit(False))
    )


def title_case(c: Column) -> Column:
    """Capital at the start of every run of letters, after apostrophes and hyphens too."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
