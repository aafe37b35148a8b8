"""Measurements, endpoints and conditions in text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import normalize_whitespace

#: Endpoint keywords in order, units, comparison signs, patterns of conditions, of statistics and of groups of organisms, and headers of counts.
ENDPOINTS = "LD50 LC50 IC50 EC50 CC50 HC50 HC10 MHC10 MHC MIC MBC GI50 KI KD".split()
UNITS = ["μM", "µM", "uM", "nM", "mM", "pM", "fM", "mg/kg", "mg·kg-1", "mg kg-1", "μg/mL", "µg/mL", "ug/mL", "ng/mL", "mg/mL", "g/L", "mg/L", "μg/L", "µg/L", "ug/L", "%"]
COMPARE = "[<>≤≥~]?"
NUMBER = r"\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?"
CONDITIONS = [
    r"\bpH\s*\d+(?:\.\d+)?\b",
    r"\b\d+(?:\.\d+)?\s*(?:°C|C|K)\b",
    r"\b\d+(?:\.\d+)?\s*(?:h|hr|hrs|hour|hours|min|mins|minute|minutes|s|sec|secs|second|seconds)\b",
    r"\bHEK\s*293T?\b",
    r"\bHCT\s*\d+\b",
    r"\bA\s*\d{3,4}\b",
    r"\bMCF-?\s*7\b",
    r"\bRAW\s*264\.?7\b",
    r"\bCaco-?\s*2\b",
    r"\bHepG2\b|\bHeLa\b|\bVero\b|\bCHO\b",
]
STATISTIC = r"\b(?:gm|gmm|geometric\s+mean|mean|median|average)\b"
GROUP = r"\b(?:gram[-\s]*positive|gram[-\s]*negative|g\s*\+|g\s*-\b|all\b|overall\b)\b"
COUNT_HEADERS = ["n", "no", "num", "number", "count", "replicates", "replicate"]

_UNIT = "|".join(map(re.escape, UNITS))
_NAMES = "|".join(ENDPOINTS)
_MEASUREMENT = re.compile(
    rf"(?P<endpoint>{_NAMES})?\s*(?P<cmp>{COMPARE})\s*(?:(?P<mean>{NUMBER})\s*±\s*(?P<error>{NUMBER})|(?P<low>{NUMBER})\s*(?:-|–|—|to)\s*(?P<high>{NUMBER})|(?P<value>{NUMBER}))\s*(?P<unit>{_UNIT})?",
    re.I,
)
_DIGIT = re.compile(r"\d")
MEASUREMENT = "array<struct<raw:string,endpoint:string,cmp:string,value:double,error:double,range_low:double,range_high:double,unit:string>>"


def parse_measurements(text: str | None, endpoint: str = "", unit: str = "", zero_is_null: bool = False) -> list[dict]:
    """Numbers with an endpoint or a unit, which hints may supply, not touching letters or digits.

    zero_is_null: a value of 0 is null, as in tables made before that was corrected.
    """
    found = []
    source = text or ""
    if not _DIGIT.search(source):
        return found
    for m in _MEASUREMENT.finditer(source):
        beside = source[m.start() - 1 : m.start()] + source[m.end() : m.end() + 1]
        if (m.start() > 0 and source[m.start() - 1].isalnum()) or (m.end() < len(source) and source[m.end()].isalnum()) or not beside and not m[0].strip():
            continue
        name, measured = (m["endpoint"] or endpoint).upper(), m["unit"] or unit
        if not (name or measured):
            continue
        number = lambda k: float(m[k]) if m[k] is not None else None  # noqa: B023, E731
        value = number("value") if m["value"] is not None else number("mean")
        found.append({"raw": m[0].strip(), "endpoint": name, "cmp": m["cmp"] or "", "value": None if zero_is_null and value == 0 else value, "error": number("error"), "range_low": number("low"), "range_high": number("high"), "unit": measured})
    return found


def measurements(text: Column, endpoint: str = "", unit: str = "") -> Column:
    """Array of measurements (an Arrow function: the grammar needs its own scan)."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_measurements(t, endpoint, unit))

    return F.pandas_udf(run, MEASUREMENT)(text)


def conditions(text: Column) -> Column:
    """pH, temperature, duration and cell lines: distinct, in the order of the patterns."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + p), F.lit(0)), lambda s: F.trim(s)) for p in CONDITIONS]
    return F.array_distinct(F.filter(F.concat(*found), lambda s: s != ""))


def endpoint_of(text: Column) -> Column:
    """First keyword, in their order, that is a word of the text; empty if none."""
    t = normalize_whitespace(text)
    return F.coalesce(*[F.when(t.rlike(rf"(?i)\b{k}\b"), F.lit(k)) for k in ENDPOINTS], F.lit(""))


def endpoints_in(text: Column) -> Column:
    """All keywords that are words of the text, in their order."""
    return F.filter(F.array(*[F.lit(k) for k in ENDPOINTS]), lambda k: F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?i)\b"), k, F.lit(r"\b"))))


def unit_of(text: Column) -> Column:
    """First unit that doesn't touch letters; empty if none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?iu)(?<![A-Za-z])(?:{_UNIT})(?![A-Za-z])", 0)


def is_derived_index(header: Column) -> Column:
    h = F.lower(normalize_whitespace(header))
    return h.rlike(r"\b(selectivity|therapeutic)\s*index\b") | h.rlike(r"\b(?:si|ti)\b")


def is_count_like(header: Column) -> Column:
    return F.regexp_replace(F.lower(normalize_whitespace(header)), r"(?U)\W+", "").isin(COUNT_HEADERS)


def header_hint(header: Column) -> Column:
    """struct(endpoint, unit) of a column header; both empty for indexes and for ratios but MIC/MBC."""
    h = normalize_whitespace(header)
    ratio = rf"(?i)\b({_NAMES})\b\s*/\s*\b({_NAMES})\b"
    pair = F.array_sort(F.array(F.upper(F.regexp_extract(h, ratio, 1)), F.upper(F.regexp_extract(h, ratio, 2))))
    drop = is_derived_index(h) | (h.rlike(ratio) & (pair != F.array(F.lit("MBC"), F.lit("MIC"))))
    keep = lambda c: F.when(drop, F.lit("")).otherwise(c)
    return F.struct(keep(endpoint_of(h)).alias("endpoint"), keep(unit_of(h)).alias("unit"))


def table_hint(label: Column, caption: Column, foot: Column) -> Column:
    return header_hint(F.concat_ws(" ", label, caption, foot))


def endpoint_override(cell: Column) -> Column:
    """HEMOLYSIS, or the endpoint a row's label names."""
    low = F.lower(normalize_whitespace(cell))
    return F.when(low.contains("hemolysis") | low.contains("hemolytic"), F.lit("HEMOLYSIS")).otherwise(endpoint_of(cell))


def paired_values(cell: Column) -> Column:
    """``a (b)`` or ``a/b``: array of two structs (which, cmp, value); empty if neither."""
    number = f"({NUMBER})"
    forms = [rf"({COMPARE})\s*{number}\s*\(\s*({COMPARE})\s*{number}\s*\)", rf"({COMPARE})\s*{number}\s*/\s*({COMPARE})\s*{number}"]
    c = F.coalesce(cell, F.lit(""))

    def two(p: str) -> Column:
        one = lambda which, i: F.struct(F.lit(which).alias("which"), F.regexp_extract(c, p, i).alias("cmp"), F.regexp_extract(c, p, i + 1).try_cast("double").alias("value"))
        return F.array(one("first", 1), one("second", 3))

    none = F.array().cast("array<struct<which:string,cmp:string,value:double>>")
    return F.when(c.rlike(forms[0]), two(forms[0])).when(c.rlike(forms[1]), two(forms[1])).otherwise(none)


def aggregate_flags(condition: Column, header: Column) -> Column:
    """struct(any, statistic, group): the record is a mean or the like, or of a group of organisms."""
    t = normalize_whitespace(F.concat_ws(" ", condition, header))
    statistic, group = t.rlike("(?i)" + STATISTIC), t.rlike("(?i)" + GROUP)
    return F.struct((statistic | group).alias("any"), statistic.alias("statistic"), group.alias("group"))


def is_threshold_sentence(sentence: Column) -> Column:
    """States a threshold: a rule of toxicity, a cutoff with a number, or a labelling rule for classes."""
    s = F.lower(normalize_whitespace(sentence))
    return (
        F.when(s == "", False)
        .when(s.contains("toxic if"), True)
        .when(s.rlike("threshold|cutoff|cut-off|cut off"), s.rlike(r"(?U)\d"))
        .when(s.rlike("labelled as|labeled as"), s.rlike("toxic|positive|negative"))
        .otherwise(False)
    )
