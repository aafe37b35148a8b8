"""Text and sequence expressions. All are Columns on built-in functions unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabets and the stop list.
MODEL_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
INGEST_ALPHABET = MODEL_ALPHABET + "X"
CELL_ALPHABET = "ACDEFGHIKLMNPQRSTVWYBXZJUO"
STOP_WORDS = (
    "SPECIFICITY SENSITIVITY PRECISION RECALL ACCURACY VALIDATION INDEPENDENT DEPENDENT CROSS TRAIN TRAINING TEST TESTING PREDICT "
    "PREDICTION CLASSIFIER CLASSIFICATION REGRESSION FEATURE FEATURES SEQUENCE SEQUENCES"
).split()

#: What is replaced in a cell that is meant to hold a sequence, in this order, whatever the case: marks, remains of style, residues
#: in brackets, terminal groups, brackets, joiners.
CELL_CLEANUPS = [
    (r"\*", ""),
    (r"(color|style)\s*=\s*[^>]*>", ""),
    (r"\(\s*(orn|dab|dap)\s*\)", "K"),
    (r"[εϵ]\s*K", "K"),
    (r"[-–—]\s*NH\s*2\b", ""),
    (r"[-–—]?\s*CONH\s*2\b", ""),
    (r"[-–—]\s*COOH\b", ""),
    (r"[-–—]\s*OH\b", ""),
    (r"[()\[\]{}]", ""),
    (r"[\s‐‑–—_\\-]+", ""),
]


def normalize_whitespace(text: Column) -> Column:
    """Runs of Unicode white space to one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def safe_stem(text: Column, longest: int = 160) -> Column:
    """A file stem: anything but word characters, dot and hyphen to _, runs of _ to one, none at the ends; cut."""
    out = F.regexp_replace(normalize_whitespace(text), r"(?U)[^\w.\-]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^[._]+|[._]+$", "")
    return F.substring(F.when(out == "", F.lit("item")).otherwise(out), 1, longest)


def clip(text: Column, longest: int = 2000) -> Column:
    """White space normalised, cut with a mark."""
    t = normalize_whitespace(text)
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("...<truncated>"))).otherwise(t)


def split_sentences(text: Column) -> Column:
    """Array of sentences: cut after . ! ? before white space; no empty ones."""
    return F.filter(F.transform(F.split(normalize_whitespace(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def alphabet_tokens(text: Column, alphabet: str = CELL_ALPHABET) -> Column:
    return F.filter(F.split(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), f"[^{alphabet}]+", " "), " "), lambda s: s != "")


def looks_like_sequence(token: Column, least: int, alphabet: str = CELL_ALPHABET) -> Column:
    """Long enough, no stop word, in the alphabet; from 10 letters on, of three different ones or more."""
    letters = F.size(F.array_distinct(F.split(token, "")))
    return (F.length(token) >= least) & ~token.isin(STOP_WORDS) & token.rlike(f"^[{alphabet}]+$") & ~((F.length(token) >= 10) & (letters <= 2))


def find_sequences(text: Column, least: int) -> Column:
    """Distinct sequence-like tokens in order."""
    return F.array_distinct(F.filter(alphabet_tokens(text), lambda t: looks_like_sequence(t, least)))


def canonical_sequence(text: Column, least: int) -> Column:
    """The longest sequence of a cell that is meant to hold one; empty if none.

    Markers, style remains, brackets, joiners and common terminal groups go, three residues in brackets and epsilon-K become K.
    """
    s = normalize_whitespace(text)
    for pattern, put in CELL_CLEANUPS:
        s = F.regexp_replace(s, "(?iU)" + pattern, put)
    runs = F.transform(F.regexp_extract_all(s, F.lit("[A-Za-z]{%d,}" % max(1, least)), F.lit(0)), F.upper)
    found = F.filter(runs, lambda t: t.rlike(f"^[{CELL_ALPHABET}]+$"))
    found = F.when(F.size(found) > 0, found).otherwise(find_sequences(s, least))
    # The first of the longest.
    best = F.array_max(F.transform(found, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))
    return F.coalesce(best["t"], F.lit(""))


def normalize_id(text: Column) -> Column:
    """An identifier for joins across tables: no parts in brackets, lower case, word characters only."""
    return F.regexp_replace(F.lower(F.regexp_replace(normalize_whitespace(text), r"\([^)]*\)", "")), r"(?U)\W+", "")


def context_value(context: Column, key: str) -> Column:
    """First k=v of a ;-joined list with that key; empty if none."""
    parts = F.filter(F.transform(F.split(F.coalesce(context, F.lit("")), ";"), lambda s: F.trim(s)), lambda p: p.startswith(f"{key}="))
    return F.coalesce(F.trim(F.substring(F.get(parts, F.lit(0)), F.lit(len(key) + 2), F.length(F.get(parts, F.lit(0))))), F.lit(""))


def is_missing(value: Column) -> Column:
    """Null, blank or the word nan."""
    t = F.lower(F.trim(value.cast("string")))
    return value.isNull() | (t == "") | (t == "nan")


def nullify(value: Column) -> Column:
    return F.when(~is_missing(value), value)


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def short_digest(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order; none where the text is shorter."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ingest_normalise(text: Column) -> Column:
    """Upper case, letters only, U Z O B J as X."""
    return F.translate(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z]", ""), "UZOBJ", "XXXXX")


def is_valid_ingest(text: Column) -> Column:
    return text.rlike(f"^[{INGEST_ALPHABET}]+$")


def changed_by_ingest(raw: Column) -> Column:
    return ingest_normalise(raw) != F.upper(F.trim(raw))


def strict_sanitise(text: Column, raising: bool = True) -> Column:
    """White space removed, upper case; other letters than the 20 raise with their sorted list, or give null."""
    t = F.upper(F.regexp_replace(text, r"(?U)\s+", ""))
    bad = F.array_sort(F.array_distinct(F.filter(F.split(t, ""), lambda c: (c != "") & ~c.rlike(f"[{MODEL_ALPHABET}]"))))
    message = F.concat(F.lit("letters outside the alphabet: "), F.array_join(bad, ","))
    return F.when(F.size(bad) == 0, t).otherwise(F.raise_error(message).cast("string") if raising else F.lit(None).cast("string"))


def encode_letters(text: Column) -> Column:
    """Array of letter numbers, 1 to 20, 0 for any other."""
    letters = F.array(*[F.lit(x) for x in MODEL_ALPHABET])
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.array_position(letters, c).cast("int"))


def sorted_set(values: Column) -> Column:
    """Sorted distinct values joined by ;"""
    return F.concat_ws(";", F.array_sort(F.array_distinct(values)))


def split_set(joined: Column) -> Column:
    """A ;-joined list to its trimmed parts, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")
