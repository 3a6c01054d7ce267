"""Names, lists and identifiers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Texts that stand for a missing value, compared in lower case.
MISSING = ("", "na", "n/a", "nan", "none", "nd", "not determined", "unknown", "-")
SEPARATOR = "\x1f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_missing(c: Column | str) -> Column:
    """Trimmed text; any spelling of a missing value, and null, is empty."""
    t = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.lower(t).isin(*MISSING), F.lit("")).otherwise(t)


def split_values(c: Column | str, separators: str = "[;|]") -> Column:
    """Listed values, trimmed, without missing ones."""
    parts = F.transform(F.split(fold_missing(c), separators), fold_missing)
    return F.filter(parts, lambda x: x != "")


@F.pandas_udf(StringType())
def nfkd(values: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition; there is no built-in."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKD", v))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def search_term(c: Column | str, decompose: bool = True) -> Column:
    """Lower-cased runs of ASCII letters and digits, one space between."""
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    t = nfkd(t) if decompose else t
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def search_bucket(term: Column | str) -> Column:
    """First two characters of a term without its spaces, filled up with ``_``."""
    return F.rpad(F.substring(F.replace(_col(term), F.lit(" "), F.lit("")), 1, 2), 2, "_")


def target_key(c: Column | str, compose: bool = True) -> Column:
    """Key of a target name: upper-case letters and digits only; capital and small beta are spelled out."""
    t = fold_missing(c)
    t = F.upper(nfkc(t) if compose else t)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "α", "ALPHA"), "[Ββ]", "BETA"), "[^A-Z0-9]+", "")


def slug(c: Column | str, decompose: bool = True) -> Column:
    """Lower-case ASCII with dashes, at most 120 characters; ``unknown`` if nothing is left."""
    t = _col(c)
    t = F.regexp_replace(nfkd(t) if decompose else t, r"[^\x00-\x7F]", "")
    t = F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 120)
    return F.when(t == "", F.lit("unknown")).otherwise(t)


def digest(*parts: Column | str, length: int = 20) -> Column:
    """Leading hex digits of the SHA-256 of the parts, joined by the unit separator; null parts are empty."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def target_id(name: Column | str, curated: Column, decompose: bool = True) -> Column:
    """Slug id; names outside the dictionary carry a hash, so that equal slugs stay apart."""
    folded = F.lower(F.trim(nfkc(_col(name)) if decompose else _col(name)))
    plain = F.concat(F.lit("target:"), slug(name, decompose))
    return F.when(curated, plain).otherwise(F.concat(plain, F.lit("-"), digest(folded, length=12)))


def without_tail(c: Column | str) -> Column:
    """Text without a closing parenthesis group."""
    return F.trim(F.regexp_replace(_col(c), r"\s*\([^)]*\)\s*$", ""))


def structure_ids(c: Column | str) -> Column:
    """Distinct four-character structure ids of a text, upper-cased and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(fold_missing(c), F.lit(r"\b[0-9][A-Za-z0-9]{3}\b"), F.lit(0)), F.upper)))


def percent_encode(c: Column | str) -> Column:
    return F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))


def array_literal(c: Column | str) -> Column:
    """Members of a ``{a,b}`` literal, unquoted."""
    inner = F.regexp_replace(fold_missing(c), "^[{}]+|[{}]+$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', "")), lambda x: x != "")


def csv_cell(c: Column | str) -> Column:
    """A cell quoted where it must be."""
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def header_field(c: Column | str) -> Column:
    """A FASTA header field: bars and white space folded to single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[|\s]+", " "))


def bib_escape(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"([{}\\])", r"\\$1")
