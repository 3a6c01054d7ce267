"""Relationships, evidence and measurements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sequor.functions.text import _col, fold_missing

# Vocabularies of relationships, evidence and measurements.
DIRECT = ("binds", "targets")
FUNCTIONAL = ("neutralizes", "protects")
LITERATURE = ("mentioned_with",)
EVIDENCE_RANK = {"STRUCTURE": 6, "MEASURED": 5, "CURATED": 4, "PUBLICATION": 3, "LITERATURE_METADATA": 2, "PATENT": 1, "METADATA": 0}
METRICS = ("IC50", "EC50", "KOFF", "KON", "KD")
QUALIFIERS = ("", "<", "<=", "=", ">=", ">", "~")
VIRUSES = {"VACV": "Vaccinia virus", "MPXV": "Mpox virus", "VARV": "Variola virus", "CPXV": "Cowpox virus"}
_MEASURE = r"^\s*(<=|>=|<|>|=|~)?\s*([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*$"


def is_negative(c: Column | str) -> Column:
    """Negative by prefix, as pages are built."""
    return _col(c).rlike("^(does_)?not_")


def family(c: Column | str) -> Column:
    """direct, functional, negative or literature; other relationships count but have no page."""
    r = _col(c)
    return F.when(r.isin(*DIRECT), "direct").when(r.isin(*FUNCTIONAL), "functional").when(r.isin(*LITERATURE), "literature").when(is_negative(r), "negative").otherwise("other")


def evidence_rank(c: Column | str) -> Column:
    e = _col(c)
    out = F
    for name, rank in EVIDENCE_RANK.items():
        out = out.when(e == name, rank)
    return out.otherwise(0)


def measurement(raw: Column | str, qualifier: Column | str | None = None) -> Column:
    """Struct of value (null if not one number), qualifier (given, else read) and the raw text.

    An empty text, an unknown qualifier and a number that is not finite are
    rejected: there the struct is null.
    """
    t = fold_missing(raw)
    given = fold_missing(qualifier) if qualifier is not None else F.lit("")
    read = F.regexp_extract(t, _MEASURE, 1)
    value = F.regexp_extract(t, _MEASURE, 2).try_cast("double")
    told = F.when(given != "", given).otherwise(read)
    fine = (t != "") & told.isin(*QUALIFIERS) & F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(True))
    return F.when(fine, F.struct(value.alias("value"), told.alias("qualifier"), t.alias("raw_value")))


def metric(response: Column | str) -> Column:
    """The first metric, in fixed order, that a response names; else empty."""
    squeezed = F.replace(F.upper(fold_missing(response)), F.lit(" "), F.lit(""))
    out = F
    for m in METRICS:
        out = out.when(squeezed.contains(m), m)
    return out.otherwise("")


# Words that tell a binding method, as sequences of words of a method or response.
BINDING_METHODS = ("surface plasmon", "biolayer interferometry", "spr", "bli", "elisa")


def _spaced(c: Column) -> Column:
    """Lower-cased words with one blank around each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "), F.lit(" "))


def is_binding_assay(method: Column | str, response: Column | str, metric_: Column) -> Column:
    """Affinity metrics, and methods or responses that name a binding method or speak of binding."""
    told = F.concat_ws(" ", fold_missing(method), fold_missing(response))
    out = metric_.isin("KD", "KON", "KOFF") | F.lower(told).contains("binding")
    for words in BINDING_METHODS:
        # phrases may stand within longer words, abbreviations may not
        out = out | (F.regexp_replace(F.lower(told), r"\s+", " ").contains(words) if " " in words else _spaced(told).contains(f" {words} "))
    return out


def chain_role(c: Column | str) -> Column:
    t = F.lower(fold_missing(c))
    return F.when((t == "h") | t.contains("heavy"), "VH").when((t == "l") | t.rlike("light|kappa|lambda"), "VL").otherwise("")


def epitope_targets(virus: Column | str, epitope: Column | str) -> Column:
    """``array<struct<target, origin>>``: the virus, and what the epitope of a SARS-CoV-2 entry asserts.

    The epitope is read as words.  A word after NON asserts nothing; an RBD that
    is asserted and denied at once only asserts the spike, as ambiguous.
    """
    name = F.translate(fold_missing(virus), "_", " ")
    words = F.filter(F.split(F.upper(fold_missing(epitope)), "[^A-Z0-9]+"), lambda w: w != "")
    before = F.concat(F.array(F.lit("")), words)
    denied = lambda w, i: (w == "RBD") & (F.element_at(before, i + 1) == "NON")
    state = F.struct(
        F.filter(words, lambda w, i: ~denied(w, i)).alias("said"),
        F.exists(F.transform(words, denied), lambda x: x).alias("denies"),
    )
    said = lambda *any_: F.arrays_overlap(state["said"], F.array(*map(F.lit, any_)))
    covid = F.upper(name).contains("SARS-COV2") | F.upper(name).contains("SARS-COV-2")
    entry = lambda target, origin: F.struct(F.lit(target).alias("target"), origin.alias("origin"))
    none = F.array().cast("array<struct<target:string,origin:string>>")
    domain = F.when(said("RBD") & ~state["denies"], F.array(entry("SARS-CoV-2 RBD", F.lit("source_epitope")))).when(said("NTD"), F.array(entry("SARS-CoV-2 NTD", F.lit("source_epitope")))).otherwise(none)
    whole = F.when(said("S", "S1", "SPIKE", "NTD", "RBD"), F.array(entry("SARS-CoV-2 Spike", F.when(said("RBD") & state["denies"], "ambiguous_epitope").otherwise("derived_hierarchy")))).otherwise(none)
    asserted = F.when(covid, F.concat(domain, whole)).otherwise(none)
    return F.array_distinct(F.concat(F.array(F.struct(name.alias("target"), F.lit("source").alias("origin"))), asserted))


def virus_entity(c: Column | str) -> Column:
    """Struct of the spelled-out virus with every later token, and the code without parentheses."""
    clean = F.trim(F.regexp_replace(fold_missing(c), r"\([^)]*\)", ""))
    parts = F.filter(F.split(clean, "_"), lambda p: p != "")
    first = F.element_at(parts, 1)
    virus = F
    for code, name in VIRUSES.items():
        virus = virus.when(F.upper(first) == code, name)
    whole = F.trim(F.concat_ws(" ", virus.otherwise(first), F.array_join(F.slice(parts, 2, 100_000), " ")))
    return F.when(F.size(parts) > 0, F.struct(whole.alias("target"), clean.alias("note"))).otherwise(F.struct(clean.alias("target"), F.lit("").alias("note")))


def reported_origin(c: Column | str, genetics: Column | str | None = None) -> Column:
    """human, mouse, other or unknown, by the first rule that fits what organism and genetics tell."""
    t = F.lower(F.concat_ws(" ", _col(c), *([] if genetics is None else [_col(genetics)])))
    return F.when(F.trim(t) == "", "unknown").when(t.rlike("human|homo sapiens"), "human").when(t.rlike("mouse|murine|mus musculus"), "mouse").otherwise("other")
