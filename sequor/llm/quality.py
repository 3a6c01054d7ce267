"""Line-first cleaning with built-in functions only: one narrow pass, no shuffle.

Each line faces three groups of rules; lines that fail go, and a document that
loses more than a share of its words with them is rejected.

* punctuation: a line of several words has no mark that closes a clause, carries more
  than one symbol of ``#*$%&|<>`` for five words, or shouts ``!!`` after a fifth
  of its words;
* navigation: a tenth of its words, three at least, are bare separators;
* boilerplate: a short line with a stock phrase of web furniture, or a line a
  third of whose words repeat the word before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_BARS = "|>»›·•"
_SYMBOLS = "#*$%&|<>"
# Stock phrases of page furniture, matched in lower-cased lines.
_PHRASES = (
    "cookie",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "enable javascript",
    "subscribe to our newsletter",
    "click here",
    "read more",
    "share this",
    "sign in",
    "log in",
    "skip to content",
)
_CLOSED = "[.!?…。！？:;\"”»)]"


def _counts(line: Column, any_symbols: Column) -> Column:
    """What the rules of a line look at; each count is made once, and symbols only where the text has any."""
    bars = F.when(_any_bar(line), F.regexp_count(line, F.lit(rf"(?<![^\x20\x09-\x0D])(?:[{_BARS}]|::)(?![^\x20\x09-\x0D])"))).otherwise(0)
    return F.struct(
        line.alias("line"),
        F.regexp_count(line, F.lit(_WORD + "+")).alias("n"),
        F.when(any_symbols, F.length(line) - F.length(F.translate(line, _SYMBOLS, ""))).otherwise(0).alias("symbols"),
        F.when(line.contains("!!"), F.regexp_count(line, F.lit(rf"!!(?={_SPACE}|$)"))).otherwise(0).alias("shouts"),
        bars.alias("bars"),
        F.regexp_count(line, F.lit(rf"(?<![^\x20\x09-\x0D])({_WORD}+)(?={_SPACE}++\1(?![^\x20\x09-\x0D]))")).alias("echoes"),
        (~line.rlike(_CLOSED)).alias("open"),
    )


def _any_bar(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(c) for c in (*_BARS, "::")])


def _judged(x: Column) -> Column:
    """A line, its words, and the first rule group that it fails, else null; blank lines fail none."""
    n = x["n"]
    stock = F.lower(x["line"]).rlike("|".join(_PHRASES))
    rule = (
        F.when(n == 0, F.lit(None))
        .when((x["bars"] >= 3) & (x["bars"] * 10 >= n), F.lit("navigation"))
        .when(((n >= 8) & x["open"]) | (x["symbols"] * 5 > n) & (n >= 3) | (x["shouts"] * 5 > n), F.lit("punctuation"))
        .when(((n <= 20) & stock) | ((x["echoes"] >= 3) & (x["echoes"] * 3 > n)), F.lit("boilerplate"))
    )
    return F.struct(x["line"].alias("line"), n.alias("n"), rule.alias("rule"))


def annotate(docs: DataFrame, text_col: str = "text", out: str = "quality", max_lost_percent: int = 50) -> DataFrame:
    """``docs`` with a struct column ``out`` of statistics, the cleaned text and the verdict.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, n_lost_words (long), clean_text, kept.  Null and empty texts have
    no words, so they fail the base rules; very long ones are judged whole.
    Every row is judged alone: repeats and ties get equal verdicts, all columns
    stay, and an existing column called ``out`` is replaced.  An empty table
    stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # intermediate columns stand alone: inside a struct the optimiser would copy their expressions into every use
    t = {k: f"__{out}_{k}" for k in ("w", "lines", "judged", "g", "h", "s", "p", "n_symbols")}
    w, g, h, s = t["w"], t["g"], t["h"], t["s"]
    step = docs.withColumns({w: F.filter(F.split(text, f"{_SPACE}+"), lambda x: x != ""), t["n_symbols"]: (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long")})
    step = step.withColumn(t["judged"], F.transform(F.transform(F.split(text, "\n", -1), lambda x: _counts(x, F.col(t["n_symbols"]) > 0)), _judged))
    step = step.withColumn(t["lines"], F.expr(f"transform(filter({t['judged']}, x -> x.n > 0), x -> x.line)"))
    hashed = lambda size: ", ".join(f"{w}[i + {j}]" for j in range(size))
    every = lambda size: f"transform(sequence(0, size({w}) - {size}), i -> xxhash64({hashed(size)}))"
    # two equal windows of eight words hold two equal ones of four, which are cheaper to look for
    step = step.withColumn(g, F.expr(f"case when size({w}) > 8 then {every(4)} else array() end").cast("array<bigint>"))
    step = step.withColumn(h, F.expr(f"case when size(array_distinct({g})) < size({g}) then {every(8)} else array() end").cast("array<bigint>"))
    # only a text with two windows of one hash can repeat a window; those are compared as texts
    windows = f"array_sort(transform(sequence(1, size({w}) - 7), i -> struct(array_join(slice({w}, i, 8), ' ') as s, i as p)))"
    step = step.withColumn(s, F.expr(f"case when size(array_distinct({h})) < size({h}) then {windows} else array() end"))
    twice = f"filter(transform({s}, (x, i) -> case when (i > 0 and {s}[greatest(i - 1, 0)].s = x.s) or (i < size({s}) - 1 and {s}[least(i + 1, size({s}) - 1)].s = x.s) then x.p end), p -> p is not null)"
    covered = f"aggregate(array_sort({twice}), named_struct('e', 0, 'c', 0L), (a, p) -> named_struct('e', p + 8, 'c', a.c + (p + 8 - greatest(a.e, p))), a -> a.c)"
    values = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.translate(text, _SPACES, "")).cast("long"),
        "n_symbols": F.col(t["n_symbols"]),
        "n_dup_lines": F.expr(f"cast(size({t['lines']}) - size(array_distinct({t['lines']})) as bigint)"),
        "n_repeat_words": F.expr(covered),
        "n_lost_words": F.expr(f"aggregate({t['judged']}, 0L, (a, x) -> a + if(x.rule is null, 0, x.n))"),
        "clean_text": F.expr(f"array_join(transform(filter({t['judged']}, x -> x.rule is null), x -> x.line), '\n')"),
    }
    t.pop("n_symbols")
    step = step.withColumns({f"__{out}_{k}": v for k, v in values.items()})
    q = {k: F.col(f"__{out}_{k}") for k in values}
    failed = (q["n_words"] < 20) | (q["n_repeat_words"] * 100 > q["n_words"] * 30)
    lost = q["n_lost_words"] * 100 > q["n_words"] * max_lost_percent
    result = F.struct(*[q[k].alias(k) for k in values], failed.alias("base_failed"), (~failed & ~lost).alias("kept"))
    # explode of one value: a filter on the verdict stays above it, instead of taking copies of every expression down
    step = step.drop(out) if out in docs.columns else step
    step = step.withColumn(out, F.explode(F.array(result)))
    return step.drop(*t.values(), *[f"__{out}_{k}" for k in values])
