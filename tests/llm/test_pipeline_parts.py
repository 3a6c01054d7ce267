"""The pipeline's mixing stage against the spans that the mix selects."""

import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from sequor.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    rng = random.Random(3)
    text = lambda i, n: " \n".join(f"d{i}w{k}" + rng.choice(["", "\tx", "  y", "\n\nz"]) for k in range(n))
    rows = [(i, "\n " + text(i, rng.randint(1, 400)) + "\n", rng.choice(["a", "b", "c"])) for i in range(90)]
    rows += [rows[4]] * 2 + [(None, rows[5][1], "b")] * 2 + [(rows[6][0], rows[6][1], "other"), (200, None, "a"), (201, "", "b")]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_a_part_is_the_words_of_the_selected_blocks(spark):
    docs = documents(spark)
    texts = {(r.doc_id, r.source): r.text for r in docs.collect()}
    want, tails = collections.Counter(), 0
    for r in mixing.mix(docs).collect():
        text = texts[r.doc_id, r.source]
        assert r.taken == r.times * r.size + sum(s.end - s.start for s in r.spans or [])
        want[r.doc_id, r.source, text] += r.times
        if r.spans:
            at = [m.start() for m in WORD.finditer(text)] + [len(text)]
            want[r.doc_id, r.source, "".join(text[at[s.start] : at[s.end]] for s in r.spans).rstrip()] += 1
            tails += r.spans[0].start > 0
    rows = corpus_pipeline.source_mixing(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.source, r.text) for r in rows) == +want
    assert tails > 10 and all(r.n_chars == len(r.text) for r in rows)
