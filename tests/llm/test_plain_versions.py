"""The mix word by word, and the line rules line by line, against plain versions."""

import collections
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sequor.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share, most):
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_ and left > 0:
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if left * weights[i % len(weights)] >= most * sizes[i] * total]
        if not over:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            return out
        for i in over:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def plain_seats(votes, caps, seats):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps) if v > 0))):
        able = [i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0]
        out[max(able, key=lambda i: (Fraction(votes[i]) / (2 * out[i] + 1), -i))] += 1
    return out


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 7)])
def test_mix_equals_words_dealt_one_by_one(spark, monkeypatch, seed, block):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 15)
    monkeypatch.setattr(mixing, "MIN_BLOCKS", 40)
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(["b", "a", None, "c", "c"])) for i in range(120)]
    rows += rows[:3] + [(None, "x y z", "a"), (500, None, "a"), (501, "  \n", None), (502, "w " * 20_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter((r.doc_id, r.size, r.source, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs, seed=seed, block_words=block).collect())
    src = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    keyed = docs.select("*", src.alias("src")).withColumn("at", F.xxhash64(F.lit(seed), mixing.row_key()))
    held = [(r, len(WORD.findall(r.text or ""))) for r in keyed.withColumn("h", F.xxhash64("at", F.lit(1))).collect()]
    names = sorted({r.source for r, _ in held}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for r, n in held if r.source == s) for s in names]
    targets = plain_targets(sizes, (5, 2, 1), Fraction(3, 2), 2)
    blocks = [max(1, min(block, n // 40)) for n in sizes]
    shards = [-(-sum(r.source == s for r, _ in held) // 15) for s in names]
    quotas = [0] * len(names)
    for b in set(blocks):
        same = [i for i in range(len(names)) if blocks[i] == b]
        for i, q in zip(same, plain_seats([targets[i] for i in same], [2 * (-(-sizes[i] // b) + shards[i]) for i in same], round(sum(targets[i] for i in same) / b))):
            quotas[i] = q
    want = collections.Counter()
    for i, s in enumerate(names):
        own = [[(r, n) for r, n in held if r.source == s and r.h % shards[i] == k] for k in range(shards[i])]
        full = [k for k in range(shards[i]) if own[k]]
        n_blocks = [-(-sum(n for _, n in own[k]) // blocks[i]) for k in full]
        quota = plain_seats([sum(n for _, n in own[k]) for k in full], [2 * b for b in n_blocks], quotas[i])
        for k, nb, q in zip(full, n_blocks, quota):
            start = spark.range(1).select(F.pmod(F.xxhash64(F.lit(seed), F.lit(own[k][0][0].src), F.lit(k).cast("long")), F.lit(max(nb, 1)))).first()[0]
            whole, r = (q // nb, q % nb) if nb else (0, 0)
            chosen = [(j + 1 + start) * r // nb > (j + start) * r // nb for j in range(nb)]
            at = 0
            for row, n in sorted(own[k], key=lambda x: (x[0].at, x[0].doc_id is not None, x[0].doc_id or 0, x[1])):
                taken = sum(whole + chosen[(at + w) // blocks[i]] for w in range(n))
                want[row.doc_id, n, s, sizes[i], round(float(targets[i]), 6), taken] += 1
                at += n
    assert got == want
    assert all(k[5] <= 2 * k[1] for k in got)


def plain_line(line):
    words = WORD.findall(line)
    n = len(words)
    if not n:
        return None
    bars = sum(w in {*"|>»›·•", "::"} for w in words)
    symbols = sum(c in "#*$%&|<>" for c in line)
    shouts = len(re.findall(r"!!(?=[\x20\x09-\x0D]|$)", line))
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    if bars >= 3 and bars * 10 >= n:
        return "navigation"
    if n >= 8 and not re.search("[.!?…。！？:;\"”»)]", line) or symbols * 5 > n and n >= 3 or shouts * 5 > n:
        return "punctuation"
    if n <= 20 and any(p in line.lower() for p in quality._PHRASES) or echoes >= 3 and echoes * 3 > n:
        return "boilerplate"
    return None


def plain_verdict(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = collections.Counter(windows)
    repeated = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    lost = sum(len(WORD.findall(x)) for x in lines if plain_line(x))
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return lost, "\n".join(x for x in lines if not plain_line(x)), not failed and 100 * lost <= 50 * len(words)


def test_line_rules_equal_a_plain_version(spark):
    rng = random.Random(5)
    bits = ["word", "other", "the", "the", "|", "»", "::", "a|b", "#x", "50%", "done.", "yes!!", "no!!", "(see)", "cookie", "Read", "more", "Log", "in", "e…", "  ", "\t", "\x0b"]
    texts = ["\n".join(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += [None, "", "\n\n", "plain words without end " * 3000, "a b c. " * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.quality for r in quality.annotate(df).collect()}
    seen = collections.Counter()
    for i, t in enumerate(texts):
        assert (got[i].n_lost_words, got[i].clean_text, got[i].kept) == plain_verdict(t), (i, t)
        seen.update(plain_line(x) for x in (t or "").split("\n"))
    assert set(seen) == {None, "navigation", "punctuation", "boilerplate"}
    assert {q.kept for q in got.values()} == {True, False}
