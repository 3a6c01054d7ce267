"""Byte-level dedup against a plain version, and its merge against sorting."""

import random

import numpy as np
import pytest

from sequor.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, kept string, row long"


def plain(rows, k):
    """Rows in the order of the table; ids order documents, null last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            w = b[p : p + k]
            if w in seen:
                gone[p : p + k] = b"\1" * k
            seen.add(w)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (rows[i][0], len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return [out[i] for i in range(len(rows))]


def texts():
    rng = random.Random(8)
    letters = "abcdefgh é語\n\0"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [make(rng.randint(0, 400)) for _ in range(50)]
    passages = [make(rng.randint(20, 200)) for _ in range(6)]
    out = base + [make(rng.randint(0, 30)) + rng.choice(passages) + make(rng.randint(0, 30)) + rng.choice(passages) for _ in range(60)]
    for t in base[:15]:
        near = list(t)
        for _ in range(3):
            if near:
                near[rng.randrange(len(near))] = "Z"
        out.append("".join(near))
    out += base[:6] + [None, "", "a" * 500, "ab" * 300, "a" * 90 + "b" + "a" * 200, passages[0], passages[0][1:]]
    return [(i, t) for i, t in enumerate(out)] + [(None, passages[1]), (None, passages[1]), (3, base[3]), (3, "x" + base[4])]


@pytest.mark.parametrize("length,options", [(20, {}), (20, {"chunk_bytes": 900, "range_rows": 40, "fan_in": 3, "bucket_marks": 50}), (100, {"chunk_bytes": 2000, "range_rows": 100})])
def test_equals_the_plain_version(spark, length, options):
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash", -1) for i, t in rows], SCHEMA).coalesce(1)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, length, **options).collect()), key=str)
    assert got == sorted(plain(rows, length), key=str)
    assert sum(r[2] for r in got) > 1000


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 101) for _ in range(3000))
    for gram in S.grams(30):
        whole = S._all_suffixes([text, text[500:900], b"", b"short"], 30, gram)
        with monkeypatch.context() as m:
            m.setattr(S, "SEGMENT_BYTES", 128)
            cut = S._all_suffixes([text, text[500:900], b"", b"short"], 30, gram)
        for r, s, n, _ in (whole, cut):
            strings = sorted((a, b + i) for a, b, c in zip(r.tolist(), s.tolist(), n.tolist()) for i in range(c))
            assert strings == [(0, i) for i in range(2971)] + [(1, i) for i in range(371)]
        # a string's anchor does not depend on where it stands
        mark = {}
        for r, s, n, m_ in (whole, cut):
            for a, b, c, x in zip(r.tolist(), s.tolist(), n.tolist(), m_.tolist()):
                for i in range(c):
                    piece = (text if a == 0 else text[500:900])[b + i : b + i + 30]
                    assert mark.setdefault(piece, x) == x


def test_loser_tree_merges_and_tells_prefixes():
    rng = random.Random(6)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40))) for _ in range(9)]
    coded = [iter([(s, S.lcp(a, s), None) for a, s in zip([b"", *run], run)]) for run in runs]
    got = [(s, k) for (s, _, _), k in S.LoserTree(coded)]
    want = sorted(s for run in runs for s in run)
    assert [s for s, _ in got] == want
    assert [k for _, k in got] == [S.lcp(a, b) for a, b in zip([b"", *want], want)]
    assert list(S.LoserTree([])) == [] and list(S.LoserTree([iter(())])) == []


def test_loser_tree_skips_known_prefixes(monkeypatch):
    """No comparison starts before the prefix that both heads share with the last winner."""
    rng = random.Random(7)
    head = b"a common head of many suffixes "
    runs = [sorted(head + bytes(rng.choice(b"abc") for _ in range(8)) for _ in range(50)) for _ in range(5)]
    compared = 0
    true = S.lcp

    def counting(a, b, at=0):
        nonlocal compared
        out = true(a, b, at)
        compared += out - at + 1
        return out

    coded = [[(s, true(a, s), None) for a, s in zip([b"", *run], run)] for run in runs]
    monkeypatch.setattr(S, "lcp", counting)
    assert len(list(S.LoserTree([iter(c) for c in coded]))) == 250
    # each suffix's bytes are passed once at most, and a step each time two meet
    assert compared <= 4 * (len(head) + 8) + 250 * (8 + 3)


def test_spans_join_what_touches():
    r, s, e = S._spans(np.array([1, 0, 0, 0, 1]), np.array([5, 0, 3, 9, 0]), np.array([9, 4, 6, 12, 5]))
    assert list(zip(r.tolist(), s.tolist(), e.tolist())) == [(0, 0, 6), (0, 9, 12), (1, 0, 9)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.remove_repeats(df).count() == 0
    one = spark.createDataFrame([(1, "short", "", 0), (2, None, "", 0)], SCHEMA)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in S.remove_repeats(one).collect()) == [(1, 5, 0), (2, 0, 0)]
