"""Likeness searches against a plain recurrence over all pairs."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F
from test_functions import plain_alignment

from sequor.functions import sequences as S
from sequor.operators import screening, similarity
from sequor.plans import registry


def fnv(k):
    h = 2166136261
    for c in k.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


def signature(s):
    return set(sorted({fnv(s[i : i + 5]) for i in range(len(s) - 4) if not set(s[i : i + 5]) - set(S.CANONICAL)})[:32])


def chains(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(S.CANONICAL) for _ in range(rng.randint(40, 90))) for _ in range(8)]
    out = []
    for i in range(n):
        s = list(base[i % 8])
        for _ in range(rng.randint(0, 30)):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([[], [rng.choice(S.CANONICAL)], [s[at], rng.choice(S.CANONICAL)]])
        out.append("".join(s)[rng.randint(0, 12) :])
    return out


def plain(asked, held, mode):
    out = {}
    signs = {i: signature(s) for i, s in held.items()}
    often = {}
    for s in signs.values():
        for h in s:
            often[h] = often.get(h, 0) + 1
    for q, ref in asked.items():
        shared = {i: len({h for h in signature(ref) & s if often[h] <= 250}) for i, s in signs.items()}
        found = {i: n for i, n in shared.items() if n}
        if mode == "loose":
            found = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:140]) | {i: 32 for i, s in held.items() if s == ref}
        for i, n in found.items():
            s = held[i]
            if not s or mode == "loose" and min(len(s), len(ref)) / max(len(s), len(ref)) < 0.65:
                continue
            score, matches, columns, residues = plain_alignment(ref, s)
            identity = round(100 * matches / columns, 3) if mode == "strict" else 100 * matches / residues if residues else 0
            coverage = 100 * residues / len(ref)
            if identity >= 45 and (round(coverage, 3) if mode == "strict" else coverage) >= 70:
                out[q, i] = (n, round(identity, 6), round(coverage, 3), score)
    return out


@pytest.mark.parametrize("mode", ["strict", "loose"])
def test_similar_equals_all_alignments(spark, mode):
    held = dict(enumerate(chains(60, 1))) | {100: "", 101: "ACD"}
    asked = {f"q{k}": held[k] for k in range(6)} | {"other": "W" * 50}
    got = similarity.similar(spark.createDataFrame(list(asked.items()), "query_id string, sequence string"), spark.createDataFrame(list(held.items()), "id int, heavy string"), "heavy", mode=mode).collect()
    assert {(r.query_id, r.id): (r.shared, round(r.identity, 6), round(r.coverage, 3), r.score) for r in got} == plain(asked, held, mode)
    assert len(got) > 20


def test_paired_similar_equals_both_sides(spark):
    heavy, light = chains(40, 2), chains(40, 3)
    rows = [(i, h, l_) for i, (h, l_) in enumerate(zip(heavy, light))] + [(90, heavy[0], ""), (91, "", light[0])]
    df = spark.createDataFrame(rows, "id int, heavy string, light string")
    asked = df.where("id < 6").withColumnRenamed("id", "query_id")
    a, b = ({(q, i): v for (q, i), v in plain({r[0]: r[k] for r in rows[:6]}, {r[0]: r[k] for r in rows}, "loose").items()} for k in (1, 2))
    long_ = {r[0] for r in rows[:6] if len(r[1]) >= 40 and len(r[2]) >= 40}
    want = {k: round((a[k][1] * a[k][2] + b[k][1] * b[k][2]) / 200, 2) for k in a.keys() & b.keys() if k[0] in long_ and k[0] != k[1]}
    got = {(r.query_id, r.id): round(r.similarity, 2) for r in similarity.paired_similar(asked, df, exclude_self=True).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.02 for k in want)


def test_no_alignment_has_more_matches_than_common_letters():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("ACDE") for _ in range(rng.randint(0, 30))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.common_letters(a, b) == table[-1][-1] >= plain_alignment(a, b)[1]


def test_batches_split_and_long_twos_agree(monkeypatch):
    rng = random.Random(4)
    refs = ["".join(rng.choice(S.CANONICAL) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    ques = [r[3:] + r[:2] for r in refs]
    want = S.align_batch(refs, ques).tolist()
    assert want == [list(plain_alignment(a, b)) for a, b in zip(refs, ques)]
    monkeypatch.setattr(S, "TRACE_BYTES", 3000)
    assert S.align_batch(refs, ques).tolist() == want
    monkeypatch.setattr(S, "TRACE_BYTES", 10)
    assert S.align_batch(refs, ques).tolist() == want


def test_screening_reports_similar_chains(spark):
    held = dict(enumerate(chains(40, 5)))
    rows = spark.createDataFrame(list(held.items()), "id int, heavy string")
    other = "".join(reversed(held[1]))
    raw = [("exact", held[0]), ("like", "W" + held[1][1:]), ("none", "W" * 60), ("bad", "AC1"), ("empty", ""), ("other", other)]
    got = screening.screen(spark.createDataFrame(raw, "query_id string, raw string"), rows, with_similar=True).collect()
    like = {i for (q, i) in plain({"like": raw[1][1], "other": other}, held, "loose") if q == "like"}
    assert {r.id for r in got if r.query_id == "like"} == like and like and {r.status for r in got if r.query_id == "like"} == {"SIMILAR"}
    assert {(r.query_id, r.status) for r in got} >= {("exact", "EXACT"), ("none", "NO MATCH"), ("bad", "INVALID"), ("empty", "INVALID")}


def test_related_takes_the_chains_that_are_there(spark):
    heavy, light = chains(24, 2), chains(24, 3)
    rows = [(i, h, l_) for i, (h, l_) in enumerate(zip(heavy, light))] + [(90, heavy[1], ""), (91, "", light[2]), (92, "ACD", "")]
    df = spark.createDataFrame(rows, "id int, heavy string, light string")
    one = next(i for i, (h, l_) in enumerate(zip(heavy, light)) if len(h) >= 40 and len(l_) >= 40)
    both = {r.id for r in similarity.related(df, one).collect()}
    assert one not in both and both == {r.id for r in similarity.paired_similar(df.where(F.col("id") == one).withColumnRenamed("id", "query_id"), df, exclude_self=True).collect()}
    alone = {r.id for r in similarity.related(df, 90).collect()}
    want = {i for _, i in plain({90: heavy[1]}, {r[0]: r[1] for r in rows}, "loose")} - {90}
    assert alone == want and 1 in alone
    assert 2 in {r.id for r in similarity.related(df, 91).collect()} and similarity.related(df, 92).count() == 0
    with pytest.raises(ValueError, match="unknown entity 7777"):
        similarity.related(df, 7777)


@pytest.mark.parametrize("name", ["compare_entities", "alignment_lines"])
def test_recurrence_in_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{sf_dir}/benchmark.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    rows = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x)
    cols = sorted(df.columns)
    assert rows(df.select(*cols).collect()) == rows(con.sql(registry.ORACLES[name]).select(*cols).fetchall()) != []


def test_copies_are_not_aligned_one_by_one(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30_000))
    short = text[:60]
    rows = spark.createDataFrame([(i, text) for i in range(6)] + [(10 + i, short) for i in range(3)] + [(20, short[:-1] + "A"), (21, short[:-1] + "A")], "id long, heavy string")
    asked = rows.select(F.col("id").alias("query_id"), F.col("heavy").alias("sequence"))
    began = time.time()
    got = {(r.query_id, r.id): r for r in similarity.similar(asked, rows, "heavy", mode="loose").collect()}
    assert time.time() - began < 60
    assert len(got) == 36 + 25 and all(r.identity == 100 and r.coverage == 100 for (q, i), r in got.items() if q < 6)
    assert got[0, 5].score == 60_000 and got[0, 5].shared == 32
    assert got[10, 20].score == got[12, 21].score and got[10, 20].identity == got[12, 21].identity == 100 * 59 / 60


def test_exact_hits_of_a_frequent_text_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(similarity, "EXACT_ROWS", 50)
    rows = similarity.keyed(spark.createDataFrame([(i, "hot" if i < 90 else f"t{i % 7}") for i in range(120)], "id long, heavy string"), "id", "heavy", "key", "length")
    asked = rows.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    got = similarity.exact_hits(asked, rows).collect()
    kind = lambda i: "hot" if i < 90 else i % 7
    want = {(q, i) for q in range(0, 120, 5) for i in range(120) if kind(q) == kind(i)}
    assert len(got) == len(want) and {(r.query_id, r.id) for r in got} == want
    found = spark.createDataFrame([(0, 1, 3), (0, 91, 4)], "query_id long, id long, shared long")
    both = {(r.query_id, r.id): r.shared for r in similarity.with_exact(found, asked, rows).collect()}
    assert both == {p: 32 for p in want} | {(0, 91): 4}


def test_pairs_of_a_frequent_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "EXACT_ROWS", 50)
    monkeypatch.setattr(similarity, "EXACT_BLOCKS", 1)
    rows = similarity.keyed(spark.createDataFrame([(i, "hot" if i < 300 else f"t{i}") for i in range(310)], "id long, heavy string"), "id", "heavy", "key", "length")
    out = similarity.exact_hits(rows.where("id % 5 = 0").withColumnRenamed("id", "query_id"), rows)
    each = [n for n in out.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(each) == 60 * 300 + 2 and max(each) < 1000


def test_copies_of_one_chain_are_not_listed(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice(S.CANONICAL) for _ in range(n))
    heavy = text(60)
    rows = spark.createDataFrame([(i, heavy, text(50)) for i in range(300)] + [(300, heavy, ""), (301, heavy, None)], "id long, heavy string, light string")
    asked = rows.withColumnRenamed("id", "query_id")
    found = similarity._paired_candidates(asked.where("length(light) >= 40"), rows)
    assert found.count() < 300 * 30
    got = {(r.query_id, r.id): r.similarity for r in similarity.paired_similar(asked, rows).collect()}
    assert {p for p in got if p[0] == p[1]} == {(i, i) for i in range(300)} and all(got[i, i] == 100 for i in range(300))
