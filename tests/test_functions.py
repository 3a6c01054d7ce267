import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import sequences as S
from sequor.functions import text as T


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [(None, ""), (" N/A ", ""), ("Not Determined", ""), ("-", ""), (" x ", "x")])
def test_missing_values_fold(spark, raw, want):
    assert one(spark, raw, T.fold_missing("v")) == want


def test_listed_values(spark):
    assert one(spark, "a; b | nd;;c", T.split_values("v")) == ["a", "b", "c"]


@pytest.mark.parametrize("raw, term, bucket", [("PD-L1", "pd l1", "pd"), ("PDL1", "pdl1", "pd"), ("É!", "e", "e_"), ("  ", "", "__")])
def test_search_terms_keep_hyphens_as_blanks(spark, raw, term, bucket):
    assert one(spark, raw, T.search_term("v")) == term
    assert one(spark, raw, T.search_bucket(T.search_term("v"))) == bucket


@pytest.mark.parametrize("raw, want", [("PD-L1", "PDL1"), ("IL-1β", "IL1BETA"), ("TNF-α", "TNF")])
def test_target_keys_spell_beta_and_lose_alpha(spark, raw, want):
    assert one(spark, raw, T.target_key("v")) == want


def test_digest_is_sha256_of_joined_parts(spark):
    assert one(spark, "a", T.digest("v", F.lit("b"), length=12)) == hashlib.sha256(b"a\x1fb").hexdigest()[:12]


def test_slugs(spark):
    assert one(spark, "Café au  Lait!", T.slug("v")) == "cafe-au-lait"
    assert one(spark, "!!", T.slug("v")) == "unknown"


def test_residues_reject_what_is_not_formatting(spark):
    assert one(spark, "ac d\n*", S.residues("v")) == "ACD*"
    assert one(spark, "AC-D", S.residues("v")) is None
    assert one(spark, "AC-D-", S.bad_characters("v")) == ["-"]
    assert one(spark, "acgu", S.nucleotides("v")) == "ACGT"
    assert one(spark, "ACGE", S.nucleotides("v")) is None


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def test_signature_is_the_least_distinct_hashes(spark):
    seq = "ACDEFGHIKLMNPQRSTVWY" * 3 + "XACDEF"
    want = sorted({fnv(seq[i : i + 5]) for i in range(len(seq) - 4) if "X" not in seq[i : i + 5]})[:32]
    assert one(spark, seq, S.signature("v")) == want
    assert one(spark, "ACD", S.signature("v")) == []
    assert one(spark, "ACDEF", S.fnv1a("v")) == fnv("ACDEF")


def plain_alignment(r, q):
    m, n = len(r), len(q)
    cells = [[None] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            if not i or not j:
                cells[i][j] = (-2 * (i + j), 0, i + j, 0)
                continue
            alike = any(r[i - 1] in g and q[j - 1] in g for g in S.GROUPS)
            sub = 2 if r[i - 1] == q[j - 1] else 1 if alike else -1
            before = (cells[i - 1][j - 1], cells[i - 1][j], cells[i][j - 1])
            scores = [before[0][0] + sub, before[1][0] - 2, before[2][0] - 2]
            k = scores.index(max(scores))
            p = before[k]
            cells[i][j] = (scores[k], p[1] + (k == 0 and r[i - 1] == q[j - 1]), p[2] + 1, p[3] + (k == 0))
    return cells[m][n]


def test_alignment_against_the_plain_recurrence(spark):
    rng = random.Random(3)
    refs = ["".join(rng.choice(S.CANONICAL) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    ques = ["".join(c if rng.random() > 0.2 else rng.choice(S.CANONICAL) for c in r)[rng.randint(0, 2) :] for r in refs]
    assert [tuple(x) for x in S.align_batch(refs, ques)] == [plain_alignment(a, b) for a, b in zip(refs, ques)]
    df = spark.createDataFrame(list(zip(refs, ques)), "r string, q string").withColumn("a", S.align("r", "q"))
    got = df.select("a.score", S.strict_identity(F.col("a")).alias("i")).collect()
    assert [g.score for g in got] == [plain_alignment(a, b)[0] for a, b in zip(refs, ques)]


def test_edit_identity_thresholds(spark):
    base = "ACDEFGHIKL" * 10
    ten = "W" * 10 + base[10:]
    eleven = "W" * 11 + base[11:]
    get = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(S.edit_identity("a", "b").alias("x")).first().x
    assert get(base, ten) == 90.0
    assert get(base, eleven) is None
    assert get(base, base[:89]) is None
    assert get("", base) is None


def test_back_translation(spark):
    assert one(spark, "MK", S.back_translate("v")) == "ATGAAG"
    assert one(spark, "MX", S.back_translate("v")) is None


def test_variants_reach_the_identity(spark):
    seq = "ACDEFGHIKL" * 10
    got = one(spark, seq, S.variant("v", 90))
    assert sum(a != b for a, b in zip(seq, got)) == 10


@pytest.mark.parametrize("raw, value, qualifier", [("<2.5e-9", 2.5e-9, "<"), ("12", 12.0, ""), ("about 3", None, ""), (">= 4", 4.0, ">=")])
def test_measurements_keep_the_raw_text(spark, raw, value, qualifier):
    got = one(spark, raw, R.measurement("v"))
    assert (got.value, got.qualifier, got.raw_value) == (value, qualifier, raw)


@pytest.mark.parametrize("raw, want", [("ic 50", "IC50"), ("KD (nM)", "KD"), ("koff", "KOFF"), ("titer", "")])
def test_metrics(spark, raw, want):
    assert one(spark, raw, R.metric("v")) == want


@pytest.mark.parametrize(
    "raw, want",
    [("binds", "direct"), ("protects", "functional"), ("does_not_bind", "negative"), ("not_tested", "negative"), ("mentioned_with", "literature"), ("other", "other")],
)
def test_families(spark, raw, want):
    assert one(spark, raw, R.family("v")) == want


@pytest.mark.parametrize(
    "epitope, want",
    [
        ("RBD", {("SARS-CoV-2 RBD", "source_epitope"), ("SARS-CoV-2 Spike", "derived_hierarchy")}),
        ("non-RBD", set()),
        ("S1 non-RBD", {("SARS-CoV-2 Spike", "derived_hierarchy")}),
        ("RBD/non-RBD", {("SARS-CoV-2 Spike", "ambiguous_epitope")}),
        ("NTD", {("SARS-CoV-2 NTD", "source_epitope"), ("SARS-CoV-2 Spike", "derived_hierarchy")}),
    ],
)
def test_epitopes_respect_negation(spark, epitope, want):
    got = one(spark, epitope, R.epitope_targets(F.lit("SARS-CoV-2"), "v"))
    assert {(t.target, t.origin) for t in got} == want | {("SARS-CoV-2", "source")}


def test_virus_codes_keep_every_token(spark):
    got = one(spark, "VACV_WR_surface_L1 (weak)", R.virus_entity("v"))
    assert got.target == "Vaccinia virus WR surface L1" and got.note == "VACV_WR_surface_L1"


def test_regions_are_located(spark):
    df = spark.createDataFrame([("CD", "ACDE"), ("", "ACDE"), ("W", "ACDE")], "r string, c string")
    assert [x.p for x in df.select(S.region_position("r", "c").alias("p")).collect()] == [1, -1, -1]


def test_alignment_texts(spark):
    assert S.aligned_texts("ACDE", "ACE") == "ACDE\n|| |\nAC-E"
    rng = random.Random(9)
    for _ in range(30):
        a, b = ("".join(rng.choice(S.CANONICAL) for _ in range(rng.randint(1, 30))) for _ in range(2))
        ref, marks, que = S.aligned_texts(a, b).split("\n") if len(a) + len(b) < 70 else (a, "", b)
        assert ref.replace("-", "") == a and que.replace("-", "") == b
        assert marks.count("|") == plain_alignment(a, b)[1] and len(ref) == plain_alignment(a, b)[2]
    assert one(spark, "AC", S.alignment_text("v", F.lit("AC"))) == "AC\n||\nAC"


def test_variant_of_a_very_long_sequence_takes_one_pass(spark):
    seq = "ACDEFGHIKL" * 30_000
    began = time.time()
    got = one(spark, seq, S.variant("v", 95))
    assert time.time() - began < 60
    assert len(got) == len(seq) and sum(a != b for a, b in zip(got, seq)) == 15_000


@pytest.mark.parametrize("level", [100, 99, 95, 90, 80, 50, 0])
def test_variants_change_where_the_floor_steps_up(level):
    for n in (1, 2, 7, 40, 99, 1000):
        seq = ("ADAK" * n)[:n]
        e = round(n * (100 - level) / 100)
        want = "".join(("G" if c == "A" else "A") if (i + 1) * e // n > i * e // n else c for i, c in enumerate(seq))
        assert S.variant_of(seq, level) == want


def test_sharp_s_and_ligatures_are_no_residues(spark):
    from sequor.operators import search

    df = spark.createDataFrame([("Tessteß",), ("teﬁt",), ("teſt",), ("ab\u2028",), ("te st*",)], "v string")
    got = df.select(search.pasted_sequence(F.col("v")).alias("p"), S.has_only_residues("v").alias("h"), search.is_sequence(F.col("v"), 2).alias("q")).collect()
    assert [tuple(r) for r in got] == [(None, False, False), (None, False, False), ("TEST", True, False), (None, False, False), ("TEST*", True, True)]
    assert df.where(S.has_only_residues("v")).select(S.strict_residues("v").alias("s")).collect() == [("TEST",), ("TEST*",)]
    with pytest.raises(Exception, match="ß"):
        df.limit(1).select(S.strict_residues("v")).collect()


def test_lengths_that_no_identity_allows(spark):
    df = spark.createDataFrame([(90, 100), (89, 100), (100, 90), (0, 0), (9, 10)], "a int, b int")
    assert [r.x for r in df.select(S.like_lengths(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True, False, True]


def test_signatures_side_by_side_equal_single_ones():
    rng = random.Random(3)
    texts = ["".join(rng.choice(S.CANONICAL + "X*\u00e9") if rng.random() < 0.1 else rng.choice("ACD") for _ in range(n)) for n in [0, 1, 4, 5, 6, 40, 400, 0, 900] * 9]
    hashes, at = S.signatures_of(texts)
    assert [hashes[a:b].tolist() for a, b in zip(at, at[1:])] == [S.signature_of(t).tolist() for t in texts]
    assert [len(x) for x in S.signatures_of([])] == [0, 1]
