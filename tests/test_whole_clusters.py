import numpy as np
import pytest

from sequor.functions import sequences as S
from sequor.operators import couples
from sequor.plans import registry

BASE = "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRF"


@pytest.fixture(scope="module")
def frequent_dir(spark, tmp_path_factory):
    """300 chains one letter apart from ``BASE``, so that all hashes which two of them share have over 250 postings."""
    chains = [BASE[: i % 66] + [x for x in "WMCHP" if x != BASE[i % 66]][i // 66 % 4] + BASE[i % 66 + 1 :] + "K" * (i // 264) for i in range(300)]
    assert len(set(chains)) == 300
    path = str(tmp_path_factory.mktemp("frequent"))
    rows = [(i, f"\n{c}", "en", "s") for i, c in enumerate(chains)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name, line", [("clusters_heavy_90", 2), ("clusters_light_90", 1)])
def test_clusters_are_linked_by_frequent_hashes(spark, frequent_dir, name, line):
    got = {(r.id, r.representative_id, r["size"]) for r in registry.QUERIES[name](spark, frequent_dir).collect()}
    assert got == {(i * 1_000_000 + line, line, 300) for i in range(300)}


@pytest.mark.parametrize("name, lines", [("cluster_lookup", (2,)), ("cluster_scopes", (1, 2))])
def test_look_ups_give_all_members(spark, frequent_dir, name, lines):
    got = {r.id: (r.representative_id, r["size"], r.members) for r in registry.QUERIES[name](spark, frequent_dir).collect()}
    want = {i: (i, 1, str(i)) for i in got}
    for line in lines:
        members = "|".join(str(i * 1_000_000 + line) for i in range(300))
        want |= {i * 1_000_000 + line: (line, 300, members) for i in range(0, 300, 50)}
    assert got == want and len(got) == 12


def test_profiles_bound_edits():
    rng = np.random.default_rng(5)
    for n in (40, 90, 700):
        a = "".join(rng.choice(list("ACDE"), n))
        b = list(a)
        for edits in range(1, 5):
            at = int(rng.integers(len(b)))
            b[at : at + int(rng.integers(2))] = [["W"], [], ["Y"]][int(rng.integers(3))]
            x, y = S.profiles_of([a, "".join(b)]).astype(int)
            assert abs(x - y).sum() <= 2 * S.PROFILE_GRAM * edits


def test_meetings_are_those_of_all_twos(monkeypatch):
    rng = np.random.default_rng(6)
    sides = [[set(rng.choice(40, 14, replace=False).tolist()) for _ in range(n)] for n in (70, 50)]
    flat = [(np.array([h for s in side for h in sorted(s)]), np.repeat(np.arange(len(side)), 14)) for side in sides]
    want = {(i, j) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if len(x & y) >= couples.LEAST_SHARED}
    for cells, meetings in ((1 << 20, 1 << 20), (60, 1 << 20), (1 << 20, 300), (1, 1)):
        monkeypatch.setattr(couples, "CELLS", cells)
        monkeypatch.setattr(couples, "MEETINGS", meetings)
        got = [(int(i), int(j)) for a, b in couples.meetings(*flat, 70, 50) for i, j in zip(a, b)]
        assert len(got) == len(set(got)) and set(got) == want
