import random

from sequor.llm import mixing


def test_a_tiny_source_leaves_the_blocks_of_others(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_BLOCKS", 16)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(5, 60), rng.choice("abc")) for i in range(900)]
    schema = "doc_id long, text string, source string"
    mixed = lambda more: mixing.mix(spark.createDataFrame(rows + more, schema), block_words=64)
    got = {r.doc_id: r for r in mixed([(1000, "one two three", "tiny")]).collect()}
    cut = lambda found: sum(bool(r.spans) for r in found if r.source == "c")
    assert 0 < cut(got.values()) <= cut(mixed([]).collect()) * 1.2
    assert all(s.end - s.start <= 64 for r in got.values() for s in r.spans or [])
    for source in "abc":
        mine = [r for r in got.values() if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 64
    assert abs(got[1000].taken - got[1000].target) <= 1


def test_equal_blocks_share_seats_and_small_sources_have_their_own():
    assert mixing.source_quotas([100_000, 100_000, 30], [60_000, 40_000, 15], [100, 100, 1], [1, 1, 1], 2) == [600, 400, 15]
