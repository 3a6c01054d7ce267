"""K-d sharding: equal texts as points, balance, many leaves, long texts, and the tree against a plain one."""

import collections
import random

from pyspark.sql import functions as F

from sequor.llm import sharding


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "clash") for i, t, la, s in rows], "doc_id long, text string, lang string, source string, t_hash string")


def by_shard(rows):
    out = collections.Counter()
    for r in rows:
        out[r.shard] += r.size
    return out


def test_equal_texts_share_a_shard_unless_they_are_too_many(spark):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randint(50, 400) + str(i), rng.choice(["en", "de"]), rng.choice(["web-crawl-a", "web-crawl-b", None])) for i in range(1500)]
    rows += [(2000 + 10 * g + j, f"group {g} " * 12, rng.choice(["en", "de", "fr"]), rng.choice(["web-crawl-a", "web-crawl-b"])) for g in range(60) for j in range(rng.randint(2, 9))]
    rows += [(9000 + j, "a very common text " * 4, rng.choice(["en", "de"]), "web-crawl-b") for j in range(1400)]
    out = sharding.kd_shards(table(spark, rows), 10).collect()
    texts = {i: t for i, t, _, _ in rows}
    shards = collections.defaultdict(set)
    for r in out:
        shards[texts[r.doc_id]].add(r.shard)
    sizes = by_shard(out)
    mean = sum(sizes.values()) / 10
    assert sorted(sizes) == list(range(10)) and max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean
    assert all(len(shards[f"group {g} " * 12]) == 1 for g in range(60))
    assert len(shards["a very common text " * 4]) > 2
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_cuts_follow_the_widest_dimension(spark):
    """Sources of equal bytes end in shards of their own, as the tree cuts there first."""
    rows = [(i, f"{i:06d}" * 20, "en", f"s{i % 4}") for i in range(800)]
    out = sharding.kd_shards(table(spark, rows), 4).collect()
    assert {(r.doc_id % 4, r.shard) for r in out} == {(k, k) for k in range(4)}


def test_long_texts_and_names_with_a_common_start(spark):
    rows = [(i, "x" * 2_000_000 if i == 7 else f"t{i} " * 40, "en", f"https://crawl/{i % 2}") for i in range(400)]
    out = sharding.kd_shards(table(spark, rows), 3).collect()
    assert len(out) == 400 and next(r.size for r in out if r.doc_id == 7) == 2_000_016
    rows = [r for r in rows if r[0] != 7]
    out = sharding.kd_shards(table(spark, rows), 2).collect()
    mixed = collections.Counter((r.doc_id % 2, r.shard) for r in out)
    # the cut passes between the two sources, but for the texts that even the bytes out
    assert sum(sorted(mixed.values())[:-2]) <= 4


def test_many_leaves_and_few_bins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BINS", 4096)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("t"), "id"), F.lit(10)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r.w for r in sharding.kd_shards(docs, 2000).groupBy("shard").agg(F.sum("size").alias("w")).collect()]
    assert len(sizes) == 2000 and max(sizes) - min(sizes) <= 2 * 80


def test_reruns_and_row_order_give_the_same_shards(spark):
    rows = [(i % 300, f"text {i % 200} " * (1 + i % 7), "en", "ab"[i % 2]) for i in range(600)] + [(None, None, None, None)] * 3
    a = sharding.kd_shards(table(spark, rows), 5).select("doc_id", "text_crc32", "shard").collect()
    b = sharding.kd_shards(table(spark, rows[::-1]).repartition(7), 5).select("doc_id", "text_crc32", "shard").collect()
    assert collections.Counter(a) == collections.Counter(b)
