"""From raw documents to shards: the stages of a training-corpus build, in order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequor.llm import decontaminate, jaccard_join, mixing, quality, sharding
from sequor.operators.storage import materialize

#: SQL cannot express the near-duplicate and sharding stages; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


#: Rows of keys (at most 32 bytes each) up to which a stage broadcasts them; beyond, it joins by a shuffle.
BROADCAST_ROWS = 2_000_000


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by their place, so that none clashes with what a stage adds; ``id``, ``text``, ``source`` and ``n_chars`` of the table keep their names."""
    return docs.toDF(*[c if c in _OWN else f"c{i}" for i, c in enumerate(docs.columns)])


def _named(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of :func:`_numbered` under their own names again."""
    return out.select(*[F.col(c if c in _OWN else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


#: Columns that stages read or set.
_OWN = ("doc_id", "text", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, with their failing lines removed; ``n_chars`` follows the text.

    Null, empty and short texts fail; texts are judged whole, whatever their
    length.  Rows are judged one by one, so repeats share their fate.  An empty
    table stays empty; all columns stay, whatever their names.
    """
    kept = quality.annotate(_numbered(docs), out="judged").where("judged.kept")
    cleaned = {"text": F.col("judged.clean_text"), "n_chars": F.length("judged.clean_text").cast("long")}
    return _named(kept.withColumns({c: v for c, v in cleaned.items() if c in docs.columns}), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, and of the least text key on a tie.

    Rows are told apart by id and text, so a row that shares only its id with
    another keeps its own fate.  Rows without an id come last in their group;
    repeated rows stay once; rows without words link with nothing and all stay.
    Of rows that repeat id and text but differ otherwise, that of the least hash
    of all columns stays.  Texts are compared whole.  An empty table stays empty;
    all columns stay, whatever their names.
    """
    docs, given = _numbered(docs), docs
    groups = materialize(jaccard_join.jaccard_components(docs).where("n_shingles > 0"), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    firsts = materialize(groups.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    # only groups of several rows lose any, so only their rows are looked up; a group may hold a third of all
    many = groups.join(_bounded(firsts), "component").withColumn("kept", (F.col("text_key") == F.col("first.text_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    rows = materialize(many.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "rows")
    keyed = docs.withColumn("key", jaccard_join.text_key())
    same = lambda t: (keyed["key"] == t["text_key"]) & keyed["doc_id"].eqNullSafe(t["doc_id"])
    gone = rows.where("not kept or n > 1").select("doc_id", "text_key")
    left = keyed.join(_bounded(gone), same(gone), "left_anti").select(docs.columns)
    again = rows.where("kept and n > 1").select("doc_id", "text_key")
    if not again.limit(1).count():
        return _named(left, given)
    held = keyed.join(_bounded(again), same(again), "left_semi")
    # the least hash of all columns names the row that stays
    held = held.withColumn("mark", F.xxhash64(*[F.col(c) if not t.startswith("map") else F.to_json(c) for c, t in docs.dtypes]))
    least = held.groupBy("doc_id", "key").agg(F.min_by(F.struct(*docs.columns), "mark").alias("row"))
    return _named(left.union(least.select("row.*")), given)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none; texts are searched whole, whatever their
    length; rows that repeat id and text share their fate.  An empty table, or
    one of items, changes nothing; all columns stay, whatever their names.
    """
    items, rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _numbered(docs)
    found = decontaminate.containments(rows, items).select("doc_key").distinct()
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    return _named(rows.join(found, key == F.col("doc_key"), "left_anti"), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole repeats, and once more the words of its selected spans.

    The words of a part keep the separators that follow them, and its last word
    has none.  Rows that repeat id, text and source have places of their own,
    dealt by the hash of their other columns.  Null and empty texts are not
    taken; a very long text may be taken in part.  A null source is a source.  An
    empty table stays empty; all columns stay, whatever their names.
    """
    docs, given = _numbered(docs), docs
    key = lambda: F.xxhash64(mixing.row_key(), F.col("source").cast("string"))
    mixed = mixing.mix(docs).select(F.xxhash64("row_key", "source").alias("key"), F.struct("times", "spans").alias("place"))
    places = mixed.groupBy("key").agg(F.array_sort(F.collect_list("place")).alias("places"))
    places = materialize(places.where(F.exists("places", lambda p: (p["times"] > 0) | p["spans"].isNotNull())), "taken")
    # a key is 32 bytes, and so is a span
    held = places.agg(F.sum(F.expr("aggregate(places, 0L, (n, p) -> n + 1 + coalesce(size(p.spans), 0))")), F.max(F.size("places"))).first()
    rows = docs.withColumn("key", key()).join(F.broadcast(places) if (held[0] or 0) <= BROADCAST_ROWS else places, "key")
    if (held[1] or 0) > 1:
        again = rows.where(F.size("places") > 1)
        order = Window.partitionBy("key").orderBy(F.xxhash64(*[c for c in docs.columns if c != "text"]))
        rows = rows.where(F.size("places") == 1).withColumn("nth", F.lit(1)).union(again.withColumn("nth", F.row_number().over(order)))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    rows = rows.withColumn("place", F.try_element_at("places", F.col("nth")))
    copies = "concat(array_repeat(cast(null as array<struct<start:int,end:int>>), place.times), if(place.spans is null, array(), array(place.spans)))"
    rows = rows.withColumn("spans", F.explode(F.expr(copies)))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    runs = F.transform("spans", lambda s: F.array_join(F.slice(words, s["start"] + 1, s["end"] - s["start"]), ""))
    part = F.regexp_replace(F.array_join(runs, ""), r"[\x20\x09-\x0D]+\z", "")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(part)
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns).transform(_named, given)


def kd_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row that the mix took, in 40 shards of near equal bytes.

    Rows of equal texts are one point of the tree, null texts count 16 bytes, a
    very long text that passes a quarter of a shard is dealt as pieces.  Repeated
    rows have slots of their own.  An empty table gives no rows; other columns
    are not read but for those that the tree measures.
    """
    return sharding.kd_shards(docs, n_shards=40)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("k-d sharding", kd_sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
