"""Single-link sequence clusters and the redundancy modes built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.functions import sequences as S
from sequor.operators.components import connected_components
from sequor.operators.couples import LEAST_SHARED, linked_classes
from sequor.operators.similarity import LEAST_LENGTH, MOST_POSTINGS, signatures
from sequor.operators.skew import hot_limit, join_hot
from sequor.operators.storage import materialize

LEVELS = (99, 95, 90)


def in_scope(rows: DataFrame, fields: tuple[str, ...], id_col: str = "id") -> DataFrame:
    kept = rows
    for f in fields:
        kept = kept.where(F.length(f) >= LEAST_LENGTH)
    return kept.select(F.col(id_col).alias("id"), *fields)


def edges(rows: DataFrame, fields: tuple[str, ...] = ("heavy",), id_col: str = "id") -> DataFrame:
    """``(a, b, identity)`` of near chains: 5 shared hashes on every field, 90 % edit identity and coverage, a < b.

    Equal chains are one class from the start, so copies make no edges.  The
    posting cap counts records, copies included, and only the first field's.
    """
    every = in_scope(rows, fields, id_col)
    classes = materialize(every.groupBy(*fields).agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    # signatures are made once for each class and weigh as many records as it has
    sizes = [F.length(f).alias(f"n{k}") for k, f in enumerate(fields)]
    marks = materialize(signatures(classes, fields[0]).join(classes.select("id", "copies", *sizes), "id"), "marks")
    often = marks.groupBy("hash").agg(F.sum("copies").alias("n")).where(F.col("n") > MOST_POSTINGS)
    first = materialize(marks.join(often, "hash", "left_anti").drop("copies"), "marks")
    # copies share all hashes, so a pair of classes shares what its least ids do
    couples = first.alias("l").join(first.alias("r"), (F.col("l.hash") == F.col("r.hash")) & (F.col("l.id") < F.col("r.id")))
    for k in range(len(fields)):
        # lengths that no identity allows make no couple, before couples are counted and meet their chains
        couples = couples.where(S.like_lengths(F.col(f"l.n{k}"), F.col(f"r.n{k}")))
    couples = couples.groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= LEAST_SHARED)
    left = classes.select(F.col("id").alias("a"), *[F.col(f).alias(f"{f}_a") for f in fields])
    right = classes.select(F.col("id").alias("b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    both = couples.join(left, "a").join(right, "b")
    for f in fields[1:]:
        both = both.where(F.size(F.array_intersect(S.signature(f"{f}_a"), S.signature(f"{f}_b"))) >= LEAST_SHARED)
    scores = [S.edit_identity(f"{f}_a", f"{f}_b") for f in fields]
    both = both.withColumn("identity", F.when(sum((s.isNull().cast("int") for s in scores[1:]), scores[0].isNull().cast("int")) == 0, F.least(*scores) if len(scores) > 1 else scores[0]))
    return both.where("identity is not null").select("a", "b", "identity")


def clusters(rows: DataFrame, level: int, fields: tuple[str, ...] = ("heavy",), id_col: str = "id", near: DataFrame | None = None, capped: bool = True) -> DataFrame:
    """``(id, representative_id, size)`` of every record in a cluster of two or more; the least id represents.

    Those not ``capped`` are linked by every near pair, by hashes above the posting cap too.
    """
    every = in_scope(rows, fields, id_col)
    if capped:
        heads = every.groupBy(*fields).agg(F.min("id").alias("head"))
        near = edges(rows, fields, id_col) if near is None else near
        comp = connected_components(near.where(F.col("identity") + 1e-9 >= level), "a", "b")
    else:
        every = materialize(every, "scope")
        heads = materialize(every.groupBy(*fields).agg(F.min("id").alias("head")), "classes")
        comp = linked_classes(heads.withColumnRenamed("head", "id"), fields, level)
    member = every.join(heads, list(fields)).select("id", "head")
    out = member.join(comp, F.col("head") == F.col("node"), "left").select("id", F.coalesce("component", "head").alias("representative_id"))
    if not capped:
        out = materialize(out, "members")
    sizes = out.groupBy("representative_id").agg(F.count("*").alias("size")).where("size > 1")
    return out.join(sizes, "representative_id").select("id", "representative_id", "size")


def lookup(members: DataFrame, ids: DataFrame, most: int | None = 100) -> DataFrame:
    """Each asked id's cluster with its first ``most`` members, or all without a number; an id in none is alone."""
    asked = ids.select(F.col(ids.columns[0]).alias("id"))
    found = asked.join(members, "id", "left").withColumn("representative_id", F.coalesce("representative_id", "id"))
    if most is None:
        found = materialize(found, "asked")
    wanted = found.select("representative_id").distinct()
    lists = members.join(wanted, "representative_id", "left_semi")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("representative_id").orderBy("id"))
        lists = lists.withColumn("_r", rank).where(F.col("_r") <= most)
    lists = lists.groupBy("representative_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    # a large cluster is asked for often, and its members would all be written by one task
    both = found.join(lists, "representative_id", "left") if most is not None else join_hot(found, materialize(lists, "lists"), "representative_id", hot_limit(found.count()), "left")
    return both.select("id", "representative_id", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("members", F.array("id")).alias("members"))


def scope_of(heavy: Column, light: Column) -> Column:
    """The scope that an entity is looked up in: both chains where it has them, else the one it has."""
    return F.when((heavy != "") & (light != ""), "heavy_light").when(heavy != "", "heavy").otherwise("light")


def scoped_lookup(rows: DataFrame, members: dict[str, DataFrame], ids: DataFrame, id_col: str = "id", most: int | None = 100) -> DataFrame:
    """As :func:`lookup`, each id in the scope of its chains; ``members`` has the clusters by scope, and unknown ids are left out."""
    asked = rows.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    asked = asked.select(F.col(id_col).alias("id"), scope_of(F.col("heavy"), F.col("light")).alias("scope"))
    out = None
    for scope, held in members.items():
        one = lookup(held, asked.where(F.col("scope") == scope).select("id"), most).select("id", F.lit(scope).alias("scope"), "representative_id", "size", "members")
        out = one if out is None else out.union(one)
    return out


def redundancy(rows: DataFrame, mode: str, id_col: str = "id", order: str = "ord", records: DataFrame | None = None) -> DataFrame:
    """``(id, kept_id)`` of a selection under a mode; a discarded row names the row that stands for it.

    Modes: entities (all), source_records (rows of ``records``), unique_chains,
    and cluster_99, cluster_95, cluster_90 over the paired scope where both
    chains are there, else heavy.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(order).alias("ord"), "heavy", "light")
    if mode == "entities":
        return base.select("id", F.col("id").alias("kept_id"))
    if mode == "source_records":
        if records is None:
            raise ValueError("source_records needs the table of records")
        return base.join(records.select(F.col(id_col).alias("id"), "source", "record_id").distinct(), "id").select(F.concat_ws(":", "id", "source", "record_id").alias("id"), F.concat_ws(":", "id", "source", "record_id").alias("kept_id"))
    if mode == "unique_chains":
        keyed = base.withColumn("key", F.when((F.col("heavy") != "") | (F.col("light") != ""), F.sha2(F.concat_ws("|", "heavy", "light"), 256)).otherwise(F.col("id").cast("string")))
    else:
        level = int(mode.removeprefix("cluster_"))
        couples, heavy = clusters(rows.where("light <> ''"), level, ("heavy", "light"), id_col), clusters(rows.where("light = ''"), level, ("heavy",), id_col)
        member = couples.union(heavy)
        keyed = base.join(member.select("id", F.col("representative_id").cast("string").alias("rep")), "id", "left").withColumn("key", F.coalesce("rep", F.col("id").cast("string")))
    first = F.first("id").over(Window.partitionBy("key").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return keyed.select("id", first.alias("kept_id"))
