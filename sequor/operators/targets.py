"""Targets: resolving names, rolling up claims, hierarchy, ranked result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import text as T
from sequor.operators.storage import materialize

PAGE_SIZE = 100
MOST_TARGETS = 80
REVIEW_LIMIT = 500
#: Rows of a dictionary up to which it may be broadcast.
BROADCAST_NAMES = 1_000_000


def alias_table(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """``(key, canonical, aliases)`` of a curated dictionary; a key of two canonical names is an error."""
    import re

    seen: dict[str, str] = {}
    rows = []
    for canonical, names in groups.items():
        every = sorted({canonical, *names}, key=lambda x: (x.casefold(), x))
        for n in (canonical, *names):
            k = re.sub("[^A-Z0-9]+", "", re.sub("[Ββ]", "BETA", n.upper().replace("α", "ALPHA")))
            if seen.setdefault(k, canonical) != canonical:
                raise ValueError(f"{n!r} belongs to both {seen[k]!r} and {canonical!r}")
            rows.append((k, canonical, every))
    return spark.createDataFrame(list({(k, c): (k, c, a) for k, c, a in rows}.values()), "key string, canonical string, aliases array<string>")


def resolve(names: DataFrame, aliases: DataFrame, name: str = "target_raw", unicode_: bool = True) -> DataFrame:
    """``names`` with ``canonical``, ``curated`` and ``target_id``: by dictionary key, else the name itself."""
    small = F.broadcast(aliases) if aliases.count() <= BROADCAST_NAMES else aliases
    out = names.withColumn("key", T.target_key(name, unicode_)).join(small.select("key", F.col("canonical").alias("found")), "key", "left")
    out = out.withColumns({"curated": F.col("found").isNotNull(), "canonical": F.coalesce("found", F.trim(name))}).drop("found", "key")
    return out.withColumn("target_id", T.target_id("canonical", F.col("curated"), unicode_))


def resolve_group(names: DataFrame, aliases: DataFrame, name: str = "target_raw", unicode_: bool = False) -> DataFrame:
    """Slash-separated synonyms: the first part that the dictionary has, else the first part."""
    parts = F.filter(F.transform(F.split(F.col(name), "/"), F.trim), lambda p: p != "")
    each = names.select(name).distinct().select(name, F.posexplode(parts).alias("pos", "part"))
    hit = resolve(each, aliases, "part", unicode_)
    best = hit.groupBy(name).agg(F.min_by(F.struct("canonical", "curated", "target_id"), F.struct(~F.col("curated"), F.col("pos"))).alias("b"))
    return names.join(best.select(name, "b.*"), name, "left")


def expand_terms(claims: DataFrame) -> DataFrame:
    """Literature terms fan out at semicolons; other sources' terms stay whole."""
    parts = F.when(F.col("source") == "plabdab", T.split_values("target_raw", ";")).otherwise(F.array(T.fold_missing("target_raw")))
    return claims.withColumn("target_raw", F.explode(F.filter(parts, lambda t: t != "")))


def dispatch(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims with their target: slash-separated synonyms of the therapeutic source go by group, all others whole.

    Each distinct name is resolved once, and claims meet the names.
    """
    grouped = F.coalesce((F.col("source") == "therasabdab") & F.col("target_raw").contains("/"), F.lit(False))
    names = claims.select("target_raw", grouped.alias("_g")).distinct()
    whole = resolve(names.where("not _g"), aliases)
    named = materialize(whole.unionByName(resolve_group(names.where("_g"), aliases, unicode_=True).select(whole.columns)), "names")
    named = named.withColumnsRenamed({"target_raw": "_raw", "_g": "_by"})
    small = F.broadcast(named) if named.count() <= BROADCAST_NAMES else named
    out = claims.withColumn("_g", grouped)
    return out.join(small, F.col("target_raw").eqNullSafe(F.col("_raw")) & (F.col("_g") == F.col("_by"))).drop("_raw", "_g", "_by")


def entity_table(spark: SparkSession, entities: dict[str, dict]) -> DataFrame:
    """``(canonical, kind, organism, identifiers, parent, relation)`` of a curated entity map."""
    rows = [(k, e.get("kind", ""), (e.get("organism") or {}).get("name", ""), {n: str(v) for n, v in (e.get("identifiers") or {}).items()}, e.get("parent") or "", e.get("relation") or "related_to") for k, e in entities.items()]
    return spark.createDataFrame(rows, "canonical string, kind string, organism string, identifiers map<string,string>, parent string, relation string")


def with_entities(targets: DataFrame, entities: DataFrame, aliases: DataFrame, unicode_: bool = True, stamp: str = "curated target entity map") -> DataFrame:
    """Targets with their curated entity (exact canonical names only), where it is from, its parent where that is a target too, and children."""
    # one row a target, met three times below
    targets = materialize(targets, "targets")
    small = F.broadcast(entities) if entities.count() <= BROADCAST_NAMES else entities
    parents = resolve(entities.where("parent <> ''").select("parent").distinct(), aliases, "parent", unicode_).select("parent", F.col("target_id").alias("parent_id"))
    known = targets.select(F.col("target_id").alias("parent_id"))
    parents = parents.join(known, "parent_id", "left_semi")
    out = targets.join(small, targets["name"] == small["canonical"], "left")
    told = F.struct(F.lit(stamp).alias("source"), F.lit("exact canonical target only").alias("scope"))
    out = out.withColumn("mapping_provenance", F.when(F.col("canonical").isNotNull(), told)).drop("canonical")
    out = out.join(F.broadcast(parents) if entities.count() <= BROADCAST_NAMES else parents, "parent", "left")
    children = out.where("parent_id is not null").groupBy(F.col("parent_id").alias("target_id")).agg(F.array_sort(F.collect_set("target_id")).alias("children"))
    out = out.join(children, "target_id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    return out.withColumn("relation", F.when(F.col("parent_id").isNotNull(), F.col("relation"))).drop("parent")


def names_of(claims: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``(target_id, aliases, external_ids)``: every raw and curated name of a target, by folded order, and its outer ids."""
    held = claims.where(R.family("relationship") != "literature")
    raw = materialize(held.select("target_id", F.col("target_raw").alias("alias"), F.col("canonical")).distinct(), "names")
    each = raw.select("target_id", "alias").union(raw.select("target_id", "canonical"))
    if aliases is not None:
        listed = aliases.select("canonical", F.explode("aliases").alias("alias")).distinct()
        each = each.union(raw.select("target_id", "canonical").distinct().join(listed, "canonical").select("target_id", "alias"))
    folded = F.array_sort(F.collect_set(F.struct(F.lower("alias").alias("k"), F.col("alias").alias("a"))))
    names = each.where("alias <> ''").groupBy("target_id").agg(F.transform(folded, lambda x: x["a"]).alias("aliases"))
    outer = held.where("target_external_id <> ''").select("target_id", "target_external_id").distinct().groupBy("target_id").agg(F.array_sort(F.collect_set("target_external_id")).alias("external_ids"))
    return names.join(outer, "target_id", "left").withColumn("external_ids", F.coalesce("external_ids", F.array().cast("array<string>")))


def interaction_lists(claims: DataFrame) -> DataFrame:
    """``(target_id, family, antibody_id, interactions)``: the claims behind each result row, by id."""
    held = claims.withColumn("family", R.family("relationship")).where(F.col("family").isin("direct", "functional", "negative"))
    fields = [c for c in ("interaction_id", "relationship", "evidence", "source", "source_record_id", "target_raw", "epitope", "assay", "note", "reference", "record_url") if c in claims.columns]
    return held.groupBy("target_id", "family", "antibody_id").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("interactions"))


def evidence_lists(claims: DataFrame) -> DataFrame:
    """Per antibody: names of direct and functional targets, of negative evidence and of literature mentions."""
    held = claims.withColumn("family", R.family("relationship"))
    names = lambda fam: F.array_sort(F.collect_set(F.when(F.col("family") == fam, F.col("target_name"))))
    return held.groupBy("antibody_id").agg(names("direct").alias("direct_names"), names("functional").alias("functional_names"), names("negative").alias("negative_names"), names("literature").alias("literature_names"))


def interaction_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("ix_"), T.digest(*parts))


def rollup(claims: DataFrame) -> DataFrame:
    """One row for each target: claims, and distinct antibodies by family; literature makes no target.

    Claims of an antibody on a target are counted first, so that no row is
    multiplied to count distinct ones, and by plain counts: sets are made of the
    few distinct names and sources, as sets of many groups are made by sorting.
    """
    held = claims.withColumn("family", R.family("relationship")).where("family <> 'literature'")
    families = ("direct", "functional", "negative")
    each = held.groupBy("target_id", "antibody_id", "source", "target_name").agg(F.count("*").alias("count"), *[F.count_if(F.col("family") == f).alias(f) for f in families])
    each = materialize(each, "counts")
    told = each.select(F.col("target_id").alias("_t"), "source", "target_name").distinct().groupBy("_t").agg(
        F.min(F.when(F.col("target_name").isNotNull(), F.struct(F.length("target_name").alias("n"), F.col("target_name").alias("name"))))["name"].alias("name"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    sums = lambda at: [F.sum(c).alias(c + (at if c != "count" else "")) for c in ("count", *families)]
    who = lambda f: F.count_if((F.col(f) > 0) & F.col("antibody_id").isNotNull()).alias(f"{f}_antibodies")
    out = each.groupBy("target_id", "antibody_id").agg(*sums("")).groupBy("target_id").agg(*sums("_count"), *map(who, families))
    out = out.join(told, F.col("target_id").eqNullSafe(F.col("_t")))
    return out.select("target_id", "name", "count", *[f"{f}_count" for f in families], *[f"{f}_antibodies" for f in families], "sources")


def histogram(claims: DataFrame) -> DataFrame:
    """``(target_id, relationships)``: claims by relationship, as a sorted map."""
    counts = claims.where(R.family("relationship") != "literature").groupBy("target_id", "relationship").agg(F.count("*").alias("n"))
    return counts.groupBy("target_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relationship", "n")))).alias("relationships"))


def results(claims: DataFrame) -> DataFrame:
    """One row for each (target, family, antibody): its relationships, evidence, sources, and rank score."""
    held = claims.withColumn("family", R.family("relationship")).where(F.col("family").isin("direct", "functional", "negative"))
    sets = [F.array_sort(F.collect_set(c)).alias(a) for c, a in (("relationship", "relationships"), ("evidence", "evidence"), ("source", "sources"))]
    out = held.groupBy("target_id", "family", "antibody_id").agg(*sets, F.count("*").alias("n_interactions"), F.max(R.evidence_rank("evidence")).alias("best"))
    return out.withColumn("rank_score", (F.col("best") * 100 + F.size("sources") * 10).cast("long")).drop("best")


def of_targets(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims on the targets asked: rows are ranked and paged within their target, so its pages need no other's claims."""
    asked = ids.select(F.col(ids.columns[0]).alias("target_id")).distinct()
    return claims.join(F.broadcast(asked) if ids.count() <= BROADCAST_NAMES else asked, "target_id", "left_semi")


def paged(rows: DataFrame, name: str = "name", size: int = PAGE_SIZE) -> DataFrame:
    """Position and page within (target, family): by score, then folded name, then id.

    Rows are numbered within slices of equal score and first letters, and slices
    start where those before them end, so a target of very many rows is spread.
    """
    part = ["target_id", "family", "rank_score", "_head"]
    out = rows.withColumn("_head", F.substring(F.lower(F.coalesce(name, F.lit(""))), 1, 2))
    before = Window.partitionBy("target_id", "family").orderBy(F.desc("rank_score"), "_head").rowsBetween(Window.unboundedPreceding, -1)
    slices = out.groupBy(part).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = out.join(slices.select(*part, "_start"), part)
    own = F.row_number().over(Window.partitionBy(*part).orderBy(F.lower(name), "antibody_id"))
    out = out.withColumn("position", (F.col("_start") + own).cast("int")).select(*rows.columns, "position")
    return out.withColumn("page", F.ceil(F.col("position") / size).cast("long"))


def collection_stats(rows: DataFrame) -> DataFrame:
    """Per (target, family): results, and those paired, therapeutic, with exact or homologous structures."""
    return rows.groupBy("target_id", "family").agg(
        F.count("*").alias("unique_results"),
        F.count_if(F.col("has_heavy") & F.col("has_light")).alias("paired"),
        F.count_if(F.col("therapeutic_status") != "").alias("therapeutic"),
        F.count_if("structure_exact").alias("structure_exact"),
        F.count_if("structure_homologous").alias("structure_homologous"),
    )


def antibody_targets(claims: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """Per antibody: target counts by family before the cap, and capped sorted lists."""
    f = R.family("relationship")
    held = claims.withColumn("family", f)
    pick = lambda fam: F.array_sort(F.collect_set(F.when(F.col("family") == fam, F.col("target_id"))))
    out = held.groupBy("antibody_id").agg(pick("direct").alias("d"), pick("functional").alias("f"), F.count_if(F.col("family") == "negative").alias("negative_evidence"), F.count_if(F.col("family") == "literature").alias("literature_mentions"))
    return out.select(
        "antibody_id",
        F.size("d").cast("long").alias("direct_target_count"),
        F.size("f").cast("long").alias("functional_target_count"),
        F.slice("d", 1, most).alias("direct_targets"),
        F.slice("f", 1, most).alias("functional_targets"),
        "negative_evidence",
        "literature_mentions",
    )


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, id, depth)`` below each root of a ``(parent, id)`` tree, by levels; a cycle ends where nothing new is met.

    A root that lies on a cycle is below itself.  Each level is one join with
    the edges, kept in the shared folder.
    """
    roots = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    steps = edges.select("parent", "id").distinct()
    level = materialize(roots.join(steps, roots.root == steps.parent).select("root", "id").distinct().withColumn("depth", F.lit(1)), "level")
    found = level
    while level.limit(1).count():
        depth = level.first()["depth"] + 1
        below = level.select("root", F.col("id").alias("parent")).join(steps, "parent").select("root", "id").distinct()
        level = materialize(below.join(found, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        found = found.union(level)
    return found


def review_candidates(claims: DataFrame, most_targets: int = 20, limit: int = REVIEW_LIMIT, least_jaccard: float = 0.45, least_containment: float = 0.8) -> DataFrame:
    """Targets that share antibodies, two by two, for review: overlap 2 at least, and Jaccard .45 or containment .8."""
    direct = claims.where(R.family("relationship") == "direct").select("antibody_id", "target_id", "target_name").distinct()
    sizes = direct.groupBy("target_id").agg(F.count_distinct("antibody_id").alias("n"), F.min("target_name").alias("name"))
    # broad records are left out before the self-join, so that no antibody makes more than 190 couples
    fit = direct.groupBy("antibody_id").agg(F.array_sort(F.collect_set("target_id")).alias("t")).where(F.size("t").between(2, most_targets))
    left = fit.select("t", F.posexplode("t").alias("i", "a")).select("a", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("b"))
    overlap = left.groupBy("a", "b").agg(F.count("*").alias("overlap")).where("overlap >= 2")
    both = overlap.join(sizes.selectExpr("target_id a", "n na", "name name_a"), "a").join(sizes.selectExpr("target_id b", "n nb", "name name_b"), "b")
    jaccard, containment = F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap")), F.col("overlap") / F.least("na", "nb")
    kept = both.where((jaccard >= least_jaccard) | (containment >= least_containment))
    out = kept.select(F.col("a").alias("target_a"), "name_a", F.col("b").alias("target_b"), "name_b", "overlap", F.round(jaccard, 4).alias("jaccard"), F.round(containment, 4).alias("containment"))
    return out.orderBy(F.desc("containment"), F.desc("jaccard"), F.desc("overlap"), "name_a", "target_a", "target_b").limit(limit)
