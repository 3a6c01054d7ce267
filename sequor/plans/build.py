"""Snapshot build: adapters, merge, resolve, roll-up, and the tables that queries read."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sequor.functions import sequences as S
from sequor.operators import clusters, entities, exports, search, similarity, targets, validate
from sequor.operators.storage import materialize
from sequor.sources.adapters import ADAPTERS
from sequor.sources.tabular import limit_groups

TABLES = (
    "observations antibodies interactions literature targets pages names searchrows sequences regions postings clusters nucleotides records conflicts review manifest totals indexstats pageindex indexparts"
).split()
_CORE = (
    "antibody_id source source_ord record_id row_ord name heavy light vh_nt_source vl_nt_source cdrh1 cdrh2 cdrh3 cdrl1 cdrl2 cdrl3 organism format heavy_v heavy_d heavy_j "
    "light_v light_j therapeutic_status aliases structures structure_tiers metadata quarantine construct_id arm_id reference source_url record_url link_scope"
).split()
SCOPES = (("heavy",), ("light",), ("heavy", "light"))


def gather(spark: SparkSession, sources: dict[str, dict], max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All observations and interactions; the order of ``sources`` is the order of arrival.

    Both are written once: the plans behind them are wide, and every table of a
    snapshot starts from them.
    """
    observations, claims = [], []
    for n, (key, options) in enumerate(sources.items()):
        obs, edges = ADAPTERS[key](spark, **options)
        obs = obs.withColumn("source_ord", F.lit(n))
        if max_records:
            obs = limit_groups(obs, "source", "record_id", "row_ord", max_records)
            edges = edges.join(obs.select(F.col("record_id").alias("source_record_id")).distinct(), "source_record_id", "left_semi").select(edges.columns)
        # only receptor sources annotate chains and tell what their nucleotides cover
        extra = {"chain_annotations": F.create_map().cast("map<string,string>"), "nucleotide_scope": F.lit("unknown")}
        obs = obs.withColumns({c: v for c, v in extra.items() if c not in obs.columns})
        observations.append(materialize(obs.select(*_CORE, *extra), "observations"))
        claims.append(materialize(edges, "claims"))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(observations), union(claims)


def assemble(observations: DataFrame, claims: DataFrame, aliases: DataFrame, entity_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, as plans."""
    merged = entities.merge(observations)
    quarantined = observations.groupBy("antibody_id").agg(F.max(F.size("quarantine") > 0).alias("quarantined"))
    parts = [quarantined, entities.merge_metadata(observations), entities.merge_tiers(observations), entities.merge_contexts(observations, "construct"), entities.merge_contexts(observations, "arm"), _annotations(observations)]
    merged = reduce(lambda a, b: a.join(b, "antibody_id", "left"), parts, merged.drop("construct_ids", "arm_ids"))
    domain = F.coalesce(F.try_element_at("metadata", F.lit("domain_type")), F.lit(""))
    single = S.is_single_domain("format", domain, "heavy", "light")
    merged = merged.withColumn("quality", S.quality("heavy", "light", single, F.col("quarantined"), (F.col("vh_nt_source") != "") | (F.col("vl_nt_source") != "")))
    merged = materialize(merged, "merged")
    resolved = targets.dispatch(targets.expand_terms(claims), aliases).withColumn("target_name", F.col("canonical"))
    listed = F.array_join(F.array_sort("assay_ids"), ",")
    ids = ("antibody_id", "target_id", "source", "source_record_id", "relationship", "epitope", "assay", "target_external_id", listed, F.to_json("measurements"), "note", "target_raw")
    resolved = materialize(resolved.withColumn("interaction_id", targets.interaction_id(*ids)), "resolved")
    is_context = F.col("relationship") == "mentioned_with"
    edges = resolved.where(~is_context)
    facts = entities.summaries(merged).withColumns({"structure_exact": F.size("exact_structures") > 0, "structure_homologous": F.size("homologous_structures") > 0})
    facts = facts.join(merged.select("antibody_id", F.col("quality.pairing").alias("pairing"), F.coalesce(F.try_element_at("metadata", F.lit("genetics")), F.lit("")).alias("genetics")), "antibody_id")
    lists = targets.antibody_targets(resolved).join(targets.evidence_lists(resolved), "antibody_id")
    none = {c: F.array().cast("array<string>") for c, t in lists.dtypes if t == "array<string>"}
    zero = F.lit(0).cast("long")
    chains = merged.withColumnRenamed("antibody_id", "id")
    known = targets.rollup(edges).join(targets.histogram(edges), "target_id").join(targets.names_of(edges, aliases), "target_id", "left")
    known = known.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "external_ids")})
    if entity_map is not None:
        known = targets.with_entities(known, entity_map, aliases)
    rows = targets.results(edges).join(targets.interaction_lists(edges), ["target_id", "family", "antibody_id"])
    paged = targets.paged(rows.join(facts, "antibody_id"))
    return {
        "observations": observations,
        "antibodies": merged.join(lists, "antibody_id", "left").withColumns({c: F.coalesce(c, none.get(c, zero)) for c in lists.columns if c != "antibody_id"}),
        "interactions": edges,
        "literature": resolved.where(is_context),
        "targets": exports.catalogue(known),
        "pages": paged,
        "names": search.name_terms(chains),
        "searchrows": search.search_rows(merged, lists.select("antibody_id", "direct_targets", "functional_targets")),
        "sequences": search.sequence_index(chains),
        "regions": similarity.region_index(chains),
        **similar_tables(chains),
        "nucleotides": entities.nucleotide_records(observations),
        "records": entities.source_records(observations).select("antibody_id", "source", "record_id", "reference", "source_url", "record_url", "link_scope", "metadata", "record_date", "record_date_field"),
        "conflicts": entities.conflicts(observations).union(entities.conflicts(_annotation_values(observations), ("VH", "VL"))),
        "review": targets.review_candidates(edges),
        "manifest": exports.manifest(observations, resolved),
        "totals": exports.totals(observations, merged, known, edges, resolved.where(is_context)),
        "indexstats": exports.index_stats(search.name_terms(chains), chains),
        "pageindex": exports.part_sizes(paged, ("target_id", "family", "page")),
    }


def _annotation_values(observations: DataFrame) -> DataFrame:
    """Chain annotations as text columns, so that they merge and conflict like other fields."""
    of = lambda c: F.coalesce(F.try_element_at("chain_annotations", F.lit(c)), F.lit("")).alias(c)
    return observations.select("antibody_id", "source", "record_id", "source_ord", "row_ord", of("VH"), of("VL"))


def _annotations(observations: DataFrame) -> DataFrame:
    """The first annotation of each chain of an entity."""
    at = F.struct("source_ord", "row_ord")
    first = _annotation_values(observations).groupBy("antibody_id").agg(*[entities.first_filled(c, at).alias(c) for c in ("VH", "VL")])
    return first.select("antibody_id", F.map_filter(F.create_map(F.lit("VH"), F.col("VH"), F.lit("VL"), F.col("VL")), lambda k, v: v != "").alias("chain_annotations"))


def similar_tables(chains: DataFrame) -> dict[str, DataFrame]:
    """Postings and clusters alone, which may be built again from written entities."""
    postings = [similarity.capped(similarity.signatures(chains, f)).select(F.lit(f).alias("field"), "hash", "id") for f in ("heavy", "light")]
    found = []
    for fields in SCOPES:
        near = materialize(clusters.edges(chains, fields), "edges")
        scope = "_".join(fields)
        for level in clusters.LEVELS:
            members = clusters.clusters(chains, level, fields, near=near)
            cluster = F.concat_ws("_", F.lit("seq"), F.lit(scope), F.lit(str(level)), "representative_id")
            found.append(members.select(F.lit(scope).alias("scope"), F.lit(level).alias("level"), "id", "representative_id", "size", cluster.alias("cluster_id")))
    digit = F.substring(F.lpad(F.lower(F.hex("hash")), 8, "0"), 1, 1)
    return {"postings": reduce(lambda a, b: a.union(b), postings).withColumn("digit", digit), "clusters": reduce(lambda a, b: a.union(b), found)}


def rebuild_similar(snapshot: Snapshot) -> None:
    """Writes postings and clusters anew from the snapshot's entities."""
    write(similar_tables(snapshot.table("antibodies").withColumnRenamed("antibody_id", "id")), snapshot.path)


#: Indexes whose parts the snapshot tells rows and bytes of, and the buckets of the cluster look-up.
INDEXES = {"names": ("bucket",), "searchrows": ("bucket",), "sequences": ("shard",), "regions": ("field", "len"), "postings": ("field", "digit"), "clusters": ("scope", "level")}
LOOKUP_BUCKETS = 64


def write(tables: dict[str, DataFrame], out: str, stamp: str | None = None) -> None:
    """One Parquet table each; entities by shard, sequences by hash prefix, names by bucket, pages by family.

    What indexes hold by part is counted from the tables given.  ``stamp`` names
    the snapshot: by default the time in UTC and a digest of its source records.
    """
    if "observations" in tables:
        digest = tables["observations"].agg(exports.multiset_digest("source", "record_id", "heavy", "light").alias("d")).first().d
        stamp = stamp or f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ} {digest}"
    held = {k: (tables[k], v) for k, v in INDEXES.items() if k in tables}
    if len(held) == len(INDEXES):
        tables = tables | {"indexparts": exports.index_manifest(held)}
    parts = {"sequences": ["shard"], "names": ["bucket"], "searchrows": ["bucket"], "postings": ["field", "digit"], "clusters": ["scope"], "regions": ["field", "len"]}
    for name, df in tables.items():
        if name == "totals":
            df.select(F.lit(exports.SCHEMA_VERSION).alias("schema_version"), F.lit(stamp).cast("string").alias("snapshot")).write.mode("overwrite").parquet(f"{out}/version")
        # partition values have no type of their own and an empty table has no files, so the schema is kept beside
        schema = df.withColumn("shard", F.lit("")).schema if name == "antibodies" else df.schema
        df.sparkSession.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{out}/_schemas/{name}")
        if name == "antibodies":
            exports.write_entities(df, f"{out}/{name}")
        elif name == "pages":
            exports.write_pages(df, f"{out}/{name}")
        elif name in parts:
            df.repartition(*parts[name]).write.mode("overwrite").partitionBy(*parts[name]).parquet(f"{out}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        if name == "clusters":
            write_lookup(df, f"{out}/clusterlookup")


def write_lookup(clusters_: DataFrame, path: str) -> None:
    """Cluster members in buckets by id, sorted, so that look-ups join them where they are."""
    name = f"sequor_lookup_{uuid.uuid4().hex}"
    clusters_.select("id", "scope", "level", "representative_id", "size", "cluster_id").write.mode("overwrite").bucketBy(LOOKUP_BUCKETS, "id").sortBy("id").option("path", path).saveAsTable(name)
    # the table's files stay where they are
    clusters_.sparkSession.sql(f"DROP TABLE {name}")


@dataclass
class Snapshot:
    """Tables of a written snapshot; partition columns prune the scans of lookups."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        if name == "version":
            return self.spark.read.parquet(f"{self.path}/{name}")
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/_schemas/{name}").first()["value"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def stamp(self) -> str:
        """The name of the snapshot, which a rebuild changes."""
        return self.table("version").first()["snapshot"] or ""

    def _view(self, name: str) -> str:
        return "sequor_" + hashlib.sha256(f"{self.path}|{name}|{self.stamp()}".encode()).hexdigest()[:24]

    def shared(self, name: str) -> DataFrame:
        """A table that later queries of this snapshot read from Spark's cache (memory, then disk); see :meth:`release`."""
        view = self._view(name)
        if not self.spark.catalog.tableExists(view):
            self.table(name).createOrReplaceTempView(view)
            self.spark.catalog.cacheTable(view, StorageLevel.MEMORY_AND_DISK)
        return self.spark.table(view)

    def release(self, *names: str) -> None:
        """Drops shared tables, of this snapshot's stamp, from the cache."""
        for name in names:
            view = self._view(name)
            if self.spark.catalog.tableExists(view):
                self.spark.catalog.uncacheTable(view)
                self.spark.catalog.dropTempView(view)

    def cluster_lookup(self, scope: str, level: int, ids: DataFrame) -> DataFrame:
        """``(id, representative_id, size, cluster_id)`` of asked ids; an id in no cluster is alone."""
        view = self._view("clusterlookup")
        if not self.spark.catalog.tableExists(view):
            self.spark.sql(f"CREATE TABLE {view} (id STRING, scope STRING, level INT, representative_id STRING, size LONG, cluster_id STRING) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {LOOKUP_BUCKETS} BUCKETS LOCATION '{self.path}/clusterlookup'")
        held = self.spark.table(view).where((F.col("scope") == scope) & (F.col("level") == level))
        asked = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).repartition(LOOKUP_BUCKETS, "id")
        found = asked.hint("merge").join(held, "id", "left")
        return found.select("id", F.coalesce("representative_id", "id").alias("representative_id"), F.coalesce("size", F.lit(1)).alias("size"), "cluster_id")

    def resolve(self, query: str) -> str | None:
        """The one target that an id, name or alias means; an ambiguous name means none."""
        asked = self.spark.createDataFrame([(query,)], "query string")
        row = search.resolve_target(self.table("targets"), asked).first()
        return row["target_id"] if row else None

    def tree(self) -> DataFrame:
        known = self.table("targets")
        if "parent_id" not in known.columns:
            return known.select(F.col("target_id").alias("parent"), F.col("target_id").alias("id")).limit(0)
        return known.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("target_id").alias("id"))

    def target(self, query: str, families: tuple[str, ...] = ("direct",), paired: bool = False, include_descendants: bool = False) -> DataFrame:
        """Result rows of the target that a query means, of all families asked, merged by antibody."""
        found = self.resolve(query)
        rows = self.table("pages")
        if found is None:
            return rows.limit(0)
        root = self.spark.createDataFrame([(found,)], "target_id string")
        scope = root.withColumn("depth", F.lit(0))
        if include_descendants:
            scope = scope.union(targets.descendants(self.tree(), root).where(F.col("id") != found).select("id", "depth"))
        parts = [search.read_pages(rows, scope, f).withColumn("turn", F.lit(n)) for n, f in enumerate(families)]
        rows = reduce(lambda a, b: a.unionByName(b), parts).join(F.broadcast(scope), "target_id")
        # the target before those below it, families as asked, pages in order
        merged = merged_rows(rows, F.struct("depth", "target_id", "turn", "position"))
        return search.sort(merged.where("has_heavy and has_light") if paired else merged)

    def antibody(self, antibody_id: str) -> DataFrame:
        ids = self.spark.createDataFrame([(antibody_id,)], "id string")
        return search.lookup(self.table("antibodies").where(F.col("shard") == antibody_id[3:5]), ids)

    def sequence(self, heavy: str = "", light: str = "", mode: str = "exact") -> DataFrame:
        """Exact, paired or similar hits of one or two chains."""
        rows = self.table("antibodies").withColumnRenamed("antibody_id", "id")
        if mode == "exact":
            # the leading digits of a hash name the partition that holds it
            shards = [hashlib.sha256(s.encode()).hexdigest()[:2] for s in (heavy, light) if s]
            index = self.table("sequences").where(F.col("shard").isin(*shards))
            if heavy and light:
                return search.paired_sequences(index, self.spark.createDataFrame([("q", heavy, light)], "query_id string, heavy string, light string"))
            field, chain = ("heavy", heavy) if heavy else ("light", light)
            return search.exact_sequences(index, self.spark.createDataFrame([("q", chain)], "query_id string, sequence string"), field)
        hits = []
        for field, chain in (("heavy", heavy), ("light", light)):
            if chain:
                written = self.table("postings").where(F.col("field") == field).select("hash", "id")
                hits.append(similarity.similar(self.spark.createDataFrame([("q", chain)], "query_id string, sequence string"), rows, field, postings=written))
        score = similarity.pair_score(*[(F.col(c), F.col(v)) for c, v in (("identity", "coverage"), ("light_identity", "light_coverage"))][: len(hits)])
        out = hits[0] if len(hits) == 1 else hits[0].join(hits[1].select("id", F.col("identity").alias("light_identity"), F.col("coverage").alias("light_coverage")), "id")
        return similarity.ranked(out.withColumn("similarity", score))

    def payload(self, query: dict, rows: DataFrame) -> dict:
        """What a command answers: version, totals, the query and the number of rows."""
        return {"schema_version": exports.SCHEMA_VERSION, "totals": self.table("totals").first().asDict(), "query": query, "count": rows.count()}

    def check_version(self) -> None:
        """An error if the snapshot was written by another version of the schema."""
        versions = {r["schema_version"] for r in self.table("version").collect()}
        if versions != {exports.SCHEMA_VERSION}:
            raise ValueError(f"snapshot of schema {sorted(versions)}, not {exports.SCHEMA_VERSION}")

    def violations(self) -> DataFrame:
        """All rules over the written tables."""
        antibodies, claims, pages, known = (self.table(t) for t in ("antibodies", "interactions", "pages", "targets"))
        observations, literature = self.table("observations"), self.table("literature")
        rows = antibodies.withColumnRenamed("antibody_id", "id")
        declared = self.table("totals").first().asDict()
        told = {t: declared[t] for t in ("antibodies", "targets", "interactions", "literature")}
        measured = claims.select("interaction_id", "assay_ids", F.explode("measurements").alias("m")).select("interaction_id", "assay_ids", "m.*")
        postings, regions = self.table("postings"), self.table("regions").withColumn("id", F.explode("ids"))
        members = self.table("clusters")
        parts = [
            validate.counts_agree(told, {"antibodies": antibodies, "targets": known, "interactions": claims, "literature": literature}),
            validate.entities(antibodies),
            validate.nucleotides(self.table("nucleotides"), self.table("records")),
            validate.contexts(observations, claims),
            validate.pages(pages, claims, antibodies),
            validate.measurements(measured),
            validate.hierarchy(self.tree(), known.select(F.col("target_id").alias("id"))),
            validate.names(search.exact_index(self.table("names")), search.name_terms(rows)),
            *[validate.sequences(self.table("sequences"), rows, f) for f in ("heavy", "light")],
            validate.normal_chains(rows, "heavy"),
            *[validate.regions(regions.where(F.col("field") == f), rows, f) for f in ("cdrh3", "cdrl3")],
            *[validate.postings(postings.where(F.col("field") == f), rows, f) for f in ("heavy", "light")],
            *[validate.cluster_members(members.where((F.col("scope") == "_".join(s)) & (F.col("level") == v))) for s in SCOPES for v in clusters.LEVELS],
            validate.not_empty({"antibodies": antibodies, "interactions": claims}),
            validate.linked_assays(claims, "iedb"),
        ]
        if "children" in known.columns:
            parts.append(validate.children(known))
        return reduce(lambda a, b: a.union(b), parts)


_SETS = ("relationships", "evidence", "sources")
_PLACES = ("antibody_id", "rank_score", "n_interactions", "position", "page", "target_id", "family", "depth", "turn")


def merged_rows(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each antibody of several pages: sets united, the first row's facts, the best score.

    Of interactions that share an id the last in ``order`` is kept, by default
    the order of targets, families and positions.
    """
    order = F.struct("target_id", "family", "position") if order is None else order
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in _SETS]
    own = [c for c in rows.columns if c not in (*_SETS, *_PLACES, "interactions")]
    out = rows.withColumn("_o", order).groupBy("antibody_id").agg(*[F.min_by(c, "_o").alias(c) for c in own], *union, F.max("rank_score").alias("rank_score"))
    held = search.merge_interactions(rows, "antibody_id", order)
    out = out.join(held, "antibody_id", "left").withColumn("interactions", F.coalesce("interactions", F.array().cast(rows.schema["interactions"].dataType)))
    return out.withColumn("n_interactions", F.size("interactions"))
