"""Queries of source adapters, snapshot tables, searches, views and exports over the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequor.operators import exports, screening, search, similarity, targets
from sequor.operators.storage import materialize, temporary
from sequor.plans import views as V
from sequor.plans.catalog import query
from sequor.sources import adapters


def _list(c: str) -> F:
    return F.array_join(c, "|").alias(c)


def _csv(rows: DataFrame, label: str) -> str:
    """The rows as CSV files in the shared folder, as sources deliver them."""
    return temporary(rows.sparkSession, label, lambda p: rows.write.option("header", True).option("escape", '"').csv(p))


_PART = "SELECT p_partkey, p_name, p_brand, p_size, p_partkey % 7 AS m FROM part"


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, trim(t) AS target_raw, 'mentioned_with' AS relationship, 'LITERATURE_METADATA' AS evidence,
 CASE WHEN p_partkey % 2 = 0 THEN 'paired antibody' ELSE 'antibody' END AS format, 'T, "' || p_brand || '"' AS reference, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2024' END AS update_date
 FROM (SELECT p_partkey, p_brand, unnest([p_name, p_brand]) AS t FROM part WHERE p_partkey % 7 <> 0) x""")
def adapter_literature(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(
        k.alias("ID"), F.lit("acd").alias("heavy_sequence"), F.when(k % 2 == 0, "efg").otherwise("nan").alias("light_sequence"), F.when(k % 7 == 0, "n/a").otherwise(F.concat("p_name", F.lit(" ; "), "p_brand", F.lit(";ND"))).alias("targets_mentioned"),
        F.concat(F.lit('T, "'), "p_brand", F.lit('"')).alias("reference_title"), F.when(k % 3 == 0, "-").otherwise("2024").alias("update_date"),
    )
    obs, claims = adapters.literature(spark, _csv(rows, "literature"))
    details = obs.select(F.col("record_id").alias("source_record_id"), "format", F.coalesce(F.try_element_at("metadata", F.lit("update_date")), F.lit("")).alias("update_date"))
    return claims.join(details, "source_record_id").select("source_record_id", "target_raw", "relationship", "evidence", "format", "reference", "update_date")


@query(f"""WITH p AS ({_PART}), arms AS (SELECT *, unnest(CASE WHEN m IN (1, 2, 3) THEN [1, 2] WHEN m = 4 THEN [1] ELSE [0] END) AS arm FROM p)
 SELECT 'th' || p_partkey AS record_id, 'th' || p_partkey || CASE WHEN arm = 2 THEN ' [arm_2]' ELSE '' END AS name, CASE WHEN arm = 2 THEN 'QQQ' WHEN m = 4 THEN '' WHEN m = 6 THEN '' ELSE 'ACD' END AS heavy,
  CASE WHEN arm = 0 THEN 'Active; Phase-I' ELSE '' END AS therapeutic_status, CASE WHEN arm = 0 THEN '1ABC' ELSE '' END AS structures, CASE WHEN m = 6 THEN 'heavy' ELSE '' END AS quarantined,
  CASE WHEN arm = 0 THEN 'construct_level' WHEN m = 1 THEN 'arm_mapped_explicit_source_field' ELSE 'unavailable_no_arm_mapping' END AS state,
  CASE WHEN m = 6 THEN '' WHEN arm = 0 THEN p_name WHEN m = 1 AND arm = 1 THEN 'A' WHEN m = 1 THEN 'B' ELSE '' END AS targets, 'https://x/th' || p_partkey AS record_url FROM arms""")
def adapter_therapeutic(spark: SparkSession, d: str) -> DataFrame:
    """Sevenths: mapped arms (1), unmapped (2), half mapped (3), no usable arm (4), a bad chain (6), else whole constructs."""
    m, text = F.col("p_partkey") % 7, lambda c, x: F.when(c, x).otherwise("")
    rows = V.table(spark, d, "part").select(
        F.concat(F.lit("th"), "p_partkey").alias("Therapeutic"), F.when(m.isin(4, 6), "AC-D").otherwise("ACD").alias("HeavySequence"), F.lit("EFG").alias("LightSequence"), text(m.isin(1, 2, 3), "QQQ").alias("HeavySequence(ifbispec)"), text(m.isin(1, 2, 3), "RRR").alias("LightSequence(ifbispec)"),
        F.when(m == 4, "Bispecific").otherwise("Whole mAb").alias("Format"), F.when(m == 4, "A").otherwise(F.col("p_name")).alias("Target"), text(m.isin(1, 3), "A").alias("Target (primary)"), text(m == 1, "B").alias("Target (ifbispec)"),
        F.lit("Active").alias("Est. Status"), F.lit("Phase-I").alias("Highest_Clin_Trial (Feb '25)"), F.lit("1abc").alias("100% SI Structure"),
    )
    obs, claims = adapters.therapeutic(spark, _csv(rows, "therapeutic"), summary_url="https://x/")
    told = claims.groupBy("antibody_id", F.col("source_record_id").alias("record_id")).agg(F.array_join(F.array_sort(F.collect_set("target_raw")), "|").alias("targets"))
    state = F.try_element_at("metadata", F.lit("target_assignment_status"))
    out = obs.join(told, ["antibody_id", "record_id"], "left")
    return out.select("record_id", "name", "heavy", "therapeutic_status", _list("structures"), F.array_join(F.map_keys("quarantine"), "|").alias("quarantined"), state.alias("state"), F.coalesce("targets", F.lit("")).alias("targets"), "record_url")


@query("""SELECT 'n' || p_partkey AS source_record_id, relationship, target_raw, note, epitope FROM (
 SELECT p_partkey, e AS epitope, unnest(['binds', 'binds', 'binds', 'does_not_bind', 'neutralizes']) AS relationship, unnest(['SARS-CoV-2', CASE WHEN e = 'RBD' THEN 'SARS-CoV-2 RBD' END, CASE WHEN e <> '' THEN 'SARS-CoV-2 Spike' END, 'MERS CoV', 'SARS-CoV-2']) AS target_raw,
  unnest(['SARS-CoV-2 (weak)', 'SARS-CoV-2 (weak)', 'SARS-CoV-2 (weak)', '', '']) AS note
 FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'RBD' WHEN 1 THEN 'Spike; non-RBD' ELSE '' END AS e FROM part) p) x WHERE target_raw IS NOT NULL""")
def adapter_coronavirus(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(
        F.concat(F.lit("n"), k).alias("Name"), F.lit("SARS-CoV-2 (weak)").alias("Binds to"), F.lit("MERS_CoV").alias("Doesn't Bind to"), F.lit("SARS-CoV-2").alias("Neutralising Vs"), F.lit("ACD").alias("VHorVHH"), F.lit("EFG").alias("VL"),
        F.when(k % 3 == 0, "RBD").when(k % 3 == 1, "Spike; non-RBD").otherwise("ND").alias("Protein + Epitope"),
    )
    return adapters.coronavirus(spark, _csv(rows, "coronavirus"))[1].select("source_record_id", "relationship", "target_raw", "note", "epitope")


@query("""SELECT 'n' || p_partkey AS source_record_id, relationship, target_raw, note FROM (SELECT p_partkey, unnest(['binds', 'binds', 'neutralizes', 'does_not_protect']) AS relationship,
 unnest(['Vaccinia virus WR L1', 'Cowpox virus', 'Mpox virus', 'Variola virus x']) AS target_raw, unnest(['VACV_WR_L1', 'CPXV', 'MPXV', 'VARV_x']) AS note FROM part WHERE p_partkey % 5 <> 0) x""")
def adapter_orthopox(spark: SparkSession, d: str) -> DataFrame:
    head = {r: f for f, r in adapters._POX_RELATIONS.items()}
    rows = V.table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, "unknown").otherwise(F.concat(F.lit("n"), "p_partkey")).alias("Name"), F.lit("VACV_WR_L1; CPXV").alias(head["binds"]), F.lit("MPXV").alias(head["neutralizes"]), F.lit("VARV_x").alias(head["does_not_protect"]), F.lit("ACD").alias("VH or VHH"), F.lit("EFG").alias("VL")
    )
    return adapters.orthopox(spark, _csv(rows, "orthopox"))[1].select("source_record_id", "relationship", "target_raw", "note")


@query("""WITH g AS (SELECT p_partkey AS g, p_partkey % 4 AS m FROM part), a AS (SELECT g, m, unnest([0, 1, 2, 3]) AS k FROM g WHERE g % 2 = 0)
 SELECT CAST(g AS VARCHAR) AS source_record_id, CASE k WHEN 0 THEN 'binds' WHEN 1 THEN 'does_not_neutralize' WHEN 2 THEN 'does_not_bind' END AS relationship, CASE WHEN k = 0 THEN 'Spike' ELSE 'Nucleo' END AS target_raw,
  CASE WHEN k = 0 THEN 'MEASURED' ELSE 'CURATED' END AS evidence, CASE WHEN k = 0 THEN 'KD<' || g || '.5 nM' ELSE '' END AS measured, CAST(g * 10 + k AS VARCHAR) AS assay FROM a WHERE k < 3""")
def adapter_receptors(spark: SparkSession, d: str) -> DataFrame:
    """Every second group has four assays: measured binding, failed neutralisation, negative ELISA, and one without a claim."""
    part = V.table(spark, d, "part")
    g = F.col("p_partkey")
    rows = part.select(g.alias("receptor_group_id"), F.lit("BCR").alias("receptor__type"), F.lit("e").alias("epitope__name"), F.lit("heavy").alias("chain_1__type"), F.lit("kappa").alias("chain_2__type"), F.lit("ACD").alias("chain_1__v_domain_calculated"))
    half = part.where(g % 2 == 0).select(g, F.explode(F.array(*map(F.lit, range(4)))).alias("k")).withColumn("id", g * 10 + F.col("k"))
    links = half.groupBy(g.alias("receptor_group_id")).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","), F.lit("}")).alias("iedb_assay_ids"))
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("k") + 1)
    assays = half.select(
        F.col("id").alias("assay_id"), pick("SPR", "plaque reduction", "ELISA", "ELISPOT").alias("assay__method"), pick("dissociation constant KD", "neutralization", "qualitative", "secretion").alias("assay__response_measured"),
        pick("Positive", "Negative", "Negative", "Positive").alias("assay__qualitative_measure"), F.when(F.col("k") == 0, F.concat(g, F.lit(".5"))).otherwise("").alias("assay__quantitative_measurement"), pick("<", "", "", "").alias("assay__measurement_inequality"), pick("nM", "", "", "").alias("assay__units"),
        pick("Spike", "", "", "").alias("epitope__molecule_parent"), pick("iri:s", "", "", "").alias("epitope__molecule_parent_iri"), F.lit("Nucleo").alias("epitope__source_molecule"), F.lit("iri:n").alias("epitope__source_molecule_iri"),
    )
    claims = adapters.receptors(spark, _csv(rows, "receptors"), links_path=_csv(links, "links"), assays_path=_csv(assays, "assays"))[1]
    told = F.array_join(F.transform("measurements", lambda m: F.concat(m["metric"], m["qualifier"], m["raw_value"], F.lit(" "), m["unit"])), "|")
    return claims.select("source_record_id", "relationship", "target_raw", "evidence", told.alias("measured"), F.array_join("assay_ids", "|").alias("assay"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_partkey % 3 = 0 THEN 'CAL' || p_partkey WHEN p_partkey % 3 = 1 THEN 'CUR' || p_partkey ELSE '' END AS chosen, CASE WHEN p_partkey % 3 <> 2 THEN 'CUR' || p_partkey ELSE '' END AS curated,
 CASE WHEN p_partkey % 3 = 0 THEN 'IEDB calculated' ELSE 'IEDB curated' END AS origin, 'full_length_bcr' AS scope FROM part""")
def chain_annotations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(k.alias("receptor_group_id"), F.lit("BCR").alias("receptor__type"), F.lit("e").alias("epitope__name"), F.lit("heavy").alias("chain_1__type"), F.lit("").alias("chain_2__type"), F.when(k % 3 == 0, F.concat(F.lit("CAL"), k)).otherwise("").alias("chain_1__calculated_v_gene"), F.when(k % 3 == 0, "GFT").otherwise("").alias("chain_1__cdr1_calculated"), F.when(k % 3 != 2, F.concat(F.lit("CUR"), k)).otherwise("").alias("chain_1__curated_v_gene"))
    obs = adapters.receptors(spark, _csv(rows, "receptors"))[0]
    get = lambda p: F.get_json_object(F.element_at("chain_annotations", "VH"), p)
    return obs.select("record_id", get("$.genes.V.chosen").alias("chosen"), get("$.genes.V.curated").alias("curated"), get("$.annotation_origin").alias("origin"), F.col("nucleotide_scope").alias("scope"))


# --- targets

# A small curated dictionary over part names and its entity map.
ALIASES = {"ring family": ["small ring", "red ring", "Big-Ring"], "widget family": ["red widget", "blue widget"], "bolt family": ["blue bolt"]}
ENTITIES = {"ring family": {"kind": "family", "identifiers": {"uniprot": "P1"}}, "widget family": {"parent": "Big Ring", "relation": "part_of"}, "green gear": {"parent": "widget family"}, "bolt family": {"parent": "no such thing"}}


def _part_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of suppliers on named parts; they are joined once, as every later step reads them again."""
    li, part = V.table(spark, d, "lineitem"), V.table(spark, d, "part")
    relation = F.when(F.col("l_returnflag") == "R", "does_not_bind").when(F.col("l_returnflag") == "A", "neutralizes").otherwise("binds")
    c = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("antibody_id"), F.when(F.col("l_linenumber") == 1, "therasabdab").otherwise("covabdab").alias("source"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("zz/"), "p_name")).otherwise(F.col("p_name")).alias("target_raw"),
        relation.alias("relationship"), F.when(F.col("l_linenumber") == 2, "MEASURED").otherwise("CURATED").alias("evidence"), F.when(F.col("l_linenumber") == 3, F.col("p_brand")).otherwise("").alias("target_external_id"),
    )
    return targets.dispatch(materialize(c, "claims"), targets.alias_table(spark, ALIASES)).withColumn("target_name", F.col("canonical"))


_KEYS = ", ".join(f"('{''.join(c for c in a.upper() if c.isalnum())}', '{g}')" for g, names in ALIASES.items() for a in (g, *names))
_LISTED = ", ".join(f"('{g}', '{a}')" for g, names in ALIASES.items() for a in (g, *names))
_CLAIMS = f"""aliases(k, canonical) AS (VALUES {_KEYS}), listed(canonical, alias) AS (VALUES {_LISTED}),
 raw AS (SELECT l_suppkey AS antibody_id, CASE WHEN l_linenumber = 1 THEN 'zz/' || p_name ELSE p_name END AS target_raw, p_name, l_linenumber, l_returnflag, p_brand, CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'functional' ELSE 'direct' END AS family,
  CASE WHEN l_linenumber = 1 THEN 'therasabdab' ELSE 'covabdab' END AS source, CASE WHEN l_linenumber = 2 THEN 'MEASURED' ELSE 'CURATED' END AS evidence, CASE l_returnflag WHEN 'R' THEN 'does_not_bind' WHEN 'A' THEN 'neutralizes' ELSE 'binds' END AS relationship FROM lineitem JOIN part ON l_partkey = p_partkey),
 claims AS (SELECT raw.*, a.canonical IS NOT NULL AS curated, CASE WHEN a.canonical IS NOT NULL THEN a.canonical WHEN l_linenumber = 1 THEN 'zz' ELSE p_name END AS canonical FROM raw LEFT JOIN aliases a ON k = regexp_replace(upper(p_name), '[^A-Z0-9]+', '', 'g')),
 ids AS (SELECT *, 'target:' || regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g') || CASE WHEN curated THEN '' ELSE '-' || substr(sha256(lower(canonical)), 1, 12) END AS target_id FROM claims)"""


@query(f"WITH {_CLAIMS} SELECT target_id, canonical, count(*) AS n FROM ids GROUP BY ALL")
def resolver_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _part_claims(spark, d).groupBy("target_id", "canonical").agg(F.count("*").alias("n"))


@query(f"""WITH {_CLAIMS}, e AS (SELECT DISTINCT target_id, target_raw AS alias FROM ids UNION SELECT target_id, canonical FROM ids UNION SELECT target_id, alias FROM ids JOIN listed USING (canonical)),
 x AS (SELECT target_id, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS external_ids FROM ids WHERE l_linenumber = 3 GROUP BY 1)
 SELECT target_id, string_agg(alias, '|' ORDER BY lower(alias), alias) AS aliases, coalesce(any_value(external_ids), '') AS external_ids FROM e LEFT JOIN x USING (target_id) GROUP BY target_id""")
def target_names(spark: SparkSession, d: str) -> DataFrame:
    out = targets.names_of(_part_claims(spark, d), targets.alias_table(spark, ALIASES))
    return out.select("target_id", _list("aliases"), _list("external_ids"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Targets with names, counts and hierarchy."""
    claims, aliases = _part_claims(spark, d), targets.alias_table(spark, ALIASES)
    out = targets.rollup(claims).join(targets.names_of(claims, aliases), "target_id")
    return targets.with_entities(out, targets.entity_table(spark, ENTITIES), aliases)


@query(f"""WITH {_CLAIMS}, t AS (SELECT DISTINCT target_id, canonical AS name FROM ids), up(name, parent) AS (VALUES ('widget family', 'ring family'), ('green gear', 'widget family')),
 j AS (SELECT t.target_id, t.name, p.target_id AS parent_id FROM t LEFT JOIN up USING (name) LEFT JOIN t p ON p.name = up.parent)
 SELECT target_id, coalesce(parent_id, '') AS parent_id, CASE WHEN parent_id IS NULL THEN '' WHEN name = 'widget family' THEN 'part_of' ELSE 'related_to' END AS relation, CASE WHEN name = 'ring family' THEN 'family' ELSE '' END AS kind,
  coalesce((SELECT string_agg(c.target_id, '|' ORDER BY c.target_id) FROM j c WHERE c.parent_id = j.target_id), '') AS children FROM j""")
def target_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("target_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), F.coalesce("relation", F.lit("")).alias("relation"), F.coalesce("kind", F.lit("")).alias("kind"), _list("children"))


TYPED = ("target:ring-family", "Big ring", "small-ring", "RED WIDGET", "Brand#12", "blue", "zz", "nothing", "green gear")
_TYPED = "typed(query) AS (VALUES " + ", ".join(f"('{q}')" for q in TYPED) + ")"


def _typed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q,) for q in TYPED], "query string")


_NAMED = f"""{_CLAIMS}, {_TYPED}, e AS (SELECT target_id, target_raw AS alias FROM ids UNION SELECT target_id, canonical FROM ids UNION SELECT target_id, alias FROM ids JOIN listed USING (canonical))"""


@query(f"""WITH {_NAMED}, by_id AS (SELECT DISTINCT query, target_id FROM typed JOIN ids ON query = target_id),
 k AS (SELECT query, min(target_id) AS target_id FROM typed JOIN e ON regexp_replace(upper(alias), '[^A-Z0-9]+', '', 'g') = regexp_replace(upper(query), '[^A-Z0-9]+', '', 'g') WHERE query NOT IN (SELECT query FROM by_id) GROUP BY query HAVING count(DISTINCT target_id) = 1)
 SELECT * FROM by_id UNION ALL SELECT * FROM k""")
def target_resolve(spark: SparkSession, d: str) -> DataFrame:
    return search.resolve_target(_known(spark, d), _typed(spark), False)


_TERM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_NAMED}, every AS (SELECT target_id, alias AS raw FROM e UNION SELECT target_id, target_id FROM ids UNION SELECT target_id, p_brand FROM ids WHERE l_linenumber = 3)
 SELECT DISTINCT query, target_id FROM typed JOIN every ON {_TERM.format('raw')} = {_TERM.format('query')}""")
def target_exact(spark: SparkSession, d: str) -> DataFrame:
    return search.exact_targets(_known(spark, d), _typed(spark), False)


@query(f"""WITH {_NAMED}, every AS (SELECT target_id, alias AS raw FROM e UNION SELECT target_id, target_id FROM ids UNION SELECT target_id, p_brand FROM ids WHERE l_linenumber = 3),
 t AS (SELECT query, count(DISTINCT target_id) AS n FROM typed JOIN every ON {_TERM.format('raw')} = {_TERM.format('query')} GROUP BY query), a AS (SELECT query, count(DISTINCT p_partkey) AS m FROM typed JOIN part ON {_TERM.format('p_brand')} = {_TERM.format('query')} GROUP BY query)
 SELECT query, CASE WHEN coalesce(n, 0) + coalesce(m, 0) = 0 THEN 'none' WHEN coalesce(n, 0) + coalesce(m, 0) > 1 THEN 'multiple' WHEN n = 1 THEN 'target' ELSE 'antibody' END AS kind, coalesce(n, 0) AS n_targets, coalesce(m, 0) AS n_antibodies FROM typed LEFT JOIN t USING (query) LEFT JOIN a USING (query)""")
def exact_resolution(spark: SparkSession, d: str) -> DataFrame:
    terms = search.name_terms(V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), unicode_=False)
    out = search.resolution(_known(spark, d), terms, _typed(spark), False)
    return out.select("query", "kind", F.size("target_ids").cast("long").alias("n_targets"), F.size("antibody_ids").cast("long").alias("n_antibodies"))


@query(f"""WITH {_NAMED}, s AS (SELECT target_id, CASE WHEN v = 'red rin' THEN 10000 WHEN starts_with(v, 'red rin') THEN 8000 WHEN contains(v, 'red rin') THEN 5000 WHEN length(v) >= 4 AND levenshtein(v, 'red rin') <= 2 THEN 3200 - levenshtein(v, 'red rin') * 450 ELSE 0 END AS score
  FROM (SELECT target_id, {_TERM.format('alias')} AS v FROM e) t), n AS (SELECT target_id, any_value(canonical) AS name, count(*) AS n FROM ids GROUP BY 1)
 SELECT target_id, name, max(score) + least(any_value(n), 999) AS score FROM s JOIN n USING (target_id) GROUP BY target_id, name HAVING max(score) > 0 ORDER BY 3 DESC, 2, 1 LIMIT 8""")
def target_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    return search.suggest_targets(_known(spark, d), "red rin", 8)


def _pages(spark: SparkSession, d: str, ids: DataFrame | None = None) -> DataFrame:
    """Pages of all targets, or of those asked."""
    supp = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("antibody_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("has_heavy"), (F.col("s_suppkey") % 3 > 0).alias("has_light"), F.lit("").alias("therapeutic_status"), (F.col("s_suppkey") % 5 == 0).alias("structure_exact"))
    claims = _part_claims(spark, d) if ids is None else targets.of_targets(_part_claims(spark, d), ids)
    claims = claims.withColumn("interaction_id", targets.interaction_id("antibody_id", "target_id", "relationship", "evidence"))
    rows = targets.results(claims).join(targets.interaction_lists(claims.drop("target_raw")), ["target_id", "family", "antibody_id"])
    return targets.paged(rows.join(supp, "antibody_id"))


_PAGES = f"""{_CLAIMS}, res AS (SELECT target_id, family, antibody_id, list(DISTINCT source) AS sources, list(DISTINCT evidence) AS evidence, CAST(max(CASE evidence WHEN 'MEASURED' THEN 500 ELSE 400 END) + count(DISTINCT source) * 10 AS BIGINT) AS rank_score, count(DISTINCT (relationship, evidence, source)) AS n_listed FROM ids GROUP BY ALL)"""


@query(f"""WITH {_PAGES} SELECT target_id, family, antibody_id, n_listed, 'ix_' || substr(sha256(antibody_id || chr(31) || target_id || chr(31) || CASE family WHEN 'direct' THEN 'binds' WHEN 'functional' THEN 'neutralizes' ELSE 'does_not_bind' END || chr(31) || 'CURATED'), 1, 20) AS curated_id,
 list_contains(evidence, 'CURATED') AS listed FROM res""")
def result_interactions(spark: SparkSession, d: str) -> DataFrame:
    relation = F.when(F.col("family") == "direct", "binds").when(F.col("family") == "functional", "neutralizes").otherwise("does_not_bind")
    own = targets.interaction_id("antibody_id", "target_id", relation, F.lit("CURATED"))
    return _pages(spark, d).select("target_id", "family", "antibody_id", F.size("interactions").cast("long").alias("n_listed"), own.alias("curated_id"), F.exists("interactions", lambda i: i["interaction_id"] == own).alias("listed"))


@query(f"""WITH {_PAGES}, scope AS (SELECT DISTINCT target_id FROM ids WHERE canonical IN ('ring family', 'widget family', 'green gear')),
 r AS (SELECT antibody_id, max(rank_score) AS rank_score, count(*) AS n_rows, array_to_string(list_sort(list_distinct(flatten(list(sources)))), '|') AS sources FROM res JOIN scope USING (target_id) WHERE family = 'direct' GROUP BY 1)
 SELECT antibody_id, rank_score, sources FROM r JOIN supplier ON s_suppkey = antibody_id WHERE s_acctbal > 0 AND s_suppkey % 3 > 0""")
def target_view(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    tree = known.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("target_id").alias("id"))
    out = search.target_view(_pages(spark, d), tree, "target:ring-family", "direct", include_descendants=True, paired=True)
    return out.select("antibody_id", "rank_score", _list("sources"))


@query(f"""WITH {_PAGES}, p AS (SELECT res.*, row_number() OVER (PARTITION BY target_id, family ORDER BY rank_score DESC, lower(s_name), antibody_id) AS position FROM res JOIN supplier ON antibody_id = s_suppkey)
 SELECT antibody_id, position FROM p WHERE target_id = 'target:ring-family' AND family = 'functional' AND position <= 100""")
def page_read(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([("target:ring-family",)], "id string")
    return search.read_pages(_pages(spark, d, ids), ids, "functional", 1).select("antibody_id", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_PAGES} SELECT antibody_id, max(rank_score) AS rank_score, count(*) AS n_rows FROM res WHERE target_id = 'target:ring-family' AND family IN ('direct', 'negative') GROUP BY 1""")
def target_families(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([("target:ring-family",)], "id string")
    pages = _pages(spark, d, ids)
    both = search.read_pages(pages, ids, "direct").unionByName(search.read_pages(pages, ids, "negative"))
    return both.groupBy("antibody_id").agg(F.max("rank_score").alias("rank_score"), F.count("*").alias("n_rows"))


@query("""SELECT 't' || n_nationkey AS target_id, CASE WHEN n_nationkey % 3 = 0 THEN 'direct' ELSE 'negative' END AS family FROM nation""")
def page_family(spark: SparkSession, d: str) -> DataFrame:
    counts = V.table(spark, d, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("target_id"), F.lit(1).alias("direct_pages"), F.lit(None).cast("int").alias("functional_pages"), F.when(F.col("n_nationkey") % 3 > 0, 2).alias("negative_pages"))
    return search.page_family("negative", counts)


@query(f"""WITH {_PAGES}, n AS (SELECT target_id, count(*) AS result_count, len(list_distinct(flatten(list(sources)))) AS s FROM res GROUP BY 1), r AS (SELECT 'count' AS mode, target_id, row_number() OVER (ORDER BY result_count DESC, target_id) AS position FROM n
 UNION ALL SELECT 'sources', target_id, row_number() OVER (ORDER BY s DESC, result_count DESC, target_id) FROM n UNION ALL SELECT 'name', target_id, row_number() OVER (ORDER BY target_id) FROM n) SELECT * FROM r WHERE position <= 60""")
def browse_sorts(spark: SparkSession, d: str) -> DataFrame:
    n = _pages(spark, d).groupBy("target_id").agg(F.count("*").alias("result_count"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources")).withColumn("name", F.col("target_id"))
    parts = []
    for mode, order in search.BROWSE.items():
        shown = search.browse(n, mode, 60)
        parts.append(shown.select(F.lit(mode).alias("mode"), "target_id", F.row_number().over(Window.orderBy(*order())).cast("long").alias("position")))
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH {V.CLAIMS}, {V.RESULTS}, {V.ANTIBODIES}, r AS (SELECT *, row_number() OVER (ORDER BY lower(name), antibody_id, target_id, family) AS n FROM results JOIN antibodies USING (antibody_id) WHERE target_id = 't7' AND family = 'direct') SELECT antibody_id, n FROM r WHERE n BETWEEN 3 AND 12""")
def view_window(spark: SparkSession, d: str) -> DataFrame:
    rows = targets.results(V.claims(spark, d)).where("target_id = 't7' and family = 'direct'").join(V.antibodies(spark, d), "antibody_id")
    page = search.window(rows, "name", 2, 10)
    return page.select("antibody_id", (F.row_number().over(Window.orderBy(F.lower("name"), "antibody_id")) + 2).cast("long").alias("n"))


@query(f"""WITH {V.CLAIMS}, {V.RESULTS}, {V.ANTIBODIES} SELECT count(*) AS results, count(*) FILTER (has_heavy AND has_light) AS paired, count(*) FILTER (structure_exact) AS structure_exact, count(*) FILTER (therapeutic_status <> '') AS therapeutic FROM results JOIN antibodies USING (antibody_id)""")
def result_metrics(spark: SparkSession, d: str) -> DataFrame:
    return search.metrics(targets.results(V.claims(spark, d)).join(V.antibodies(spark, d), "antibody_id"))


@query("""SELECT count(*) FILTER (n_nationkey % 4 > 0) AS ok, count(*) AS expected, false AS complete, 'no_match_in_incomplete_snapshot' AS told FROM nation""")
def snapshot_completeness(spark: SparkSession, d: str) -> DataFrame:
    out = search.completeness(V.table(spark, d, "nation").select(F.col("n_name").alias("source"), (F.col("n_nationkey") % 4 > 0).alias("ok")))
    return out.withColumn("told", search.no_match(F.lit(0), F.col("complete")))


@query("""SELECT DISTINCT id, raw FROM (SELECT p_partkey AS id, unnest([p_name, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END]) AS raw FROM part) t WHERE raw <> ''""")
def term_stream(spark: SparkSession, d: str) -> DataFrame:
    names = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("").alias("external_id"))
    return search.entity_terms(names)


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN 'no such' ELSE p_name END AS shown FROM part""")
def matched_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    asked = F.when(k == 0, F.upper("p_name")).when(k == 1, F.replace("p_brand", F.lit("#"), F.lit(" "))).when(k == 2, "no such").otherwise("")
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), search.matched_name("p_name", F.array("p_brand"), asked).alias("shown"))


@query(f"""WITH {V.CLAIMS}, n AS (SELECT antibody_id, list_sort(list(DISTINCT target_name) FILTER (family = 'direct')) AS a, list_sort(list(DISTINCT target_name) FILTER (family = 'functional')) AS b, list_sort(list(DISTINCT target_name) FILTER (family = 'negative')) AS c, list_sort(list(DISTINCT target_name) FILTER (family = 'literature')) AS e FROM family GROUP BY 1)
 SELECT antibody_id, coalesce(array_to_string(a, '|'), '') AS direct_names, coalesce(array_to_string(b, '|'), '') AS functional_names, coalesce(array_to_string(c, '|'), '') AS negative_names, coalesce(array_to_string(e, '|'), '') AS literature_names FROM n""")
def evidence_names(spark: SparkSession, d: str) -> DataFrame:
    return targets.evidence_lists(V.claims(spark, d)).select("antibody_id", *map(_list, ("direct_names", "functional_names", "negative_names", "literature_names")))


@query("""SELECT DISTINCT id, bucket, aliases, paired FROM (SELECT p_partkey AS id, rpad(substr(regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'), 1, 2), 2, '_') AS bucket, p_brand AS aliases, p_partkey % 2 = 0 AS paired FROM (SELECT p_partkey, p_brand, unnest([p_name, p_brand]) AS x FROM part) t) u""")
def name_search_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("antibody_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.array(F.lit("s")).alias("sources"), F.lit("ACD").alias("heavy"), F.when(F.col("p_partkey") % 2 == 0, "EFG").otherwise("").alias("light"))
    lists = rows.select("antibody_id", F.array(F.lit("t")).alias("direct_targets"), F.array().cast("array<string>").alias("functional_targets"))
    return search.search_rows(rows, lists).select(F.col("antibody_id").alias("id"), "bucket", _list("aliases"), "paired")


@query("""WITH t AS (SELECT DISTINCT p_partkey AS id, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS term FROM (SELECT p_partkey, unnest([p_name, p_brand]) AS x FROM part) u), n AS (SELECT term, count(*) AS n FROM t GROUP BY 1)
 SELECT count(*) AS terms, CAST(sum(n) AS BIGINT) AS postings, count(*) FILTER (n > 1) AS multi_entity_terms, (SELECT count(*) FROM part) AS aliases, (SELECT CAST(sum(length('{"term":"' || term || '","id":' || id || '}') + 1) AS BIGINT) FROM t) AS bytes FROM n""")
def name_index_stats(spark: SparkSession, d: str) -> DataFrame:
    names = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return exports.index_stats(search.name_terms(names, unicode_=False), names)


@query(f"""WITH {V.CHAINS}, e AS (SELECT id, unnest(['heavy', 'light']) AS field, unnest([heavy, light]) AS s FROM chains) SELECT field, CAST(length(s) AS INTEGER) AS len, s AS sequence, count(DISTINCT id) AS n, min(id) AS first_id FROM e WHERE s <> '' GROUP BY ALL""")
def region_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return similarity.region_index(V.chains(spark, d), ("heavy", "light")).select("field", "len", "sequence", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"))


@query("""SELECT count(DISTINCT (l_returnflag, l_orderkey)) AS records, count(DISTINCT (l_returnflag, l_orderkey)) FILTER (l_linenumber = 1) AS quarantined, count(DISTINCT (l_returnflag, l_orderkey)) FILTER (l_linenumber = 2) AS multispecific, count(*) FILTER (l_linenumber = 3) AS unassigned_arms,
 (SELECT count(*) FROM supplier) AS antibodies, (SELECT count(*) FROM part) AS targets, (SELECT count(*) FROM orders) AS interactions, (SELECT count(*) FROM nation) AS literature FROM lineitem""")
def snapshot_totals(spark: SparkSession, d: str) -> DataFrame:
    n, text = F.col("l_linenumber"), lambda c, x: F.when(c, x).otherwise("")
    none = F.create_map().cast("map<string,string>")
    obs = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("record_id"), F.when(n == 1, F.create_map(F.lit("heavy"), F.lit("x"))).otherwise(none).alias("quarantine"), F.create_map(F.lit("multispecific"), text(n == 2, "true"), F.lit("target_assignment_status"), text(n == 3, "unavailable_no_arm_mapping")).alias("metadata"))
    return exports.totals(obs, *(V.table(spark, d, t) for t in ("supplier", "part", "orders", "nation")))


@query("""SELECT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 2) AS shard, count(*) AS n FROM customer GROUP BY 1""")
def entity_shards(spark: SparkSession, d: str) -> DataFrame:
    """Entities as written: one partition for each two digits of the id."""
    rows = V.table(spark, d, "customer").select(F.concat(F.lit("ab_"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 20)).alias("antibody_id"), F.col("c_name").alias("name"))
    path = temporary(spark, "entities", lambda p: exports.write_entities(rows, p))
    return spark.read.schema("antibody_id string, name string, shard string").parquet(path).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"""WITH {_PAGES} SELECT family, count(*) AS n, count(DISTINCT target_id) AS n_targets FROM res GROUP BY 1""")
def page_folders(spark: SparkSession, d: str) -> DataFrame:
    """Result pages as written: one partition for each family."""
    path = temporary(spark, "pages", lambda p: exports.write_pages(_pages(spark, d), p))
    return spark.read.parquet(path).groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("n_targets"))


@query(f"""WITH {_CLAIMS}, t AS (SELECT DISTINCT target_id, canonical AS name FROM ids) SELECT target_id, row_number() OVER (ORDER BY lower(name), target_id) AS place FROM t""")
def target_catalogue(spark: SparkSession, d: str) -> DataFrame:
    rows = exports.catalogue(targets.rollup(_part_claims(spark, d)))
    return rows.select("target_id", F.row_number().over(Window.orderBy(F.lower("name"), "target_id")).cast("long").alias("place"))


# --- exports


def _export_rows(spark: SparkSession, d: str) -> DataFrame:
    a = V.antibodies(spark, d).select("antibody_id", "name", "organism", "therapeutic_status", F.when(F.col("has_heavy"), "ACD").otherwise("").alias("heavy"), F.when(F.col("has_light"), "EFX").otherwise("").alias("light"))
    tiers = F.create_map(F.lit("100%"), F.array(F.lit("1ABC")), F.lit("99%"), F.array(F.lit("2XYZ")))
    return a.join(targets.evidence_lists(V.claims(spark, d)), "antibody_id").withColumns({"sources": F.array(F.lit("s1"), F.lit("s2")), "structure_tiers": tiers})


@query(f"""WITH {V.CLAIMS}, {V.ANTIBODIES}, n AS (SELECT antibody_id, list_sort(list(DISTINCT target_name) FILTER (family = 'direct')) AS x FROM family GROUP BY 1)
 SELECT antibody_id, '1ABC' AS exact_structures, '2XYZ (99% SI)' AS homologous_structures, 's1;s2' AS sources, coalesce(array_to_string(x, ';'), '') AS direct_targets, CASE WHEN len(x) > 1 THEN 'multiple' ELSE 'unspecified' END AS export_target,
 CASE WHEN has_heavy AND has_light THEN 'paired' WHEN has_heavy THEN 'heavy_only' WHEN has_light THEN 'light_only' ELSE 'no_full_chain' END AS sequence_pairing, CASE WHEN has_light THEN 'X' ELSE '' END AS ambiguous_residues, 'no source nucleotide sequence available' AS source_nucleotide_status, 29 AS n_columns
 FROM antibodies JOIN n USING (antibody_id)""")
def export_table(spark: SparkSession, d: str) -> DataFrame:
    out = exports.export_rows(_export_rows(spark, d))
    return out.select("antibody_id", "exact_structures", "homologous_structures", "sources", "direct_targets", "export_target", "sequence_pairing", "ambiguous_residues", "source_nucleotide_status", F.lit(len(out.columns)).alias("n_columns"))


@query("""SELECT '"q' || event_id || '","ACD","","","single_chain","3","heavy","' || CASE WHEN event_id % 2 = 0 THEN 'EXACT' ELSE 'NO MATCH' END || '","","0","","","","","' || CASE WHEN event_id % 2 = 0 THEN 'ab_1' ELSE '' END || '","a ""b"" c","","","","' || CASE WHEN event_id % 2 = 0 THEN '?ab=ab_1' ELSE '' END || '","S1","4"' AS line FROM events""")
def screening_report(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 2 == 0
    hits = V.table(spark, d, "events").select(F.concat(F.lit("q"), "event_id").alias("query_id"), F.lit("ACD").alias("query_sequence"), F.lit("heavy").alias("query_type"), F.when(m, "EXACT").otherwise("NO MATCH").alias("match_type"), F.lit(0).alias("edit_distance"), F.when(m, "ab_1").alias("antibody_id"), F.lit('a "b" c').alias("antibody_name"))
    return exports.quoted_lines(exports.screening_rows(hits, "S1"))


@query(f"""SELECT 'S1' AS snapshot, 4 AS schema_version, 'filtered' AS scope, 'unique_chains' AS redundancy_mode, count(*) AS record_count, count(DISTINCT o_custkey) AS unique_entity_count, count(*) FILTER (o_orderkey % 3 = 0) AS nucleotide_records, {V.digest_sql('CAST(o_custkey AS VARCHAR)')} AS ids_digest, {V.digest_sql('o_orderstatus || chr(31) || o_orderkey')} AS sources_digest FROM orders""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("antibody_id"), F.when(F.col("o_orderkey") % 3 == 0, "ACG").otherwise("").alias("vh_nt_source"), F.lit("").alias("vl_nt_source"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("record_id"))
    return exports.export_manifest(rows, "filtered", "unique_chains", "S1")


_CITES = "WITH c AS (SELECT DISTINCT source, CAST(n_chars % 10 AS VARCHAR) AS r, lang FROM documents)"


@query(_CITES + """ SELECT 'bib' AS kind, '@misc{' || regexp_replace(source || '_' || r, '[^A-Za-z0-9_]+', '_', 'g') || ',' || chr(10) || '  title = {' || '\\{' || lang || '},' || chr(10) || '  howpublished = {' || source || '},' || chr(10) || '  url = {}' || chr(10) || '}' AS line FROM c
 UNION ALL SELECT 'ris', 'TY  - DATA' || chr(10) || 'TI  - {' || lang || chr(10) || 'DB  - ' || source || chr(10) || 'ID  - ' || r || chr(10) || 'UR  - ' || chr(10) || 'ER  - ' FROM c""")
def citation_exports(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("source", F.concat(F.lit("{"), "lang").alias("reference"), F.lit("").alias("record_url"), (F.col("n_chars") % 10).cast("string").alias("record_id"), F.col("doc_id").alias("antibody_id"))
    return exports.export(rows, "bib").select(F.lit("bib").alias("kind"), "line").union(exports.export(rows, "ris").select(F.lit("ris"), "line"))


@query(f"""WITH {V.ANTIBODIES} SELECT 'fasta_heavy' AS kind, count(*) FILTER (has_heavy) AS n FROM antibodies UNION ALL SELECT 'fasta_light', count(*) FILTER (has_light) FROM antibodies UNION ALL SELECT 'fasta_aa', count(*) FILTER (has_heavy) + count(*) FILTER (has_light) FROM antibodies
 UNION ALL SELECT 'generated_nt', count(*) FILTER (has_heavy) FROM antibodies UNION ALL SELECT 'json', count(*) FROM antibodies UNION ALL SELECT 'csv', count(*) FROM antibodies""")
def export_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = V.antibodies(spark, d).select("antibody_id", "name", F.when(F.col("has_heavy"), "ACD").otherwise("").alias("heavy"), F.when(F.col("has_light"), "EFX").otherwise("").alias("light"))
    parts = [exports.export(rows, k).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("fasta_heavy", "fasta_light", "fasta_aa", "generated_nt", "json", "csv")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""SELECT p_partkey AS id, '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '"}' AS payload FROM part""")
def provenance_payload(spark: SparkSession, d: str) -> DataFrame:
    return exports.provenance(V.table(spark, d, "part"), ("p_partkey", "p_brand")).withColumn("id", F.get_json_object("payload", "$.p_partkey").cast("long"))


# --- parameters


@query("""SELECT DISTINCT c_custkey AS id FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AND c_custkey % 2 = 0""")
def selection_state(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda w: V.table(spark, d, "customer").where(w).select(F.col("c_custkey").alias("id"))
    return search.selection(ids("c_custkey % 3 = 0"), ids("c_custkey % 5 = 0"), ids("c_custkey % 2 = 1"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'antibody' WHEN event_id % 3 = 0 THEN 'target' WHEN event_id % 5 > 0 THEN 'text' ELSE 'none' END AS kind, CASE WHEN event_id % 4 = 0 THEN 'ab_' || user_id WHEN event_id % 3 = 0 THEN 't' || user_id WHEN event_id % 5 > 0 THEN event_type ELSE '' END AS value,
 CASE WHEN event_id % 4 > 0 AND event_id % 3 = 0 AND event_id % 2 = 0 THEN 'include_descendants' ELSE 'exact' END AS scope, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'paired' ELSE 'exact' END WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'paired_similarity' ELSE 'similarity' END ELSE 'cdr' END AS search,
 CASE WHEN event_type = 'view' THEN 'all' ELSE 'view' END AS clicked FROM events""")
def dispatches(spark: SparkSession, d: str) -> DataFrame:
    """What links, sequence forms and clicks on filters ask for, by event."""
    k, text = F.col("event_id"), lambda c, x: F.when(c, x).otherwise("")
    link = search.linked(text(k % 4 == 0, F.concat(F.lit("ab_"), "user_id")), text(k % 3 == 0, F.concat(F.lit("t"), "user_id")), text(k % 5 > 0, F.col("event_type")), text(k % 2 == 0, "descendants"))
    mode = F.when(k % 3 == 0, "exact").when(k % 3 == 1, "similarity").otherwise("cdr")
    told = V.table(spark, d, "events").select(k, link.alias("l"), search.asked_search(F.lit("A"), text(k % 2 == 0, "B"), mode).alias("search"), search.after_click(F.col("event_type"), F.lit("view")).alias("clicked"))
    return told.select("event_id", "l.*", "search", "clicked")


@query("""SELECT query, CASE n WHEN 0 THEN 'none' ELSE 'multiple' END AS status FROM (SELECT 'red widget' AS query, (SELECT count(*) FROM part WHERE p_name = 'red widget') AS n UNION ALL SELECT 'no such part', 0) t WHERE n <> 1""")
def example_checks(spark: SparkSession, d: str) -> DataFrame:
    names = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = spark.createDataFrame([("Red-widget",), ("no such part",)], "query string")
    return search.missing_examples(search.name_terms(names, unicode_=False), asked, False).select(F.lower(F.replace("query", F.lit("-"), F.lit(" "))).alias("query"), "status")


# --- similarity


@query(f"""WITH {V.CHAINS}, {V.SIGNATURES}, s AS (SELECT q.id AS query_id, p.id, count(*) AS shared FROM postings q JOIN postings p USING (hash) WHERE q.id // 1000000 % 50 = 0 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) AS n FROM s) SELECT query_id, id, shared FROM r WHERE n <= 140""")
def candidate_top(spark: SparkSession, d: str) -> DataFrame:
    postings = similarity.capped(similarity.signatures(V.chains(spark, d), "heavy"))
    asked = postings.where(F.floor(F.col("id") / 1000000) % 50 == 0).select(F.col("id").alias("query_id"), "hash")
    return similarity.candidates(asked, postings, similarity.MOST_CANDIDATES)


@query(f"""WITH {V.CHAINS}, {V.SIGNATURES}, c AS (SELECT q.id AS query_id, p.id, count(*) AS shared FROM postings q JOIN postings p USING (hash) WHERE q.id // 1000000 % 50 = 0 GROUP BY ALL),
 x AS (SELECT q.id AS query_id, c.id, 32 AS shared FROM chains q JOIN chains c ON q.heavy = c.heavy WHERE q.id // 1000000 % 50 = 0 AND q.heavy <> '') SELECT query_id, id, max(shared) AS shared FROM (SELECT * FROM c UNION ALL SELECT * FROM x) t GROUP BY ALL""")
def exact_union(spark: SparkSession, d: str) -> DataFrame:
    # lines are parted once for all that follows
    c = materialize(V.chains(spark, d).select("id", "heavy"), "chains")
    postings = similarity.capped(similarity.signatures(c, "heavy"))
    asked = postings.where(F.floor(F.col("id") / 1000000) % 50 == 0).select(F.col("id").alias("query_id"), "hash")
    rows = materialize(similarity.keyed(c.where("heavy <> ''"), "id", "heavy", "key", "length"), "keys")
    own = rows.where(F.floor(F.col("id") / 1000000) % 50 == 0).select(F.col("id").alias("query_id"), "key")
    return similarity.with_exact(similarity.candidates(asked, postings), own, rows).select("query_id", "id", "shared")


@query("""WITH h AS (SELECT event_id % 50 AS query_id, event_id AS id, CAST(event_id * 37 % 101 AS DOUBLE) AS identity, CAST(event_id * 53 % 97 AS DOUBLE) AS coverage, event_id % 32 AS shared FROM events)
 SELECT 'strict' AS mode, id, row_number() OVER (PARTITION BY query_id ORDER BY identity DESC, coverage DESC, id) AS position FROM h UNION ALL SELECT 'loose', id, row_number() OVER (PARTITION BY query_id ORDER BY identity * coverage DESC, shared DESC, id) FROM h""")
def similarity_orders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    hits = V.table(spark, d, "events").select((k % 50).alias("query_id"), k.alias("id"), (k * 37 % 101).cast("double").alias("identity"), (k * 53 % 97).cast("double").alias("coverage"), (k % 32).alias("shared"))
    number = lambda df: df.withColumn("place", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).cast("long"))
    parts = [number(similarity.ranked(hits, m)).select(F.lit(m).alias("mode"), "id", "position") for m in ("strict", "loose")]
    return parts[0].union(parts[1])


_SCREEN = """q AS (SELECT item_id, i, regexp_replace(l[i], '[^A-Za-z]', '', 'g') AS raw FROM (SELECT item_id, regexp_split_to_array(text, '[ ' || chr(10) || ']+') AS l FROM benchmark) t, unnest(range(1, len(l) + 1)) AS u(i)),
 s AS (SELECT item_id * 1000 + i AS query_id, upper(replace(raw, 'ß', 'SS')) AS s FROM q), w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS region FROM documents)"""


@query(f"""WITH {_SCREEN}, v AS (SELECT query_id, s, s = '' OR lower(s) IN ('na', 'nan', 'none', 'nd', 'unknown') AS bad FROM s), u AS (SELECT DISTINCT s FROM v WHERE NOT bad), h AS (SELECT s, region, levenshtein(s, region) AS distance FROM u JOIN w ON abs(length(s) - length(region)) <= 1 AND levenshtein(s, region) <= CASE WHEN length(s) <= 8 THEN 1 ELSE 2 END)
 SELECT query_id, CASE WHEN bad THEN 'INVALID' WHEN region IS NULL THEN 'NO MATCH' WHEN distance = 0 THEN 'EXACT' ELSE 'NEAR' END AS status, region AS id, distance FROM v LEFT JOIN h USING (s)""")
def batch_screen_near(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark screened against the words of documents as regions."""
    words = V.table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "[ \n]+")).alias("i", "raw"))
    asked = words.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("query_id"), F.regexp_replace("raw", "[^A-Za-z]", "").alias("raw"))
    regions = V.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.upper("w").alias("sequence")).distinct().withColumn("id", F.col("sequence"))
    none = asked.select(F.lit("-").alias("id"), F.lit("").alias("heavy")).limit(1)
    return screening.screen(asked, none, regions=regions).select("query_id", "status", "id", "distance")
