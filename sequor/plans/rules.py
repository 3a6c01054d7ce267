"""Queries of scalar functions, predicates and merges over the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import sequences as S
from sequor.functions import text as T
from sequor.operators import entities, exports, search, similarity, targets, validate
from sequor.operators.storage import materialize
from sequor.plans import views as V
from sequor.plans.catalog import query
from sequor.sources import adapters, tabular

_E = "SELECT event_id, event_id % {n} AS m FROM events"


def _cases(column: str, values: tuple[str, ...]) -> F:
    """The values in turn, by ``column`` modulo their number."""
    out = F
    for i, v in enumerate(values):
        out = out.when(F.col(column) % len(values) == i, v)
    return out


def _case_sql(column: str, values: tuple[str, ...]) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


def _table_sql(column: str, values: list) -> str:
    """SQL of the expected value of each case."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


NUCLEOTIDES = ("acgu", "ACG T\nN", "ACGX", " ryswkm ", "", "n/a")


@query(f"SELECT event_id, {_table_sql('event_id', ['ACGT', 'ACGTN', '?', 'RYSWKM', '', ''])} AS nt FROM events")
def nucleotide_normalize(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", F.coalesce(S.nucleotides(_cases("event_id", NUCLEOTIDES)), F.lit("?")).alias("nt"))


FORMATS = ("VHH", "whole mAb", "nanobody fusion", "single-domain", "Nb", "VHHx", "single chain VHH", "scFv")


@query("SELECT event_id, event_id % 8 IN (0, 2, 3, 4, 6) AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS single FROM events")
def single_domain(spark: SparkSession, d: str) -> DataFrame:
    heavy, light = F.when(F.col("event_id") % 3 == 0, "").otherwise("ACD"), F.when(F.col("event_id") % 5 == 0, "DEF").otherwise("")
    return V.table(spark, d, "events").select("event_id", S.is_single_domain(_cases("event_id", FORMATS), F.lit(""), heavy, light).alias("single"))


SPECIES = ("Bispecific mAb", "Whole mAb", "trispecific", "multispecific", "Fab", "tetraspecific scFv")


@query("SELECT event_id, event_id % 6 IN (0, 2, 3, 5) OR event_id % 7 = 1 OR event_id % 11 = 2 AS multi FROM events")
def multispecific(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    rows = e.select("event_id", _cases("event_id", SPECIES).alias("Format"), F.when(F.col("event_id") % 7 == 1, "ACD").otherwise("na").alias("HeavySequence(ifbispec)"), F.when(F.col("event_id") % 11 == 2, "A;B").otherwise("A").alias("Target"))
    return rows.select("event_id", adapters.is_multispecific(rows).alias("multi"))


ROLES = ("heavy", "H", "light", "kappa", "lambda chain", "l", "alpha", "")


@query(f"SELECT event_id, {_table_sql('event_id', ['VH', 'VH', 'VL', 'VL', 'VL', 'VL', '', ''])} AS role FROM events")
def chain_roles(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", R.chain_role(_cases("event_id", ROLES)).alias("role"))


EPITOPES = ("S; RBD", "non-RBD", "S1 non-RBD", "RBD/non-RBD", "S; NTD", "unknown", "Spike stem", "NTD, non RBD")
_ASSERTED = [
    "SARS-CoV2 WT:source|SARS-CoV-2 RBD:source_epitope|SARS-CoV-2 Spike:derived_hierarchy",
    "SARS-CoV2 WT:source",
    "SARS-CoV2 WT:source|SARS-CoV-2 Spike:derived_hierarchy",
    "SARS-CoV2 WT:source|SARS-CoV-2 Spike:ambiguous_epitope",
    "SARS-CoV2 WT:source|SARS-CoV-2 NTD:source_epitope|SARS-CoV-2 Spike:derived_hierarchy",
    "SARS-CoV2 WT:source",
    "SARS-CoV2 WT:source|SARS-CoV-2 Spike:derived_hierarchy",
    "SARS-CoV2 WT:source|SARS-CoV-2 NTD:source_epitope|SARS-CoV-2 Spike:derived_hierarchy",
]


@query(f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'MERS-CoV:source' ELSE {_table_sql('event_id', _ASSERTED)} END AS asserted FROM events")
def epitope_assertions(spark: SparkSession, d: str) -> DataFrame:
    virus = F.when(F.col("event_id") % 9 == 0, "MERS-CoV").otherwise("SARS-CoV2_WT")
    found = R.epitope_targets(virus, _cases("event_id", EPITOPES))
    return V.table(spark, d, "events").select("event_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["target"], x["origin"])), "|").alias("asserted"))


VIRUS_CODES = ("VACV_WR_surface_L1", "MPXV", "cpxv-I_GRI (x)_B", "Foo_bar", "", "VARV_ (a)")


@query(f"SELECT event_id, {_table_sql('event_id', ['Vaccinia virus WR surface L1', 'Mpox virus', 'cpxv-I GRI B', 'Foo bar', '', 'Variola virus'])} AS target FROM events")
def virus_codes(spark: SparkSession, d: str) -> DataFrame:
    clean = F.regexp_replace(R.virus_entity(_cases("event_id", VIRUS_CODES))["target"], r"\s+", " ")
    return V.table(spark, d, "events").select("event_id", clean.alias("target"))


STRUCTURES = ("7abc; 6XYZ 7ABC", "none", "1a2b,xx 12345", "9zzz/1AAA")


@query(f"SELECT event_id, {_table_sql('event_id', ['6XYZ|7ABC', '', '1A2B', '1AAA|9ZZZ'])} AS ids FROM events")
def structure_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", F.array_join(T.structure_ids(_cases("event_id", STRUCTURES)), "|").alias("ids"))


NAMES = ("PD-L1 (human)", "IL 1", "--", "A/B_c", "X" * 130)
_SLUGS = ["pd-l1-human", "il-1", "unknown", "a-b-c", "x" * 120]


@query(f"""SELECT event_id, {_table_sql('event_id', _SLUGS)} AS slug, {_table_sql('event_id', ['PD-L1', 'IL 1', '--', 'A/B_c', 'X' * 130])} AS bare,
 {_table_sql('event_id', ['PD-L1%20%28human%29', 'IL%201', '--', 'A%2FB_c', 'X' * 130])} AS encoded FROM events""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    n = _cases("event_id", NAMES)
    return V.table(spark, d, "events").select("event_id", T.slug(n, False).alias("slug"), T.without_tail(n).alias("bare"), T.percent_encode(n).alias("encoded"))


@query(f"""WITH {V.CHAINS} SELECT id, regexp_matches(regexp_replace(line, '[[:space:]-]+', '', 'g'), '^[A-Za-z*]{{25,}}$') AS is_sequence,
 CASE WHEN regexp_matches(upper(regexp_replace(line, '[[:space:]]+', '', 'g')), '^[A-Z*]+$') THEN upper(regexp_replace(line, '[[:space:]]+', '', 'g')) END AS pasted FROM chains WHERE NOT starts_with(line, '>')""")
def typed_sequences(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d).where(~F.col("line").startswith(">"))
    return c.select("id", search.is_sequence(F.col("line")).alias("is_sequence"), search.pasted_sequence(F.concat(F.lit("> header\n"), "line")).alias("pasted"))


@query(f"""WITH {V.CHAINS}, v AS (SELECT id, heavy, unnest([99, 95, 90, 80]) AS level FROM chains WHERE heavy <> ''), n AS (SELECT *, length(heavy) AS n, CAST(round_even(length(heavy) * (100 - level) / 100.0, 0) AS INTEGER) AS e FROM v),
 p AS (SELECT id, level, n, e, i, substr(heavy, i + 1, 1) AS c FROM n, unnest(range(0, n)) AS u(i))
 SELECT id, level, md5(string_agg(CASE WHEN (i + 1) * e // n > i * e // n THEN CASE WHEN c = 'A' THEN 'G' ELSE 'A' END ELSE c END, '' ORDER BY i)) AS variant FROM p GROUP BY id, level""")
def identity_variants(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d).where("heavy <> ''")
    each = c.select("id", "heavy", F.explode(F.array(*map(F.lit, (99, 95, 90, 80)))).alias("level"))
    return each.select("id", "level", F.md5(S.variant("heavy", F.col("level"))).alias("variant"))


@query(f"WITH {V.CHAINS} SELECT id, CASE WHEN length(heavy) < 8 THEN -1 ELSE strpos(heavy, substr(heavy, 4, 5)) - 1 END AS at, CAST(CASE WHEN light = '' THEN -1 ELSE strpos(heavy, light) - 1 END AS INTEGER) AS other FROM chains")
def region_positions(spark: SparkSession, d: str) -> DataFrame:
    region = F.when(F.length("heavy") >= 8, F.substring("heavy", 4, 5)).otherwise("")
    return V.chains(spark, d).select("id", S.region_position(region, "heavy").cast("long").alias("at"), S.region_position("light", "heavy").alias("other"))


@query(f"""WITH {V.CHAINS}, e AS (SELECT id, unnest(['VH', 'VL']) AS chain, unnest([heavy || CASE WHEN id % 5 = 0 THEN 'X' ELSE '' END, light]) AS s FROM chains)
 SELECT id, chain, sha256(s) AS input_sha256, length(s) AS input_length, CASE WHEN contains(s, 'X') THEN 0 ELSE length(s) * 3 END AS output_length, CASE WHEN contains(s, 'X') THEN 'ambiguous residue' ELSE '' END AS error FROM e WHERE s <> ''""")
def coding_manifest(spark: SparkSession, d: str) -> DataFrame:
    return exports.coding_manifest(V.chains(spark, d).withColumn("heavy", F.concat("heavy", F.when(F.col("id") % 5 == 0, "X").otherwise(""))))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'no source nucleotide sequence available' WHEN 1 THEN 'source nucleotide — unknown' ELSE 'source nucleotide — full_length_bcr; source nucleotide — unknown' END AS status FROM events""")
def nucleotide_status(spark: SparkSession, d: str) -> DataFrame:
    m, s = F.col("event_id") % 3, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return V.table(spark, d, "events").select("event_id", exports.nucleotide_status(F.when(m == 0, s()).when(m == 1, s("")).otherwise(s("full_length_bcr", "", "full_length_bcr"))).alias("status"))


@query(f"""WITH {V.CLAIMS}, n AS (SELECT antibody_id, count(DISTINCT target_id) FILTER (family = 'direct') AS n, array_to_string(list_sort(list(DISTINCT relationship)), ';') AS r, array_to_string(list_sort(list(DISTINCT source)), ';') AS s FROM family GROUP BY antibody_id)
 SELECT antibody_id, CASE WHEN n > 1 THEN 'multiple' ELSE 'unspecified' END AS alone, 'T' AS chosen, r AS relationships, s AS sources FROM n""")
def export_context(spark: SparkSession, d: str) -> DataFrame:
    direct = F.collect_set(F.when(R.family("relationship") == "direct", F.col("target_id"))).alias("direct")
    rows = V.claims(spark, d).groupBy("antibody_id").agg(direct, F.collect_set(F.struct("relationship", "source")).alias("interactions"))
    alone, chosen = exports.target_context(None, F.col("direct")), exports.target_context("T", F.col("direct"), F.col("interactions"))
    joined = lambda c: F.array_join(F.array_sort(chosen[c]), ";")
    return rows.select("antibody_id", alone["export_target"].alias("alone"), chosen["export_target"].alias("chosen"), joined("export_relationships").alias("relationships"), joined("export_target_sources").alias("sources"))


@query(f"""WITH {V.CLAIMS} SELECT event_id, 'ix_' || substr(sha256(antibody_id || chr(31) || target_id || chr(31) || source || chr(31) || relationship || chr(31) || ''), 1, 20) AS interaction_id FROM claims""")
def interaction_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.claims(spark, d).select("event_id", targets.interaction_id("antibody_id", "target_id", "source", "relationship", F.lit(None).cast("string")).alias("interaction_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_custkey WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN 'b' || o_custkey ELSE '' END AS record_date,
 CASE WHEN o_orderkey % 3 = 0 THEN 'date_added' WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN 'update_date' ELSE '' END AS record_date_field FROM orders""")
def record_dates(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    m = F.col("o_orderkey") % 3
    meta = F.create_map(F.lit("update_date"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("b"), "o_custkey")).otherwise(""), F.lit("date_added"), F.when(m == 0, F.concat(F.lit("a"), "o_custkey")).otherwise(""))
    rows = o.select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("antibody_id"), F.lit("s").alias("source"), F.col("o_orderkey").alias("record_id"), F.lit(0).alias("source_ord"), F.col("o_orderkey").alias("row_ord"), F.when(m == 2, F.create_map().cast("map<string,string>")).otherwise(meta).alias("metadata"))
    return entities.source_records(rows).select("o_orderkey", "record_date", "record_date_field")


@query("""WITH o AS (SELECT o_custkey AS antibody_id, k, v, o_orderkey AS pos FROM (SELECT o_custkey, o_orderkey, unnest(['status', 'priority']) AS k, unnest([CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, o_orderpriority]) AS v FROM orders) t WHERE v <> ''),
 f AS (SELECT antibody_id, k, arg_min(v, pos) AS v FROM o GROUP BY ALL)
 SELECT antibody_id, string_agg(k || '=' || v, '|' ORDER BY k) AS metadata FROM f GROUP BY antibody_id""")
def metadata_first_wins(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    meta = F.create_map(F.lit("status"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")), F.lit("priority"), F.col("o_orderpriority"))
    rows = o.select(F.col("o_custkey").alias("antibody_id"), F.lit(0).alias("source_ord"), F.col("o_orderkey").alias("row_ord"), meta.alias("metadata"))
    told = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return entities.merge_metadata(rows).select("antibody_id", F.array_join(told, "|").alias("metadata"))


@query("""WITH t AS (SELECT p_brand AS antibody_id, CASE p_size % 3 WHEN 0 THEN '100%' WHEN 1 THEN '99%' ELSE '95-98%' END AS tier, list_sort(list(DISTINCT p_name)) AS ids FROM part GROUP BY ALL)
 SELECT antibody_id, string_agg(tier || ':' || array_to_string(ids, ','), '|' ORDER BY tier) AS tiers FROM t GROUP BY antibody_id""")
def tier_unions(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 3
    tier = F.when(m == 0, "100%").when(m == 1, "99%").otherwise("95-98%")
    rows = V.table(spark, d, "part").select(F.col("p_brand").alias("antibody_id"), F.create_map(tier, F.array("p_name")).alias("structure_tiers"))
    told = F.transform(F.map_entries("structure_tiers"), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"], ",")))
    return entities.merge_tiers(rows).select("antibody_id", F.array_join(told, "|").alias("tiers"))


@query("""WITH a AS (SELECT p_brand AS antibody_id, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1), x AS (SELECT DISTINCT p_brand AS antibody_id, unnest([p_name, upper(p_name), 'zz']) AS alias FROM part)
 SELECT antibody_id, array_to_string(list(alias ORDER BY lower(alias), alias), '|') AS aliases FROM x JOIN a USING (antibody_id) WHERE alias <> name GROUP BY antibody_id""")
def alias_unions(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "part").select(F.col("p_brand").alias("antibody_id"), F.col("p_name").alias("name"), F.array(F.upper("p_name"), F.lit("zz")).alias("aliases"), F.lit("s").alias("source"), F.col("p_partkey").alias("record_id"), F.lit(0).alias("source_ord"), F.col("p_partkey").alias("row_ord"))
    return entities.merge(rows).select("antibody_id", F.array_join("aliases", "|").alias("aliases"))


@query("""WITH l AS (SELECT l_orderkey AS antibody_id, 'c' || (l_suppkey % 4) AS id, arg_min(l_returnflag, l_linenumber || l_returnflag) AS status, min(l_linenumber || l_returnflag) AS pos FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1, 2)
 SELECT antibody_id, string_agg(id || ':' || status, '|' ORDER BY pos, id) AS constructs FROM l GROUP BY antibody_id""")
def constructs_first_wins(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("c"), F.col("l_suppkey") % 4)).otherwise("")
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("antibody_id"), c.alias("construct_id"), F.lit(0).alias("source_ord"), F.concat("l_linenumber", "l_returnflag").alias("row_ord"), F.create_map(F.lit("target_assignment_status"), F.col("l_returnflag")).alias("metadata"))
    told = F.transform("constructs", lambda x: F.concat_ws(":", x["id"], x["target_assignment_status"]))
    return entities.merge_contexts(rows, "construct").select("antibody_id", F.array_join(told, "|").alias("constructs"))


_NT = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC')"


@query(f"""WITH o AS (SELECT doc_id % 40 AS antibody_id, source, CAST(doc_id % 80 AS VARCHAR) AS source_record_id, {_NT} AS nt FROM documents)
 SELECT DISTINCT antibody_id, source, source_record_id, chain, sequence, 'unknown' AS scope, field AS source_field FROM (SELECT antibody_id, source, source_record_id, unnest(['VH', 'VL']) AS chain, unnest(['vh_nt_source', 'vl_nt_source']) AS field, unnest([nt, CASE WHEN antibody_id % 2 = 0 THEN nt ELSE '' END]) AS sequence FROM o) t WHERE sequence <> ''""")
def nucleotide_records(spark: SparkSession, d: str) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    nt = F.translate(letters, "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    a = F.col("doc_id") % 40
    rows = V.table(spark, d, "documents").select(a.alias("antibody_id"), "source", (F.col("doc_id") % 80).cast("string").alias("record_id"), F.lit(0).alias("source_ord"), F.col("doc_id").alias("row_ord"), nt.alias("vh_nt_source"), F.when(a % 2 == 0, nt).otherwise("").alias("vl_nt_source"))
    return entities.nucleotide_records(rows)


@query("""WITH x AS (SELECT o_custkey AS antibody_id, o_orderpriority AS v, o_orderkey AS pos, o_orderstatus AS source FROM orders WHERE o_orderkey % 4 <> 0), f AS (SELECT antibody_id, arg_min(v, pos) AS existing_value FROM x GROUP BY 1)
 SELECT DISTINCT antibody_id, 'heavy_v' AS field, existing_value, v AS incoming_value, source AS incoming_source, CAST(pos AS VARCHAR) AS incoming_source_record_id FROM x JOIN f USING (antibody_id) WHERE v <> existing_value""")
def field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    v = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = o.select(F.col("o_custkey").alias("antibody_id"), v.alias("heavy_v"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").cast("string").alias("record_id"), F.lit(0).alias("source_ord"), F.col("o_orderkey").alias("row_ord"))
    return entities.conflicts(rows, ("heavy_v",))


@query("""WITH x AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 3 = 0)) AS e, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey % 3 = 1)) AS h FROM orders GROUP BY 1)
 SELECT id, coalesce(array_to_string(e, ';'), '') AS exact, coalesce(array_to_string(list_filter(h, lambda v: NOT list_contains(coalesce(e, []), v)), ';'), '') AS homologous FROM x""")
def structure_tiers_view(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    ids = lambda k: F.array_sort(F.collect_set(F.when(m == k, F.col("o_orderpriority"))))
    rows = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(ids(0).alias("a"), ids(1).alias("b"))
    tiers = F.map_filter(F.create_map(F.lit("100%"), F.col("a"), F.lit("99%"), F.col("b")), lambda k, v: F.size(v) > 0)
    none = F.array().cast("array<string>")
    s = entities.structure_collections(tiers, none, none, none)
    return rows.select("id", s.alias("s")).select("id", F.array_join("s.exact", ";").alias("exact"), F.array_join("s.homologous", ";").alias("homologous"))


@query("""SELECT c_custkey AS id, 'ab_' || lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS antibody_id, array_to_string(list_transform(range(1, least(c_custkey % 9, 6) + 1), lambda i: 'n' || i), '|') AS aliases, c_acctbal > 0 AS has_heavy, CASE WHEN c_acctbal > 0 THEN 3 ELSE 0 END AS heavy_length, substr(lpad(CAST(c_custkey AS VARCHAR), 20, '0'), 1, 2) AS shard,
 CAST(least(c_custkey % 15, 12) AS INTEGER) AS n_exact FROM customer""")
def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer")
    upto = lambda n, p: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(p), i))).otherwise(F.array().cast("array<string>"))
    blank = {k: F.lit("") for k in ("organism", "format", "light", "therapeutic_status")}
    rows = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("ab_"), F.lpad(F.col("c_custkey").cast("string"), 20, "0")).alias("antibody_id"), F.col("c_name").alias("name"), upto(F.col("c_custkey") % 9, "n").alias("aliases"), F.when(F.col("c_acctbal") > 0, "ACD").otherwise("").alias("heavy"), upto(F.col("c_custkey") % 15, "s").alias("structures"), F.create_map().cast("map<string,array<string>>").alias("structure_tiers")).withColumns(blank)
    out = entities.summaries(rows).join(rows.select("id", "antibody_id"), "antibody_id")
    return out.select("id", "antibody_id", F.array_join("aliases", "|").alias("aliases"), "has_heavy", "heavy_length", "shard", F.size("exact_structures").alias("n_exact"))


@query("""SELECT DISTINCT source, trim(t) AS target_raw FROM (SELECT source, unnest(CASE WHEN source = 'plabdab' THEN string_split(raw, ';') ELSE [raw] END) AS t FROM
 (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'plabdab' ELSE 'covabdab' END AS source, p_name || '; ' || p_brand || ';na' AS raw FROM part) a) b WHERE lower(trim(t)) NOT IN ('', 'na')""")
def literature_fan_out(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("; "), "p_brand", F.lit(";na"))
    claims = V.table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "plabdab").otherwise("covabdab").alias("source"), raw.alias("target_raw"))
    return targets.expand_terms(claims).select("source", "target_raw").distinct()


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'record' ELSE 'source_homepage' END AS link_scope, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 3 END AS heavy_length,
 CASE WHEN event_id % 5 = 0 THEN 'heavy' ELSE '' END AS quarantined, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0 ELSE 1 END AS n_claims FROM events""")
def quarantine_and_claims(spark: SparkSession, d: str) -> DataFrame:
    """Observations with a bad heavy chain in a fifth of the rows; those make no claims."""
    e = V.table(spark, d, "events")
    heavy = F.when(F.col("event_id") % 5 == 0, "AC-D").otherwise("a c d")
    url = F.when(F.col("event_id") % 2 == 0, "https://x/1").otherwise("")
    obs = adapters.observe(e, "src", F.col("event_id").cast("string"), F.concat(F.lit("n"), "event_id"), heavy=heavy, record_url=url)
    edge = F.filter(F.array(adapters._edge(F.when(F.col("event_id") % 7 == 0, "").otherwise("T"), F.lit("binds"))), lambda x: x["target_raw"] != "")
    n = adapters.claims(obs, edge).groupBy(F.col("source_record_id").alias("record_id")).agg(F.count("*").alias("n_claims"))
    out = obs.join(n, "record_id", "left")
    return out.select("event_id", "link_scope", F.length("heavy").alias("heavy_length"), F.array_join(F.map_keys("quarantine"), ",").alias("quarantined"), F.coalesce("n_claims", F.lit(0)).cast("int").alias("n_claims"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderstatus, o_orderkey) AS position FROM orders) SELECT o_orderkey, position FROM r WHERE position <= 200""")
def timeline_order(spark: SparkSession, d: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 9 == 0, "undated").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("record_id"), date.alias("record_date"))
    first = search.timeline(rows).limit(200)
    order = Window.orderBy(F.expr("try_to_timestamp(record_date)").asc_nulls_last(), "source", "record_id")
    return first.select("o_orderkey", F.row_number().over(order).cast("long").alias("position"))


@query("""SELECT doc_id AS batch, CAST(1 AS BIGINT) AS record, CASE WHEN doc_id % 3 = 0 THEN 'sequence_1' ELSE 'doc ' || doc_id END AS name, length(regexp_replace(replace(text, '>', ''), '[[:space:]]+', '', 'g')) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) = 1)""")
def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    docs = docs.join(docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k = 1"), "doc_id", "left_semi")
    head = F.concat(F.lit(">"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("doc "), "doc_id")), F.lit("\n"))
    lines = docs.select(F.col("doc_id").alias("batch"), F.posexplode(F.split(F.concat(head, F.replace("text", F.lit(">"), F.lit(""))), "\n", -1)).alias("line_no", "line"))
    return tabular.fasta_records(lines).select("batch", "record", "name", F.length("sequence").cast("long").alias("n"))


_BRAND = "SELECT p_brand AS batch, p_partkey, p_name, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS record FROM part"


def _pasted(spark: SparkSession, d: str, line: F.Column, head: F.Column) -> DataFrame:
    """A pasted text for each brand: a head, and a line for each of its parts."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n")
    return V.table(spark, d, "part").groupBy(F.col("p_brand").alias("batch")).agg(F.concat(head, lines, F.lit("\n")).alias("raw"))


@query(f"""SELECT batch, record, CASE WHEN p_partkey % 3 = 0 THEN 'sequence_' || record ELSE p_name || ', x' END AS name, s AS heavy, CASE WHEN p_partkey % 2 = 0 THEN 'EFG' ELSE '' END AS light, '' AS sequence FROM ({_BRAND}) t""")
def batch_table(spark: SparkSession, d: str) -> DataFrame:
    """Parts as tables that were pasted, one for each brand."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit('"'), "p_name", F.lit(', x"')))
    line = F.concat_ws(",", name, F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")), F.when(k % 2 == 0, "efg").otherwise(""))
    return tabular.parse_batches(_pasted(spark, d, line, F.lit("\ufeffLabel,VH,vl\n"))).drop("error")


@query(f"""SELECT batch, record, CASE WHEN ascii(right(batch, 1)) % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'sequence_' || record ELSE p_name END ELSE 'sequence_' || record END AS name, s AS sequence FROM ({_BRAND}) t""")
def batch_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Parts as FASTA or as lines that were pasted, by the last letter of their brand."""
    fasta = F.ascii(F.right("p_brand", F.lit(1))) % 2 == 0
    head = F.when(F.col("p_partkey") % 3 == 0, ">\n").otherwise(F.concat(F.lit(">"), "p_name", F.lit("\n")))
    line = F.when(fasta, F.concat(head, F.lower("p_name"))).otherwise(F.lower("p_name"))
    return tabular.parse_batches(_pasted(spark, d, line, F.lit(""))).select("batch", "record", "name", F.regexp_replace("sequence", "[^A-Z]", "").alias("sequence"))


@query(f"""WITH {V.CHAINS} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(replace(regexp_replace(line, '[[:space:]]+', '', 'g'), 'ß', 'SS')), '[^A-Z*]'))), '') AS bad FROM chains
 WHERE lower(trim(line)) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'nd', 'not determined', 'unknown', '-')""")
def bad_characters(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d).where(T.fold_missing("line") != "")
    return c.select("id", F.array_join(S.bad_characters("line"), "").alias("bad"))


@query("""SELECT name, 'missing columns ' || missing AS message FROM (VALUES ('nation', 'x, y'), ('region', 'x')) t(name, missing)""")
def required_columns(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for name, wanted in (("nation", ("n_name", "x", "y")), ("region", ("r_name", "x")), ("part", ("p_name",))):
        try:
            tabular.require(V.table(spark, d, name), wanted, name)
        except ValueError as e:
            out.append((name, str(e).split(": ", 1)[1]))
    return spark.createDataFrame(out, "name string, message string")


@query("SELECT event_id, round((a * b / 100 + c * e / 100) / 2, 9) AS similarity FROM (SELECT event_id, 50 + event_id % 50 AS a, 70 + event_id % 30 AS b, 60.0 AS c, 80 + event_id % 20 AS e FROM events) t")
def similarity_score(spark: SparkSession, d: str) -> DataFrame:
    m = lambda n: (F.col("event_id") % n).cast("double")
    return V.table(spark, d, "events").select("event_id", F.round(similarity.pair_score((50 + m(50), 70 + m(30)), (F.lit(60.0), 80 + m(20))), 9).alias("similarity"))


@query("""SELECT 'V1' AS rule, 'nation' AS subject, 'count differs from manifest' AS message""")
def validate_counts(spark: SparkSession, d: str) -> DataFrame:
    return validate.counts_agree({"region": 5, "nation": 24}, {t: V.table(spark, d, t) for t in ("region", "nation")})


@query("""SELECT 'V14' AS rule, 'none' AS subject, 'empty' AS message""")
def validate_not_empty(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation")
    return validate.not_empty({"nation": n, "none": n.where("n_nationkey < 0")})


@query("""WITH a AS (SELECT 'ab_' || lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS id, c_custkey AS k FROM customer)
 SELECT 'V2' AS rule, id AS subject, 'duplicate id' AS message FROM a WHERE k % 50 = 1 UNION ALL SELECT 'V2', id, 'wrong shard' FROM a WHERE k % 50 = 2
 UNION ALL SELECT 'V3', id, 'no direct target list' FROM a WHERE k % 50 = 3 UNION ALL SELECT 'V3', id, 'sequence quality differs' FROM a WHERE k % 50 = 4""")
def validate_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with planted defects: one twice, one in the wrong shard, one without targets, one of another length."""
    m = F.col("c_custkey") % 50
    rows = V.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("ab_"), F.lpad(F.col("c_custkey").cast("string"), 20, "0")).alias("antibody_id"), F.lit("ACD").alias("heavy"), F.lit("").alias("light"))
    no = F.lit(False)
    rows = rows.withColumns({"shard": F.when(m == 2, "zz").otherwise(exports.shard("antibody_id")), "direct_targets": F.when(m != 3, F.array(F.lit("t"))), "quality": S.quality(F.when(m == 4, "AC").otherwise(F.col("heavy")), "light", no, no, no)})
    return validate.entities(rows.union(rows.where(m == 1)))


@query(f"""WITH o AS (SELECT event_id % 60 AS r, event_id FROM events)
 SELECT 'V4' AS rule, CAST(event_id AS VARCHAR) AS subject, 'nucleotide alphabet' AS message FROM o WHERE r = 1 UNION ALL SELECT 'V4', CAST(event_id AS VARCHAR), 'no source record' FROM o WHERE r = 2
 UNION ALL SELECT 'V4', CAST(event_id AS VARCHAR), 'scope vocabulary' FROM o WHERE r = 3 UNION ALL SELECT 'V4', CAST(event_id AS VARCHAR), 'chain vocabulary' FROM o WHERE r = 4""")
def validate_nucleotides(spark: SparkSession, d: str) -> DataFrame:
    e, m = V.table(spark, d, "events"), F.col("event_id") % 60
    rid = F.col("event_id").cast("string")
    rows = e.select(F.lit("s").alias("source"), rid.alias("source_record_id"), F.when(m == 1, "ACGX").otherwise("ACGT").alias("sequence"), F.when(m == 3, "all").otherwise("unknown").alias("scope"), F.when(m == 4, "VX").otherwise("VH").alias("chain"))
    return validate.nucleotides(rows, e.where(m != 2).select(F.lit("s").alias("source"), rid.alias("record_id")))


@query("""SELECT 'V5' AS rule, CAST(event_id AS VARCHAR) AS subject, 'record link without url' AS message FROM events WHERE event_id % 60 = 1 UNION ALL SELECT 'V5', 'e' || event_id, 'claim on an unassigned arm' FROM events WHERE event_id % 60 = 2
 UNION ALL SELECT 'V5', CAST(event_id AS VARCHAR), 'multispecific without construct or arm' FROM events WHERE event_id % 60 = 3 UNION ALL SELECT 'V5', CAST(event_id AS VARCHAR), 'chain annotations' FROM events WHERE event_id % 60 = 4""")
def validate_contexts(spark: SparkSession, d: str) -> DataFrame:
    e, m = V.table(spark, d, "events"), F.col("event_id") % 60
    text = lambda c, x: F.when(c, x).otherwise("")
    meta = F.create_map(F.lit("multispecific"), text(m == 3, "true"), F.lit("target_assignment_status"), text(m == 2, "unavailable_no_arm_mapping"))
    obs = e.select(F.concat(F.lit("e"), "event_id").alias("antibody_id"), F.col("event_id").alias("record_id"), F.lit("record").alias("link_scope"), text(m != 1, "u").alias("record_url"), meta.alias("metadata"), F.lit("c").alias("construct_id"), text(m != 3, "a").alias("arm_id"), F.create_map(F.when(m == 4, "VX").otherwise("VH"), F.lit("x")).alias("chain_annotations"))
    return validate.contexts(obs, obs.select("antibody_id"))


@query(f"""WITH {V.CHAINS} SELECT 'V11' AS rule, heavy AS subject, 'wrong length bucket' AS message FROM (SELECT DISTINCT heavy FROM chains WHERE heavy <> '' AND length(heavy) % 50 = 7) t
 UNION ALL SELECT 'V11', CAST(id AS VARCHAR), 'region not indexed' FROM chains WHERE heavy <> '' AND length(heavy) % 50 = 9 UNION ALL SELECT 'V11', '-1', 'member without the region' """)
def validate_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = V.chains(spark, d).select("id", "heavy")
    index = similarity.region_index(rows, ("heavy",)).where("len % 50 <> 9")
    index = index.withColumn("len", F.when(F.col("len") % 50 == 7, F.col("len") + 1).otherwise(F.col("len")))
    wrong = validate.regions(index.select("len", "sequence", F.explode("ids").alias("id")).union(spark.createDataFrame([(3, "ACD", -1)], "len int, sequence string, id long")), rows, "heavy")
    return wrong.distinct()


@query(f"""WITH {V.CHAINS}, {V.SIGNATURES} SELECT 'V12' AS rule, CAST(id AS VARCHAR) AS subject, 'hash without posting' AS message FROM postings WHERE id % 1000 = 1 AND hash % 50 = 0
 UNION ALL SELECT 'V12', '-1', 'posting without hash' UNION ALL SELECT 'V12', '-1', 'posting without hash' UNION ALL SELECT 'V12', '-1', 'duplicate posting'""")
def validate_postings(spark: SparkSession, d: str) -> DataFrame:
    c = materialize(V.chains(spark, d).select("id", "heavy"), "chains")
    index = similarity.capped(similarity.signatures(c, "heavy")).where("not (id % 1000 = 1 and hash % 50 = 0)").select("hash", "id")
    return validate.postings(index.union(spark.createDataFrame([(5, -1), (5, -1)], "hash long, id long")), c, "heavy")


@query("""SELECT 'V8' AS rule, 'n' || n_nationkey AS subject, CASE WHEN n_nationkey % 5 = 0 THEN 'not among its parent''s children' ELSE 'child of another parent' END AS message FROM nation WHERE n_nationkey % 5 IN (0, 1)""")
def validate_children(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation")
    none = F.array().cast("array<string>")
    kids = n.where("n_nationkey % 5 <> 0").groupBy(F.concat(F.lit("r"), "n_regionkey").alias("target_id")).agg(F.collect_set(F.concat(F.lit("n"), "n_nationkey")).alias("children"))
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("target_id"), F.when(F.col("n_nationkey") % 5 != 1, F.concat(F.lit("r"), "n_regionkey")).alias("parent_id"), none.alias("children"))
    roots = kids.select("target_id", F.lit(None).cast("string").alias("parent_id"), "children")
    return validate.children(up.union(roots))
