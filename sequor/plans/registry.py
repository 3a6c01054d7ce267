"""Queries of the library, each with the DuckDB SQL that it is held against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import sequences as S
from sequor.functions import text as T
from sequor.operators import clusters, entities, exports, screening, search, similarity, targets, validate
from sequor.operators.storage import materialize
from sequor.plans import rules, snapshots, tables  # noqa: F401, they register their queries
from sequor.plans import views as V
from sequor.plans.catalog import ORACLES, QUERIES, query
from sequor.sources import adapters, tabular

__all__ = ["ORACLES", "QUERIES", "flagship"]

# A small curated dictionary over part names, and typed queries.
ALIASES = {"ring family": ["small ring", "red ring", "Big-Ring"], "widget family": ["red widget", "blue widget"], "bolt family": ["blue bolt"]}
TYPED = ("small ring", "Red Widget", "red widgt", "nothing like it", "blue", "Customer#000000007")


def _list(c: str) -> F:
    return F.array_join(c, "|").alias(c)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Lines as observations: the document is the record, its language the organism, its line number the order."""
    c = V.chains(spark, d)
    name = F.concat(F.lit("doc "), F.col("doc_id"))
    single = F.lit(False)
    return c.select(
        S.identity("source", F.col("id").cast("string"), name, "heavy", "light", single).alias("antibody_id"),
        "source",
        F.col("doc_id").cast("string").alias("record_id"),
        F.col("source").alias("source_ord"),
        F.col("id").alias("row_ord"),
        name.alias("name"),
        "heavy",
        "light",
        F.col("lang").alias("organism"),
        F.array(F.concat(F.lit("alias "), "lang")).alias("aliases"),
    )


_IDENTITY = f"""WITH {V.CHAINS}, obs AS (SELECT *, 'doc ' || doc_id AS name,
 'ab_' || substr(CASE WHEN heavy <> '' AND light <> '' THEN sha256(heavy || chr(31) || light)
  ELSE sha256('source_record' || chr(31) || source || chr(31) || CAST(id AS VARCHAR) || chr(31) ||
   CASE WHEN heavy <> '' THEN 'heavy' WHEN light <> '' THEN 'light' ELSE 'unsequenced' END || chr(31) || 'doc ' || doc_id) END, 1, 20) AS antibody_id FROM chains)"""


@query(f"""{_IDENTITY} SELECT antibody_id, arg_min(name, (source, id)) AS name, arg_min(lang, (source, id)) AS organism, max(heavy) AS heavy, max(light) AS light,
 array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, count(DISTINCT (source, doc_id)) AS source_record_count FROM obs GROUP BY antibody_id""")
def entity_identity_merge(spark: SparkSession, d: str) -> DataFrame:
    return entities.merge(_observations(spark, d)).select("antibody_id", "name", "organism", "heavy", "light", _list("sources"), "source_record_count")


@query(f"""{_IDENTITY}, r AS (SELECT *, row_number() OVER (PARTITION BY antibody_id, source, doc_id ORDER BY source, id) AS n FROM obs)
 SELECT antibody_id, source, CAST(doc_id AS VARCHAR) AS record_id, id AS row_ord FROM r WHERE n = 1""")
def source_record_rollup(spark: SparkSession, d: str) -> DataFrame:
    return entities.source_records(_observations(spark, d)).select("antibody_id", "source", "record_id", "row_ord")


@query(f"""{_IDENTITY}, f AS (SELECT antibody_id, arg_min(lang, (source, id)) AS existing_value FROM obs GROUP BY antibody_id)
 SELECT DISTINCT antibody_id, 'organism' AS field, existing_value, lang AS incoming_value, source AS incoming_source, CAST(doc_id AS VARCHAR) AS incoming_source_record_id
 FROM obs JOIN f USING (antibody_id) WHERE lang <> existing_value AND lang <> ''""")
def source_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return entities.conflicts(_observations(spark, d), ("organism",))


@query("""SELECT doc_id, CASE WHEN lower(trim(source)) IN ('', 'na', 'n/a', 'nan', 'none', 'nd', 'not determined', 'unknown', '-') THEN '' ELSE trim(source) END AS source,
 CASE WHEN lower(v) IN ('', 'na', 'n/a', 'nan', 'none', 'nd', 'not determined', 'unknown', '-') THEN '' ELSE v END AS folded
 FROM (SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN 'unknown' WHEN 2 THEN '-' WHEN 3 THEN 'ND' ELSE lang END AS v FROM documents) t""")
def na_fold_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    m = F.col("doc_id") % 6
    v = F.when(m == 0, " N/A ").when(m == 1, "unknown").when(m == 2, "-").when(m == 3, "ND").otherwise(F.col("lang"))
    return docs.select("doc_id", T.fold_missing("source").alias("source"), T.fold_missing(v).alias("folded"))


@query(f"""WITH {V.CHAINS} SELECT id, regexp_matches(line, '[^A-Za-z*[:space:]]') AS quarantined,
 CASE WHEN regexp_matches(line, '[^A-Za-z*[:space:]]') THEN '' ELSE upper(regexp_replace(line, '[[:space:]]+', '', 'g')) END AS normalized FROM chains""")
def sequence_quarantine(spark: SparkSession, d: str) -> DataFrame:
    # the words that stand for a missing value are lines of prose here, so only white space and case are folded
    s = F.upper(F.regexp_replace("line", r"\s+", ""))
    bad = F.col("line").rlike(r"[^A-Za-z*\s]")
    return V.chains(spark, d).select("id", bad.alias("quarantined"), F.when(bad, "").otherwise(s).alias("normalized"))


@query(f"""WITH {V.CHAINS}, raw AS (SELECT id, upper(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS heavy, light FROM chains)
 SELECT id, CASE WHEN heavy <> '' AND light <> '' THEN 'paired' WHEN heavy <> '' THEN 'heavy_only' WHEN light <> '' THEN 'light_only' ELSE 'no_full_chain' END AS pairing,
 length(heavy) AS heavy_length, length(light) AS light_length, array_to_string(list_sort(list_distinct(regexp_extract_all(heavy || light, '[*BJOUXZ]'))), '') AS ambiguous FROM raw""")
def sequence_quality(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d).withColumn("heavy", F.upper(F.regexp_replace("line", "[^A-Za-z]", "")))
    q = S.quality("heavy", "light", F.lit(False), F.lit(False), F.lit(False))
    return c.select("id", q.alias("q")).select("id", "q.pairing", F.col("q.heavy_length").cast("long").alias("heavy_length"), F.col("q.light_length").cast("long").alias("light_length"), F.array_join("q.ambiguous_residues", "").alias("ambiguous"))


@query("""SELECT l_orderkey, l_linenumber, relationship, raw FROM (
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['binds', 'does_not_bind', 'neutralizes']) AS relationship,
  unnest([l_returnflag || ';' || l_linestatus, l_linestatus || '| na ', '']) AS cell FROM lineitem) t,
 unnest(list_filter(list_transform(regexp_split_to_array(cell, '[;|]'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'na')) AS u(raw)""")
def unpivot_relations(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem")
    cells = {"binds": F.concat_ws(";", "l_returnflag", "l_linestatus"), "does_not_bind": F.concat("l_linestatus", F.lit("| na ")), "neutralizes": F.lit("")}
    return li.select("l_orderkey", "l_linenumber", F.explode(adapters.unpivot_cells(cells)).alias("e")).select("l_orderkey", "l_linenumber", "e.relationship", "e.raw")


@query(f"""WITH {V.CLAIMS} SELECT target_id, min(target_name) AS name, count(*) AS count, count(*) FILTER (family = 'direct') AS direct_count,
 count(*) FILTER (family = 'functional') AS functional_count, count(*) FILTER (family = 'negative') AS negative_count,
 count(DISTINCT antibody_id) FILTER (family = 'direct') AS direct_antibodies, count(DISTINCT antibody_id) FILTER (family = 'functional') AS functional_antibodies,
 count(DISTINCT antibody_id) FILTER (family = 'negative') AS negative_antibodies, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources
 FROM family WHERE family <> 'literature' GROUP BY target_id""")
def target_rollup(spark: SparkSession, d: str) -> DataFrame:
    return targets.rollup(V.claims(spark, d)).withColumn("sources", F.array_join("sources", "|"))


@query(f"""WITH {V.CLAIMS}, h AS (SELECT target_id, relationship, count(*) AS n FROM family WHERE family <> 'literature' GROUP BY ALL)
 SELECT target_id, array_to_string(list(relationship || ':' || n ORDER BY relationship), '|') AS relationships FROM h GROUP BY target_id""")
def relationship_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = targets.histogram(V.claims(spark, d))
    told = F.transform(F.map_entries("relationships"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return h.select("target_id", F.array_join(told, "|").alias("relationships"))


def _named_results(spark: SparkSession, d: str) -> DataFrame:
    return targets.results(V.claims(spark, d)).join(V.antibodies(spark, d), "antibody_id")


@query(f"""WITH {V.CLAIMS}, {V.RESULTS}, {V.ANTIBODIES} SELECT target_id, family, antibody_id, name, array_to_string(relationships, '|') AS relationships,
 array_to_string(evidence, '|') AS evidence, array_to_string(sources, '|') AS sources, n_interactions, rank_score,
 row_number() OVER (PARTITION BY target_id, family ORDER BY rank_score DESC, lower(name), antibody_id) AS position FROM results JOIN antibodies USING (antibody_id)""")
def target_results_ranked(spark: SparkSession, d: str) -> DataFrame:
    out = targets.paged(_named_results(spark, d))
    return out.select("target_id", "family", "antibody_id", "name", _list("relationships"), _list("evidence"), _list("sources"), "n_interactions", "rank_score", F.col("position").cast("long").alias("position"))


@query("""WITH r AS (SELECT p_name AS target_id, l_suppkey AS antibody_id, l_returnflag AS family, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 p AS (SELECT target_id, family, CAST(ceil(row_number() OVER (PARTITION BY target_id, family ORDER BY n DESC, lower(s_name), antibody_id) / 20.0) AS BIGINT) AS page FROM r JOIN supplier ON antibody_id = s_suppkey)
 SELECT target_id, family, page, count(*) AS count FROM p GROUP BY ALL""")
def target_pages(spark: SparkSession, d: str) -> DataFrame:
    li, part, supp = (V.table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    r = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_name").alias("target_id"), F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("antibody_id")).agg(F.count("*").alias("rank_score"))
    r = r.join(supp.select(F.col("s_suppkey").alias("antibody_id"), F.col("s_name").alias("name")), "antibody_id")
    return exports.page_manifest(targets.paged(r, size=20))


@query(f"""WITH {V.CLAIMS}, {V.RESULTS}, {V.ANTIBODIES} SELECT target_id, family, count(*) AS unique_results, count(*) FILTER (has_heavy AND has_light) AS paired,
 count(*) FILTER (therapeutic_status <> '') AS therapeutic, count(*) FILTER (structure_exact) AS structure_exact, count(*) FILTER (structure_homologous) AS structure_homologous
 FROM results JOIN antibodies USING (antibody_id) GROUP BY ALL""")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return targets.collection_stats(_named_results(spark, d))


@query(f"""WITH {V.CLAIMS}, n AS (SELECT antibody_id, count(DISTINCT target_id) FILTER (family = 'direct') AS direct_target_count, count(DISTINCT target_id) FILTER (family = 'functional') AS functional_target_count,
 list_sort(coalesce(list(DISTINCT target_id) FILTER (family = 'direct'), [])) AS d, count(*) FILTER (family = 'negative') AS negative_evidence, count(*) FILTER (family = 'literature') AS literature_mentions FROM family GROUP BY antibody_id)
 SELECT antibody_id, direct_target_count, functional_target_count, array_to_string(d[1:5], '|') AS direct_targets, negative_evidence, literature_mentions FROM n""")
def antibody_target_lists(spark: SparkSession, d: str) -> DataFrame:
    return targets.antibody_targets(V.claims(spark, d), 5).select("antibody_id", "direct_target_count", "functional_target_count", _list("direct_targets"), "negative_evidence", "literature_mentions")


def _family_query(name: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        c = V.claims(spark, d).withColumn("family", R.family("relationship")).where(F.col("family") == name)
        return c.groupBy("antibody_id", "target_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))

    f.__name__ = {"literature": "literature_mentions", "negative": "negative_evidence", "functional": "functional_family"}[name]
    query(f"WITH {V.CLAIMS} SELECT antibody_id, target_id, count(*) AS n, round(sum(value), 2) AS total FROM family WHERE family = '{name}' GROUP BY ALL")(f)


for _name in ("literature", "negative", "functional"):
    _family_query(_name)

_ALIAS_SQL = "aliases(k, canonical) AS (VALUES " + ", ".join(f"('{''.join(c for c in a.upper() if c.isalnum())}', '{g}')" for g, names in ALIASES.items() for a in (g, *names)) + ")"


@query(f"""WITH {_ALIAS_SQL}, r AS (SELECT DISTINCT p_name AS target_raw, coalesce(canonical, p_name) AS canonical, canonical IS NOT NULL AS curated
 FROM part LEFT JOIN aliases ON k = regexp_replace(upper(p_name), '[^A-Z0-9]+', '', 'g'))
 SELECT target_raw, canonical, curated, 'target:' || regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g') || CASE WHEN curated THEN '' ELSE '-' || substr(sha256(lower(canonical)), 1, 12) END AS target_id FROM r""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    names = V.table(spark, d, "part").select(F.col("p_name").alias("target_raw")).distinct()
    return targets.resolve(names, targets.alias_table(spark, ALIASES), unicode_=False).select("target_raw", "canonical", "curated", "target_id")


@query(f"""WITH {_ALIAS_SQL}, g AS (SELECT DISTINCT p_type || ' / ' || p_name || '/' || p_brand AS target_raw FROM part),
 e AS (SELECT target_raw, i, trim(p[i]) AS part FROM (SELECT target_raw, string_split(target_raw, '/') AS p FROM g) t, unnest(range(1, len(p) + 1)) AS u(i)),
 h AS (SELECT target_raw, i, part, canonical FROM e LEFT JOIN aliases ON k = regexp_replace(upper(part), '[^A-Z0-9]+', '', 'g'))
 SELECT target_raw, arg_min(coalesce(canonical, part), (canonical IS NULL, i)) AS canonical FROM h GROUP BY target_raw""")
def synonym_group_first_hit(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_type", F.lit(" / "), "p_name", F.lit("/"), "p_brand")
    names = V.table(spark, d, "part").select(raw.alias("target_raw")).distinct()
    return targets.resolve_group(names, targets.alias_table(spark, ALIASES)).select("target_raw", "canonical")


@query(f"WITH RECURSIVE {V.TREE}, {V.DOWN} SELECT root, id, min(depth) AS depth FROM down WHERE root LIKE 'r%' GROUP BY ALL")
def hierarchy_descendants(spark: SparkSession, d: str) -> DataFrame:
    roots = V.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return targets.descendants(V.tree(spark, d), roots)


@query(f"""WITH RECURSIVE {V.TREE}, {V.DOWN}, o AS (SELECT 'c' || o_custkey AS target_id, 'o' || (o_orderkey % 200) AS antibody_id, o_orderstatus AS family, o_orderpriority AS source FROM orders),
 s AS (SELECT DISTINCT root, id AS target_id FROM down WHERE root LIKE 'r%')
 SELECT root, family, antibody_id, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, count(DISTINCT target_id) AS n_targets FROM o JOIN s USING (target_id) GROUP BY ALL""")
def descendant_rows_merged(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("target_id"), F.concat(F.lit("o"), F.col("o_orderkey") % 200).alias("antibody_id"), F.col("o_orderstatus").alias("family"), F.array("o_orderpriority").alias("sources"))
    o = o.withColumns({"relationships": F.col("sources"), "evidence": F.col("sources")})
    roots = V.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return search.merged_with_descendants(o, V.tree(spark, d), roots).select("root", "family", "antibody_id", _list("sources"), "n_targets")


@query(f"""WITH {V.CLAIMS}, direct AS (SELECT DISTINCT 'd' || event_id % 197 AS a, target_id AS t FROM family WHERE family = 'direct'),
 n AS (SELECT t, count(*) AS n FROM direct GROUP BY t), fit AS (SELECT a FROM direct GROUP BY a HAVING count(*) BETWEEN 2 AND 20),
 o AS (SELECT x.t AS target_a, y.t AS target_b, count(*) AS overlap FROM direct x JOIN direct y ON x.a = y.a AND x.t < y.t WHERE x.a IN (SELECT a FROM fit) GROUP BY ALL HAVING count(*) >= 2),
 j AS (SELECT target_a, target_b, overlap, overlap / (p.n + q.n - overlap) AS jaccard, overlap / least(p.n, q.n) AS containment FROM o JOIN n p ON p.t = target_a JOIN n q ON q.t = target_b)
 SELECT target_a, target_b, overlap, round(jaccard, 4) AS jaccard, round(containment, 4) AS containment FROM j WHERE jaccard >= 0.1 OR containment >= 0.2
 ORDER BY round(containment, 4) DESC, round(jaccard, 4) DESC, overlap DESC, 'Target ' || substr(target_a, 2), target_a, target_b LIMIT 500""")
def alias_review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Direct claims of all events, dealt to 197 entities, with gates that these data reach."""
    c = V.claims(spark, d).withColumn("antibody_id", F.concat(F.lit("d"), F.col("event_id") % 197))
    return targets.review_candidates(c, least_jaccard=0.1, least_containment=0.2).select("target_a", "target_b", "overlap", "jaccard", "containment")


def _names(spark: SparkSession, d: str) -> DataFrame:
    part = V.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return part.union(V.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases")))


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TERMS = f"""names AS (SELECT 'p' || p_partkey AS id, unnest([p_name, p_brand]) AS raw FROM part UNION ALL SELECT 'c' || c_custkey, c_name FROM customer),
 terms AS (SELECT DISTINCT rpad(substr(replace(term, ' ', ''), 1, 2), 2, '_') AS bucket, term, id FROM (SELECT id, {_NORM.format('raw')} AS term FROM names) t WHERE term <> '')"""
_TYPED = "typed(query) AS (VALUES " + ", ".join(f"('{q}')" for q in TYPED) + ")"


@query(f"""WITH {_TERMS} SELECT bucket, term, count(*) AS n_ids, min(id) AS first_id FROM terms GROUP BY ALL""")
def exact_name_index(spark: SparkSession, d: str) -> DataFrame:
    index = search.exact_index(search.name_terms(_names(spark, d), unicode_=False))
    return index.select("bucket", "term", F.size("ids").cast("long").alias("n_ids"), F.element_at("ids", 1).alias("first_id"))


@query(f"""WITH {_TERMS}, {_TYPED}, h AS (SELECT query, count(id) AS n, min(id) AS first_id FROM typed LEFT JOIN terms ON term = {_NORM.format('query')} GROUP BY query)
 SELECT query, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'multiple' END AS status, n AS n_ids, first_id FROM h""")
def exact_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    terms = search.name_terms(_names(spark, d), unicode_=False)
    typed = spark.createDataFrame([(q,) for q in TYPED], "query string")
    return search.exact_names(terms, typed, False).select("query", "status", F.size("ids").cast("long").alias("n_ids"), F.try_element_at("ids", F.lit(1)).alias("first_id"))


@query(f"""WITH {_TERMS}, s AS (SELECT id, term, CASE WHEN term = 'red widgt' THEN 10000 WHEN starts_with(term, 'red widgt') THEN 8000 WHEN contains(term, 'red widgt') THEN 5000
  WHEN length(term) >= 4 AND levenshtein(term, 'red widgt') <= 2 THEN 3200 - levenshtein(term, 'red widgt') * 450 ELSE 0 END AS score FROM terms)
 SELECT id, arg_max(term, (score, -length(term), term)) AS term, CAST(max(score) AS INTEGER) AS score FROM s WHERE score > 0 GROUP BY id ORDER BY 3 DESC, length(arg_max(term, (score, -length(term), term))), 2, 1 LIMIT 12""")
def autocomplete_score(spark: SparkSession, d: str) -> DataFrame:
    return search.autocomplete(search.name_terms(_names(spark, d), unicode_=False), "red widgt", 12)


@query(f"""WITH {V.CHAINS}, q AS (SELECT item_id, upper(translate(upper(regexp_replace(l, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'ACDEFG')) AS s FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS l FROM benchmark) t)
 SELECT DISTINCT item_id AS query_id, id, 'heavy' AS field, length(heavy) AS length FROM q JOIN chains ON heavy = s WHERE s <> ''""")
def exact_sequence_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", "\n", -1)).alias("l"))
    asked = lines.select("query_id", F.translate(F.upper(F.regexp_replace("l", "[^A-Za-z]", "")), "BJOUXZ", "ACDEFG").alias("sequence")).where("sequence <> ''")
    return search.exact_sequences(search.sequence_index(V.chains(spark, d)), asked, "heavy").distinct()


@query(f"""WITH {V.CHAINS}, q AS (SELECT DISTINCT heavy, light FROM chains WHERE doc_id % 50 = 0 AND heavy <> '' AND light <> '')
 SELECT md5(q.heavy || '|' || q.light) AS query_id, id FROM q JOIN chains c ON c.heavy = q.heavy AND c.light = q.light""")
def paired_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d)
    asked = c.where("doc_id % 50 = 0 and heavy <> '' and light <> ''").select("heavy", "light").distinct()
    asked = asked.withColumn("query_id", F.md5(F.concat_ws("|", "heavy", "light")))
    return search.paired_sequences(search.sequence_index(c), asked)


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(upper(regexp_replace(text, '[^A-Za-z ' || chr(10) || ']', '', 'g')), '[A-Z]+')) AS w FROM {}"


@query(f"""WITH q AS ({_WORDS.format('benchmark')}), s AS ({_WORDS.format('documents')})
 SELECT q.w AS query, s.w AS sequence, levenshtein(q.w, s.w) AS distance FROM q JOIN s ON abs(length(q.w) - length(s.w)) <= 1
 WHERE levenshtein(q.w, s.w) <= CASE WHEN length(q.w) <= 8 THEN 1 ELSE 2 END""")
def cdr_near_match(spark: SparkSession, d: str) -> DataFrame:
    def regions(name: str, col: str) -> DataFrame:
        plain = F.upper(F.regexp_replace("text", "[^A-Za-z \n]", ""))
        return V.table(spark, d, name).select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Z]+"), F.lit(0))).alias(col)).distinct()

    return similarity.near_regions(regions("benchmark", "query"), regions("documents", "sequence"))


@query(f"WITH {V.CHAINS}, {V.SIGNATURES} SELECT id, count(*) AS n, min(hash) AS least, max(hash) AS most FROM signatures GROUP BY id")
def kmer_signature(spark: SparkSession, d: str) -> DataFrame:
    return similarity.signatures(V.chains(spark, d), "heavy").groupBy("id").agg(F.count("*").alias("n"), F.min("hash").alias("least"), F.max("hash").alias("most"))


@query(f"""WITH {V.CHAINS}, {V.SIGNATURES}, c AS (SELECT hash, count(*) AS n FROM signatures GROUP BY hash)
 SELECT count(*) FILTER (n <= 250) AS indexed_hashes, count(*) FILTER (n > 250) AS skipped_hashes, CAST(coalesce(sum(n) FILTER (n <= 250), 0) AS BIGINT) AS postings FROM c""")
def posting_stats(spark: SparkSession, d: str) -> DataFrame:
    return similarity.posting_stats(similarity.signatures(V.chains(spark, d), "heavy"))


@query(f"""WITH {V.CHAINS}, {V.SIGNATURES} SELECT q.id AS query_id, p.id, count(*) AS shared FROM postings q JOIN postings p USING (hash)
 WHERE q.id // 1000000 % 50 = 0 GROUP BY ALL HAVING count(*) >= 5""")
def similarity_candidates(spark: SparkSession, d: str) -> DataFrame:
    postings = similarity.capped(similarity.signatures(V.chains(spark, d), "heavy"))
    asked = postings.where(F.floor(F.col("id") / 1000000) % 50 == 0).select(F.col("id").alias("query_id"), "hash")
    return similarity.candidates(asked, postings).where("shared >= 5")


def _edges_sql(where: str, paired: bool = False, p: str = "", capped: bool = True) -> str:
    """CTEs that end in ``{p}edges(a, b, identity)`` between classes of equal chains in the scope ``where``; those not ``capped`` count all hashes."""
    own = "heavy, light" if paired else "heavy"
    near = lambda x, y: f"CASE WHEN 100 * least(length({x}), length({y})) / greatest(length({x}), length({y})) + 1e-9 >= 90 AND levenshtein({x}, {y}) <= floor(greatest(length({x}), length({y})) * 10 / 100 + 1e-9) THEN round(100 * (greatest(length({x}), length({y})) - levenshtein({x}, {y})) / greatest(length({x}), length({y})), 4) END"
    identity = f"CASE WHEN {near('x.heavy', 'y.heavy')} IS NOT NULL THEN least({near('x.heavy', 'y.heavy')}, {near('x.light', 'y.light')}) END" if paired else near("x.heavy", "y.heavy")
    light = f", {V.signature_sql(p + 'classes', 'light', p + 'lsig')}, {p}lboth AS (SELECT a, b FROM {p}couples JOIN {p}lsig l ON l.id = a JOIN {p}lsig r ON r.id = b AND l.hash = r.hash GROUP BY ALL HAVING count(*) >= 5)" if paired else ""
    least = f"{p}lboth" if paired else f"{p}couples"
    both = "AND identity IS NOT NULL" + (" AND light_ok" if paired else "")
    light_ok = f", {near('x.light', 'y.light')} IS NOT NULL AS light_ok" if paired else ""
    cap = f"hash NOT IN (SELECT hash FROM {p}sig GROUP BY hash HAVING count(*) > 250) AND " if capped else ""
    return f"""{p}scope AS (SELECT id, {own} FROM chains WHERE length(heavy) >= 40 AND {where}), {p}classes AS (SELECT {own}, min(id) AS id FROM {p}scope GROUP BY ALL),
 {p}sig AS (SELECT s.id, hash FROM signatures s JOIN {p}scope USING (id)), {p}mark AS (SELECT hash, id FROM {p}sig WHERE {cap}id IN (SELECT id FROM {p}classes)),
 {p}couples AS (SELECT l.id AS a, r.id AS b FROM {p}mark l JOIN {p}mark r ON l.hash = r.hash AND l.id < r.id GROUP BY ALL HAVING count(*) >= 5){light},
 {p}edges AS (SELECT a, b, identity FROM (SELECT a, b, {identity} AS identity{light_ok} FROM {least} JOIN {p}classes x ON a = x.id JOIN {p}classes y ON b = y.id) t WHERE true {both})"""


_EDGES = f"{V.CHAINS}, {V.SIGNATURES}, {_edges_sql('true')}"
_PAIRED_EDGES = f"{V.CHAINS}, {V.SIGNATURES}, {_edges_sql('length(light) >= 40', True)}"
_ALL_EDGES = f"{V.CHAINS}, {V.SIGNATURES}, {_edges_sql('true', capped=False)}"
_ALL_PAIRED_EDGES = f"{V.CHAINS}, {V.SIGNATURES}, {_edges_sql('length(light) >= 40', True, capped=False)}"


@query(f"WITH {_EDGES} SELECT a, b, identity FROM edges")
def cluster_edges_90(spark: SparkSession, d: str) -> DataFrame:
    return clusters.edges(V.chains(spark, d))


def _clusters_sql(level: int, edges: str = _EDGES, same: str = "s.heavy = c.heavy") -> str:
    return f"""WITH RECURSIVE {edges}, e AS (SELECT a, b FROM edges WHERE identity + 1e-9 >= {level} UNION SELECT b, a FROM edges WHERE identity + 1e-9 >= {level}),
 reach AS (SELECT id AS n, id AS r FROM classes UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n WHERE reach.r < e.b),
 root AS (SELECT n, min(r) AS r FROM reach GROUP BY n),
 member AS (SELECT s.id, r AS representative_id FROM scope s JOIN classes c ON {same} JOIN root ON n = c.id),
 size AS (SELECT representative_id, count(*) AS size FROM member GROUP BY ALL HAVING count(*) > 1)
 SELECT id, representative_id, size FROM member JOIN size USING (representative_id)"""


_BOTH = "s.heavy = c.heavy AND s.light = c.light"
_NO_LIGHT = "light = ''"
_LONE_EDGES = f"{V.CHAINS}, {V.SIGNATURES}, {_edges_sql(_NO_LIGHT)}"


def _cluster_query(level: int, capped: bool) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return clusters.clusters(_both(spark, d), level, capped=False) if not capped else clusters.clusters(V.chains(spark, d), level)

    f.__name__ = f"clusters_heavy_{level}"
    query(_clusters_sql(level) if capped else _clusters_sql(level, _ALL_EDGES))(f)


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Chains written once, for steps that read them again and again."""
    return materialize(V.chains(spark, d).select("id", "doc_id", "heavy", "light"), "chains")


for _level in clusters.LEVELS:
    _cluster_query(_level, _level > 90)


@query(_clusters_sql(90, _PAIRED_EDGES, _BOTH))
def clusters_paired_90(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(V.chains(spark, d), 90, ("heavy", "light"))


_LIGHT = V.CHAINS.replace("chains AS (", "base AS (", 1) + ", chains AS (SELECT id, light AS heavy FROM base)"
_ALL_LIGHT_EDGES = f"{_LIGHT}, {V.SIGNATURES}, {_edges_sql('true', capped=False)}"


@query(_clusters_sql(90, _ALL_LIGHT_EDGES))
def clusters_light_90(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_both(spark, d), 90, ("light",), capped=False)


@query(f"""WITH p AS ({_clusters_sql(90, _ALL_PAIRED_EDGES, _BOTH)}), h AS ({_clusters_sql(90, _ALL_EDGES)}), l AS ({_clusters_sql(90, _ALL_LIGHT_EDGES)}), {V.CHAINS},
 m AS (SELECT 'heavy_light' AS scope, * FROM p UNION ALL SELECT 'heavy', * FROM h UNION ALL SELECT 'light', * FROM l),
 a AS (SELECT id, CASE WHEN heavy <> '' AND light <> '' THEN 'heavy_light' WHEN heavy <> '' THEN 'heavy' ELSE 'light' END AS scope FROM chains WHERE doc_id % 50 = 0),
 f AS (SELECT scope, representative_id, array_to_string(list_sort(list(id)), '|') AS members FROM m GROUP BY ALL)
 SELECT a.id, a.scope, coalesce(m.representative_id, a.id) AS representative_id, coalesce(size, 1) AS size, coalesce(members, CAST(a.id AS VARCHAR)) AS members
 FROM a LEFT JOIN m ON m.id = a.id AND m.scope = a.scope LEFT JOIN f ON f.scope = a.scope AND f.representative_id = m.representative_id""")
def cluster_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the lines of every fiftieth document, each in the scope of its chains."""
    c = _both(spark, d)
    members = {s: clusters.clusters(c, 90, f, capped=False) for s, f in (("heavy_light", ("heavy", "light")), ("heavy", ("heavy",)), ("light", ("light",)))}
    found = clusters.scoped_lookup(c, members, c.where("doc_id % 50 = 0").select("id"), most=None)
    return found.select("id", "scope", "representative_id", "size", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"))


@query(f"""WITH {V.CHAINS} SELECT DISTINCT id || ':' || source || ':' || doc_id AS id, id || ':' || source || ':' || doc_id AS kept_id FROM chains""")
def redundancy_source_records(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d)
    records = c.select("id", "source", F.col("doc_id").alias("record_id"))
    return clusters.redundancy(c.withColumn("ord", F.col("id")), "source_records", records=records)


@query(f"""WITH m AS ({_clusters_sql(95, _ALL_EDGES)}), l AS (SELECT representative_id, array_to_string(list_sort(list(id)), '|') AS members FROM m GROUP BY 1), {V.CHAINS}
 SELECT c.id, coalesce(m.representative_id, c.id) AS representative_id, coalesce(size, 1) AS size, coalesce(members, CAST(c.id AS VARCHAR)) AS members FROM chains c LEFT JOIN m USING (id) LEFT JOIN l ON l.representative_id = m.representative_id WHERE c.doc_id % 50 = 0""")
def cluster_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = _both(spark, d)
    found = clusters.lookup(clusters.clusters(c, 95, capped=False), c.where("doc_id % 50 = 0").select("id"), most=None)
    return found.select("id", "representative_id", "size", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"))


@query(f"""WITH {V.CHAINS} SELECT id, CASE WHEN heavy <> '' OR light <> '' THEN min(id) OVER (PARTITION BY heavy, light) ELSE id END AS kept_id FROM chains""")
def redundancy_unique_chains(spark: SparkSession, d: str) -> DataFrame:
    return clusters.redundancy(V.chains(spark, d).withColumn("ord", F.col("id")), "unique_chains")


@query(f"""WITH p AS ({_clusters_sql(95, _PAIRED_EDGES, _BOTH)}), h AS ({_clusters_sql(95, _LONE_EDGES)}), m AS (SELECT id, representative_id FROM p UNION ALL SELECT id, representative_id FROM h), {V.CHAINS}
 SELECT c.id, coalesce(min(c.id) OVER (PARTITION BY coalesce(representative_id, c.id)), c.id) AS kept_id FROM chains c LEFT JOIN m USING (id)""")
def redundancy_cluster_95(spark: SparkSession, d: str) -> DataFrame:
    return clusters.redundancy(V.chains(spark, d).withColumn("ord", F.col("id")), "cluster_95")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """All lines of every fiftieth document as query chains, and benchmark items, whose ids are ``-1 - item_id``."""
    lines = V.chains(spark, d).where("doc_id % 50 = 0 and heavy <> ''").select(F.col("id").alias("query_id"), F.col("heavy").alias("sequence"))
    letters = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "ACDEFG")
    items = V.table(spark, d, "benchmark").select((-1 - F.col("item_id")).cast("long").alias("query_id"), letters.alias("sequence"))
    return lines.union(items.where("length(sequence) >= 40"))


@query()
def similarity_strict(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar(_asked(spark, d), V.chains(spark, d), "heavy")


@query()
def similarity_loose(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar(_asked(spark, d), V.chains(spark, d), "heavy", mode="loose")


@query()
def paired_similarity(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d)
    return similarity.paired_similar(c.where("doc_id % 50 = 0").select(F.col("id").alias("query_id"), "heavy", "light"), c, exclude_self=True)


@query(f"""WITH RECURSIVE items AS (SELECT item_id AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark ORDER BY item_id LIMIT 10),
 first AS (SELECT id AS reference_id, s AS a FROM items ORDER BY id LIMIT 1), pairs AS (SELECT reference_id, id AS k, a, s AS b FROM items, first WHERE id <> reference_id), {V.alignment_sql()}
 SELECT reference_id, k AS id, 100.0::DOUBLE * m / r AS identity, 100.0::DOUBLE * r / length(a) AS coverage, score FROM aligned JOIN pairs USING (k)""")
def compare_entities(spark: SparkSession, d: str) -> DataFrame:
    lines = V.table(spark, d, "benchmark").orderBy("item_id").limit(10).select(F.col("item_id").alias("id"), F.col("item_id").alias("ord"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("heavy"))
    return similarity.compare(lines, "heavy")


@query(f"""WITH {V.CLAIMS}, {V.RESULTS}, {V.ANTIBODIES} SELECT target_id, antibody_id, rank_score + CASE WHEN structure_exact THEN 5 ELSE 0 END + CASE WHEN therapeutic_status <> '' THEN 3 ELSE 0 END AS score
 FROM results JOIN antibodies USING (antibody_id) WHERE family = 'direct' AND list_contains(evidence, 'MEASURED') AND list_has_any(sources, ['s0', 's1']) AND has_heavy AND has_light""")
def filters_and_rank(spark: SparkSession, d: str) -> DataFrame:
    kept = search.filters(_named_results(spark, d).where("family = 'direct'"), sources=["s0", "s1"], evidence=["MEASURED"], paired=True)
    return kept.select("target_id", "antibody_id", search.view_score(F.lit(False)).cast("long").alias("score"))


@query(f"""WITH {V.ANTIBODIES} SELECT antibody_id, CASE WHEN trim(organism) = '' THEN 'unknown' WHEN regexp_matches(lower(organism), 'human|homo sapiens') THEN 'human'
 WHEN regexp_matches(lower(organism), 'mouse|murine|mus musculus') THEN 'mouse' ELSE 'other' END AS origin FROM antibodies""")
def reported_origin(spark: SparkSession, d: str) -> DataFrame:
    return V.antibodies(spark, d).select("antibody_id", R.reported_origin("organism").alias("origin"))


@query(f"""WITH {V.CLAIMS}, {V.ANTIBODIES} SELECT antibody_id, name FROM antibodies WHERE has_heavy AND therapeutic_status <> '' AND contains(lower(name), '00') AND antibody_id IN (SELECT antibody_id FROM family WHERE family = 'direct')""")
def browse_facets(spark: SparkSession, d: str) -> DataFrame:
    direct = V.claims(spark, d).where(R.family("relationship") == "direct").select("antibody_id").distinct()
    kept = V.antibodies(spark, d).where(F.col("has_heavy") & (F.col("therapeutic_status") != "") & F.lower("name").contains("00"))
    return kept.join(direct, "antibody_id", "left_semi").select("antibody_id", "name")


_RAW = "(CASE event_id % 7 WHEN 0 THEN '<' WHEN 1 THEN '>=' WHEN 2 THEN '~ ' WHEN 3 THEN 'about ' ELSE '' END) || CAST(event_id % 1000 AS VARCHAR) || '.5'"


@query(f"""SELECT event_id, CASE WHEN event_id % 7 = 3 THEN NULL ELSE CAST(event_id % 1000 AS DOUBLE) + 0.5 END AS value,
 CASE event_id % 7 WHEN 0 THEN '<' WHEN 1 THEN '>=' WHEN 2 THEN '~' ELSE '' END AS qualifier, {_RAW} AS raw_value FROM events""")
def measurement_parse(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").withColumn("raw", F.expr(_RAW.replace("VARCHAR", "STRING")))
    return e.select("event_id", R.measurement("raw").alias("m")).select("event_id", "m.value", "m.qualifier", "m.raw_value")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'IC50' WHEN 1 THEN 'KD' WHEN 2 THEN 'KOFF' WHEN 3 THEN 'EC50' WHEN 4 THEN 'KON' ELSE '' END AS metric, event_id % 6 IN (1, 2, 4, 5) AS binding FROM events""")
def metric_sniff(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 6
    response = F.when(m == 0, "neutralization ic 50").when(m == 1, "dissociation constant KD").when(m == 2, "k off").when(m == 3, "ec50 titer").when(m == 4, "kon").otherwise("qualitative binding")
    metric = R.metric(response)
    return V.table(spark, d, "events").select("event_id", metric.alias("metric"), R.is_binding_assay(F.lit("x"), response, metric).alias("binding"))


@query("""WITH g AS (SELECT user_id, list_sort(list(DISTINCT event_id)) AS ids FROM events GROUP BY user_id), x AS (SELECT user_id, unnest(ids) AS event_id FROM g)
 SELECT x.user_id, count(*) AS n_assays, round(sum(value), 2) AS total FROM x JOIN events USING (event_id) GROUP BY x.user_id""")
def assay_linked_join(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    literal = e.groupBy("user_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set(F.col("event_id").cast("string"))), ","), F.lit("}")).alias("ids"))
    linked = literal.select("user_id", F.explode(T.array_literal("ids")).alias("event_id")).withColumn("event_id", F.col("event_id").cast("long"))
    return linked.join(e.select("event_id", "value"), "event_id").groupBy("user_id").agg(F.count("*").alias("n_assays"), F.round(F.sum("value"), 2).alias("total"))


_CODON_SQL = "codons(aa, codon) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in S.CODONS["human"].items()) + ")"


@query(f"""WITH {V.CHAINS}, {_CODON_SQL}, c AS (SELECT id, unnest(range(1, length(heavy) + 1)) AS p, heavy FROM chains WHERE heavy <> '')
 SELECT id, md5(string_agg(codon, '' ORDER BY p)) AS coding_md5, CAST(sum(length(codon)) AS BIGINT) AS length FROM c JOIN codons ON aa = substr(heavy, p, 1) GROUP BY id""")
def back_translate(spark: SparkSession, d: str) -> DataFrame:
    c = V.chains(spark, d).select("id", S.back_translate("heavy").alias("nt")).where("nt is not null")
    return c.select("id", F.md5("nt").alias("coding_md5"), F.length("nt").cast("long").alias("length"))


@query("""SELECT source, lang AS reference, '' AS record_url, CAST(n_chars % 10 AS VARCHAR) AS record_id, array_to_string(list_sort(list(DISTINCT doc_id)), '|') AS ids FROM documents GROUP BY ALL""")
def citations_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("source", F.col("lang").alias("reference"), F.lit("").alias("record_url"), (F.col("n_chars") % 10).cast("string").alias("record_id"), F.col("doc_id").alias("antibody_id"))
    return exports.citations(docs).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|"))


@query(f"""WITH {V.CHAINS}, e AS (SELECT id, source, unnest(['heavy', 'light']) AS chain, unnest([heavy, light]) AS s FROM chains)
 SELECT id, chain, '>' || id || '|' || source || '|' || chain || chr(10) || regexp_replace(regexp_replace(s, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS record FROM e WHERE s <> ''""")
def fasta_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.fasta(V.chains(spark, d).withColumn("name", F.col("source")))


@query("""SELECT doc_id || ',' || source || ',' || CASE WHEN regexp_matches(text, '[",' || chr(13) || chr(10) || ']') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS line FROM documents""")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    return exports.csv_lines(V.table(spark, d, "documents"), ("doc_id", "source", "text"))


@query(f"""WITH {V.CHAINS}, q AS (SELECT item_id, i, upper(regexp_replace(l[i], '[[:space:]]+', '', 'g')) AS s FROM (SELECT item_id, string_split(regexp_replace(text, '[.,]', '', 'g'), chr(10)) AS l FROM benchmark) t, unnest(range(1, len(l) + 1)) AS u(i)),
 x AS (SELECT item_id * 1000 + i AS query_id, s, regexp_matches(s, '[^A-Z*]') OR s = '' AS bad FROM q), h AS (SELECT id, upper(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS heavy FROM chains)
 SELECT query_id, CASE WHEN bad THEN 'INVALID' WHEN id IS NULL THEN 'NO MATCH' ELSE 'EXACT' END AS status, id FROM x LEFT JOIN h ON NOT bad AND heavy = s""")
def batch_screen(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("text", "[.,]", "")
    asked = V.table(spark, d, "benchmark").select("item_id", F.posexplode(F.split(plain, "\n", -1)).alias("i", "raw")).select((F.col("item_id") * 1000 + F.col("i") + 1).alias("query_id"), "raw")
    held = V.chains(spark, d).select("id", F.upper(F.regexp_replace("line", "[^A-Za-z]", "")).alias("heavy"))
    return screening.screen(asked, held).select("query_id", "status", "id")


_VARIANTS = f"""{V.CHAINS}, base AS (SELECT id, heavy FROM chains WHERE length(heavy) >= 80), {V.signature_sql('base', 'heavy', 'basesig')}, kept AS (SELECT hash, id FROM basesig WHERE hash NOT IN (SELECT hash FROM basesig GROUP BY hash HAVING count(*) > 250)),
 v AS (SELECT id, heavy, length(heavy) AS n, unnest([100, 99, 95, 90, 80]) AS level FROM base), w AS (SELECT *, CAST(round_even(n * (100 - level) / 100.0, 0) AS INTEGER) AS e FROM v),
 chars AS (SELECT id, level, i, n, e, substr(heavy, i + 1, 1) AS c FROM w, unnest(range(0, n)) AS u(i)),
 made AS (SELECT id * 1000 + level AS id, string_agg(CASE WHEN (i + 1) * e // n > i * e // n THEN CASE WHEN c = 'A' THEN 'G' ELSE 'A' END ELSE c END, '' ORDER BY i) AS s FROM chars GROUP BY id, level), {V.signature_sql('made', 's', 'madesig')}"""


@query(f"""WITH {_VARIANTS}, hit AS (SELECT DISTINCT m.id FROM madesig m JOIN kept k ON k.hash = m.hash AND k.id = m.id // 1000)
 SELECT CAST(made.id % 1000 AS INTEGER) AS level, count(*) AS sample, count(hit.id) AS hits, round(count(hit.id) / count(*), 4) AS recall FROM made LEFT JOIN hit USING (id) GROUP BY 1""")
def recall_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return similarity.recall(V.chains(spark, d), "heavy")


@query("""SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) t WHERE regexp_matches(link, '^/[A-Z]')""")
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    return tabular.links(V.table(spark, d, "pages"), "^/[A-Z]")


@query("""SELECT count(*) AS n_ids, count(DISTINCT b) AS n_batches, max(b) AS last_batch FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 100 AS b FROM (SELECT DISTINCT event_id FROM events) t) u""")
def fetch_batches(spark: SparkSession, d: str) -> DataFrame:
    b = tabular.batches(V.table(spark, d, "events"), "event_id")
    return b.agg(F.count("*").alias("n_ids"), F.count_distinct("batch").alias("n_batches"), F.max("batch").alias("last_batch"))


@query(f"""WITH {V.CLAIMS} SELECT target_id, antibody_id, relationship, evidence, source FROM (SELECT *, row_number() OVER (PARTITION BY target_id, antibody_id
 ORDER BY CASE evidence WHEN 'MEASURED' THEN 5 WHEN 'CURATED' THEN 4 ELSE 3 END DESC, relationship, source) AS r FROM claims) t WHERE r = 1""")
def top_evidence(spark: SparkSession, d: str) -> DataFrame:
    return search.best_evidence(V.claims(spark, d)).select("target_id", "antibody_id", "relationship", "evidence", "source")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS r FROM events) t WHERE r = 1 ORDER BY ts DESC LIMIT 12""")
def recent_views(spark: SparkSession, d: str) -> DataFrame:
    return search.latest(V.table(spark, d, "events"), "event_type", "user_id", "ts").select("user_id", "event_type", "event_id")


@query(f"""WITH {V.ANTIBODIES}, q(antibody_id) AS (VALUES ('ab000001'), ('ab000099'), ('ab999999'))
 SELECT antibody_id, CASE WHEN name IS NULL THEN 'stale_id' ELSE 'ok' END AS status, name FROM q LEFT JOIN antibodies USING (antibody_id)""")
def stale_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([("ab000001",), ("ab000099",), ("ab999999",)], "id string")
    return search.lookup(V.antibodies(spark, d), ids).select("antibody_id", "status", "name")


@query(f"""WITH {V.CHAINS} SELECT id, """ + ", ".join(f"length(heavy) - length(translate(heavy, '{v}', '')) AS {k}" for k, v in S.RESIDUE_CLASSES.items()) + f""", length(translate(heavy, '{"".join(S.RESIDUE_CLASSES.values())}', '')) AS other FROM chains""")
def residue_composition(spark: SparkSession, d: str) -> DataFrame:
    return V.chains(spark, d).select("id", S.composition("heavy").alias("c")).select("id", "c.*")


@query("""SELECT source, count(DISTINCT doc_id) AS records, count(*) FILTER (contains(text, '|')) AS quarantined, count(*) AS interactions FROM documents GROUP BY source""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    marks = F.when(F.col("text").contains("|"), F.create_map(F.lit("text"), F.lit("bar"))).otherwise(F.create_map().cast("map<string,string>"))
    return exports.manifest(docs.select("source", F.col("doc_id").alias("record_id"), marks.alias("quarantine")), docs)


@query("""WITH f AS (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source) AS x FROM documents), r AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY doc_id // 3) AS k FROM f)
 SELECT source, doc_id FROM r WHERE k <= 5""")
def capped_record_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 3).alias("g"))
    return tabular.limit_groups(docs, "source", "g", "doc_id", 5).select("source", "doc_id")


@query("""WITH b(name, parent) AS (VALUES ('x', 'y'), ('y', 'x'), ('z', 'missing')) SELECT 'V8' AS rule, 'missing' AS subject, 'unknown parent' AS message
 UNION ALL SELECT 'V8', name, 'cycle' FROM b WHERE name IN ('x', 'y')""")
def validate_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The tree with planted defects: a cycle and a missing parent."""
    bad = spark.createDataFrame([("y", "x"), ("x", "y"), ("missing", "z")], "parent string, id string")
    tree = V.tree(spark, d)
    every = tree.select("id").union(tree.select("parent")).union(spark.createDataFrame([("x",), ("y",), ("z",)], "id string")).distinct()
    return validate.hierarchy(tree.union(bad), every)


@query(f"""WITH {V.CLAIMS}, {V.RESULTS} SELECT DISTINCT 'V6' AS rule, antibody_id AS subject, 'unknown antibody' AS message FROM results WHERE antibody_id NOT IN (SELECT 'ab' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer WHERE c_custkey % 10 <> 3)
 UNION ALL SELECT 'V6', antibody_id, 'row without claim of its family' FROM (VALUES ('ab000000')) t(antibody_id)""")
def validate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with planted defects: a tenth of the entities gone, and one row that no claim backs."""
    pages = targets.paged(_named_results(spark, d))
    extra = pages.where("antibody_id = 'ab000000'").limit(1).withColumn("target_id", F.lit("t-none"))
    kept = V.antibodies(spark, d).where("cast(substr(antibody_id, 3) as int) % 10 <> 3")
    return validate.pages(pages.union(extra), V.claims(spark, d), kept).distinct()


@query(f"""WITH {V.CHAINS} SELECT 'V10' AS rule, CAST(id AS VARCHAR) AS subject, 'hash or length differs' AS message FROM chains WHERE heavy <> '' AND id % 97 = 0
 UNION ALL SELECT 'V10', CAST(id AS VARCHAR), 'not indexed' FROM chains WHERE heavy <> '' AND id % 97 = 0""")
def validate_sequences(spark: SparkSession, d: str) -> DataFrame:
    """A sequence index with planted wrong lengths."""
    c = V.chains(spark, d)
    index = search.sequence_index(c, ("heavy",)).withColumn("length", F.when(F.col("id") % 97 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return validate.sequences(index, c, "heavy")


@query(f"""WITH {_TERMS} SELECT 'V9' AS rule, term AS subject, 'named but not indexed' AS message FROM terms WHERE id LIKE 'c%7'""")
def validate_names(spark: SparkSession, d: str) -> DataFrame:
    """A name index from which some ids were lost."""
    terms = search.name_terms(_names(spark, d), unicode_=False)
    return validate.names(search.exact_index(terms.where("id not like 'c%7'")), terms)


@query("""SELECT 'V7' AS rule, CAST(event_id AS VARCHAR) AS subject, 'vocabulary' AS message FROM events WHERE event_id % 500 = 1
 UNION ALL SELECT 'V7', CAST(event_id AS VARCHAR), 'not finite' FROM events WHERE event_id % 500 = 2""")
def validate_measurements(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 500
    rows = V.table(spark, d, "events").select(
        F.col("event_id").alias("interaction_id"),
        F.when(m == 1, "TM").otherwise("KD").alias("metric"),
        F.lit("").alias("qualifier"),
        F.when(m == 2, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
        F.col("event_id").cast("string").alias("assay_id"),
        F.col("value").cast("string").alias("raw_value"),
    )
    return validate.measurements(rows)


@query(f"""WITH m AS ({_clusters_sql(95)}) SELECT DISTINCT 'V13' AS rule, CAST(representative_id AS VARCHAR) AS subject, 'cluster shape' AS message FROM m WHERE representative_id % 3 = 1 UNION ALL SELECT 'V13', '-5', 'duplicate id' UNION ALL SELECT 'V13', '-5', 'cluster shape'""")
def validate_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with planted defects: sizes too large by one, and a member that is listed twice."""
    found = clusters.clusters(V.chains(spark, d), 95)
    wrong = found.withColumn("size", F.when(F.col("representative_id") % 3 == 1, F.col("size") + 1).otherwise(F.col("size")))
    return validate.cluster_members(wrong.union(spark.createDataFrame([(-5, -5, 1), (-5, -5, 1)], "id long, representative_id long, size long")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked target pages: claims rolled up, ranked and numbered."""
    return target_results_ranked(spark, sf_dir)
