"""Queries of page and index sizes, merges, views, cases and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import sequences as S
from sequor.operators import exports, gold, previews, screening, search, similarity, targets, validate
from sequor.plans import views as V
from sequor.plans.catalog import query

_PAGED = f"""{V.CLAIMS}, {V.RESULTS}, placed AS (SELECT target_id, family, antibody_id, rank_score, row_number() OVER (PARTITION BY target_id, family ORDER BY rank_score DESC, antibody_id) AS position FROM results),
 paged AS (SELECT *, CAST(ceil(position / 20.0) AS BIGINT) AS page FROM placed)"""


def _paged(spark: SparkSession, d: str) -> DataFrame:
    rows = targets.results(V.claims(spark, d)).select("target_id", "family", "antibody_id", "rank_score")
    return targets.paged(rows, name="antibody_id", size=20)


@query(f"""WITH {_PAGED} SELECT target_id, family, page, count(*) AS rows, CAST(sum(length('{{"antibody_id":"' || antibody_id || '","rank_score":' || rank_score || ',"position":' || position || '}}') + 1) AS BIGINT) AS bytes FROM paged GROUP BY ALL""")
def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    return exports.part_sizes(_paged(spark, d).select("target_id", "family", "page", "antibody_id", "rank_score", "position"), ("target_id", "family", "page"))


@query(f"""WITH {V.CHAINS}, {V.SIGNATURES}, {_PAGED.replace('WITH ', '')} SELECT 'postings' AS index, substr(printf('%08x', hash), 1, 1) AS part, count(*) AS rows, CAST(sum(length('{{"hash":' || hash || ',"id":' || id || '}}') + 1) AS BIGINT) AS bytes FROM postings GROUP BY 2
 UNION ALL SELECT 'pages', family, count(*), CAST(sum(length('{{"target_id":"' || target_id || '","antibody_id":"' || antibody_id || '"}}') + 1) AS BIGINT) FROM paged GROUP BY family""")
def index_parts(spark: SparkSession, d: str) -> DataFrame:
    digit = F.substring(F.lpad(F.lower(F.hex("hash")), 8, "0"), 1, 1)
    postings = similarity.capped(similarity.signatures(V.chains(spark, d), "heavy")).select(digit.alias("digit"), "hash", "id")
    pages = _paged(spark, d).select("family", "target_id", "antibody_id")
    return exports.index_manifest({"postings": (postings, ("digit",)), "pages": (pages, ("family",))})


@query(f"""WITH {_PAGED}, n AS (SELECT target_id, family, page, count(*) FILTER (antibody_id LIKE '%3' OR antibody_id LIKE '%7') AS n FROM paged GROUP BY ALL),
 c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY target_id, family ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
 SELECT target_id, family, page, antibody_id FROM paged JOIN c USING (target_id, family, page) WHERE before < 6 AND (antibody_id LIKE '%3' OR antibody_id LIKE '%7')""")
def filled_view(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each target until six rows pass a filter."""
    pages = _paged(spark, d)
    return search.filled(pages, pages.where(F.col("antibody_id").rlike("[37]$")), 6).select("target_id", "family", "page", "antibody_id")


@query(f"""WITH {V.CLAIMS}, e AS (SELECT antibody_id, 'i' || event_id % 40 AS iid, event_id, evidence, relationship FROM claims),
 l AS (SELECT antibody_id, iid, arg_max(relationship || ':' || event_id, event_id) AS kept, min(event_id) AS pos FROM e GROUP BY ALL)
 SELECT antibody_id, count(*) AS n, string_agg(iid || '=' || kept, '|' ORDER BY pos) AS interactions FROM l GROUP BY antibody_id""")
def interactions_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose ids repeat: each antibody keeps the last of each id, where the first stood."""
    one = F.array(F.struct(F.concat(F.lit("i"), F.col("event_id") % 40).alias("interaction_id"), F.concat_ws(":", "relationship", "event_id").alias("note")))
    rows = V.claims(spark, d).select("antibody_id", "event_id", one.alias("interactions"))
    merged = search.merge_interactions(rows, "antibody_id", F.col("event_id"))
    told = F.transform("interactions", lambda i: F.concat_ws("=", i["interaction_id"], i["note"]))
    return merged.select("antibody_id", F.size("interactions").cast("long").alias("n"), F.array_join(told, "|").alias("interactions"))


_VIEW = f"""{V.CLAIMS}, {V.RESULTS}, {V.ANTIBODIES}, told AS (SELECT *, CASE WHEN antibody_id LIKE '%4' THEN 'humanized' ELSE '' END AS genetics,
 CASE WHEN has_heavy AND has_light THEN 'paired' WHEN has_heavy THEN 'heavy_only' WHEN has_light THEN 'light_only' ELSE 'no_full_chain' END AS pairing FROM antibodies)"""


@query(f"""WITH {_VIEW}, o AS (SELECT *, trim(lower(organism || ' ' || genetics)) AS t FROM told), r AS (SELECT results.*, pairing, CASE WHEN t = '' THEN 'unknown' WHEN regexp_matches(t, 'human|homo sapiens') THEN 'human' WHEN regexp_matches(t, 'mouse|murine|mus musculus') THEN 'mouse' ELSE 'other' END AS origin FROM results JOIN o USING (antibody_id))
 SELECT mode, class, origin_asked, count(*) AS n, min(target_id || antibody_id) AS least FROM r, (VALUES ('positive', 'paired', 'human'), ('functional', 'heavy_only', 'mouse'), ('negative', 'cdr_only', 'unknown'), ('positive', 'light_only', 'other')) f(mode, class, origin_asked)
 WHERE family = CASE mode WHEN 'positive' THEN 'direct' ELSE mode END AND pairing = CASE class WHEN 'cdr_only' THEN 'no_full_chain' ELSE class END AND origin = origin_asked GROUP BY ALL""")
def view_filters(spark: SparkSession, d: str) -> DataFrame:
    """Result rows by evidence mode, sequence class and origin told by organism and genetics."""
    h, li = F.col("has_heavy"), F.col("has_light")
    pairing = F.when(h & li, "paired").when(h, "heavy_only").when(li, "light_only").otherwise("no_full_chain")
    facts = V.antibodies(spark, d).select("antibody_id", "organism", "therapeutic_status", "structure_exact", "has_heavy", "has_light", pairing.alias("pairing"), F.when(F.col("antibody_id").endswith("4"), "humanized").otherwise("").alias("genetics"))
    rows, out = targets.results(V.claims(spark, d)).join(facts, "antibody_id"), None
    for mode, kind, origin in (("positive", "paired", "human"), ("functional", "heavy_only", "mouse"), ("negative", "cdr_only", "unknown"), ("positive", "light_only", "other")):
        kept = search.filters(rows, origin=origin, sequence_class=kind, evidence_mode=mode)
        kept = kept.groupBy(F.lit(mode).alias("mode"), F.lit(kind).alias("class"), F.lit(origin).alias("origin_asked")).agg(F.count("*").alias("n"), F.min(F.concat("target_id", "antibody_id")).alias("least"))
        out = kept if out is None else out.union(kept)
    return out


@query(f"""WITH {V.ANTIBODIES} SELECT antibody_id, name FROM antibodies WHERE contains(lower(name), '1') AND has_light AND structure_exact AND therapeutic_status <> ''""")
def catalogue_facets(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(V.antibodies(spark, d), "1", has_light=True, structure_exact=True, therapeutic_status=True, has_heavy=False).select("antibody_id", "name")


@query("""WITH w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark),
 h AS (SELECT q.w AS query, s.w AS sequence, levenshtein(q.w, s.w) AS distance FROM w q JOIN w s ON abs(length(q.w) - length(s.w)) <= 1 WHERE levenshtein(q.w, s.w) <= CASE WHEN length(q.w) <= 8 THEN 1 ELSE 2 END)
 SELECT query, sequence, distance, row_number() OVER (PARTITION BY query ORDER BY distance, sequence) AS position FROM h""")
def region_order(spark: SparkSession, d: str) -> DataFrame:
    """Near regions of the benchmark's words in their order: by distance, then by sequence."""
    words = V.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.upper("w").alias("sequence")).distinct()
    hits = similarity.ranked_regions(similarity.near_regions(words.withColumnRenamed("sequence", "query"), words))
    placed = hits.withColumn("at", F.monotonically_increasing_id()).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "sequence", "distance"))).alias("l"))
    return placed.select("query", F.posexplode("l").alias("i", "e")).select("query", "e.sequence", "e.distance", (F.col("i") + 1).cast("long").alias("position"))


_GOLD = """e AS (SELECT o_custkey AS id, list(DISTINCT o_orderstatus) AS direct, list(DISTINCT substr(o_orderpriority, 1, 1)) AS exact FROM orders GROUP BY 1),
 c AS (SELECT c_custkey AS id, 'case ' || c_custkey AS case_id, ['F', 'O'] AS direct_targets, [CAST(c_custkey % 6 AS VARCHAR), '1'] AS exact_structures FROM customer)"""


@query(f"""WITH {_GOLD}, x AS (SELECT case_id, id, 'direct_targets' AS "check", unnest(direct_targets) AS m FROM c UNION SELECT case_id, id, 'exact_structures', unnest(exact_structures) FROM c)
 SELECT case_id, "check", m AS missing FROM x JOIN e USING (id) WHERE NOT list_contains(CASE "check" WHEN 'direct_targets' THEN direct ELSE exact END, m) UNION ALL SELECT case_id, 'entity', CAST(id AS VARCHAR) FROM c WHERE id NOT IN (SELECT id FROM e)""")
def gold_cases(spark: SparkSession, d: str) -> DataFrame:
    """Expected lists of every customer against what its orders have: misses by name."""
    entities = V.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("antibody_id")).agg(F.collect_set("o_orderstatus").alias("direct_targets"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("exact_structures"))
    key = F.col("c_custkey")
    cases = V.table(spark, d, "customer").select(key.cast("string").alias("antibody_id"), F.concat(F.lit("case "), key).alias("case_id"), F.array(F.lit("F"), F.lit("O")).alias("direct_targets"), F.array((key % 6).cast("string"), F.lit("1")).alias("exact_structures"))
    return gold.check_cases(cases, entities)


@query(f"""SELECT source, {V.digest_sql('k')} AS digest FROM (SELECT source, CAST(doc_id AS VARCHAR) || chr(31) || lang AS k FROM documents) t GROUP BY source""")
def source_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each source's records that their order does not change."""
    return V.table(spark, d, "documents").groupBy("source").agg(exports.multiset_digest("doc_id", "lang").alias("digest"))


_MEASURES = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '<' WHEN 1 THEN '!=' WHEN 2 THEN '' WHEN 3 THEN '~' WHEN 4 THEN 'about' ELSE '>=' END AS q, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '1e999' ELSE CAST(event_id AS VARCHAR) END AS raw FROM events"


@query(f"""SELECT event_id, q IN ('!=', 'about') OR raw = '' OR raw = '1e999' AS rejected, CASE WHEN q NOT IN ('!=', 'about') AND raw NOT IN ('', '1e999') THEN CAST(event_id AS DOUBLE) END AS value FROM ({_MEASURES}) t""")
def measurement_rejects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    q = F.element_at(F.array(*map(F.lit, ("<", "!=", "", "~", "about", ">="))), (k % 6 + 1).cast("int"))
    raw = F.when(k % 5 == 0, "").when(k % 5 == 1, "1e999").otherwise(k.cast("string"))
    return V.table(spark, d, "events").select("event_id", R.measurement(raw, q).alias("m")).select("event_id", F.col("m").isNull().alias("rejected"), "m.value")


@query("""SELECT 'V14' AS rule, o_orderpriority AS subject, 'no claim is linked to an assay' AS message FROM orders GROUP BY o_orderpriority HAVING count(*) FILTER (o_orderkey % 2 = 0 AND o_orderpriority NOT LIKE '3%') = 0""")
def validate_linked_assays(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    linked = F.when((k % 2 == 0) & ~F.col("o_orderpriority").startswith("3"), F.array(k.cast("string"))).otherwise(F.array().cast("array<string>"))
    claims = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), linked.alias("assay_ids"))
    out = None
    for source in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        one = validate.linked_assays(claims, source)
        out = one if out is None else out.union(one)
    return out


@query("""SELECT level, rows, true AS near FROM (SELECT 'records' AS level, count(DISTINCT l_orderkey) AS rows FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'pairs', count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem) t""")
def preview_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact numbers by level, and whether those merged from the sketches of parts are within 2 % of them."""
    rows = V.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", F.concat_ws(":", "l_partkey", "l_suppkey").alias("pair"))
    levels = {"records": "l_orderkey", "parts": "l_partkey", "pairs": "pair"}
    told = previews.preview(previews.sketches(rows, levels, ("l_returnflag",))).withColumnRenamed("rows", "about")
    return previews.selected(rows, levels).join(told, "level").select("level", "rows", (F.abs(F.col("about") - F.col("rows")) <= 0.02 * F.col("rows")).alias("near"))


@query(f"""WITH {V.CHAINS} SELECT id, upper(regexp_replace(trim(line), '[[:space:]]+', '', 'g')) AS strict FROM chains WHERE regexp_matches(upper(regexp_replace(trim(line), '[[:space:]]+', '', 'g')), '^[A-Z*]+$') AND lower(trim(line)) NOT IN ('na', 'n/a', 'nan', 'none', 'nd', 'not determined', 'unknown', '-')""")
def strict_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are sequences; one that is not would fail the query."""
    fine = V.chains(spark, d).where(S.has_only_residues("line")).where(S.residues("line") != "")
    return fine.select("id", S.strict_residues("line").alias("strict"))


_ITEMS = "items AS (SELECT item_id AS id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'ACDEFG') AS s FROM benchmark)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    letters = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "ACDEFG")
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), letters.alias("heavy"))


@query(f"""WITH RECURSIVE {_ITEMS}, {V.signature_sql('items', 's', 'sg')}, post AS (SELECT hash, id FROM sg WHERE hash NOT IN (SELECT hash FROM sg GROUP BY hash HAVING count(*) > 250)),
 found AS (SELECT q.id AS query_id, p.id, count(*) AS shared FROM sg q JOIN post p USING (hash) GROUP BY ALL),
 pairs AS (SELECT query_id * 1000000 + found.id AS k, query_id, found.id, shared, x.s AS a, y.s AS b FROM found JOIN items x ON x.id = query_id JOIN items y ON y.id = found.id WHERE least(length(x.s), length(y.s)) * 100 >= greatest(length(x.s), length(y.s)) * 45 AND least(length(x.s), length(y.s)) * 100 >= length(x.s) * 70),
 {V.alignment_sql()} SELECT query_id, id, shared, round(100.0::DOUBLE * m / c, 3) AS identity, round(100.0::DOUBLE * r / length(a), 3) AS coverage, score FROM aligned JOIN pairs USING (k) WHERE round(100.0::DOUBLE * m / c, 3) >= 45 AND round(100.0::DOUBLE * r / length(a), 3) >= 70""")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """All items of the benchmark among all of them, in the strict mode."""
    rows = _items(spark, d)
    return similarity.similar(rows.withColumnsRenamed({"id": "query_id", "heavy": "sequence"}), rows, "heavy")


_SCREENED = f"""{_ITEMS}, asked AS (SELECT id AS query_id, CASE WHEN id % 2 = 0 THEN s WHEN id % 7 = 0 THEN '' WHEN id % 3 = 0 THEN repeat('W', 60) ELSE substr(s, 1, length(s) * 4 // 5) END AS q FROM items),
 hit AS (SELECT query_id, id FROM asked JOIN items ON q = s AND q <> ''), rest AS (SELECT query_id AS id, q FROM asked WHERE q <> '' AND query_id NOT IN (SELECT query_id FROM hit)),
 {V.signature_sql('rest', 'q', 'qs')}, {V.signature_sql('items', 's', 'sg')}, post AS (SELECT hash, id FROM sg WHERE hash NOT IN (SELECT hash FROM sg GROUP BY hash HAVING count(*) > 250)),
 found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) AS n FROM (SELECT x.id AS query_id, p.id, count(*) AS shared FROM qs x JOIN post p USING (hash) GROUP BY ALL) t),
 pairs AS (SELECT found.query_id * 1000000 + found.id AS k, found.query_id, found.id, q AS a, s AS b FROM found JOIN rest ON rest.id = found.query_id JOIN items ON items.id = found.id
  WHERE n <= 140 AND least(length(q), length(s))::DOUBLE / greatest(length(q), length(s)) >= 0.65 AND least(length(q), length(s)) * 100 >= length(q) * 70),
 {V.alignment_sql()}, alike AS (SELECT query_id, id, 100.0::DOUBLE * m / r AS identity, 100.0::DOUBLE * r / length(a) AS coverage FROM aligned JOIN pairs USING (k) WHERE r > 0 AND 100.0::DOUBLE * m / r >= 45 AND 100.0::DOUBLE * r / length(a) >= 70),
 out AS (SELECT query_id, id, 'EXACT' AS status, CAST(NULL AS DOUBLE) AS identity, CAST(NULL AS DOUBLE) AS coverage FROM hit UNION ALL SELECT query_id, id, 'SIMILAR', identity, coverage FROM alike),
 screened AS (SELECT query_id, q, CASE WHEN q = '' THEN 'INVALID' ELSE coalesce(status, 'NO MATCH') END AS status, id, CASE WHEN status = 'EXACT' THEN CAST(0 AS BIGINT) END AS distance, identity, coverage FROM asked LEFT JOIN out USING (query_id))"""


def _screened(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, k = _items(spark, d), F.col("id")
    raw = F.when(k % 2 == 0, F.col("heavy")).when(k % 7 == 0, "").when(k % 3 == 0, "W" * 60).otherwise(F.expr("substr(heavy, 1, cast(length(heavy) * 4 div 5 as int))"))
    return rows.select(k.alias("query_id"), raw.alias("raw")), rows


@query(f"WITH RECURSIVE {_SCREENED} SELECT query_id, status, id, distance FROM screened")
def screen_similar(spark: SparkSession, d: str) -> DataFrame:
    """Items of the benchmark, whole or shortened, empty or meaningless, screened against all of them."""
    return screening.screen(*_screened(spark, d), with_similar=True).select("query_id", "status", "id", "distance")


def _cells(*cells: str) -> str:
    return " || ',' || ".join(f"'\"' || coalesce(CAST({c} AS VARCHAR), '') || '\"'" for c in cells)


_REPORT = ("query_id", "q", "''", "''", "'single_chain'", "length(q)", "'heavy'", "status", "s", "distance", "round(identity, 3)", "round(coverage, 3)", "''", "''", "screened.id", "'item ' || screened.id", "''", "''", "'bench'", "'?ab=' || screened.id", "'S1'", "4")


@query(f"WITH RECURSIVE {_SCREENED} SELECT {_cells(*(c.replace(chr(39) + 'bench' + chr(39), 'CASE WHEN screened.id IS NOT NULL THEN ' + chr(39) + 'bench' + chr(39) + ' END') for c in _REPORT))} AS line FROM screened LEFT JOIN items ON items.id = screened.id")
def screening_items(spark: SparkSession, d: str) -> DataFrame:
    """The report of that screening, as quoted lines of 22 columns."""
    asked, rows = _screened(spark, d)
    rows = rows.withColumns({"name": F.concat(F.lit("item "), "id"), "sources": F.array(F.lit("bench"))})
    return exports.quoted_lines(screening.report(asked, rows, snapshot="S1", with_similar=True))


_RELATED = f"""{_ITEMS}, held AS (SELECT id, s FROM items UNION ALL SELECT id + 100000, substr(s, 1, length(s) * 4 // 5) FROM items), one AS (SELECT id, s AS q FROM items WHERE id = (SELECT min(id) FROM items)),
 {V.signature_sql('one', 'q', 'qs')}, {V.signature_sql('held', 's', 'sg')}, post AS (SELECT hash, id FROM sg WHERE hash NOT IN (SELECT hash FROM sg GROUP BY hash HAVING count(*) > 250)),
 found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) AS n FROM (SELECT x.id AS query_id, p.id, count(*) AS shared FROM qs x JOIN post p USING (hash) GROUP BY ALL) t),
 pairs AS (SELECT found.id AS k, query_id, found.id, q AS a, s AS b FROM found JOIN one ON one.id = query_id JOIN held ON held.id = found.id WHERE n <= 140 AND found.id <> query_id AND least(length(q), length(s))::DOUBLE / greatest(length(q), length(s)) >= 0.65 AND least(length(q), length(s)) * 100 >= length(q) * 70)"""


@query(f"WITH RECURSIVE {_RELATED}, {V.alignment_sql()} SELECT query_id, id, 100.0::DOUBLE * m / r * (100.0::DOUBLE * r / length(a)) / 100 AS similarity FROM aligned JOIN pairs USING (k) WHERE r > 0 AND 100.0::DOUBLE * m / r >= 45 AND 100.0::DOUBLE * r / length(a) >= 70")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    """Items and shortened items like the first one."""
    rows = _items(spark, d)
    short = rows.select((F.col("id") + 100000).alias("id"), F.expr("substr(heavy, 1, cast(length(heavy) * 4 div 5 as int))").alias("heavy"))
    first = rows.agg(F.min("id")).first()[0]
    return similarity.related(rows.union(short).withColumn("light", F.lit("")), first)


@query(f"""WITH RECURSIVE {_ITEMS}, first AS (SELECT s AS a FROM items ORDER BY id LIMIT 1), pairs AS (SELECT id AS k, a, s AS b FROM items, first WHERE id > 0 ORDER BY id LIMIT 12), {V.alignment_sql()}
 SELECT k AS id, CAST(m AS BIGINT) AS n_equal, CAST(2 * c - length(a) - length(b) AS BIGINT) AS n_gaps, CAST(c AS BIGINT) AS n_columns FROM aligned JOIN pairs USING (k)""")
def alignment_lines(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of a dozen items to the first as texts: their equal columns, gaps and all columns, counted in the lines shown."""
    rows = _items(spark, d)
    first = rows.orderBy("id").limit(1).select(F.col("heavy").alias("reference"))
    both = rows.where("id > 0").orderBy("id").limit(12).join(F.broadcast(first))
    shown = both.select("id", F.split(S.alignment_text("reference", "heavy"), "\n").alias("l"))
    # blocks are three lines and an empty one
    lines = lambda k: F.array_join(F.filter("l", lambda x, i: i % 4 == k), "")
    counted = lambda c, ch: (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("long")
    return shown.select("id", counted(lines(1), "|").alias("n_equal"), (counted(lines(0), "-") + counted(lines(2), "-")).alias("n_gaps"), F.length(lines(1)).cast("long").alias("n_columns"))
