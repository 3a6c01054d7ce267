"""Domain views over the general tables, in Spark and in SQL.

Records are the lines of ``documents``: a line's letters are its heavy chain and
the next line's its light chain.  Claims are ``events``: a user is an entity, the
property ``k`` a target, and the type of event tells the relationship.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.functions.sequences import GROUPS

#: Letters that are not amino acids, and what stands for them.
_FROM, _TO = "BJOUXZ", "ACDEFG"
# How types of events are read.
RELATIONS = {"purchase": "binds", "signup": "targets", "view": "neutralizes", "click": "mentioned_with", "error": "does_not_bind"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, doc_id, source, lang, line_no, line, heavy, light)``, one row for each line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split("text", "\n", -1).alias("l"))
    letters = F.transform("l", lambda x: F.translate(F.upper(F.regexp_replace(x, "[^A-Za-z]", "")), _FROM, _TO))
    each = docs.withColumn("h", letters).select("doc_id", "source", "lang", "l", "h", F.posexplode("h").alias("i", "heavy"))
    return each.select(
        (F.col("doc_id") * 1000000 + F.col("i") + 1).alias("id"),
        "doc_id",
        "source",
        "lang",
        (F.col("i") + 1).cast("long").alias("line_no"),
        F.element_at("l", F.col("i") + 1).alias("line"),
        "heavy",
        F.coalesce(F.try_element_at("h", F.col("i") + 2), F.lit("")).alias("light"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(antibody_id, target_id, target_name, relationship, evidence, source, value, event_id)``."""
    e = table(spark, sf_dir, "events")
    relation = F
    for kind, name in RELATIONS.items():
        relation = relation.when(F.col("event_type") == kind, name)
    k = F.get_json_object("props", "$.k")
    evidence = F.when(F.col("event_id") % 3 == 0, "MEASURED").when(F.col("event_id") % 3 == 1, "CURATED").otherwise("PUBLICATION")
    return e.select(
        F.concat(F.lit("ab"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("antibody_id"),
        F.concat(F.lit("t"), k).alias("target_id"),
        F.concat(F.lit("Target "), k).alias("target_name"),
        relation.otherwise("other").alias("relationship"),
        evidence.alias("evidence"),
        F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source"),
        "value",
        "event_id",
    )


def antibodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(antibody_id, name, organism, has_heavy, has_light, therapeutic_status, structure_exact, structure_homologous)`` of customers."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.concat(F.lit("ab"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("antibody_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("n_regionkey") == 0, "").when(F.col("n_regionkey") == 1, "Homo sapiens").when(F.col("n_regionkey") == 2, "Mus musculus").otherwise(F.col("n_name")).alias("organism"),
        (F.col("c_acctbal") > 0).alias("has_heavy"),
        (F.col("c_custkey") % 2 == 0).alias("has_light"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Approved").otherwise("").alias("therapeutic_status"),
        (F.col("c_custkey") % 5 == 0).alias("structure_exact"),
        (F.col("c_custkey") % 7 == 0).alias("structure_homologous"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(parent, id)`` of regions, nations and customers."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    return n.union(c)


CHAINS = f"""chains AS (
 SELECT doc_id * 1000000 + i AS id, doc_id, source, lang, i AS line_no, l[i] AS line, h[i] AS heavy, coalesce(h[i + 1], '') AS light
 FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l,
       list_transform(string_split(text, chr(10)), lambda x: translate(upper(regexp_replace(x, '[^A-Za-z]', '', 'g')), '{_FROM}', '{_TO}')) AS h
       FROM documents) d, unnest(range(1, len(h) + 1)) AS u(i))"""
CLAIMS = """claims AS (
 SELECT 'ab' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS antibody_id, 't' || k AS target_id, 'Target ' || k AS target_name,
  CASE event_type WHEN 'purchase' THEN 'binds' WHEN 'signup' THEN 'targets' WHEN 'view' THEN 'neutralizes' WHEN 'click' THEN 'mentioned_with'
   WHEN 'error' THEN 'does_not_bind' ELSE 'other' END AS relationship,
  CASE event_id % 3 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'CURATED' ELSE 'PUBLICATION' END AS evidence,
  's' || CAST(event_id % 4 AS VARCHAR) AS source, value, event_id
 FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events) e),
family AS (SELECT *, CASE WHEN relationship IN ('binds', 'targets') THEN 'direct' WHEN relationship IN ('neutralizes', 'protects') THEN 'functional'
  WHEN relationship = 'mentioned_with' THEN 'literature' WHEN regexp_matches(relationship, '^(does_)?not_') THEN 'negative' ELSE 'other' END AS family FROM claims)"""
ANTIBODIES = """antibodies AS (
 SELECT 'ab' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS antibody_id, c_name AS name,
  CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'Homo sapiens' WHEN 2 THEN 'Mus musculus' ELSE n_name END AS organism,
  c_acctbal > 0 AS has_heavy, c_custkey % 2 = 0 AS has_light, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Approved' ELSE '' END AS therapeutic_status,
  c_custkey % 5 = 0 AS structure_exact, c_custkey % 7 = 0 AS structure_homologous
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
RESULTS = """results AS (
 SELECT target_id, family, antibody_id, list_sort(list(DISTINCT relationship)) AS relationships, list_sort(list(DISTINCT evidence)) AS evidence,
  list_sort(list(DISTINCT source)) AS sources, count(*) AS n_interactions,
  CAST(max(CASE evidence WHEN 'MEASURED' THEN 5 WHEN 'CURATED' THEN 4 ELSE 3 END) * 100 + count(DISTINCT source) * 10 AS BIGINT) AS rank_score
 FROM family WHERE family IN ('direct', 'functional', 'negative') GROUP BY ALL)"""
TREE = """tree AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS id FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""
DOWN = """down AS (SELECT parent AS root, id, 1 AS depth FROM tree
 UNION ALL SELECT d.root, t.id, d.depth + 1 FROM down d JOIN tree t ON t.parent = d.id)"""


def signature_sql(source: str, col: str, out: str) -> str:
    """CTEs that end in ``out(id, hash)``: the 32 least hashes of 5-mers of a column of ``source(id, ...)``."""
    step = lambda inner, i: f"xor({inner}, ascii(substr(s, p + {i}, 1))::UBIGINT) * 16777619 % 4294967296"
    h = "2166136261::UBIGINT"
    for i in range(5):
        h = step(h, i)
    return f"""{out}_kmers AS (SELECT id, unnest(range(1, length({col}) - 3)) AS p, {col} AS s FROM {source} WHERE length({col}) >= 5),
{out}_fnv AS (SELECT DISTINCT id, h FROM (SELECT id, substr(s, p, 5) AS k, {h} AS h FROM {out}_kmers) t WHERE NOT regexp_matches(k, '[^ACDEFGHIKLMNPQRSTVWY]')),
{out} AS (SELECT id, CAST(h AS BIGINT) AS hash FROM (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS r FROM {out}_fnv) t WHERE r <= 32)"""


SIGNATURES = signature_sql("chains", "heavy", "signatures") + """,
postings AS (SELECT hash, id FROM signatures WHERE hash NOT IN (SELECT hash FROM signatures GROUP BY hash HAVING count(*) > 250))"""


def alignment_sql() -> str:
    """CTEs that end in ``aligned(k, score, m, c, r)`` of ``pairs(k, a, b)``: the recurrence of the alignment, antidiagonal by antidiagonal.

    A cell of age 0 offers itself to its neighbours below (2) and to the right (1), one of age 1
    diagonally (3); the best offer wins, and among equal ones the greater kind.
    """
    letter = lambda text, at: f"substr({text}, {at}, 1)"
    x, y = letter("p.a", "z.i + 1"), letter("p.b", "z.d - z.i + 1")
    groups = "[" + ", ".join(f"'{g}'" for g in GROUPS) + "]"
    sub = f"CASE WHEN {x} = {y} THEN 2 WHEN len(list_filter({groups}, lambda g: contains(g, {x}) AND contains(g, {y}))) > 0 THEN 1 ELSE -1 END"
    return f"""cells AS (SELECT k, 0 AS d, 0 AS i, 0 AS age, 0 AS score, 0 AS m, 0 AS c, 0 AS r FROM pairs UNION ALL
 SELECT k, d, i, age, v.score, v.m, v.c, v.r FROM (SELECT k, nd AS d, ni AS i, na AS age, arg_max(struct_pack(score := s, m := nm, c := nc, r := nr), (s, kind)) AS v FROM (
  SELECT z.k, kind, CASE kind WHEN 0 THEN z.d WHEN 3 THEN z.d + 2 ELSE z.d + 1 END AS nd, z.i + CAST(kind >= 2 AS INTEGER) AS ni, CAST(kind = 0 AS INTEGER) AS na, length(p.a) AS la, length(p.b) AS lb,
   z.score + CASE kind WHEN 0 THEN 0 WHEN 3 THEN {sub} ELSE -2 END AS s, z.m + CASE WHEN kind = 3 AND {x} = {y} THEN 1 ELSE 0 END AS nm, z.c + CAST(kind > 0 AS INTEGER) AS nc, z.r + CAST(kind = 3 AS INTEGER) AS nr
  FROM cells z JOIN pairs p USING (k), (VALUES (0), (1), (2), (3)) t(kind) WHERE (z.age = 1) = (kind = 3)) o WHERE ni <= la AND nd - ni <= lb GROUP BY k, nd, ni, na) w),
aligned AS (SELECT k, score, m, c, r FROM cells JOIN pairs USING (k) WHERE age = 0 AND i = length(a) AND d = length(a) + length(b))"""


def digest_sql(key: str) -> str:
    """The multiset digest of a text expression over a group."""
    lane = lambda at: f"CAST(coalesce(sum(CAST(CAST('0x' || substr(sha256({key}), {at}, 15) AS BIGINT) AS HUGEINT)), 0) % 1152921504606846976 AS VARCHAR)"
    return f"count(*) || '-' || {lane(1)} || '-' || {lane(16)}"
