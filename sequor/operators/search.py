"""Exact lookups, autocomplete, filters and ranking over built tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.functions import relations as R
from sequor.functions import text as T
from sequor.functions.sequences import SINGLE
from sequor.operators.targets import descendants


def name_terms(names: DataFrame, id_col: str = "id", unicode_: bool = True) -> DataFrame:
    """``(bucket, term, id)`` of every name and alias; ``names`` has ``name`` and may have ``aliases``."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in names.columns else F.array("name")
    terms = names.select(F.col(id_col).alias("id"), F.explode(every).alias("raw")).withColumn("term", T.search_term("raw", unicode_))
    return terms.where("term <> ''").select(T.search_bucket("term").alias("bucket"), "term", "id").distinct()


def exact_index(terms: DataFrame) -> DataFrame:
    """``(bucket, term, ids)``: every id of a term, sorted, without a cap."""
    return terms.groupBy("bucket", "term").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def exact_names(terms: DataFrame, queries: DataFrame, unicode_: bool = True) -> DataFrame:
    """``(query, status, ids)`` of each ``query``: none, one or multiple; a near name is never chosen."""
    asked = queries.select("query", T.search_term("query", unicode_).alias("term"))
    asked = asked.withColumn("bucket", T.search_bucket("term"))
    hits = asked.join(terms, ["bucket", "term"], "left").groupBy("query").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return hits.select("query", F.when(F.size("ids") == 0, "none").when(F.size("ids") == 1, "one").otherwise("multiple").alias("status"), "ids")


def text_score(value: Column, query: Column) -> Column:
    """10000 equal, 8000 prefix, 5000 contained, else 3200 less 450 an edit for up to two edits of texts of 4 or more."""
    edits = F.levenshtein(value, query, 2)
    near = (F.length(value) >= 4) & (F.length(query) >= 4) & (edits >= 0)
    return F.when((value == "") | (query == ""), 0).when(value == query, 10000).when(value.startswith(query), 8000).when(value.contains(query), 5000).when(near, 3200 - edits * 450).otherwise(0)


def autocomplete(terms: DataFrame, query: str, limit: int, boost: Column | None = None, least: int = 3) -> DataFrame:
    """Best ids for a typed query: each id's best term, the shorter one on a tie; ``query`` under ``least`` gives none."""
    q = T.search_term(F.lit(query), False)
    scored = terms.withColumn("score", text_score(F.col("term"), q)).where(F.col("score") > 0).where(F.length(q) >= least)
    best = scored.groupBy("id").agg(F.max_by("term", F.struct("score", -F.length("term"), "term")).alias("term"), F.max("score").alias("score"))
    best = best.withColumn("score", F.col("score") + boost) if boost is not None else best
    return best.orderBy(F.desc("score"), F.length("term"), "term", "id").limit(limit)


def sequence_index(rows: DataFrame, fields: tuple[str, ...] = ("heavy", "light"), id_col: str = "id") -> DataFrame:
    """``(sha, field, id, length)`` of every filled sequence field; ``shard`` prunes partitions."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in fields]))
    out = rows.select(F.col(id_col).alias("id"), each.alias("e")).where("e.s <> ''")
    out = out.select(F.sha2("e.s", 256).alias("sha"), F.col("e.field").alias("field"), "id", F.length("e.s").cast("long").alias("length"))
    return out.withColumn("shard", F.substring("sha", 1, 2))


def exact_sequences(index: DataFrame, queries: DataFrame, field: str = "auto") -> DataFrame:
    """``(query_id, id, field)`` of exact hits of ``queries(query_id, sequence)``; one field, or any."""
    asked = queries.select("query_id", F.sha2("sequence", 256).alias("sha"))
    hits = asked.join(index, "sha")
    return (hits if field == "auto" else hits.where(F.col("field") == field)).select("query_id", "id", "field", "length")


def paired_sequences(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Ids that hold both the heavy and the light chain of a query."""
    heavy = exact_sequences(index, queries.selectExpr("query_id", "heavy AS sequence"), "heavy")
    light = exact_sequences(index, queries.selectExpr("query_id", "light AS sequence"), "light")
    return heavy.select("query_id", "id").join(light.select("query_id", "id"), ["query_id", "id"], "left_semi").distinct()


def filters(
    rows: DataFrame,
    sources: list[str] | None = None,
    evidence: list[str] | None = None,
    origin: str | None = None,
    sequence_class: str | None = None,
    paired: bool = False,
    therapeutic: bool = False,
    structure: bool = False,
    evidence_mode: str | None = None,
) -> DataFrame:
    """Result rows that pass every filter given; list columns match on any listed value.

    ``origin`` is told by the organism and, where there is such a column, the
    genetics.  ``sequence_class`` is a pairing, ``cdr_only`` for none, or ``vhh``
    for explicit single domains.  ``evidence_mode`` (positive, functional or
    negative) wants a relationship of its kind.
    """
    out = rows
    if evidence_mode:
        kind = {"positive": lambda r: R.family(r) == "direct", "functional": lambda r: R.family(r) == "functional", "negative": R.is_negative}[evidence_mode]
        out = out.where(F.exists("relationships", kind))
    for col, wanted in (("sources", sources), ("evidence", evidence)):
        if wanted:
            out = out.where(F.arrays_overlap(col, F.array(*map(F.lit, wanted))))
    if origin:
        out = out.where(R.reported_origin("organism", *(["genetics"] if "genetics" in rows.columns else [])) == origin)
    if sequence_class == "vhh":
        out = out.where("single_domain")
    elif sequence_class:
        out = out.where(F.col("pairing") == {"cdr_only": "no_full_chain"}.get(sequence_class, sequence_class))
    if paired:
        out = out.where(F.col("has_heavy") & F.col("has_light"))
    if therapeutic:
        out = out.where(F.col("therapeutic_status") != "")
    return out.where("structure_exact") if structure else out


def view_score(in_target: Column, similarity: Column | None = None) -> Column:
    """Rank of a row in a view; outside a target, structures and status add to it, and a similarity replaces it."""
    base = F.col("rank_score") + F.when(in_target, 0).otherwise(F.when(F.col("structure_exact"), 5).otherwise(0) + F.when(F.col("therapeutic_status") != "", 3).otherwise(0))
    return base if similarity is None else F.coalesce(similarity * 10, base)


SORTS = {
    "evidence": lambda: (F.desc("rank_score"), F.lower("name"), F.col("antibody_id")),
    "name": lambda: (F.lower("name"), F.col("antibody_id")),
    "sources": lambda: (F.desc(F.size("sources")), F.lower("name"), F.col("antibody_id")),
}


def sort(rows: DataFrame, mode: str = "evidence") -> DataFrame:
    return rows.orderBy(*SORTS[mode]())


def merged_with_descendants(rows: DataFrame, tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of each root and everything below it, one for each antibody, sets united."""
    below = descendants(tree, roots).select("root", F.col("id").alias("target_id"))
    scope = below.union(roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("target_id"))).distinct()
    held = rows.join(scope, "target_id")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return held.groupBy("root", "family", "antibody_id").agg(union("relationships"), union("evidence"), union("sources"), F.count_distinct("target_id").alias("n_targets"))


def latest(views: DataFrame, kind: str, key: str, at: str, keep: int = 12) -> DataFrame:
    """Recently viewed items: the last view of each, newest first."""
    rank = F.row_number().over(Window.partitionBy(kind, key).orderBy(F.desc(at)))
    return views.withColumn("_r", rank).where("_r = 1").drop("_r").orderBy(F.desc(at), kind, key).limit(keep)


def timeline(records: DataFrame, date: str = "record_date") -> DataFrame:
    """Source records by date, undated ones last."""
    return records.orderBy(F.expr(f"try_to_timestamp({date})").asc_nulls_last(), "source", "record_id")


def best_evidence(claims: DataFrame) -> DataFrame:
    """Each (target, antibody)'s claim of highest evidence."""
    order = Window.partitionBy("target_id", "antibody_id").orderBy(F.desc(R.evidence_rank("evidence")), "relationship", "source")
    return claims.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def lookup(rows: DataFrame, ids: DataFrame, id_col: str = "antibody_id") -> DataFrame:
    """``(id, status, ...)`` of asked ids: a stale one is reported, never replaced."""
    asked = ids.select(F.col(ids.columns[0]).alias(id_col))
    return asked.join(rows.withColumn("_there", F.lit(True)), id_col, "left").withColumn("status", F.when(F.col("_there"), "ok").otherwise("stale_id")).drop("_there")


def no_match(hits: Column, complete: Column) -> Column:
    """An empty result means absence only where the snapshot is complete."""
    return F.when(hits > 0, "matches").when(complete, "no_match").otherwise("no_match_in_incomplete_snapshot")


def selection(current: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """A set of ids after adding and removing others; order does not matter, repeats don't count."""
    key = current.columns[0]
    out = current.select(key)
    if add is not None:
        out = out.union(add.select(F.col(add.columns[0]).alias(key)))
    if remove is not None:
        out = out.join(remove.select(F.col(remove.columns[0]).alias(key)), key, "left_anti")
    return out.distinct()


def missing_examples(terms: DataFrame, examples: DataFrame, unicode_: bool = True) -> DataFrame:
    """Advertised example queries that do not resolve to exactly one entity."""
    return exact_names(terms, examples, unicode_).where("status <> 'one'").select("query", "status")


def window(rows: DataFrame, mode: str = "evidence", start: int = 0, size: int = 30) -> DataFrame:
    """The next rows of a view in its order."""
    return sort(rows, mode).offset(start).limit(size)


def filled(pages: DataFrame, passing: DataFrame, least: int = 30) -> DataFrame:
    """Rows of ``passing`` from each (target, family)'s first pages that hold ``least`` of them, and all where there are fewer.

    Pages are whole: the last one that is read may bring more than is asked.
    """
    per = passing.groupBy("target_id", "family", "page").agg(F.count("*").alias("n"))
    order = Window.partitionBy("target_id", "family").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    every = pages.select("target_id", "family", "page").distinct().join(per, ["target_id", "family", "page"], "left")
    read = every.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < least)
    return passing.join(read.select("target_id", "family", "page"), ["target_id", "family", "page"], "left_semi")


def facets(rows: DataFrame, text: str = "", name: str = "name", **wanted: bool) -> DataFrame:
    """Catalogue rows whose name holds ``text``, whatever its case, and whose facets asked for are all set.

    A facet is a boolean column, or a text column that must be filled.
    """
    kinds = dict(rows.dtypes)
    out = rows.where(F.lower(name).contains(text.lower())) if text else rows
    for facet in (f for f, on in wanted.items() if on):
        out = out.where(F.col(facet) if kinds[facet] == "boolean" else F.coalesce(F.col(facet), F.lit("")) != "")
    return out


def merge_interactions(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """``(key, interactions)``: those of all rows of a key, one for each id: the last in ``order``, where the first stood.

    Interactions without an id are told apart by their fields.
    """
    each = rows.select(key, order.alias("_o"), F.posexplode("interactions").alias("_p", "_i"))
    named = F.col("_i.interaction_id") if "interaction_id" in rows.schema["interactions"].dataType.elementType.names else F.lit(None).cast("string")
    each = each.withColumn("_id", F.coalesce(named, F.to_json("_i"))).withColumn("_at", F.struct("_o", "_p"))
    last = each.groupBy(key, "_id").agg(F.max_by("_i", "_at").alias("_i"), F.min("_at").alias("_at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_i"))), lambda x: x["_i"])
    return last.groupBy(key).agg(listed.alias("interactions"))


def is_sequence(query: Column, least: int = 25) -> Column:
    """Whether typed text is a sequence: long enough, letters and ``*`` only, once blanks and hyphens are dropped."""
    return F.regexp_replace(query, r"[\s-]+", "").rlike(rf"^[A-Za-z*]{{{least},}}\z")


def pasted_sequence(query: Column) -> Column:
    """A pasted sequence without FASTA headers and white space, in upper case; null if empty or invalid."""
    body = F.array_join(F.filter(F.split(query, "\n"), lambda x: ~x.startswith(">")), "")
    s = F.regexp_replace(body, r"\s+", "")
    # judged before upper-casing, which makes two letters of a sharp s and of ligatures
    return F.when(s.rlike(rf"^[{SINGLE}]+\z"), F.upper(s))


def dispatch(heavy: str, light: str, mode: str) -> str:
    """The search that a sequence form asks for."""
    if mode in ("similarity", "cdr"):
        return "paired_similarity" if mode == "similarity" and heavy and light else mode
    return "paired" if heavy and light else "exact"


def entity_terms(names: DataFrame, id_col: str = "id", optional: tuple[str, ...] = ("record_id", "therapeutic_name", "external_id")) -> DataFrame:
    """``(id, raw)``: the name, aliases and optional fields of each entity that are filled, as stored."""
    more = [F.col(c) for c in ("name", *optional) if c in names.columns]
    every = F.concat(F.array(*more), F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in names.columns else F.array().cast("array<string>"))
    return names.select(F.col(id_col).alias("id"), F.explode(every).alias("raw")).where("raw <> ''").distinct()


def matched_name(name: Column | str, aliases: Column | str, query: Column) -> Column:
    """The stored name or alias that a query equals; else the query; the name where nothing was asked."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    q = T.search_term(query, False)
    hit = F.filter(F.concat(F.array(c(name)), c(aliases)), lambda v: T.search_term(v, False) == q)
    return F.when(q == "", c(name)).otherwise(F.coalesce(F.try_element_at(hit, F.lit(1)), query))


def search_rows(antibodies: DataFrame, lists: DataFrame, id_col: str = "antibody_id", most: int = 12) -> DataFrame:
    """Rows for name search: the first aliases and targets, sources, and the buckets of all names."""
    out = antibodies.join(lists, id_col, "left")
    none = F.array().cast("array<string>")
    first = lambda c: F.slice(F.coalesce(c, none), 1, most).alias(c)
    buckets = F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(F.array("name"), F.col("aliases")), lambda n: T.search_term(n, False) != ""), lambda n: T.search_bucket(T.search_term(n, False)))))
    return out.select(id_col, "name", first("aliases"), "sources", first("direct_targets"), first("functional_targets"), ((F.col("heavy") != "") & (F.col("light") != "")).alias("paired"), F.explode(buckets).alias("bucket"))


def exact_targets(targets: DataFrame, queries: DataFrame, unicode_: bool = True) -> DataFrame:
    """``(query, target_id)`` of targets whose id, name, alias or outer id equals a query as a search term."""
    every = F.concat(F.array("target_id", "name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("external_ids", F.array().cast("array<string>")))
    named = targets.select("target_id", F.explode(every).alias("raw")).select("target_id", T.search_term("raw", unicode_).alias("term")).where("term <> ''").distinct()
    asked = queries.select("query", T.search_term("query", unicode_).alias("term")).where("term <> ''")
    return asked.join(named, "term").select("query", "target_id").distinct()


def resolve_target(targets: DataFrame, queries: DataFrame, unicode_: bool = True) -> DataFrame:
    """``(query, target_id)``: the target of that id, else the one target with a name or alias of that key; several mean none."""
    by_id = queries.select("query").join(targets.select("target_id"), F.col("query") == F.col("target_id"))
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = targets.select("target_id", F.explode(every).alias("raw")).select("target_id", T.target_key("raw", unicode_).alias("key")).where("key <> ''").distinct()
    asked = queries.select("query", T.target_key("query", unicode_).alias("key")).join(by_id.select("query"), "query", "left_anti")
    met = asked.join(keyed, "key").groupBy("query").agg(F.collect_set("target_id").alias("ids")).where(F.size("ids") == 1)
    return by_id.union(met.select("query", F.element_at("ids", 1)))


def resolution(targets: DataFrame, terms: DataFrame, queries: DataFrame, unicode_: bool = True) -> DataFrame:
    """``(query, kind, target_ids, antibody_ids)`` of typed names: target, antibody, multiple or none; near names never count."""
    t = exact_targets(targets, queries, unicode_).groupBy("query").agg(F.array_sort(F.collect_set("target_id")).alias("target_ids"))
    a = exact_names(terms, queries, unicode_).select("query", F.col("ids").alias("antibody_ids"))
    none = F.array().cast("array<string>")
    both = queries.select("query").distinct().join(t, "query", "left").join(a, "query", "left").withColumns({"target_ids": F.coalesce("target_ids", none), "antibody_ids": F.coalesce("antibody_ids", none)})
    n, m = F.size("target_ids"), F.size("antibody_ids")
    return both.select("query", F.when(n + m == 0, "none").when(n + m > 1, "multiple").when(n == 1, "target").otherwise("antibody").alias("kind"), "target_ids", "antibody_ids")


def suggest_targets(targets: DataFrame, query: str, limit: int = 12, least: int = 2) -> DataFrame:
    """``(target_id, name, score)`` for a typed query: the best score of name and aliases, and the count up to 999."""
    q = T.search_term(F.lit(query), False)
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    best = F.array_max(F.transform(every, lambda v: text_score(T.search_term(v, False), q)))
    scored = targets.withColumn("best", best).where((F.col("best") > 0) & (F.length(q) >= least))
    out = scored.select("target_id", "name", (F.col("best") + F.least("count", F.lit(999))).cast("long").alias("score"))
    return out.orderBy(F.desc("score"), "name", "target_id").limit(limit)


def page_family(asked: str, counts: DataFrame) -> DataFrame:
    """``(target_id, family)``: the family of pages to read; positive ones where the asked has no count."""
    have = F.col({"negative": "negative_pages", "functional": "functional_pages"}.get(asked, "direct_pages"))
    return counts.select("target_id", F.when(have.isNotNull(), asked).otherwise("direct").alias("family"))


def read_pages(pages: DataFrame, target_ids: DataFrame, family: str = "direct", page: int | None = None) -> DataFrame:
    """Rows of a target's pages of one family: one page, or all."""
    rows = pages.where(F.col("family") == family).join(target_ids.select(F.col(target_ids.columns[0]).alias("target_id")).distinct(), "target_id", "left_semi")
    return rows if page is None else rows.where(F.col("page") == page)


def target_view(pages: DataFrame, tree: DataFrame, target_id: str, family: str = "direct", include_descendants: bool = False, mode: str = "evidence", **wanted) -> DataFrame:
    """A target's rows, with those of the targets below it if asked, merged by antibody, filtered and ranked."""
    root = pages.sparkSession.createDataFrame([(target_id,)], "target_id string")
    scope = root
    if include_descendants:
        scope = root.union(descendants(tree, root).select("id")).distinct()
    rows = read_pages(pages, scope, family)
    lists = {"relationships", "evidence", "sources"}
    keep = [F.first(c).alias(c) for c in rows.columns if c not in lists | {"antibody_id", "target_id", "rank_score", "position", "page", "interactions"}]
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sorted(lists)]
    merged = rows.groupBy("antibody_id").agg(*keep, *union, F.max("rank_score").alias("rank_score"))
    if "interactions" in rows.columns:
        # the target's own pages come before those of targets below it
        order = F.struct(F.col("target_id") != target_id, "target_id", "position")
        merged = merged.join(merge_interactions(rows, "antibody_id", order), "antibody_id", "left")
    return sort(filters(merged, **wanted), mode)


def metrics(rows: DataFrame) -> DataFrame:
    """One row over a view: results, those paired, with exact structures, and therapeutic."""
    return rows.agg(F.count("*").alias("results"), F.count_if(F.col("has_heavy") & F.col("has_light")).alias("paired"), F.count_if("structure_exact").alias("structure_exact"), F.count_if(F.col("therapeutic_status") != "").alias("therapeutic"))


def completeness(sources: DataFrame) -> DataFrame:
    """One row over ``sources(source, ok)``: how many came, of how many, and whether that is all."""
    out = sources.agg(F.count_if("ok").alias("ok"), F.count("*").alias("expected"))
    return out.withColumn("complete", (F.col("expected") > 0) & (F.col("ok") == F.col("expected")))


BROWSE = {
    "count": lambda: (F.desc("result_count"), F.col("name"), F.col("target_id")),
    "name": lambda: (F.col("name"), F.col("target_id")),
    "sources": lambda: (F.desc(F.size("sources")), F.desc("result_count"), F.col("name"), F.col("target_id")),
}


def browse(targets: DataFrame, mode: str = "count", shown: int = 60) -> DataFrame:
    """The first targets of a catalogue, by count, name or number of sources."""
    return targets.orderBy(*BROWSE[mode]()).limit(shown)


def toggled(current: str, asked: str) -> str:
    """A quick filter after a click on it: off on the second."""
    return "all" if current == asked else asked


def linked(ab: Column, target: Column, text: Column, scope: Column) -> Column:
    """As :func:`deep_link`, of columns: a struct of kind, value and scope."""
    have = lambda c: F.coalesce(c, F.lit("")) != ""
    kind = F.when(have(ab), "antibody").when(have(target), "target").when(have(text), "text").otherwise("none")
    value = F.when(have(ab), ab).when(have(target), target).otherwise(F.coalesce(text, F.lit("")))
    wide = (kind == "target") & (F.coalesce(scope, F.lit("")) == "descendants")
    return F.struct(kind.alias("kind"), value.alias("value"), F.when(wide, "include_descendants").otherwise("exact").alias("scope"))


def asked_search(heavy: Column, light: Column, mode: Column) -> Column:
    """As :func:`dispatch`, of columns."""
    both = (heavy != "") & (light != "")
    return F.when(mode.isin("similarity", "cdr"), F.when((mode == "similarity") & both, "paired_similarity").otherwise(mode)).otherwise(F.when(both, "paired").otherwise("exact"))


def after_click(current: Column, asked: Column) -> Column:
    """As :func:`toggled`, of columns."""
    return F.when(current == asked, "all").otherwise(asked)


def deep_link(parameters: dict[str, str]) -> tuple[str, str, str]:
    """``(kind, value, scope)`` that a link's parameters ask for: an antibody, else a target, else a text."""
    for key, kind in (("ab", "antibody"), ("target", "target"), ("q", "text")):
        if parameters.get(key):
            return kind, parameters[key], "include_descendants" if kind == "target" and parameters.get("scope") == "descendants" else "exact"
    return "none", "", "exact"
