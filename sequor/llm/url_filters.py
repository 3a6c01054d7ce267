"""URL filters with redirect equivalence, in built-in functions only.

Host-suffix and path-prefix rules judge a url directly; the longest wins.  Urls
that redirect to each other, or name one canonical url, are aliases: connected
components over those edges carry a block to aliases that no rule fits.  An
explicit allow takes precedence twice: the url it fits stays allowed, and its
aliases that no rule fits are allowed too, whatever else is blocked there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.operators.components import connected_components
from sequor.operators.skew import hot_limit, join_hot
from sequor.operators.storage import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules up to which they may be broadcast.
BROADCAST_RULES = 100_000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def url_key(url: Column) -> Column:
    """128-bit key of a url: scheme, fragment, default port and closing slash don't tell urls apart, the query does."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    plain = F.concat(F.regexp_replace(host(url), ":(80|443)$", ""), F.regexp_replace(path(url), "/+$", ""), query)
    return F.when(url.contains("://"), F.md5(plain))


def _resolved(base: Column, link: Column) -> Column:
    """``link`` as an absolute url, read on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"^[#?]") | (link == ""), F.lit(None))
        .when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` urls: each page's canonical link, ``og:url`` and refresh target, if any."""
    html, url = F.col("html"), F.col("url")
    tags = F.when(html.rlike(r"(?i)canonical|og:url|http-equiv"), F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    t = F.col("tag")
    value = lambda name: F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    link = (
        F.when(t.rlike(r"(?is)^<link\b[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), value("href"))
        .when(t.rlike(r"(?is)^<meta\b[^>]*\bproperty\s*=\s*[\"']?og:url\b"), value("content"))
        .when(t.rlike(r"(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    )
    found = pages.where(url.contains("://")).select("url", F.explode(tags).alias("tag")).select(F.col("url").alias("src"), F.regexp_replace(link, "&amp;", "&").alias("link"))
    return found.where("link is not null and link <> ''").select("src", _resolved(F.col("src"), F.col("link")).alias("dst")).where("dst is not null")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """``(verdict, rule)`` rows, such as ``("block", "com/en/")``, as a table for :func:`judge`."""
    return spark.createDataFrame(list(rules), "verdict string, rule string").select(
        "verdict",
        "rule",
        F.translate(F.regexp_extract("rule", "(?s)^([^/]*)", 1), _UPPER, _LOWER).alias("rule_host"),
        F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("rule_path"),
    )


def _fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, host, path)`` with the longest fitting rule; an allow wins a tie.

    A url meets rules by equality on each suffix of its host, so the work is its
    number of labels and not the number of rules.
    """
    names = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), "."))
    each = urls.select("host", "path").distinct().select("host", "path", F.explode(names).alias("rule_host"))
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.col("rule"), F.col("verdict")))
    return each.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, alias_of)`` for every row of ``pages(page_id, url, html)``.

    ``redirects(src, dst)`` adds edges to those that the pages themselves state.
    A null url or one without ``://`` has empty host and path, fits no rule, has
    no alias and is allowed.  Repeated rows keep their rows.  ``alias_of`` is the
    key of the component, null for a url without edges.  Other columns are not
    read.  Empty tables give no rows.
    """
    pages = pages.select("page_id", "url", "html")
    urls = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst").where(F.col("src").contains("://") & F.col("dst").contains("://")))
    # urls of the same key are one node, so only stated edges need the components
    edges = materialize(edges.distinct(), "redirects")
    keyed = edges.select(url_key(F.col("src")).alias("a"), url_key(F.col("dst")).alias("b"))
    comp = materialize(connected_components(keyed, "a", "b"), "aliases")
    fitting = materialize(_fitting(urls, rules), "fitting")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("url")).select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    nodes = ends.union(urls.select("host", "path", "key")).distinct()
    ruled = _fitting(ends, rules).union(fitting).distinct()
    known = nodes.join(ruled, ["host", "path"]).groupBy("key").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
    label = comp.join(known, comp.node == known.key, "left").groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    marked = comp.join(label, "component").select(F.col("node").alias("key"), F.col("component").alias("alias_of"), "allow", "block")
    # a key without edges still ties the urls that spell it
    alone = known.join(comp, known.key == comp.node, "left_anti").select("key", F.lit(None).cast("string").alias("alias_of"), "allow", "block")
    # one path may have very many queries, and one page very many copies: their rows stay where they are
    limit = hot_limit(urls.count())
    at = F.struct("host", "path")
    told = materialize(join_hot(urls.withColumn("at", at), fitting.select(at.alias("at"), "rule", "verdict"), "at", limit, "left").drop("at"), "told")
    known = materialize(marked.union(alone), "known")
    out = join_hot(told, known, "key", limit, "left")
    spread = F.coalesce("block", F.lit(False)) & ~F.coalesce("allow", F.lit(False))
    verdict = F.coalesce("verdict", F.when(spread, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "alias_of")
