"""URL filter with redirect equivalence.

A rule (host, path, verdict) fits its host and all subdomains where the url's
path starts with the rule's path; the longest rule wins (then the longer host,
then the greater rule text). Urls that no rule fits take the verdict of their
equivalence class: the connected component over canonical-link, meta-refresh
and given redirect edges. A component with an explicitly allowed member is
allowed, else one with a blocked member is blocked, else it is allowed.

Nodes of the graph are urls without scheme, fragment, tracking parameters and
final slash. Rules are judged for link targets too, so a page is blocked when
its canonical target is, whether that target was crawled or not.

Defined results: null url or one without ``://`` has empty host and path and no
rule, and is allowed; null or empty html has no links; repeated rows get the
same verdict each; an empty table or an empty rule list is fine; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlab.llm.common import own_names, salted_join
from answerlab.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _query_of(url: Column) -> Column:
    q = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"))
    return F.array_join(F.array_sort(kept), "&")


def node_of(url: Column) -> Column:
    """Graph node of a url; null where there is no ``://``."""
    q = _query_of(url)
    body = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.when(q == "", body).otherwise(F.concat_ws("?", body, q)))


def _absolute(href: Column, host: Column, path: Column) -> Column:
    h = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    return (F.when(h == "", None)
            .when(h.contains("://"), h)
            .when(h.startswith("//"), F.concat(F.lit("http:"), h))
            .when(h.startswith("/"), F.concat(F.lit("http://"), host, h))
            .otherwise(F.concat(F.lit("http://"), host, F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), h)))


def _with_token(attribute: str, token: str) -> str:
    """Pattern of an attribute whose space-separated tokens hold ``token``."""
    quoted = "|".join(rf"{q}(?:[^{q}>]*\s)?{token}(?:\s[^{q}>]*)?{q}" for q in "\"'")
    return rf"(?<![\w-]){attribute}\s*=\s*(?:{quoted}|{token}(?=[\s/>]))"


def _targets(element: str, attribute: str, token: str, place: str) -> Column:
    """What stands behind ``place`` in each such element of ``_html``, in order."""
    tags = F.regexp_extract_all(F.col("_html"), F.lit(rf"(?is)(<{element}\b[^>]*>)"), 1)
    meant = F.filter(tags, lambda t: t.rlike(rf"(?is){_with_token(attribute, token)}"))
    return F.transform(meant, lambda t: F.regexp_extract(t, rf"""(?is){place}\s*=\s*["']?\s*([^"'\s>]*)""", 1))


def links(pages: DataFrame) -> DataFrame:
    """``src, dst`` urls of all canonical links and meta refreshes of ``_url, _html``."""
    found = F.concat(_targets("link", "rel", "canonical", r"(?<![\w-])href"), _targets("meta", "http-equiv", "refresh", r"\burl"))
    both = pages.where(F.col("_html").isNotNull() & F.col("_url").isNotNull()).select(
        F.col("_url").alias("src"), F.explode_outer(found).alias("_href"))
    return (both.where(F.col("_href") != "")
            .select("src", _absolute(F.col("_href"), host_of(F.col("src")), path_of(F.col("src"))).alias("dst"))
            .where(F.col("dst").isNotNull()))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``_rule`` and ``_verdict`` of the longest rule that fits ``_host``
    and ``_path`` (null: none). One row id per row makes the grouped maximum
    free of hot keys; a hot domain is salted in the join."""
    keep = rows.columns
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("_suffix"), F.col("path").alias("_rpath"),
                     F.col("verdict").alias("_rv"), F.concat("host", "path").alias("_rtext"))
    ided = rows.withColumn("_rid", F.monotonically_increasing_id())
    tried = ided.withColumn("_suffix", F.explode(_suffixes(F.col("_host"))))
    hit = salted_join(tried, r, ["_suffix"], ["_rid"], "left")
    best = F.when(F.col("_path").startswith(F.col("_rpath")),
                  F.struct(F.char_length("_rtext").alias("a"), F.char_length("_suffix").alias("b"),
                           F.col("_rtext").alias("rule"), F.col("_rv").alias("verdict")))
    out = hit.groupBy("_rid").agg(*[F.first(c).alias(c) for c in keep], F.max(best).alias("_best"))
    return out.select(*keep, F.col("_best.rule").alias("_rule"), F.col("_best.verdict").alias("_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict, component``.

    ``rules`` has ``host, path, verdict`` (allow or block); ``redirects`` may
    add ``src, dst`` urls. ``component`` is the least url node of the page's
    class (null for a page without links to or from it)."""
    own = own_names(pages, {"_id": id_col, "_url": url_col, "_html": html_col})
    edges = links(own)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    ends = edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"), "src", "dst")
    comp = components(ends, "a", "b")
    urls = (ends.select(F.col("a").alias("node"), F.col("src").alias("_url"))
            .union(ends.select(F.col("b").alias("node"), F.col("dst").alias("_url")))
            .where(F.col("node").isNotNull()).distinct())
    ruled = with_rule(urls.select("node", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")), rules)
    voted = salted_join(comp, ruled.groupBy("node").agg(F.max(F.col("_verdict") == "allow").alias("_allow"),
                                                        F.max(F.col("_verdict") == "block").alias("_block")), ["node"], ["node"])
    classes = voted.groupBy("component").agg(F.max("_allow").alias("_allow"), F.max("_block").alias("_block"))
    nodes = salted_join(comp, classes, ["component"], ["node"]).withColumnRenamed("node", "_node")
    judged = with_rule(own.select("_id", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"),
                                  node_of(F.col("_url")).alias("_node")), rules)
    out = salted_join(judged, nodes, ["_node"], how="left")
    alias = F.when(F.coalesce("_allow", F.lit(False)), "allow").when(F.coalesce("_block", F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_rule").alias("rule"), F.coalesce("_verdict", alias).alias("verdict"), "component")
