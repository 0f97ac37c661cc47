"""URL filters with redirect equivalence; DataFrame operations only.

A page's own rule decides first. Pages without one take the decision of their equivalence class: addresses joined by
redirects (meta refresh) and canonical links, closed by connected components. A class in which a rule allows any
address is allowed, whatever else is in it; else one in which a rule blocks any address is blocked; else it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: (host, path, verdict): fixed values of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What two spellings of one address share: host, path and query; neither scheme nor fragment."""
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.when(path(url) == "", "/").otherwise(path(url)), _query(url)))


def _fits(h: Column, p: Column, rule: tuple[str, str, str]) -> Column:
    return ((h == rule[0]) | h.endswith("." + rule[0])) & p.startswith(rule[1])


def ruling(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host + path) that fits, null if none does; of equally long ones an allow wins, then the first."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", [-ord(c) for c in r[0] + r[1]])):
        fits = _fits(h, p, r)
        name, verdict = F.when(fits, r[0] + r[1]).otherwise(name), F.when(fits, r[2]).otherwise(verdict)
    return name, verdict


def _resolved(base: Column, link: Column) -> Column:
    """An href against the page that names it: absolute, scheme-relative, rooted or relative to the page's folder."""
    link = F.trim(F.regexp_replace(F.regexp_replace(link, "&amp;", "&"), "#.*$", ""))
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"(?s)^(.*/)", 1)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link != "", F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in double quotes, single quotes or none; empty if it is absent."""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{v}", 1), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")], F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """(u, v): addresses joined by a canonical link or a meta refresh of a page's html."""
    canonical = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<link\s[^>]*>)"), 1), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<meta\s[^>]*>)"), 1), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    to = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1))),
    )
    # pages without either tag, nearly all, are dropped before the patterns above run
    named = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & (F.instr("url", "://") > 0))
    found = named.select("url", F.explode(to).alias("to")).select(address(F.col("url")).alias("u"), address(_resolved(F.col("url"), F.col("to"))).alias("v"))
    return found.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by) for each row of pages (page_id, url, html).

    redirects: further edges (source, target) of urls. A url that is null or has no :// has an empty host and path, no
    class and the verdict allow. `decided_by` says what decided: rule, class or default. Repeated rows are judged alike; a null
    html names no link. Rules are few and are compiled into the plan. Only addresses that some edge names are shuffled
    into the components; the join back to pages is on the address.
    """
    p = pages.select("page_id", "url", "html")
    edges = links(p)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(address(F.col("source")).alias("u"), address(F.col("target")).alias("v")))
    classes = components(edges, "u", "v")
    h, q = F.regexp_extract("node", r"(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    ruled = classes.withColumn("r", ruling(h, q, rules)[1])
    told = ruled.where("r IS NOT NULL").groupBy("component").agg(F.max((F.col("r") == "allow").cast("int")).alias("allowed"))
    verdicts = stored(classes.join(told, "component").select("node", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("inherited")), "inherited")
    name, verdict = ruling(F.col("host"), F.col("path"), rules)
    own = p.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    own = own.select("*", name.alias("rule"), verdict.alias("own"))
    out = own if verdicts.isEmpty() else own.join(verdicts.withColumnRenamed("node", "address"), "address", "left")
    inherited = F.col("inherited") if "inherited" in out.columns else F.lit(None).cast("string")
    by = F.when(F.col("own").isNotNull(), "rule").when(inherited.isNotNull(), "class").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", inherited, F.lit("allow")).alias("verdict"), by.alias("decided_by"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
