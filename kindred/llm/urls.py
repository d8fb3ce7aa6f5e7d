"""URL filters: rules by host and path, spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.words import ascii_lower, let

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host(url: Column) -> Column:
    """Host of a url, A-Z in lower case; empty for null or where there is no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to a query or fragment; empty where there is none."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: host, path and query. Null without a host."""
    query = F.regexp_extract(url, r"\A[^?#]*(\?[^#]*)?", 1)
    return F.when(host(url) != "", F.concat(host(url), path(url), query))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def rule_table(like: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Rules as a table of ``verdict`` and ``rule``, such as ``net/``."""
    return like.sparkSession.createDataFrame(list(rules), "verdict string, rule string")


def apply_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest rule for each distinct ``host`` and ``path``: adds ``rule`` and ``verdict``, null without one.

    Each host meets the rules through its own suffixes, an equi-join whatever the
    number of rules. Of the same rule with both verdicts, ``allow`` holds.
    """
    rules = rules.select(
        F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substr(rule, instr(rule, '/'))").alias("prefix"), "rule",
        F.col("verdict").alias("says"),
    )
    distinct = addresses.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = let(parts, lambda p: F.transform(p, lambda _, i: F.array_join(F.slice(p, i + 1, F.size(p)), ".")))
    met = distinct.withColumn("suffix", F.explode(suffixes)).join(rules, "suffix")
    met = met.filter(F.col("path").startswith(F.col("prefix")))
    best = met.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), (F.col("says") == "allow").alias("allow"))).alias("best")
    )
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))
    return addresses.join(best, ["host", "path"], "left")


def page_links(pages: DataFrame) -> DataFrame:
    """Redirect and canonical-link edges of raw pages, as ``a`` and ``b`` keys.

    Read from ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh
    content="0; url=...">``; targets may be absolute, start with ``//`` or ``/``,
    or be relative to the page's folder.
    """
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    tag = lambda name, mark: F.regexp_extract("html", rf"(?is)<{name}\b(?=[^>]*{mark})[^>]*>", 0)
    canonical = attribute(tag("link", r"\brel\s*=\s*[\"']?canonical\b"), "href")
    refresh = F.regexp_extract(tag("meta", r"\bhttp-equiv\s*=\s*[\"']?refresh\b"), r"(?is)url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    marked = pages.filter(F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv"))
    targets = marked.select("url", F.explode(F.array(canonical, refresh)).alias("to")).filter("to <> ''")
    scheme = F.substring_index("url", "://", 1)
    base = F.concat(scheme, F.lit("://"), host(F.col("url")))
    folder = F.regexp_extract(path(F.col("url")), r"\A.*/", 0)
    to = F.col("to")
    whole = (
        F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(base, to))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), to))
    )
    return targets.select(alias_key(F.col("url")).alias("a"), alias_key(whole).alias("b"))


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Verdict on each page: its rule's, else that of its aliases.

    ``pages`` has ``page_id``, ``url`` and ``html``; ``links`` (columns ``a``
    and ``b`` of ``alias_key``) defaults to ``page_links``. Addresses joined by
    redirects or canonical links, over any number of steps, are one resource: if
    a rule blocks one of them, all are blocked, except those that a rule of
    their own allows. All else is allowed. Returns ``page_id``, ``host``,
    ``path``, ``rule``, ``verdict`` and ``component`` (null without links).

    Null urls and urls without ``://`` have no host, no rule and no aliases, and
    are allowed. Repeated pages are judged alike, each in its row.
    """
    links = page_links(pages) if links is None else links
    groups = components(links)
    address = F.concat(F.lit("x://"), F.col("node"))
    members = apply_rules(groups.withColumn("host", host(address)).withColumn("path", path(address)), rules)
    blocked = members.groupBy("component").agg(F.bool_or(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("blocked"))
    aliases = groups.join(blocked, "component").withColumnRenamed("node", "key")
    url = F.col("url")
    seen = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), alias_key(url).alias("key"))
    seen = apply_rules(seen, rules).join(aliases, "key", "left")
    inherited = F.when(F.col("blocked"), "block").otherwise("allow")
    return seen.select("page_id", "host", "path", "rule", F.coalesce("verdict", inherited).alias("verdict"), "component")
