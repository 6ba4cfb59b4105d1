"""URL filter rules with redirect equivalence.

A page's own rule decides: a rule fits its host and all subdomains if the path starts with the rule's, and
the longest rule wins.  Pages are aliases when a redirect (``meta refresh``) or canonical link joins their
addresses, through any number of steps: the connected components of those links.  A page without a rule
takes the decision of its aliases: allow if any address of the component is allowed by a rule, else block if
any is blocked, else allow.  Links are joined and grouped in Spark; nothing of them reaches the driver.

An address is compared without its fragment, scheme and host in lower case.  A null url, or one without
``://``, has empty host and path, no rule and no aliases and is allowed.  Null html has no links.  Repeated
rows get a result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from creditloom.llm.components import components
from creditloom.llm.scratch import materialize

# Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _low(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(_low(F.regexp_extract(_after(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The form in which addresses are compared; null if there is none."""
    scheme = _low(F.substring(url, F.lit(1), F.instr(url, "://") - 1))
    rest = F.regexp_extract(_after(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 1, F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolved(base: Column, link: Column) -> Column:
    """The address a link on page ``base`` leads to; null for none."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring(base, F.lit(1), F.instr(base, "://") - 1)
    top = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    target = (
        F.when((link == "") | link.startswith("#"), None)
        .when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(top, link))
        .otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), link))
    )
    return address(target)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    name = verdict = F.lit(None).cast("string")
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        name, verdict = F.when(fits, r_host + r_path).otherwise(name), F.when(fits, r_verdict).otherwise(verdict)
    return name, verdict


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): the addresses joined by a redirect or canonical link."""
    tags = lambda pattern: F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(0))
    links = F.concat(
        F.transform(tags(CANONICAL), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(tags(REFRESH), lambda t: F.regexp_extract(t, TARGET, 1)),
    )
    found = pages.select("url", F.explode(links).alias("link"))
    edges = found.select(address(F.col("url")).alias("u"), resolved(F.col("url"), F.col("link")).alias("v"))
    return edges.filter("u is not null and v is not null and u <> v").distinct()


def alias_decisions(pages: DataFrame, rules=RULES) -> DataFrame:
    """(node, decision) of the addresses that have aliases, by the rules that fit any address of the component."""
    nodes = components(link_edges(pages.select("url", "html")))
    verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
    parts = nodes.withColumn("verdict", verdict).groupBy("component").agg(F.min("verdict").alias("decision"))  # allow before block
    parts = materialize(parts.filter("decision is not null"), "decisions")
    return nodes.join(parts, "component").select("node", "decision")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``pages`` has page_id, url and html."""
    url = F.col("url")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("node"))
    own = own.select("*", name.alias("rule"), verdict.alias("own_verdict"))
    decisions = materialize(alias_decisions(pages, rules), "aliases")
    judged = own.join(decisions, "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own_verdict", "decision", F.lit("allow")).alias("verdict"))
