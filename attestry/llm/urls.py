"""URL filters with redirect equivalence: block decisions spread over aliases, explicit allow rules come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, looked_up, stored
from .components import components

# fixed values: the rules of the query
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column, loose: bool = False) -> Column:
    """The name of a page: host, path and query, without scheme and fragment. loose drops what often does not matter too:
    www. or m., the query, .html and a closing slash."""
    if loose:
        return F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(path(url), r"\.html?$", ""), r"/+$", ""))
    return F.concat(host(url), path(url), F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^?#]*(\?[^#]*)", 1), F.lit("")))


def without_dots(p: Column) -> Column:
    """A path with its . and .. segments carried out."""
    parts = F.split(p, "/")
    empty = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    folded = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(folded, F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(p)


def resolved(link: Column, base: Column) -> Column:
    """A link as the page at base means it: with a scheme, with a host (//host/x), from the root (/x), of the query (?x), or
    beside the page (x). Null where it has another scheme, or where it names the page itself (empty or #x)."""
    root = F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1)
    own = path(base)
    beside = F.concat(F.when(own == "", "/").otherwise(F.regexp_extract(own, r"^(.*/)", 1)))
    name, query = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(\?[^#]*)", 1)
    whole = F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link).when(link.rlike(SCHEME), None).when((name == "") & (query == ""), None)
    whole = whole.when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^((?s:.*?)):", 1), F.lit(":"), link))
    return whole.when(link.startswith("/"), F.concat(root, without_dots(name), query)).when(name == "", F.concat(root, own, query)).otherwise(F.concat(root, without_dots(F.concat(beside, name)), query))


LINK = r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>)"""
REFRESH = r"""(?is)(<meta\b[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>)"""


def declared(html: Column, base: Column) -> Column:
    """The addresses that a page names as its canonical link or as the target of a refresh, all of them, relative ones resolved."""
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    moved = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 1), lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    there = F.filter(F.concat(links, moved), lambda u: u != "")
    return F.filter(F.transform(there, lambda u: resolved(u, base)), lambda u: u.contains("://"))


def rule_table(spark, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame([(k, v, h, p) for k, (v, h, p) in enumerate(rules)], "k long, verdict string, host string, path string")


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, and page_id to spread them by) with v and r, the verdict and text of the longest rule that fits, or nulls.

    Of equally long rules an allow rule wins, then the first. Each host's suffixes meet the rules' hosts by equality, once for
    a host; the rows then look up their host's rules, longest first. rules has k, verdict, host and path.
    """
    order = F.struct((-F.length(F.concat("host", "path"))).alias("n"), (F.col("verdict") != "allow").alias("b"), "k", F.col("path").alias("p"), F.col("verdict").alias("v"), F.concat("host", "path").alias("r"))
    by_host = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_list(order).alias("own"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct().where("host <> ''")
    met = hosts.select("host", F.explode(suffixes).alias("suffix")).join(by_host, "suffix").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("own"))
    found = looked_up(rows, stored(met), "host", "page_id")
    first = F.get(F.filter("own", lambda x: F.startswith(F.col("path"), x["p"])), 0)
    return found.withColumn("_f", first).withColumns({"v": F.col("_f.v"), "r": F.col("_f.r")}).drop("own", "_f")


def judged(pages: DataFrame, rules: tuple | DataFrame = RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", loose: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every page.

    A page with a rule gets the rule's verdict: an explicit allow holds whatever its aliases are. Any other page is blocked if
    a page or address of its component is blocked by a rule, and allowed if not. Components join pages of one address (host,
    path and query), a page and what it declares as canonical or refreshes to, and the pairs (src, dst) of redirects, if
    given; loose joins addresses that differ in www., query, .html or a closing slash, too. Null urls and urls without ://
    have empty host and path, no rule and no aliases, and are allowed. Repeated rows are judged alike; other columns are not
    read; texts of any length are searched; ids are integers; an empty table gives no rows. rules are tuples (verdict, host,
    path) or a table of these columns and k, their order. DataFrame functions only; names of 64 bits stand for addresses.
    """
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    name = lambda u: F.xxhash64(address(u, loose))
    u = column(pages, url, "string")
    rows = pages.select(column(pages, page_id, "long").alias("page_id"), u.alias("url"), F.when(u.contains("://"), declared(F.coalesce(column(pages, html, "string"), F.lit("")), u)).alias("to"))
    rows = stored(rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.when(F.col("url").contains("://"), name(F.col("url"))).alias("node"), "to"))
    rows = stored(ruled(rows, table))
    hit = rows.where("node is not null and v = 'block'").select("node").distinct()
    named = rows.where("node is not null and size(to) > 0").select("page_id", "node", F.explode("to").alias("dst"))
    if redirects is not None:
        named = named.union(redirects.where("src like '%://%' and dst like '%://%'").select(F.lit(None).cast("long"), name(F.col("src")), "dst"))
    aimed = stored(named.select("page_id", F.col("node").alias("a"), name(F.col("dst")).alias("b"), host(F.col("dst")).alias("host"), path(F.col("dst")).alias("path")))
    edges = stored(ruled(aimed, table).select("a", "b", "v"))
    hit = hit.union(edges.where("v = 'block'").select("b")).distinct()
    groups = stored(components(edges))
    bad = hit.join(groups.hint("merge"), "node", "left").select(F.coalesce("component", "node").alias("component")).distinct()
    # every node of a blocked component, and the nodes that stand alone
    known = groups.select("node", "component").union(groups.select(F.col("component"), "component")).distinct()
    marked = stored(known.join(bad.withColumn("bad", F.lit(True)).hint("merge"), "component", "full").select(F.coalesce("node", "component").alias("node"), "component", "bad").dropDuplicates(["node"]))
    discard(aimed)
    discard(edges)
    discard(groups)
    found = looked_up(rows, marked, "node", "page_id")
    own = F.when(F.col("bad"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("r").alias("rule"), F.coalesce("v", own).alias("verdict"), F.coalesce("component", "node").alias("component"))
