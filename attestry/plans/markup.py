"""Queries over trees of pages, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import markup as M
from .common import table

SITE = "https://catalogue.example.org"


def page_tree(spark, sf_dir):
    """First headings, list items and links of whole pages, from their trees."""
    return M.tagged(M.trees(table(spark, sf_dir, "pages")), ("h1", "li", "a"))


def study_pages(spark, sf_dir):
    """Customers as studies of three labelled pages: every seventh page tells another id, later pages replace fields."""
    c = table(spark, sf_dir, "customer")
    k, s = F.col("c_custkey").cast("string"), F.lit
    item = lambda v: F.concat(s('<div class="a field__item"> '), v.cast("string"), s("</div>"))
    details = F.concat(
        s("<dl><dt>Study ID</dt><dd>"), (F.col("c_custkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).cast("string"), s("</dd></dl><dl><dt>Official title and acronym</dt><dd>"), F.col("c_name"),
        s(" &amp;<br><i>"), F.col("c_mktsegment"), s("</i></dl><dl><dt>Study status</dt><dd>Planned</dd></dl><dl><dt>Group</dt><dd><dl><dt>DARWIN EU® study</dt><dd>"),
        F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No"), s('</dd></dl></dd></dl><a href="/study/'), k, s('/data-management/">d</a><a href="/study/'), k, s('">self</a>'),
    )
    methods = F.concat(s("<dl><dt>Study countries</dt><dd>"), item(F.col("c_nationkey")), item(F.col("c_nationkey") + 1), s("</dd></dl>"))
    data = F.concat(s("<dl><dt>Data source(s)</dt><dd>"), F.col("c_mktsegment"), s("</dd></dl>"), F.when(F.col("c_nationkey") % 2 == 0, s("<dl><dt>Study Status:</dt><dd>Ended</dd></dl>")).otherwise(s("")))
    pages = c.select(k.alias("study_id"), F.posexplode(F.array(details, methods, data)).alias("part", "html"))
    rows = M.study_records(pages, SITE)
    return rows.select("study_id", "title", "status", "darwin_eu", F.array_join("countries", "|").alias("countries"), F.array_join("catalogue_data_sources", "|").alias("sources"), F.col("tabs")["data-management"].alias("data_tab"), F.size(F.map_keys("tabs")).alias("tabs"), "source_url", "error")


def file_cards(spark, sf_dir):
    """Orders as files on the page of their customer: addresses occur again, closed orders lie in the container of updates."""
    o = table(spark, sf_dir, "orders")
    s, k = F.lit, F.col("o_orderkey")
    card = F.concat(
        s('<div class="x field-protocol-file'), F.when(F.col("o_orderstatus") == "F", "-upd").otherwise(""), s('"><div><div class="field__item"><p><a href="/f/'), (k % 5).cast("string"), s("%20_v"), (k % 3).cast("string"), s('.pdf">x</a><a href="/f">no</a><span class="file-title">Plan, version '),
        F.col("o_custkey").cast("string"), s(".<b>"), (k % 9).cast("string"), s('</b> of 2020-01-0'), (k % 9 + 1).cast("string"), s('</span></div></div></div>'),
    )
    pages = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), card.alias("c")))), lambda x: x["c"]), "\n").alias("html"))
    return M.file_cards(M.trees(pages), "field-protocol-file", SITE)


QUERIES = {f.__name__: f for f in (page_tree, study_pages, file_cards)}

_TEXT = r"trim(regexp_replace(replace(replace(replace(regexp_replace({}, '&amp;?', '&', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '\s+$', ''))".replace('\\"', '"')


def _tag(tag: str) -> str:
    form = rf"'(?is)<{tag}\b[^>]*>(.*?)</{tag}>'"
    return f"SELECT page_id, '{tag}' AS tag, unnest(regexp_extract_all(html, {form}, 1)) AS x, unnest(generate_series(0, len(regexp_extract_all(html, {form}, 1)) - 1)) AS k, unnest(regexp_extract_all(html, {form}, 0)) AS w FROM pages"


SQL = {
    "page_tree": rf"""
WITH t AS ({_tag('h1')} UNION ALL {_tag('li')} UNION ALL {_tag('a')})
SELECT page_id, CAST(k AS INT) AS ord, tag, CASE WHEN tag = 'a' THEN regexp_extract(w, 'href="([^"]*)"', 1) END AS href, {_TEXT.format("regexp_replace(x, '<[^>]*>', '', 'g')")} AS text FROM t""",
    "study_pages": f"""
SELECT CAST(c_custkey AS VARCHAR) AS study_id, CASE WHEN ok THEN c_name || ' & ' || c_mktsegment END AS title, CASE WHEN ok THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Ended' ELSE 'Planned' END END AS status,
  CASE WHEN ok THEN coalesce(c_acctbal > 0, false) END AS darwin_eu, CASE WHEN ok THEN c_nationkey || '|' || (c_nationkey + 1) END AS countries, CASE WHEN ok THEN c_mktsegment END AS sources,
  CASE WHEN ok THEN '{SITE}/study/' || c_custkey || '/data-management/' END AS data_tab, CASE WHEN ok THEN 1 END AS tabs, CASE WHEN ok THEN '{SITE}/study/' || c_custkey END AS source_url, CASE WHEN NOT ok THEN 'STUDY_NOT_FOUND' END AS error
FROM (SELECT *, c_custkey % 7 <> 0 AS ok FROM customer)""",
    "file_cards": f"""
WITH f AS (SELECT o_custkey AS page_id, '{SITE}/f/' || (o_orderkey % 5) || '%20_v' || (o_orderkey % 3) || '.pdf' AS document_url, o_orderkey AS k, o_orderstatus AS s FROM orders),
g AS (SELECT page_id, document_url, min(k) AS a, max(k) AS z, arg_max(s, k) AS s FROM f GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a) AS INT) AS ord, document_url, 'Plan, version ' || page_id || '. ' || (z % 9) || ' of 2020-01-0' || (z % 9 + 1) AS title,
  CASE WHEN s = 'F' THEN 'updated' ELSE 'initial' END AS kind, CAST(page_id AS VARCHAR) AS version, '2020-01-0' || (z % 9 + 1) AS document_date, CAST(NULL AS VARCHAR) AS published_date FROM g""",
}
