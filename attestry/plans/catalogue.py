"""Queries over imports, state, versions, codes and pages."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import state
from ..sources import catalogue as C
from ..sources import pages as P
from .common import table

NOW = datetime.datetime(2024, 2, 1, tzinfo=datetime.UTC)
TTL = 3 * 86_400


def split_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cell = F.concat_ws("", F.col("p_name"), F.lit(" | "), F.col("p_type"), F.lit(";\n"), F.col("p_brand"), F.lit(" ;; "), F.col("p_name"))
    return part.select("p_partkey", F.posexplode(F.array_distinct(T.split_values(cell))).alias("ord", "value"))


#: Headers as exports write them: every alias, and some that name no field.
HEADERS = (*(a for names in C.ALIASES.values() for a in names), "contact", "remarks")


def header_alias(spark, sf_dir):
    """Every order as an export whose lines are its headers, some of them in capitals, with signs, or twice."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("l_partkey") % len(HEADERS)).cast("int") + 1)
    header = F.when(F.col("l_returnflag") == "A", F.upper(name)).when(F.col("l_returnflag") == "R", F.regexp_replace(name, " ", " - ")).otherwise(name)
    return C.resolved_table(lines.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("position"), header.alias("header")))


def unmatched_log(spark, sf_dir):
    """Titles of documents as queries; a language's number of letters stands for what matched."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("dictionaries"), (F.col("doc_id") % 2).alias("groups"), (F.col("doc_id") % 3).alias("concepts"), F.lit(0).alias("medicines"))
    return C.to_log(docs).select("doc_id", "text")


def bundle_refresh(spark, sf_dir):
    """Nations as the own table, regions as a bundle whose import is newer."""
    own, bundle = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    log = table(spark, sf_dir, "events")
    return C.replaced_if_newer(own, bundle, log.where("event_type = 'error'"), log, "ts")


def export_days(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_claims.csv"))).otherwise(F.concat("event_type", F.lit("_2020.csv")))
    return ev.select("event_id", C.export_day(name, F.col("ts") + F.expr("interval 1 day")).alias("day"), F.when(C_kind(name) == "claims", "claims").alias("kind"))


def C_kind(name):
    """kind_of() as an expression: the one kind that a name holds as a word."""
    words = F.array_intersect(F.split(F.lower(name), r"[_\-. ]+"), F.array(*map(F.lit, C.KINDS)))
    return F.when(F.size(words) == 1, words[0])


def _customers(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count(F.lit(1)).alias("orders"))
    old = customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.lit(0).cast("long").alias("orders"))
    return old, last


def upsert_merge(spark, sf_dir):
    old, last = _customers(spark, sf_dir)
    return C.upserted(old, last.where("status <> 'F'"), last.where("status = 'F'"), key="id")


def tag_accumulation(spark, sf_dir):
    return C.accumulated_tags(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("tags", ",").alias("tags"))


def newest_per_kind(spark, sf_dir):
    out = C.newest_per_kind(table(spark, sf_dir, "events"), "event_type", "ts", NOW, TTL)
    dates = F.size(F.collect_set(F.to_date("newest")).over(_all()))
    return out.withColumn("aligned", dates <= 1).select("event_type", "imports", "age_seconds", "state", "aligned")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def freshness_state(spark, sf_dir):
    return C.newest_per_kind(table(spark, sf_dir, "events"), "user_id", "ts", NOW, TTL).select("user_id", "age_seconds", "state")


def html_fields(spark, sf_dir):
    return P.page_fields(table(spark, sf_dir, "pages"))


def link_cards(spark, sf_dir):
    return P.link_cards(table(spark, sf_dir, "pages"))


def latest_version(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    docs = li.select(
        F.col("l_orderkey").alias("study"), F.when(F.col("l_returnflag") == "R", "updated").otherwise("initial").alias("kind"),
        F.when(F.col("l_discount") > 0.02, F.concat_ws(".", F.col("l_quantity").cast("int"), F.col("l_linenumber"))).alias("version"),
        F.when(F.col("l_tax") > 0.01, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("document_date"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published_date"),
        F.concat_ws("/", F.lit("u"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")).alias("url"),
    )
    return C.latest_versions(docs, "study").select("study", "url", "reason")


def observation_merge(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("version"))
    newest = lambda kind: ev.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by(F.struct("value", "event_id", "version"), F.struct("version", "event_id")).alias("x")).select("user_id", F.col("x.value").alias("value"), F.when(F.col("x.value") > 5, F.col("x.event_id")).alias("event_id"), F.col("x.version").alias("version"))
    return C.merged_observations(newest("view"), newest("click"), "user_id", ["value", "event_id"])


def backoff_states(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "rate_limit").otherwise("ok").alias("outcome"))
    return state.backoff(ev, "user_id", "event_id")


def unmatched_summary(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("term", F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")))
    return C.unmatched_summary(C.unmatched_terms(ev, "term", "event_type", "ts"), "term").select("term", "n", "last_seen")


QUERIES = {f.__name__: f for f in (split_values, header_alias, upsert_merge, tag_accumulation, newest_per_kind, freshness_state, html_fields, link_cards, latest_version, observation_merge, backoff_states, unmatched_summary, unmatched_log, bundle_refresh, export_days)}

_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"
_TAG = lambda t: _PLAIN.format(rf"regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1)")
SQL = {
    "split_values": r"""
WITH c AS (SELECT p_partkey, p_name || ' | ' || p_type || ';' || chr(10) || p_brand || ' ;; ' || p_name AS cell FROM part),
v AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(cell, '[|;\n]+'), lambda x: trim(x)), lambda x: x <> '') AS v FROM c),
u AS (SELECT p_partkey, unnest(v) AS value, unnest(generate_series(1, len(v))) AS k FROM v),
f AS (SELECT p_partkey, value, min(k) AS k FROM u GROUP BY ALL)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INT) AS ord, value FROM f""",
    "upsert_merge": """
WITH l AS (SELECT o_custkey AS id, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS status, count(*) AS orders FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(l.status, c_mktsegment) AS status, coalesce(orders, 0) AS orders FROM customer LEFT JOIN l ON l.id = c_custkey WHERE l.status IS DISTINCT FROM 'F'
UNION ALL SELECT id, status, orders FROM l WHERE status <> 'F' AND id NOT IN (SELECT c_custkey FROM customer)""",
    "tag_accumulation": "SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS tags FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) GROUP BY user_id",
    "newest_per_kind": f"""
WITH n AS (SELECT event_type, max(ts) AS newest, count(*) AS imports FROM events GROUP BY 1),
a AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(newest)) / 1000000.0) AS BIGINT) AS age_seconds FROM n)
SELECT event_type, imports, age_seconds, CASE WHEN age_seconds <= {TTL} THEN 'current' ELSE 'stale' END AS state, (SELECT count(DISTINCT CAST(newest AS DATE)) FROM n) <= 1 AS aligned FROM a""",
    "freshness_state": f"""
WITH a AS (SELECT user_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0) AS BIGINT) AS age_seconds FROM events GROUP BY 1)
SELECT user_id, age_seconds, CASE WHEN age_seconds <= {TTL} THEN 'current' ELSE 'stale' END AS state FROM a""",
    "html_fields": f"""
SELECT * FROM (
  SELECT page_id, 'title' AS label, {_TAG('title')} AS value FROM pages UNION ALL SELECT page_id, 'h1', {_TAG('h1')} FROM pages
  UNION ALL SELECT page_id, 'footer', {_TAG('footer')} FROM pages UNION ALL SELECT page_id, 'lang', regexp_extract(html, '(?is)<html[^>]*\\blang="([^"]*)"', 1) FROM pages) WHERE value <> ''""",
    "link_cards": rf"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
u AS (SELECT page_id, unnest(h) AS href, unnest(t) AS t, unnest(generate_series(0, len(h) - 1)) AS k FROM l WHERE len(h) > 0)
SELECT page_id, CAST(min(k) AS INT) AS ord, href, arg_min({_PLAIN.format('t')}, k) AS text FROM u GROUP BY page_id, href""",
    "latest_version": """
WITH d AS (
  SELECT l_orderkey AS study, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS k, CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS INT) END AS v, l_linenumber,
    CASE WHEN l_tax > 0.01 THEN strftime(l_shipdate, '%Y-%m-%d') END AS dd, strftime(l_shipdate, '%Y-%m-%d') AS pd, 'u/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber AS url FROM lineitem),
b AS (SELECT *, min(k) OVER (PARTITION BY study) AS bk FROM d),
f AS (SELECT *, bool_and(v IS NOT NULL) OVER (PARTITION BY study) AS av, bool_and(dd IS NOT NULL) OVER (PARTITION BY study) AS ad FROM b WHERE k = bk),
r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY CASE WHEN av THEN v END DESC, CASE WHEN av THEN l_linenumber END DESC, CASE WHEN av OR ad THEN coalesce(dd, '') END DESC, pd DESC, url DESC) AS rn FROM f)
SELECT study, url, CASE WHEN av THEN 'version' WHEN ad THEN 'document_date' ELSE 'published_date' END AS reason FROM r WHERE rn = 1""",
    "observation_merge": """
WITH e AS (SELECT user_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS version FROM events),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC, event_id DESC) AS rn FROM e WHERE event_type IN ('view', 'click')) WHERE rn = 1),
b AS (SELECT user_id, value, CASE WHEN value > 5 THEN event_id END AS event_id, version FROM n WHERE event_type = 'view'),
l AS (SELECT user_id, value, CASE WHEN value > 5 THEN event_id END AS event_id, version FROM n WHERE event_type = 'click')
SELECT user_id, CASE WHEN b.version > l.version THEN coalesce(b.value, l.value) ELSE coalesce(l.value, b.value) END AS value,
  CASE WHEN b.version > l.version THEN coalesce(b.event_id, l.event_id) ELSE coalesce(l.event_id, b.event_id) END AS event_id, greatest(b.version, l.version) AS version
FROM b FULL JOIN l USING (user_id)""",
    "unmatched_summary": "SELECT event_type || ' ' || json_extract_string(props, '$.k') AS term, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1 ORDER BY n DESC, last_seen, term LIMIT 20",
    "header_alias": f"""
WITH a(field, h, k) AS (VALUES {", ".join(f"('{f}', '{a}', {k})" for f, names in C.ALIASES.items() for k, a in enumerate(names))}),
l AS (SELECT l_orderkey AS file, l_linenumber AS position, l_returnflag AS r, [{", ".join(f"'{h}'" for h in HEADERS)}][l_partkey % {len(HEADERS)} + 1] AS h FROM lineitem),
x AS (SELECT file, h, max({{'p': position, 't': CASE r WHEN 'A' THEN upper(h) WHEN 'R' THEN replace(h, ' ', ' - ') ELSE h END}}) AS m, count(*) AS n FROM l GROUP BY file, h),
g AS (SELECT file, h, m.p AS position, m.t AS header, n FROM x)
SELECT file, field, arg_min(header, k) AS header, CAST(arg_min(position, k) AS INT) AS position FROM g JOIN a USING (h) GROUP BY file, field
UNION ALL SELECT file, '(repeated)', h, -1 FROM g WHERE n > 1""",
    "unmatched_log": r"""WITH t AS (SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 200) AS text FROM documents) SELECT * FROM t WHERE doc_id % 6 = 0 AND text <> '' AND text <> regexp_replace(text, '[^\x00-\x7F]', '', 'g')""",
    "bundle_refresh": "SELECT r_name AS name FROM region WHERE (SELECT max(ts) FROM events) > (SELECT max(ts) FROM events WHERE event_type = 'error') UNION ALL SELECT n_name FROM nation WHERE (SELECT max(ts) FROM events) <= (SELECT max(ts) FROM events WHERE event_type = 'error')",
    "export_days": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts + INTERVAL 1 DAY, '%Y%m%d') END AS day, CASE WHEN event_id % 3 = 0 THEN 'claims' END AS kind FROM events",
    "backoff_states": """
WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (
  SELECT user_id, 0 AS k, 0 AS limits, 0 AS pauses, 0 AS in_row, 0 AS had, false AS stopped, 0 AS done FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT s.user_id, e.k, limits + CAST(l AS INT), pauses + CAST(l AND in_row >= 1 AND had < 3 AS INT), CASE WHEN l THEN in_row + 1 ELSE 0 END, CASE WHEN l THEN had + CAST(in_row >= 1 AND had < 3 AS INT) ELSE 0 END, l AND in_row >= 1 AND had >= 3, done + CAST(NOT l AS INT)
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1 WHERE NOT stopped)
SELECT user_id, CAST(limits AS INT) AS limits, CAST(pauses AS INT) AS pauses, stopped, CAST(done AS INT) AS done FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
}
