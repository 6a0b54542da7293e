"""Queries over stored records: batches, readings, history, archives, notes, tallies, comparisons, restored facts, verdicts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import medicines as N
from ..operators import merging as M
from ..operators import mining as G
from ..operators import service as V
from ..sources import pages as P
from ..sources import sinks as K
from .common import WHOLE, quote, table

NOW = datetime.datetime(2024, 1, 20, tzinfo=datetime.UTC)


def batch_store(spark, sf_dir):
    """Lines of orders as batches; first lines of large orders are saved anew under another reading."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("study_id"), F.col("l_linenumber").alias("offset")).agg(F.max("l_returnflag").alias("fingerprint"), F.max("l_linestatus").alias("reading"), F.max("l_quantity").alias("q"))
    rows = li.select("study_id", "fingerprint", "reading", (F.col("offset") % 2).cast("string").alias("kind"), "offset", F.lit("old").alias("body"), "q")
    return K.saved_batches(rows.drop("q"), rows.where("offset = 1 and q > 30").withColumn("body", F.lit("new")).drop("q"))


def reading_store(spark, sf_dir):
    """Suppliers' readings and customers' analyses; a third are read anew, and those of parser 3 stay as they are."""
    s = table(spark, sf_dir, "supplier")
    own = s.select(F.col("s_suppkey").alias("protocol_id"), F.col("s_nationkey").cast("string").alias("reading"), F.concat(F.lit("p"), F.col("s_suppkey") % 4).alias("parser"))
    new = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("protocol_id"), F.when(F.col("s_nationkey") > 10, "other").otherwise(F.col("s_nationkey").cast("string")).alias("reading"), F.lit("p9").alias("parser"))
    analyses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study_id"), F.pmod(F.col("c_custkey"), F.lit(200)).alias("protocol_id"))
    readings, kept = K.saved_readings(own, new, analyses, "p3")
    return readings.select(F.lit("reading").alias("what"), F.col("protocol_id").alias("id"), F.concat_ws("/", "reading", "parser").alias("value")).union(kept.select(F.lit("analysis"), "study_id", F.col("protocol_id").cast("string")))


def analysis_history(spark, sf_dir):
    """What a save of customers' latest orders over their segments moves to the history."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    now = c.select(F.col("c_custkey").alias("study_id"), F.lit("f").alias("fingerprint"), F.concat("c_mktsegment", F.col("c_nationkey")).alias("body"))
    new = o.groupBy(F.col("o_custkey").alias("study_id")).agg(F.lit("f").alias("fingerprint"), F.max("o_orderpriority").alias("body"))
    return K.history_rows(now, new)


def archive_store(spark, sf_dir):
    """Documents by content: those of one source and text are one."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    files = docs.select(F.col("source").alias("study_id"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("archived_at"))
    return K.archived(files).select("study_id", "sha256", "protocol_id", "length", "archived_at")


def merged_answers(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("batch"), F.col("event_id").alias("ord"), F.concat_ws(" ", F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, "!")).alias("value"))
    return V.batch_turn(ev, "user_id", 20).select("user_id", "ord", "omitted")


def cap_notes(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return V.cap_notes(ev, "user_id", "event_type", "k", {"view": 20, "click": 20, "error": 20})


def outcome_tallies(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return V.tallied(ev.select(F.when(F.col("event_type") == "click", "PROTOCOL_NOT_FOUND").when(F.col("event_type") != "view", F.upper("event_type")).alias("code")))


def retry_delays(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sat, "), F.date_format(F.to_timestamp(F.lit("2024-01-19 00:00:00")) + F.make_interval(hours=F.col("user_id").cast("int")), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(F.col("event_id") % 4 == 2, "soon")
    return ev.select("event_id", F.round(V.retry_delay(value, (F.col("user_id") % 5).cast("int"), NOW), 3).alias("seconds"))


def observed_totals(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("study_id")).agg(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("exposures"))
    return V.observed_totals(ev, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_id")))


def reindexed_studies(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    of = lambda kind: ev.where(F.col("event_type") == kind).select(F.col("user_id").alias("study_id"))
    return V.needing_index(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study_id")), of("purchase"), of("signup"))


def graded_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("found"), F.count_if(F.col("l_linestatus") == "F").alias("correct"))
    return V.summed(li, ("found", "correct"))


def failed_thresholds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("found"), F.count_if(F.col("l_linestatus") == "F").alias("misplaced"))
    return V.thresholds(li, {"found": 1}, {"misplaced": 3}).select("doc_id", F.array_join("failed", "; ").alias("failed"))


def comparison_work(spark, sf_dir):
    """Customers as rows, suppliers as analyses, users of events as answers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study_id"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")).alias("fingerprint"), (F.col("c_custkey") % 2).cast("string").alias("reading"))
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey").cast("string")).otherwise("0").alias("fingerprint"), (F.col("s_suppkey") % 4 % 2).cast("string").alias("reading"))
    w = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("study_id")).distinct()
    return V.pending_tools(c, a, w).select("study_id", "status", "tool", "error")


def comparison_cells(spark, sf_dir):
    """Cited pages and matched terms of users, from their events."""
    ev = table(spark, sf_dir, "events").where("event_id % 7 = 0")
    e = F.struct(F.col("event_id").alias("page"), F.when(F.col("event_type") == "view", "source_name").alias("server"))
    rows = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(e)).alias("evidence"), F.array_sort(F.collect_set("event_type")).alias("terms"), F.array_sort(F.collect_set(F.when(F.col("event_type").isin("click", "error"), F.col("event_type")))).alias("category"))
    return rows.select("user_id", M.cited_pages(F.col("evidence")).alias("pages"), M.match_text(F.when(F.col("user_id") % 5 == 0, "analogous").otherwise("concept"), F.col("terms"), F.col("category")).alias("match"))


def _found(spark, sf_dir):
    pages = P.paged(table(spark, sf_dir, "documents").select("doc_id", "text"), chars=WHOLE)
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return pages, quotes, E.containment(quotes, pages)


def restored_facts(spark, sf_dir):
    """Held benchmark items as distributed facts; of every fourth the document is another one, and of every fifth the place is wrong."""
    pages, quotes, found = _found(spark, sf_dir)
    q = T.normalize_quote(F.col("quote"))
    rows = found.join(quotes, "quote_id").join(pages, ["doc_id", "page"]).select(F.concat_ws("-", "quote_id", "doc_id").alias("fact_id"), F.sha2(F.when(F.col("doc_id") % 4 == 0, "gone").otherwise(F.col("doc_id").cast("string")), 256).alias("sha256"), "page", F.when(F.col("doc_id") % 5 == 0, 3).otherwise(F.instr(T.normalize_quote(F.col("text")), q) - 1).alias("start"), F.sha2(q, 256).alias("quote_sha256"), F.length(q).alias("quote_length"))
    archive = table(spark, sf_dir, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), "doc_id")
    return E.restored_facts(rows, pages, archive).select("fact_id", "status", F.sha2(F.array_join(F.transform("quotes", T.normalize_quote), "|"), 256).alias("quotes_sha256"))


def facts_overview(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and turn > 3").select(F.col("conv_id").alias("study_id"), "turn")
    return E.facts_summary(turns, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("study_id")), 100)


def exportable_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("study_id"), F.col("event_type").alias("ord"), F.when(F.col("value") > 0.2, F.col("event_id")).alias("start"))
    return E.exportable(rows)


def long_quotes(spark, sf_dir):
    """Quotes of 8 characters or more, 8 at most, of each conversation: the texts cut at blanks count for themselves."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("quote"))).alias("e"))
    return turns.select("conv_id", "turn", F.array_join(F.transform(E.without_short_quotes(F.col("e")), lambda x: x["quote"]), "|").alias("quotes"))


def audit_notes(spark, sf_dir):
    """Documents whose sources are their language and its name; words of their texts stand for marks."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    none = F.array().cast("array<struct<page:int,quote:string>>")
    facts = docs.select("doc_id", F.lit("data_source").alias("kind"), F.concat(F.lit("The "), F.col("lang"), F.lit(" register")).alias("value"), none.alias("evidence")).union(docs.select("doc_id", F.lit("exposure"), F.concat(F.lit("Tinacid "), F.col("doc_id") % 50, F.lit(" mg")), F.array(F.struct(F.lit(1), F.concat(F.lit("tinacid "), F.col("doc_id") % 40, F.lit(" mg"))))))
    listed = docs.select("doc_id", F.explode(F.array(F.concat(F.col("lang"), F.lit(" Register")), F.col("source"))).alias("source"))
    return E.audit_notes(facts, docs.select("doc_id", F.lit(1).alias("page"), "text"), listed)


def gram_orders(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.element_at(F.split("p_name", " "), 1)))).alias("gram"), "p_size")
    return G.one_order(part.groupBy("gram").agg(F.sum("p_size").alias("a")))


def mined_decisions(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("concept"), F.concat(F.substring("event_type", 1, 2), F.get_json_object("props", "$.k")).alias("term"), "value").groupBy("concept", "term").agg(F.round(F.sum("value"), 3).alias("score"))
    verdicts = ev.select("concept", "term", F.when(F.length("term") % 2 == 0, "related").otherwise("synonym").alias("kind"), F.col("term").endswith("4").alias("confirmed"))
    owners = ev.where(F.col("concept") == "1").select("term", "concept").where(F.col("term").endswith("3"))
    return G.decided(ev, verdicts, owners).select("concept", "term", "kind", "score")


def label_review(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "relevant").otherwise("partial").alias("label"), F.lit("high").alias("confidence"), F.when(F.col("toxic") == 1, "not in it at all").otherwise("THE").alias("quote"))
    return G.merged_labels(rows, docs).select("id", "label", "confidence", "review_order")


def medicine_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    labels = part.select(F.concat(F.lit("A01AA"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")).alias("code"), F.col("p_name").alias("label")).groupBy("code").agg(F.min("label").alias("label"))
    records = part.select(F.col("p_partkey").alias("record_id"), F.col("p_type").alias("product"), F.split("p_name", " ").alias("ingredients"))
    return N.known_names(labels, records)


def url_allowed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.allowed_url(F.col("url"), ("thther.example.org", "www.thther.example.org")).alias("allowed"), F.coalesce(F.col("url").startswith("https://"), F.lit(False)).alias("secure")).groupBy("secure").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("pages"))


def page_errors(spark, sf_dir):
    pages = P.paged(table(spark, sf_dir, "documents").select("doc_id", "text"), chars=500)
    return P.page_errors(pages)


def catalogue_actions(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("newest"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n") > 60, "stale").otherwise("current")
    return ev.select("user_id", V.summary_row(F.when(F.col("user_id") % 9 > 0, F.col("newest")), state, F.when(F.col("user_id") % 2 == 0, "missing").otherwise("there")).alias("next"), V.newer_version(F.concat_ws(".", F.lit("1"), F.col("user_id")), F.concat_ws(".", F.lit("v1"), F.col("n"), F.lit("3"))).alias("newer"))


def proposed_codes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("question"), F.col("p_partkey").alias("ord"), F.element_at(F.array(*map(F.lit, ("ATC", "ICD-10", "LOCAL"))), (F.col("p_partkey") % 3).cast("int") + 1).alias("system"), F.concat(F.lit(" "), F.lower(F.substring("p_type", 1, 1)), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.when(F.col("p_size") % 5 == 0, ".12345").otherwise("")).alias("code"))
    return V.proposed_codes(rows).select("question", "ord", "system", "code", "origin", "verified")


def finished_batches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    batches = turns.groupBy("conv_id", (F.col("turn") / 2).cast("int").alias("batch")).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    done = V.checkpointed(batches, batches.select(F.lit("").alias("signature"))).where("conv_id % 2 = 0").select("signature")
    return V.checkpointed(batches, done).select("conv_id", "batch", "reused")


def shared_observations(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    key = F.element_at(F.array(*map(F.lit, (*V.SHAREABLE, "pdf_id", "error"))), F.pmod("event_id", F.lit(7)).cast("int") + 1)
    rows = ev.groupBy("user_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(key.alias("k"), F.lit("x").alias("v"))))).alias("m"))
    return rows.select("user_id", F.array_join(F.array_sort(F.map_keys(V.shareable(F.col("m")))), ",").alias("keys"))


def analysis_views(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    of = lambda role: F.collect_list(F.when(F.col("role") == role, F.struct("text")))
    rows = turns.groupBy(F.col("conv_id").alias("study_id")).agg(of("user").alias("outcomes"), of("system").alias("data_sources"), F.max(F.when(F.col("turn") == 5, F.struct("text"))).alias("population"))
    return V.analysis_view(rows)


def search_plans(spark, sf_dir):
    """Titles of documents as questions; every third has terms of an expansion."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.coalesce(F.regexp_extract("text", r"^\s*([^\n]+)", 1), F.lit("")).alias("text"))
    terms = docs.where("query_id % 3 = 0").select("query_id", F.explode(F.array(F.struct(F.lit(2).alias("ord"), F.lit("second").alias("term")), F.struct(F.lit(1).alias("ord"), F.lit("first").alias("term")))).alias("x")).select("query_id", "x.*")
    return V.planned(docs, terms).select("query_id", F.array_join("queries", "|").alias("queries"), "target_role", "status")


def expansion_views(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in (("view", "english"), ("click", "related"), ("error", "analogous"), ("purchase", "code")) for x in kv]), F.col("event_type"))
    rows = ev.select(F.col("user_id").alias("query_id"), F.concat(F.lit("t"), F.get_json_object("props", "$.k")).alias("term"), kind.alias("kind"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "broader").otherwise("ATC").alias("detail"))
    return V.expansion_view(rows).select("query_id", *(F.array_join(k, ",").alias(k) for k in ("english", "related", "analogous", "code")))


QUERIES = {f.__name__: f for f in (
    shared_observations, analysis_views, search_plans, expansion_views, batch_store, reading_store, analysis_history, archive_store, merged_answers, cap_notes, outcome_tallies, retry_delays, observed_totals, reindexed_studies, graded_totals, failed_thresholds, comparison_work, comparison_cells, restored_facts, facts_overview, exportable_facts, long_quotes, audit_notes,
    gram_orders, mined_decisions, label_review, medicine_names, url_allowed, page_errors, catalogue_actions, proposed_codes, finished_batches,
)}

_PAGES = "pages_ AS (SELECT doc_id, CAST(k AS INT) AS page, substr(text, (k - 1) * 50000000 + 1, 50000000) AS text FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(1, CAST(ceil(length(text) / 50000000.0) AS INT)))) AS k FROM documents WHERE text IS NOT NULL))"
SQL = {
    "batch_store": """
WITH r AS (SELECT l_orderkey AS study_id, max(l_returnflag) AS fingerprint, max(l_linestatus) AS reading, CAST(l_linenumber % 2 AS VARCHAR) AS kind, l_linenumber AS "offset", max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
n AS (SELECT * FROM r WHERE "offset" = 1 AND q > 30)
SELECT r.study_id, r.fingerprint, r.reading, r.kind, r."offset", CASE WHEN n.study_id IS NOT NULL AND r."offset" = 1 THEN 'new' ELSE 'old' END AS body FROM r LEFT JOIN n ON n.study_id = r.study_id WHERE n.study_id IS NULL OR (n.fingerprint = r.fingerprint AND n.reading = r.reading)""",
    "reading_store": """
WITH n AS (SELECT s_suppkey, CASE WHEN s_nationkey > 10 THEN 'other' ELSE CAST(s_nationkey AS VARCHAR) END AS reading, s_nationkey > 10 AS changed FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 <> 3)
SELECT 'reading' AS what, s.s_suppkey AS id, coalesce(n.reading || '/p9', s_nationkey || '/p' || (s.s_suppkey % 4)) AS value FROM supplier s LEFT JOIN n ON n.s_suppkey = s.s_suppkey
UNION ALL SELECT 'analysis', c_custkey, CAST(c_custkey % 200 AS VARCHAR) FROM customer WHERE c_custkey % 200 NOT IN (SELECT s_suppkey FROM n WHERE changed)""",
    "analysis_history": """
WITH n AS (SELECT DISTINCT o_custkey FROM orders), m AS (SELECT c_custkey AS study_id, c_mktsegment || c_nationkey AS body FROM customer WHERE c_custkey IN (SELECT o_custkey FROM n))
SELECT sha256(body) AS snapshot_id, min(study_id) AS study_id, 'f' AS fingerprint, body FROM m GROUP BY body""",
    "archive_store": "SELECT source AS study_id, sha256(text) AS sha256, 'pdf_' || source || '_' || sha256(text) AS protocol_id, CAST(strlen(text) AS INT) AS length, min(doc_id) AS archived_at FROM documents WHERE text IS NOT NULL GROUP BY source, text",
    "merged_answers": """
WITH f AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS v, min(event_id) AS o FROM events GROUP BY user_id, json_extract_string(props, '$.k'), event_type),
g AS (SELECT user_id, v, min(o) AS ord FROM f GROUP BY ALL), b AS (SELECT g.*, e.event_type FROM g JOIN events e ON e.event_id = g.ord),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ord) AS rn, min(ord) OVER (PARTITION BY user_id, event_type) AS first, count(*) OVER (PARTITION BY user_id) AS n FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn, first) AS turn FROM r)
SELECT user_id, ord, greatest(n - 20, 0) AS omitted FROM t WHERE turn <= 20""",
    "cap_notes": "SELECT user_id, event_type || ': 20 of ' || count(*) || ' kept, ' || CASE WHEN count(DISTINCT json_extract_string(props, '$.k')) > 1 THEN 'in turn from ' || count(DISTINCT json_extract_string(props, '$.k')) || ' batches' ELSE 'from the beginning' END AS note FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id, event_type HAVING count(*) > 20",
    "outcome_tallies": "SELECT CASE event_type WHEN 'view' THEN 'fetched' WHEN 'click' THEN 'no_protocol' ELSE 'error:' || upper(event_type) END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "retry_delays": """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN greatest(epoch(TIMESTAMP '2024-01-19') + user_id * 3600 - epoch(TIMESTAMP '2024-01-20'), 0) ELSE [2.0, 5.0, 15.0][least(user_id % 5, 2) + 1] END::DOUBLE, 3) AS seconds FROM events""",
    "observed_totals": "SELECT count(*) AS observed, count(*) FILTER (p > 0) AS with_exposures FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1) WHERE user_id IN (SELECT s_suppkey FROM supplier)",
    "reindexed_studies": "SELECT c_custkey AS study_id FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup'))",
    "graded_totals": "SELECT count(DISTINCT l_orderkey) AS documents, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS found, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS correct FROM lineitem",
    "failed_thresholds": "WITH g AS (SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R') AS f, count(*) FILTER (l_linestatus = 'F') AS m FROM lineitem GROUP BY 1) SELECT doc_id, CASE WHEN f < 1 AND m > 3 THEN 'found < 1; misplaced > 3' WHEN f < 1 THEN 'found < 1' ELSE 'misplaced > 3' END AS failed FROM g WHERE f < 1 OR m > 3",
    "comparison_work": """
WITH r AS (SELECT c_custkey AS study_id, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) END AS f, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '0' END AS af, coalesce(s_suppkey % 4 % 2 = c_custkey % 2, false) AS same, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS w FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
s AS (SELECT *, CASE WHEN f IS NULL THEN 'pending' WHEN same AND af <> f THEN 'error' WHEN same AND af = f AND w THEN 'complete' ELSE 'needs_processing' END AS status FROM r)
SELECT study_id, status, CASE WHEN status = 'needs_processing' THEN CASE WHEN same AND af = f THEN 'answer' ELSE 'analyze' END END AS tool, CASE WHEN status = 'error' THEN 'COMPARISON_SOURCE_CHANGED' END AS error FROM s""",
    "comparison_cells": """
WITH e AS (SELECT * FROM events WHERE event_id % 7 = 0),
g AS (SELECT user_id, string_agg(event_id, ', ' ORDER BY event_id) FILTER (event_type <> 'view') AS s, string_agg(event_id, ', ' ORDER BY event_id) FILTER (event_type = 'view') AS n, list_sort(list(DISTINCT event_type)) AS t, list_sort(list(DISTINCT event_type) FILTER (event_type IN ('click', 'error'))) AS c FROM e GROUP BY 1)
SELECT user_id, CASE WHEN s IS NULL THEN 'p. ' || n WHEN n IS NULL THEN 'p. ' || s ELSE 'p. ' || s || '; 名前の記載 p. ' || n END AS pages,
  CASE WHEN user_id % 5 = 0 THEN 'analogue: ' || array_to_string(t, ', ') WHEN len(c) = len(t) THEN 'category only: ' || array_to_string(t, ', ') ELSE 'concept: ' || array_to_string(list_transform(t, lambda x: CASE WHEN x IN ('click', 'error') THEN x || '（カテゴリー語）' ELSE x END), ', ') END AS match FROM g""",
    "restored_facts": f"WITH {_PAGES}, h AS (SELECT item_id, doc_id, {quote('b.text')} AS q FROM pages_ p JOIN benchmark b ON contains({quote('p.text')}, {quote('b.text')}) WHERE {quote('b.text')} <> ''), g AS (SELECT item_id, doc_id, string_agg(q, '|') AS qs FROM h GROUP BY ALL) SELECT item_id || '-' || doc_id AS fact_id, CASE WHEN doc_id % 4 = 0 THEN 'verified_at_build' ELSE 'verified_local' END AS status, CASE WHEN doc_id % 4 > 0 THEN sha256(qs) END AS quotes_sha256 FROM g",
    "facts_overview": "SELECT count(*) FILTER (f) AS total_facts, count(DISTINCT conv_id) FILTER (f) AS studies, count(*) FILTER (f) > 100 AS truncated, count(DISTINCT conv_id) - count(DISTINCT conv_id) FILTER (f) AS no_facts FROM (SELECT conv_id, role = 'assistant' AND turn > 3 AS f FROM conversations)",
    "exportable_facts": "SELECT user_id AS study_id, event_type AS ord, bool_and(value > 0.2) AS placed, count(*) AS quotes FROM events GROUP BY ALL",
    "long_quotes": r"SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ' '), lambda w: length(trim(regexp_replace(replace(w, chr(173), ''), '\s+', ' ', 'g'))) >= 8)[1:8], '|') AS quotes FROM conversations",
    "audit_notes": r"""
WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'removed passages near outcomes on pages 1' AS note FROM d WHERE regexp_matches(text, '(?i)\b(?:CCI|redacted|commercially confidential)\b') AND regexp_matches(text, '(?i)outcome|endpoint')
UNION ALL SELECT doc_id, 'listed sources not extracted: ' || source FROM d UNION ALL SELECT doc_id, 'terms of exposure without a quote: ' || (doc_id % 50) || ' mg' FROM d WHERE NOT contains('tinacid ' || (doc_id % 40) || ' mg', (doc_id % 50) || ' mg')""",
    "gram_orders": "WITH g AS (SELECT unnest([p_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)]) AS gram, p_size FROM part), a AS (SELECT gram, sum(p_size) AS a FROM g GROUP BY 1) SELECT gram, CAST(a AS BIGINT) AS a FROM a QUALIFY row_number() OVER (PARTITION BY list_sort(string_split(gram, ' ')) ORDER BY a DESC, gram) = 1",
    "mined_decisions": """
WITH e AS (SELECT CAST(user_id % 7 AS VARCHAR) AS concept, event_type[1:2] || json_extract_string(props, '$.k') AS term, round(sum(value), 3) AS score FROM events GROUP BY ALL),
r AS (SELECT *, CASE WHEN length(term) % 2 = 0 THEN 'related' ELSE 'synonym' END AS kind FROM e WHERE length(term) > 3 AND (length(term) > 5 OR term LIKE '%4') AND NOT (term LIKE '%3' AND concept <> '1' AND term IN (SELECT term FROM e WHERE concept = '1')))
SELECT concept, term, kind, score FROM r QUALIFY row_number() OVER (PARTITION BY concept, kind ORDER BY score DESC, term) <= CASE kind WHEN 'related' THEN 15 ELSE 40 END""",
    "label_review": f"""
WITH r AS (SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'partial' END AS label, CASE WHEN contains({quote("coalesce(text, '')")}, CASE WHEN toxic = 1 THEN 'not in it at all' ELSE 'the' END) THEN 'high' ELSE 'low' END AS confidence FROM labels l JOIN documents USING (doc_id))
SELECT *, CAST(CASE WHEN confidence = 'low' THEN 0 WHEN label = 'partial' THEN 1 ELSE 2 END AS INT) AS review_order FROM r""",
    "medicine_names": """
WITH l AS (SELECT 'A01AA' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS code, min(p_name) AS label FROM part GROUP BY 1),
n AS (SELECT label AS name, label AS term, {'o': 0, 'c': code} AS k FROM l UNION ALL SELECT p_name, replace(p_name, ' ', ' / '), {'o': 1, 'c': CAST(p_partkey AS VARCHAR)} FROM part UNION ALL SELECT lower(p_type), replace(p_name, ' ', ' / '), {'o': 2, 'c': CAST(p_partkey AS VARCHAR)} FROM part WHERE NOT contains(p_type, ' '))
SELECT name, arg_min(term, k) AS term FROM n WHERE length(name) >= 5 GROUP BY 1""",
    "url_allowed": r"SELECT coalesce(url LIKE 'https://%', false) AS secure, count(*) FILTER (url LIKE 'https://%' AND regexp_extract(url, '^https://([^/?#]*)', 1) IN ('thther.example.org', 'www.thther.example.org')) AS allowed, count(*) AS pages FROM pages GROUP BY 1",
    "page_errors": "WITH s AS (SELECT doc_id, greatest(1, CAST(ceil(length(text) / 500.0) AS BIGINT)) AS pages, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL) SELECT *, CASE WHEN pages > 1500 THEN 'DOCUMENT_TOO_LONG' WHEN chars < 150 THEN 'OCR_REQUIRED' WHEN chars > 5000000 THEN 'DOCUMENT_TOO_LARGE' END AS error FROM s WHERE pages > 1500 OR chars < 150 OR chars > 5000000",
    "catalogue_actions": "WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 'import' WHEN n > 60 THEN 'update' WHEN user_id % 2 = 0 THEN 'refresh_dictionary' ELSE 'none' END AS next, n > user_id OR (n = user_id) AS newer FROM e",
    "proposed_codes": """
WITH r AS (SELECT p_brand AS question, p_partkey AS ord, ['ATC', 'ICD-10', 'LOCAL'][p_partkey % 3 + 1] AS system, upper(p_type[1:1]) || lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE WHEN p_size % 5 = 0 THEN '.12345' ELSE '' END AS code FROM part)
SELECT question, ord, system, code, 'llm' AS origin, false AS verified FROM r WHERE system = 'LOCAL' OR NOT contains(code, '.') QUALIFY row_number() OVER (PARTITION BY question ORDER BY ord) <= 40""",
    "finished_batches": """
WITH b AS (SELECT conv_id, CAST(turn // 2 AS INT) AS batch, list_sort(list(text)) AS t FROM conversations GROUP BY ALL) SELECT conv_id, batch, t IN (SELECT t FROM b WHERE conv_id % 2 = 0) AS reused FROM b""",
    "shared_observations": "SELECT user_id, coalesce(string_agg(DISTINCT k, ',' ORDER BY k) FILTER (k NOT IN ('pdf_id', 'error')), '') AS keys FROM (SELECT user_id, ['protocol_found', 'text_layer', 'exposures', 'exposure_rules', 'backfill_done', 'pdf_id', 'error'][event_id % 7 + 1] AS k FROM events) GROUP BY 1",
    "analysis_views": "SELECT conv_id AS study_id, CAST(count(*) FILTER (role = 'user') AS INT) AS outcomes, CAST(count(*) FILTER (role = 'system') AS INT) AS data_sources, CAST(max(CAST(turn = 5 AS INT)) AS INT) AS population FROM conversations GROUP BY 1",
    "search_plans": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract(text, '^\s*([^\n]+)', 1), '') AS t FROM documents), a AS (SELECT *, t = regexp_replace(t, '[^\x00-\x7F]', '', 'g') AS ascii FROM d)
SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'first|second' WHEN ascii AND trim(t) <> '' THEN t ELSE '' END AS queries, CASE WHEN contains(lower(t), 'outcome') THEN 'outcome' ELSE 'unspecified' END AS target_role, CASE WHEN doc_id % 3 = 0 OR (ascii AND trim(t) <> '') THEN 'planned' ELSE 'needs_client_translation' END AS status FROM a""",
    "expansion_views": """
WITH e AS (SELECT user_id, event_id, event_type, 't' || json_extract_string(props, '$.k') AS t FROM events WHERE event_type <> 'signup')
SELECT user_id AS query_id, coalesce(string_agg(t, ',' ORDER BY event_id) FILTER (event_type = 'view'), '') AS english, coalesce(string_agg(t, ',' ORDER BY event_id) FILTER (event_type = 'click'), '') AS related, coalesce(string_agg(t || ' (broader)', ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS analogous, coalesce(string_agg('ATC:' || t, ',' ORDER BY event_id) FILTER (event_type = 'purchase'), '') AS code FROM e GROUP BY 1""",
}
