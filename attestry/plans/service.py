"""Queries over budgets, fallbacks, refreshes, queues and collected comparisons."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import mining as G
from ..operators import retrieval as R
from ..operators import service as V
from .common import table
from .common import CODE, part_code

NOW = datetime.datetime(2024, 1, 20, tzinfo=datetime.UTC)


def term_budget(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("question"), F.col("p_size").alias("block"), F.col("p_brand").alias("query"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), (F.col("p_size") > 45).alias("is_class"))
    return V.within_term_budget(names, 20).select("question", "name", "place")


def class_conflicts(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select(F.substring(part_code(), 1, 5).alias("code"), F.element_at(F.split("p_name", " "), 1).alias("label"))
    return V.class_conflicts(codes).select("code", F.array_join("labels", ",").alias("labels"), "omitted")


def class_analogues(spark, sf_dir):
    """Every code typed as a query; those of ordered parts found something. Classes of five signs have names where their number is even."""
    part = table(spark, sf_dir, "part")
    code = part_code()
    leaves = part.select(code.alias("code"), "p_name").groupBy("code").agg(F.min("p_name").alias("label"))
    fives = part.where("p_size % 2 = 0").select(F.substring(code, 1, 5).alias("code"), F.concat("p_type", F.lit(" CLASS")).alias("label")).distinct().groupBy("code").agg(F.min("label").alias("label"))
    fours = part.select(F.substring(code, 1, 4).alias("code"), F.concat(F.lit("group "), F.substring(code, 1, 4)).alias("label")).distinct()
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select(F.lower(code).alias("query")).distinct()
    return V.class_analogues(part.select(F.lower(code).alias("query")).distinct(), leaves.union(fives).union(fours), found)


def fallback_states(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in ("purchase", "click", "error", "signup")))
    return ev.select("user_id", V.fallback_state(F.greatest(F.col("purchase") - 8, F.lit(0)), F.greatest(F.col("click") - 20, F.lit(0)), F.greatest(F.col("error") - 8, F.lit(0)), F.greatest(F.col("signup") - 10, F.lit(0))).alias("state"))


def refresh_merge(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    old = customer.select(F.col("c_custkey").alias("study_id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("contact"))
    new = orders.groupBy(F.col("o_custkey").alias("study_id")).agg(F.max("o_orderpriority").alias("status"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("")).alias("contact"))
    return V.refreshed(old, new, ("contact",))


def unexpired_entries(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("stored_at"), (F.get_json_object("props", "$.k").cast("int") * 86_400).alias("ttl_seconds"), F.col("event_type").alias("sha256"), F.when(F.col("value") > 2, F.col("event_type")).alias("actual_sha256"))
    return V.unexpired(ev, NOW).select("event_id")


def resumable_queue(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return V.pending(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


def strategy_lists(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    kinds = {"purchase": ("narrow", 0), "signup": ("narrow", 1), "view": ("broad", 0), "click": ("broad", 1), "error": ("broad", 2)}
    told = spark.createDataFrame([(k, s, b) for k, (s, b) in kinds.items()], "event_type string, strategy string, block int")
    scored = ev.select("event_type", F.col("user_id").alias("id"), (F.col("n") * 1_000_000_000 + F.col("last")).cast("double").alias("score"))
    out = R.ranks(scored, ["event_type"], "score").join(told, "event_type").select(F.lit("q").alias("question"), "strategy", "block", F.col("event_type").alias("list"), "id", "rank")
    return V.strategies(out).select("strategy", "id", "fused")


def family_split(spark, sf_dir):
    return G.parity_split(table(spark, sf_dir, "documents").select(F.col("source").alias("family")).distinct())


def collected_comparison(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("study_id"), F.col("c_nationkey").cast("string").alias("fingerprint"), F.when(F.col("c_acctbal") < 0, "NOT_FOUND").alias("error"))
    answers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_id"), F.col("s_nationkey").cast("string").alias("fingerprint"), F.col("s_name").alias("answer"))
    return V.collected(rows, answers).select("study_id", "state", "answer")


QUERIES = {f.__name__: f for f in (term_budget, class_conflicts, class_analogues, fallback_states, refresh_merge, unexpired_entries, resumable_queue, strategy_lists, family_split, collected_comparison)}
SQL = {
    "term_budget": """
WITH n AS (SELECT p_type AS question, p_name AS name, p_size, p_brand, p_partkey, p_size > 45 AS c FROM part),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, name ORDER BY c DESC, p_size, p_brand, p_partkey) AS f FROM n) WHERE f = 1),
p AS (SELECT question, name, row_number() OVER (PARTITION BY question ORDER BY c DESC, p_size, p_brand, p_partkey, name) AS place FROM o)
SELECT question, name, CAST(place AS INT) AS place FROM p WHERE place <= 20""",
    "class_conflicts": f"WITH c AS (SELECT DISTINCT substr({CODE}, 1, 5) AS code, split_part(p_name, ' ', 1) AS label FROM part) SELECT code, string_agg(label, ',' ORDER BY label) AS labels, count(*) > 1 AS omitted FROM c GROUP BY code",
    "class_analogues": f"""
WITH p AS (SELECT p_partkey, {CODE} AS code, p_name, p_type, p_size FROM part),
leaf AS (SELECT code, min(p_name) AS label FROM p GROUP BY code), five AS (SELECT code[1:5] AS code, min(p_type || ' CLASS') AS label FROM p WHERE p_size % 2 = 0 GROUP BY 1),
found AS (SELECT DISTINCT code FROM lineitem JOIN p ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_discount > 0.05),
q AS (SELECT DISTINCT code FROM p WHERE code NOT IN (SELECT code FROM found))
SELECT lower(q.code) AS query, coalesce(five.label, 'group ' || q.code[1:4]) AS term, 'broader' AS relation FROM q LEFT JOIN five ON five.code = q.code[1:5]
UNION SELECT lower(q.code), leaf.label, 'sibling' FROM q JOIN leaf ON leaf.code[1:5] = q.code[1:5] AND leaf.code <> q.code""",
    "fallback_states": """
WITH e AS (SELECT user_id, greatest(count(*) FILTER (event_type = 'purchase') - 8, 0) AS h, greatest(count(*) FILTER (event_type = 'click') - 20, 0) AS f, greatest(count(*) FILTER (event_type = 'error') - 8, 0) AS t, greatest(count(*) FILTER (event_type = 'signup') - 10, 0) AS a FROM events GROUP BY 1)
SELECT user_id, CASE WHEN h > 0 THEN NULL WHEN f > 0 THEN 'concept_filtered_out' WHEN t = 0 THEN 'no_analogous_terms' WHEN a > 0 THEN 'available' ELSE 'no_matches' END AS state FROM e""",
    "refresh_merge": """
WITH n AS (SELECT o_custkey AS study_id, max(o_orderpriority) AS status, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE '' END) AS contact FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, study_id) AS study_id, CASE WHEN study_id IS NULL THEN c_mktsegment ELSE n.status END AS status, coalesce(nullif(n.contact, ''), c_name) AS contact FROM customer FULL JOIN n ON study_id = c_custkey""",
    "unexpired_entries": "SELECT event_id FROM events WHERE epoch_us(ts) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 86400 * 1000000 > epoch_us(TIMESTAMP '2024-01-20') AND value > 2",
    "resumable_queue": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "strategy_lists": """
WITH e AS (SELECT event_type, user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, last DESC) AS rank, CASE WHEN event_type IN ('purchase', 'signup') THEN 'narrow' ELSE 'broad' END AS strategy FROM e)
SELECT strategy, user_id AS id, round(sum(1.0::DOUBLE / (20 + rank)), 6) AS fused FROM r GROUP BY ALL HAVING count(*) = CASE strategy WHEN 'narrow' THEN 2 ELSE 3 END""",
    "family_split": "SELECT DISTINCT source AS family, CASE WHEN right(sha256(source), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'dev' ELSE 'test' END AS split FROM documents",
    "collected_comparison": """
SELECT c_custkey AS study_id, CASE WHEN c_acctbal < 0 THEN 'error' WHEN s_suppkey IS NULL THEN 'pending' WHEN s_nationkey <> c_nationkey THEN 'stale' ELSE 'complete' END AS state,
  CASE WHEN c_acctbal >= 0 AND s_nationkey = c_nationkey THEN s_name END AS answer FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
}
