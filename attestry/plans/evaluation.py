"""Queries over mining and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining as G
from ..operators import retrieval as R
from ..operators.expansion import STOP_WORDS
from ..sources.sinks import stored
from .common import table, toks

ODDS = 1.0


def ngram_log_odds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    anchors = docs.where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    # the anchors are a property of the document here, so no join tells it
    words = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", 1).alias("_a"), F.lit(None).cast("int").alias("_k"), T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    only = G.shared_words(words.where("_a = 1"), "w", anchors.count())
    grams = G.ngrams(words, "w", STOP_WORDS, keep=("_a", "_k"), only=only, parts=G.parts_for(docs, "text"))
    return G.mined(grams, anchors, total=docs.count(), least_odds=ODDS)


def subsumption_dedupe(spark, sf_dir):
    anchors = table(spark, sf_dir, "documents").where("lang = 'fr'")
    parts = G.parts_for(anchors, "text")
    grams = G.ngrams(anchors.select(F.col("doc_id").alias("id"), T.tokens(F.coalesce("text", F.lit(""))).alias("w")), "w", STOP_WORDS, parts=parts)
    # the plan reads the counts twice
    return G.without_subsumed(stored(G.gram_counts(grams, parts).where(F.col("a") >= G.LEAST_ANCHORS)), parts)


def _judged(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "relevant").when(F.col("quality") == 1, "partial").otherwise("not")
    return labels.select(F.col("lang").alias("question"), F.col("doc_id").alias("id"), label.alias("label"))


def _lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("question"), F.col("doc_id").alias("id"), "n_chars", F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("s"))
    scores = F.array(*(F.struct(F.lit(k).alias("strategy"), v.cast("double").alias("score")) for k, v in (("short", -F.col("n_chars")), ("long", F.col("n_chars")), ("source", -F.col("s")))))
    each = docs.select("question", "id", F.explode(scores).alias("x")).select("question", "id", "x.strategy", "x.score")
    return R.ranks(each, ["question", "strategy"], "score").select("question", "id", "strategy", "rank")


def pool_recall(spark, sf_dir):
    return G.recall(_lists(spark, sf_dir).where("rank <= 60").select("question", "strategy", "id"), _judged(spark, sf_dir))


def pooled_candidates(spark, sf_dir):
    return G.pooled(_lists(spark, sf_dir)).select("question", "id", F.array_join("found_by", ",").alias("found_by"))


def ranking_metrics(spark, sf_dir):
    return G.ranking_metrics(_lists(spark, sf_dir).where("strategy = 'long'").select("question", "id", "rank"), _judged(spark, sf_dir))


def graded_items(spark, sf_dir):
    """Items that ask each document for two words as facts of its language; half of them are of another kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"), F.col("lang").alias("kind"))
    items = docs.select(F.col("doc_id").alias("item_id"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("kind")).otherwise("other").alias("kind"), F.when(F.col("doc_id") % 3 == 0, r"\bthe\b").otherwise("(?i)de[rs]?\\s").alias("pattern"))
    return G.graded(items, docs)


def run_diff(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    count = lambda kind: ev.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return G.run_diff(count("view"), count("purchase"), ["user_id"], "n")


def call_timing(spark, sf_dir):
    return G.timings(table(spark, sf_dir, "events"), "event_type", "value")


QUERIES = {f.__name__: f for f in (ngram_log_odds, subsumption_dedupe, pool_recall, pooled_candidates, ranking_metrics, graded_items, run_diff, call_timing)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_GRAMS = f"""
w AS (SELECT doc_id AS id, {toks("coalesce(text, '')")} AS w FROM documents),
c AS (SELECT id, w[i:i + n - 1] AS g, n FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (VALUES (1), (2), (3)) k(n) WHERE len(w) >= n)),
grams AS (SELECT DISTINCT id, array_to_string(g, ' ') AS gram FROM c WHERE g[1] NOT IN ({_STOP}) AND g[n] NOT IN ({_STOP}) AND len(list_distinct(g)) = n
  AND len(list_filter(g, lambda x: regexp_full_match(x, '[0-9]+'))) < n AND len(list_filter(g, lambda x: NOT regexp_full_match(x, '[\\x00-\\x7F]+'))) = 0)"""
_JUDGED = "judged AS (SELECT lang AS question, doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 1 THEN 'partial' ELSE 'not' END AS label FROM labels JOIN documents USING (doc_id))"
_LISTS = """lists AS (
  SELECT lang AS question, doc_id AS id, 'short' AS strategy, row_number() OVER (PARTITION BY lang ORDER BY n_chars, CAST(doc_id AS VARCHAR)) AS rank FROM documents
  UNION ALL SELECT lang, doc_id, 'long', row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) FROM documents
  UNION ALL SELECT lang, doc_id, 'source', row_number() OVER (PARTITION BY lang ORDER BY CAST(regexp_extract(source, '(\\d+)', 1) AS INT), CAST(doc_id AS VARCHAR)) FROM documents)"""
SQL = {
    "ngram_log_odds": f"""
WITH {_GRAMS},
n AS (SELECT count(*) AS n, count(*) FILTER (lang = 'fr') AS a FROM documents),
k AS (SELECT gram, count(*) FILTER (lang = 'fr') AS a, count(*) AS df FROM grams JOIN documents ON doc_id = id GROUP BY gram),
s AS (SELECT gram, k.a, df, ln((k.a + 0.5::DOUBLE) / (n.a - k.a + 0.5::DOUBLE)) - ln((df - k.a + 0.5::DOUBLE) / (n.n - n.a - (df - k.a) + 0.5::DOUBLE)) AS odds, n.a AS total FROM k, n)
SELECT gram, a, df, round(odds, 6) AS score FROM s WHERE a >= 3 AND a::DOUBLE / total >= 0.03 AND odds >= {ODDS} AND df > a ORDER BY score DESC, a DESC, gram LIMIT 60""",
    "subsumption_dedupe": f"""
WITH {_GRAMS}, k AS (SELECT gram, count(*) AS a FROM grams JOIN documents ON doc_id = id WHERE lang = 'fr' GROUP BY gram HAVING count(*) >= 3)
SELECT gram, a FROM k WHERE NOT EXISTS (SELECT 1 FROM k l WHERE l.a = k.a AND l.gram <> k.gram AND contains(' ' || l.gram || ' ', ' ' || k.gram || ' '))""",
    "pool_recall": f"""
WITH {_JUDGED}, {_LISTS},
t AS (SELECT question, count(*) FILTER (label = 'relevant') AS ns, count(*) FILTER (label IN ('relevant', 'partial')) AS nl FROM judged GROUP BY 1),
r AS (SELECT l.question, strategy, count(*) AS n, count(label) AS j, count(*) FILTER (label = 'relevant') AS s, count(*) FILTER (label IN ('relevant', 'partial')) AS p FROM lists l LEFT JOIN judged USING (question, id) WHERE rank <= 60 GROUP BY ALL)
SELECT question, strategy, round(s::DOUBLE / nullif(ns, 0), 3) AS recall, round(p::DOUBLE / nullif(nl, 0), 3) AS recall_lenient, round(s::DOUBLE / nullif(j, 0), 3) AS precision, n - j AS unjudged FROM r LEFT JOIN t USING (question)""",
    "pooled_candidates": f"WITH {_LISTS} SELECT question, id, string_agg(strategy, ',' ORDER BY strategy) AS found_by FROM lists WHERE rank <= 60 GROUP BY question, id",
    "ranking_metrics": f"""
WITH {_JUDGED}, {_LISTS},
g AS (SELECT question, id, label, CASE label WHEN 'relevant' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS gain FROM judged),
m AS (SELECT l.question, coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 5), 0) AS d5, coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 10), 0) AS d10, count(*) FILTER (rank <= 5 AND label = 'relevant') AS relevant5, count(*) FILTER (rank <= 20 AND label = 'relevant') AS h20
  FROM lists l LEFT JOIN g USING (question, id) WHERE strategy = 'long' GROUP BY 1),
i AS (SELECT question, sum(gain / log2(r + 1)) FILTER (r <= 5) AS i5, sum(gain / log2(r + 1)) FILTER (r <= 10) AS i10, count(*) FILTER (label = 'relevant') AS n FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY gain DESC, id) AS r FROM g WHERE gain > 0) GROUP BY 1)
SELECT question, round(d5 / nullif(i5, 0), 3) AS ndcg5, round(d10 / nullif(i10, 0), 3) AS ndcg10, relevant5, round(h20::DOUBLE / nullif(n, 0), 3) AS recall20 FROM m LEFT JOIN i USING (question)""",
    "graded_items": r"""
WITH d AS (SELECT doc_id, regexp_matches(coalesce(text, ''), CASE WHEN doc_id % 3 = 0 THEN '\bthe\b' ELSE '(?i)de[rs]?\s' END) AS m, doc_id % 2 = 0 AS same FROM documents)
SELECT doc_id AS item_id, m AND same AS correct, m AND NOT same AS misplaced FROM d""",
    "run_diff": """
WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS gained, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS lost FROM b FULL JOIN a USING (user_id)""",
    "call_timing": "SELECT event_type, count(*) AS calls, round(avg(value), 3) AS mean_ms, round(sum(value), 3) AS total_ms FROM events GROUP BY 1",
}
