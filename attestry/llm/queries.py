"""One query for each operator, over its whole table, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, embeddings, langid, lattice, packing, pii, simhash, substrings, tokens, toxicity, urls, whitening
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long, which some 10**8 vectors can have, raises; the operator's own are decimals."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice.scored(table(spark, sf_dir, "documents"), ~lattice.held_out())
    return out.select("doc_id", lattice.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    own = (
        op1_token_counts, op2_toxicity, op3_language, op4_packing, op5_pii, op6_decontamination, op7_url_filters, op8_substring_dedup, op9_simhash, op10_embedding_dedup,
        op11_whitening, op12_source_divergence, op13_lattice_score,
    )
    return {f.__name__: f for f in own}


FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS6 = r"regexp_extract_all(" + FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH items AS (SELECT item_id, {WORDS6.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, coalesce({WORDS6.format('text')}, []) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs),
hit AS (
  SELECT p.doc_id, p.i, s.n, iw.item_id
  FROM (SELECT pos.doc_id, pos.i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS win FROM pos, (SELECT DISTINCT n FROM iw) z WHERE i + z.n - 1 <= len(w)) p
  JOIN iw ON iw.win = p.win AND iw.n = p.n
  JOIN (SELECT DISTINCT n FROM iw) s ON s.n = p.n
),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(generate_series(0, n - 1)) AS k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

_HOST = FOLDED.format(r"coalesce(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), '')")
_PATH = r"coalesce(regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
_NODE = _HOST + " || " + _PATH + r" || coalesce(regexp_extract({0}, '^(?s:.*?)://[^?#]*(\?[^#]*)', 1), '')"
_ROOT = r"regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1)"
_BESIDE = "CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END"
_TAIL = r"regexp_extract(l, '^([^?#]*)', 1) || regexp_extract(l, '^[^?#]*(\?[^#]*)', 1)"
#: A link resolved against its page; segments of dots, which the SQL leaves as they are, are tested by hand.
_MEANT = rf"""CASE WHEN regexp_matches(l, '(?i)^[a-z][a-z0-9+.-]*://') THEN l WHEN regexp_matches(l, '(?i)^[a-z][a-z0-9+.-]*:') OR l = '' OR l LIKE '#%' THEN NULL
  WHEN l LIKE '//%' THEN regexp_extract(url, '^((?s:.*?)):', 1) || ':' || l WHEN l LIKE '/%' THEN {_ROOT} || {_TAIL} WHEN l LIKE '?%' THEN {_ROOT} || path || {_TAIL} ELSE {_ROOT} || {_BESIDE} || {_TAIL} END"""
_FITS = "(({h} = '{own}' OR ends_with({h}, '.{own}')) AND starts_with({p}, '{start}'))"
_ORDERED = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(f"WHEN {_FITS.format(h='host', p='path', own=o, start=s)} THEN '{v}|{o}{s}'" for v, o, s in _ORDERED) + " END"

OP7 = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, CASE WHEN url LIKE '%://%' THEN {_NODE.format('url')} END AS node,
    list_concat(
      list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical["'']?[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS ls
  FROM pages
),
r AS (SELECT *, {_RULE} AS hit FROM p),
e AS (SELECT node AS a, {_MEANT} AS dst FROM (SELECT node, url, path, unnest(ls) AS l FROM p WHERE node IS NOT NULL)),
f AS (SELECT a, {_NODE.format('dst')} AS b, {_HOST.format('dst')} AS host, {_PATH.format('dst')} AS path FROM e WHERE dst LIKE '%://%'),
pairs AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
bad(node) AS (
  SELECT node FROM r WHERE hit LIKE 'block|%' AND node IS NOT NULL
  UNION SELECT b FROM (SELECT b, {_RULE} AS hit FROM f) WHERE hit LIKE 'block|%'
  UNION SELECT pairs.b FROM bad JOIN pairs ON pairs.a = bad.node
)
SELECT page_id, host, path, split_part(hit, '|', 2) AS rule,
  coalesce(split_part(hit, '|', 1), CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""

OP8 = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT win.doc_id, i, unnest(generate_series(0, 49)) AS k FROM win JOIN first USING (h) WHERE win.doc_id > d)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM docs WHERE len(w) > 0),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
c AS (SELECT x, least(x, min(y)) AS component FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS links FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT g.lang, count(v.term) AS kept, coalesce(sum(v.n), 0) AS spoken FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN v USING (lang) GROUP BY g.lang),
own AS (SELECT c.* FROM c JOIN v USING (lang, term)),
tot AS (SELECT g.lang, g.source, kept, spoken, coalesce(sum(own.n), 0) AS total FROM g JOIN size USING (lang) LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, v.term, coalesce(own.n, 0) AS n,
    1 + (1000000000 * (coalesce(own.n, 0) + 5)::HUGEINT) // (total + 5 * kept) AS p, 1 + (1000000000 * (v.n + 5)::HUGEINT) // (spoken + 5 * kept) AS q
  FROM tot t JOIN v USING (lang) LEFT JOIN own ON own.lang = t.lang AND own.source = t.source AND own.term = v.term
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
    ON z.lang = a.lang AND z.s1 = a.source AND z.s2 = b.source
),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q) WHERE rank <= 50
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""


def oracle_sql() -> dict[str, str]:
    """Token counts, classifiers, packing, boosted spans, 64-bit hashes of shingles, eigenvectors and lattices have no SQL; tests compare them with brute force."""
    return {"op6_decontamination": OP6, "op7_url_filters": OP7, "op8_substring_dedup": OP8, "op10_embedding_dedup": OP10, "op12_source_divergence": OP12}
