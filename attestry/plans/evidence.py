"""Queries over quotes, facts, merging and comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import merging as M
from ..operators import state
from ..sources import pages as P
from .common import WHOLE, quote, table


def _pages(spark, sf_dir):
    return P.paged(table(spark, sf_dir, "documents").select("doc_id", "text"), chars=WHOLE)


def _quotes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


def quote_containment(spark, sf_dir):
    return E.containment(_quotes(spark, sf_dir), _pages(spark, sf_dir))


def _held(spark, sf_dir):
    """Each held quote with its page, in normal form."""
    pages = _pages(spark, sf_dir).withColumn("p", T.normalize_quote(F.col("text"))).drop("text")
    quotes = _quotes(spark, sf_dir).withColumn("q", T.normalize_quote(F.col("quote"))).drop("quote")
    found = E.containment(_quotes(spark, sf_dir), _pages(spark, sf_dir))
    return pages.join(found.join(quotes, "quote_id"), ["doc_id", "page"])


def quote_position(spark, sf_dir):
    start, end, sha, size = E.quote_position(F.col("p"), F.col("q"))
    return _held(spark, sf_dir).select("quote_id", "doc_id", "page", start.alias("quote_start"), end.alias("quote_end"), sha.alias("quote_sha256"), size.alias("quote_length"))


#: What a page is moved by: a word of a sign for private use, in which no quote, however short, is found.
MOVED = "\ue000 "


def quote_restore(spark, sf_dir):
    """The printed text of held quotes, at their place and where their page begins with another word; breaks at hyphens are joined."""
    start, _, sha, size = E.quote_position(F.col("p"), F.col("q"))
    printed = _pages(spark, sf_dir).select("doc_id", "page", "text")
    rows = _held(spark, sf_dir).select("quote_id", "doc_id", "page", start.alias("s"), sha.alias("h"), size.alias("n")).join(printed, ["doc_id", "page"])
    found = rows.select("quote_id", "doc_id", "page", E.restored(F.col("text"), F.col("s"), F.col("h"), F.col("n")).alias("a"), E.restored(F.concat(F.lit(MOVED), F.col("text")), F.col("s"), F.col("h"), F.col("n")).alias("b"))
    # a soft hyphen that goes may leave two blanks
    joined = lambda c: F.sha2(F.regexp_replace(F.regexp_replace(F.replace(F.col(c), F.lit(chr(173)), F.lit("")), r"-\s+", "-"), r"\s+", " "), 256)
    return found.select("quote_id", "doc_id", "page", joined("a").alias("at_place"), joined("b").alias("after_move"))


def _lines(spark, sf_dir):
    """Documents as pages of one line each."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "text"))


def _cited(spark, sf_dir):
    """Quotes cited on the wrong line: a document's first line and the first line of the document before it, which most do not hold."""
    lines = _lines(spark, sf_dir)
    head = lines.where("page = 0").select("doc_id", "text")
    own = head.select((F.col("doc_id") * 2).alias("quote_id"), "doc_id", F.col("text").alias("quote"))
    other = head.select((F.col("doc_id") * 2 + 3).alias("quote_id"), (F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("quote")).join(head.select("doc_id"), "doc_id", "left_semi").select("quote_id", "doc_id", "quote")
    return lines, own.union(other).withColumns({"page": F.lit(2), "section": F.lit("x"), "server": F.lit(None).cast("string")})


def nearest_page(spark, sf_dir):
    lines, cited = _cited(spark, sf_dir)
    return E.corrected_pages(cited, lines).select("quote_id", "doc_id", "page", "section", "server")


def derived_section(spark, sf_dir):
    """Sections are lines, pages four lines; the heading of a section is its own line, which the page prints where it is not cut."""
    lines = _lines(spark, sf_dir)
    chunks = lines.select("doc_id", (F.col("page") / 4).cast("int").alias("page"), F.when(F.col("page") % 3 == 0, F.concat(F.lit("line "), F.col("page"))).otherwise(F.col("text")).alias("section"), "text")
    pages = lines.groupBy("doc_id", (F.col("page") / 4).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page").alias("n"), "text"))), lambda x: x["text"]), "\n").alias("text"))
    quotes = lines.where("page = 1").select(F.col("doc_id").alias("quote_id"), "doc_id", F.lit(0).alias("page"), F.col("text").alias("quote"))
    return E.derived_section(quotes, chunks, pages)


def naming_quote(spark, sf_dir):
    """Each document as a source that is called by its second and third word, cited with a quote that does not say so."""
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1)
    facts = docs.select(F.col("doc_id").alias("fact_id"), "doc_id", F.array_join(F.slice(words, 2, 2), " ").alias("value"), F.array(F.struct(F.lit(1).alias("page"), F.lit("0 no name here 0").alias("quote"))).alias("evidence"))
    chunks = _pages(spark, sf_dir).select("doc_id", "page", F.format_string("s%04d", "page").alias("section_id"), F.lit("data_sources").alias("role"), "text")
    return E.naming_quotes(facts, chunks)


def evidence_codes(spark, sf_dir):
    """Which of many quotes stand: benchmark items and first lines against the lines that are cited for them."""
    lines, cited = _cited(spark, sf_dir)
    chunks = lines.select("doc_id", "page", F.concat(F.lit("line "), F.col("page")).alias("section"), F.when(F.col("page") % 5 == 2, "references").otherwise("methods").alias("role"), "text")
    quotes = cited.withColumns({"page": F.when(F.col("quote_id") % 4 < 2, 0).otherwise(2), "section": F.when(F.col("quote_id") % 8 < 3, F.lit("line  0"))})
    return E.evidence_errors(quotes, chunks)


def _analyses(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    ev = F.array(F.struct(F.col("turn").alias("page"), F.col("text").alias("quote")))
    fact = F.struct("turn", F.col("text").alias("value"), ev.alias("evidence"), F.lit("used").alias("usage"))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, fact))), lambda x: x.dropFields("turn"))
    user, first = F.col("role") == "user", F.col("turn") == 0
    own = turns.groupBy(F.col("conv_id").alias("study_id")).agg(pick(user & ~first).alias("outcomes"), pick(F.col("role") == "assistant").alias("data_sources"), F.get(pick(user & first), 0).alias("study_design"), pick(F.col("role") == "system").alias("inc"), F.array_sort(F.collect_list(F.when(F.col("turn") == 3, F.col("role")))).alias("missing_information"))
    return own.withColumn("cohort", F.struct(F.col("inc").alias("inclusion_criteria"))).drop("inc")


def fact_rows(spark, sf_dir):
    return E.fact_rows(_analyses(spark, sf_dir)).select("study_id", "ord", "item_kind", "value", "usage", F.size("evidence").alias("quotes"), "status")


def find_facts(spark, sf_dir):
    rows = E.fact_rows(_analyses(spark, sf_dir)).select("study_id", "ord", "item_kind", "value", "evidence")
    local, bundle = rows.where("item_kind = 'outcome'"), rows
    return E.find_facts(local, bundle, kinds=("outcome", "data_source"), text="on", limit=200).select("study_id", "ord", "item_kind", "value")


def prebuilt_roundtrip(spark, sf_dir):
    rows = E.prebuilt_rows(E.fact_rows(_analyses(spark, sf_dir)))
    return E.prebuilt_facts(rows).select("study_id", "ord", "item_kind", "value", F.size("evidence").alias("quotes"), F.get("evidence", 0)["quote_sha256"].alias("first_sha256"))


def _entries(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id"), F.col("event_id").alias("ord"), F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, ".").otherwise("")).alias("value"), F.element_at(F.array(*map(F.lit, M.USAGE)), (F.col("event_id") % 4).cast("int") + 1).alias("usage"),
        F.when(F.get_json_object("props", "$.k").cast("int") > 50, "explicit").otherwise("inferred").alias("basis"), (F.col("value") > 8).alias("linkage"), F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.lit(" more")).otherwise("")).alias("definition"), F.get_json_object("props", "$.k").alias("quote"), F.lit(None).cast("array<string>").alias("types"), F.lit("source").alias("role"),
    )


def merge_entries(spark, sf_dir):
    out = M.merged_entries(_entries(spark, sf_dir), ["user_id"], M.entry_key(F.col("value"), F.col("role"), F.col("types")), "ord")
    return out.select("user_id", "value", "first", "usage", "basis", "linkage", F.array_join("quotes", ",").alias("quotes"), "definition", "merged")


def round_robin_cap(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return M.round_robin(ev, "user_id", "event_type", "event_id", 20)


def notes_overflow(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat(F.format_string("%03d ", "turn"), F.col("text")))).alias("missing"))
    return turns.select("conv_id", F.array_join(M.notes_within(F.col("missing"), F.array(F.lit("note")), 4), "|").alias("entries"))


def coverage_gaps(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    served = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("offset"), F.when(F.col("role") == "system", F.col("turn") + 2).when(F.lead("turn").over(w).isNotNull(), F.col("turn") + 1).alias("next"))
    return state.coverage(served, "conv_id", "offset", "next")


def _assessments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int") + 1)
    return li.select(
        F.col("l_suppkey").alias("study"), F.col("l_shipdate").cast("date").cast("string").alias("value"), pick(("outcome", "exposure", "unclear"), F.col("l_partkey")).alias("role"), F.lit("d").alias("definition"), (F.col("l_tax") > 0.04).alias("linkage"), F.array("l_returnflag", "l_linestatus").alias("types"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), pick(("used", "planned", "candidate"), F.col("l_orderkey")).alias("usage"), F.when(F.col("l_discount") > 0.03, "explicit").otherwise("inferred").alias("basis"), (F.col("l_quantity") > 10).alias("answered"),
    )


def conflict_pairs(spark, sf_dir):
    return M.conflict_pairs(_assessments(spark, sf_dir), "study", "ord").select("study", "value", "role", "left", "right")


def _suitable(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_id"), F.when(F.col("s_acctbal") > 500, "complete").otherwise("pending").alias("status"), F.when(F.col("s_nationkey") > 12, F.array(F.lit("X"))).otherwise(F.array(F.lit("R"))).alias("catalogue_types"))
    return M.assessed(rows, _assessments(spark, sf_dir).withColumnRenamed("study", "study_id"), ("R",), "outcome")


def suitability_status(spark, sf_dir):
    return _suitable(spark, sf_dir).select("study_id", "status", "suitability", "disjoint")


def row_selection(spark, sf_dir):
    """Studies in the order of their suitability; too many are eligible, so none is shown until some are chosen."""
    rows, state = M.selected(_suitable(spark, sf_dir), False, "study_id")
    return rows.select("study_id", "priority", "eligible", "shown", F.lit(state).alias("state"))


NATIONS = tuple(str(k) for k in range(25))


def comparison_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.groupBy(F.col("c_nationkey").cast("string").alias("study")).agg(F.count(F.lit(1)).alias("customers"), F.max("c_name").alias("last_name"), F.min("c_mktsegment").alias("segment"), F.lit("").alias("remark"))
    return M.transposed(rows, NATIONS, ("customers", "last_name", "segment", "remark")).select("attribute", *(F.col(f"`{n}`").alias(f"study_{n}") for n in NATIONS))


QUERIES = {f.__name__: f for f in (quote_containment, quote_position, quote_restore, nearest_page, derived_section, naming_quote, evidence_codes, fact_rows, find_facts, prebuilt_roundtrip, merge_entries, round_robin_cap, notes_overflow, coverage_gaps, conflict_pairs, suitability_status, row_selection, comparison_pivot)}

_PAGES = "pages_ AS (SELECT doc_id, CAST(k AS INT) AS page, substr(text, (k - 1) * 50000000 + 1, 50000000) AS text FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(1, CAST(ceil(length(text) / 50000000.0) AS INT)))) AS k FROM documents WHERE text IS NOT NULL))"
#: The normal form of a text with its letters as printed.
_PRINTED = r"trim(regexp_replace(regexp_replace(replace({}, chr(173), ''), '-\s+', '-', 'g'), '\s+', ' ', 'g'))"
_HELD = f"{_PAGES}, p AS (SELECT doc_id, page, {quote('text')} AS p FROM pages_), b AS (SELECT item_id AS quote_id, {quote('text')} AS q FROM benchmark), held AS (SELECT * FROM p JOIN b ON contains(p, q) WHERE q <> '')"
_LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS page FROM documents)"
_CITED = "head AS (SELECT doc_id, text FROM lines WHERE page = 0), cited AS (SELECT doc_id * 2 AS quote_id, doc_id, text AS quote FROM head UNION ALL SELECT doc_id * 2 + 3, doc_id + 1, text FROM head WHERE doc_id + 1 IN (SELECT doc_id FROM head))"
_FACTS = """
f AS (
  SELECT conv_id AS study_id, CASE WHEN role = 'user' AND turn = 0 THEN 'study_design' WHEN role = 'user' THEN 'outcome' WHEN role = 'system' THEN 'cohort.inclusion' ELSE 'data_source' END AS item_kind, text AS value, text AS quote, CASE role WHEN 'assistant' THEN 'used' END AS usage,
    CASE WHEN role = 'user' AND turn = 0 THEN 0 WHEN role = 'system' THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS k, turn FROM conversations
  UNION ALL SELECT conv_id, 'missing', role, NULL, NULL, 4, turn FROM conversations WHERE turn = 3),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY study_id ORDER BY k, turn, value) - 1 AS INT) AS ord FROM f)"""
_ASSESS = """a AS (SELECT l_suppkey AS study, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS value, ['outcome', 'exposure', 'unclear'][l_partkey % 3 + 1] AS role, l_tax > 0.04 AS linkage, [l_returnflag, l_linestatus] AS types, l_orderkey * 10 + l_linenumber AS ord,
  ['used', 'planned', 'candidate'][l_orderkey % 3 + 1] AS usage, CASE WHEN l_discount > 0.03 THEN 'explicit' ELSE 'inferred' END AS basis, l_quantity > 10 AS answered FROM lineitem)"""
_SUITABLE = _ASSESS + """,
r AS (SELECT *, answered AND role = 'outcome' AND usage IN ('used', 'planned') AS usable FROM a),
c AS (SELECT DISTINCT x.study FROM r x JOIN r y ON x.study = y.study AND x.value = y.value AND x.ord < y.ord AND x.usable AND y.usable AND x.basis = 'explicit' AND y.basis = 'explicit' AND (x.linkage <> y.linkage OR (NOT list_has_any(x.types, y.types) AND NOT x.linkage))),
g AS (SELECT study, bool_or(usable AND basis = 'explicit' AND list_contains(types, 'R') AND NOT linkage) AS m, bool_or(usable AND basis = 'explicit' AND list_contains(types, 'R')) AS p, bool_or(usable AND list_contains(types, 'R')) AS q, bool_or(usable AND basis = 'explicit') AS e,
  bool_or(basis = 'explicit' AND list_contains(types, 'R')) AS has_r, bool_or(basis = 'explicit') AS any_e FROM r GROUP BY study),
s AS (SELECT s_suppkey AS study_id, CASE WHEN s_acctbal > 500 THEN 'complete' ELSE 'pending' END AS status, coalesce(any_e AND (s_nationkey > 12 OR NOT has_r), false) AS disjoint,
  CASE WHEN s_acctbal <= 500 THEN 'unknown' WHEN c.study IS NOT NULL THEN 'conflicting' WHEN m THEN 'matched' WHEN p THEN 'partial' WHEN q THEN 'possible' WHEN e THEN 'other_type' ELSE 'unknown' END AS suitability FROM supplier LEFT JOIN g ON g.study = s_suppkey LEFT JOIN c ON c.study = s_suppkey)"""
SQL = {
    "quote_containment": f"WITH {_HELD} SELECT quote_id, doc_id, page FROM held",
    "quote_position": f"WITH {_HELD} SELECT quote_id, doc_id, page, CAST(instr(p, q) - 1 AS INT) AS quote_start, CAST(instr(p, q) - 1 + length(q) AS INT) AS quote_end, sha256(q) AS quote_sha256, CAST(length(q) AS INT) AS quote_length FROM held",
    "quote_restore": rf"""WITH {_HELD}, c AS (SELECT quote_id, h.doc_id, page, {_PRINTED.format('h.text')} AS p, {_PRINTED.format('b.text')} AS q FROM (SELECT held.*, g.text FROM held JOIN pages_ g USING (doc_id, page)) h JOIN benchmark b ON b.item_id = h.quote_id),
s AS (SELECT quote_id, doc_id, page, sha256(substr(p, instr(lower(p), lower(q)), length(q))) AS x FROM c) SELECT quote_id, doc_id, page, x AS at_place, x AS after_move FROM s""",
    "nearest_page": f"""
WITH {_LINES}, {_CITED},
h AS (SELECT quote_id, l.page AS p, abs(l.page - 2) AS d FROM cited c JOIN lines l ON l.doc_id = c.doc_id AND contains({quote('l.text')}, {quote('c.quote')}) WHERE {quote('c.quote')} <> ''),
m AS (SELECT quote_id, min(d) AS d FROM h GROUP BY 1),
b AS (SELECT h.quote_id, m.d, min(p) AS lo, max(p) AS hi FROM h JOIN m ON m.quote_id = h.quote_id AND m.d = h.d GROUP BY ALL)
SELECT c.quote_id, c.doc_id, CAST(CASE WHEN b.d > 0 AND lo = hi THEN lo ELSE 2 END AS INT) AS page, CASE WHEN b.d > 0 AND lo = hi THEN NULL ELSE 'x' END AS section, CASE WHEN b.d > 0 AND lo = hi THEN 'page' END AS server FROM cited c LEFT JOIN b ON b.quote_id = c.quote_id""",
    "derived_section": f"""
WITH {_LINES},
c AS (SELECT doc_id, text, CASE WHEN page % 3 = 0 THEN 'line ' || page ELSE text END AS section FROM lines WHERE page < 4),
p AS (SELECT doc_id, {quote("string_agg(text, chr(10) ORDER BY page)")} AS t FROM lines WHERE page < 4 GROUP BY 1),
q AS (SELECT doc_id, {quote('text')} AS q FROM lines WHERE page = 1),
s AS (SELECT q.doc_id, list_distinct(list(c.section) FILTER (c.section <> '' AND contains(p.t, {quote('c.section')}) AND contains({quote('c.text')}, q))) AS s FROM q JOIN p ON p.doc_id = q.doc_id JOIN c ON c.doc_id = q.doc_id GROUP BY 1)
SELECT doc_id AS quote_id, CASE WHEN len(s) = 1 THEN s[1] END AS section FROM s""",
    "evidence_codes": f"""
WITH {_LINES}, {_CITED},
q AS (SELECT quote_id, doc_id, quote, CASE WHEN quote_id % 4 < 2 THEN 0 ELSE 2 END AS page, quote_id % 8 < 3 AS labelled FROM cited),
j AS (SELECT q.*, coalesce(contains({quote('l.text')}, {quote('q.quote')}), false) AS has, l.page % 5 = 2 AS rejected FROM q LEFT JOIN lines l ON l.doc_id = q.doc_id AND l.page = q.page),
r AS (SELECT quote_id, CASE WHEN length(trim(regexp_replace(replace(quote, chr(173), ''), '\\s+', ' ', 'g'))) < 8 THEN 'QUOTE_TOO_SHORT' WHEN NOT has THEN 'QUOTE_NOT_FOUND' WHEN rejected THEN 'EVIDENCE_WRONG_SECTION' WHEN labelled AND page <> 0 THEN 'SECTION_MISMATCH' END AS code FROM j)
SELECT quote_id, code FROM r WHERE code IS NOT NULL""",
    "fact_rows": f"WITH {_FACTS} SELECT study_id, ord, item_kind, value, usage, CAST(CASE WHEN k < 4 THEN 1 ELSE 0 END AS INT) AS quotes, CASE WHEN k < 4 THEN 'ok' ELSE 'no_quote' END AS status FROM n",
    "find_facts": f"""
WITH {_FACTS}, l AS (SELECT * FROM n WHERE item_kind = 'outcome'), a AS (SELECT * FROM l UNION ALL SELECT * FROM n WHERE study_id NOT IN (SELECT study_id FROM l))
SELECT study_id, ord, item_kind, value FROM a WHERE item_kind IN ('outcome', 'data_source') AND (contains(replace(lower(value), 'ß', 'ss'), 'on') OR contains(replace(lower(quote), 'ß', 'ss'), 'on')) ORDER BY study_id, ord LIMIT 200""",
    "prebuilt_roundtrip": f"WITH {_FACTS} SELECT study_id, ord, item_kind, value, CAST(CASE WHEN k < 4 THEN 1 ELSE 0 END AS INT) AS quotes, CASE WHEN k < 4 THEN sha256(quote) END AS first_sha256 FROM n",
    "merge_entries": """
WITH e AS (SELECT user_id, event_id, event_type, event_type || CASE WHEN event_id % 2 = 0 THEN '.' ELSE '' END AS v, ['planned', 'used', 'candidate', 'unclear'][event_id % 4 + 1] AS usage, 3 - event_id % 4 AS r,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, value > 8 AS linkage FROM events),
q AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS q, min(event_id) AS o FROM events GROUP BY ALL),
l AS (SELECT user_id, event_type, string_agg(q, ',' ORDER BY o) AS quotes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY o) AS rn FROM q) WHERE rn <= 8 GROUP BY ALL)
SELECT user_id, arg_min(v, event_id) AS value, min(event_id) AS first, arg_max(usage, r) AS usage, CASE WHEN max(k) > 50 THEN 'explicit' ELSE 'inferred' END AS basis, bool_or(linkage) AS linkage, any_value(quotes) AS quotes, CASE WHEN arg_min(event_id % 3 = 0, event_id) THEN event_type || ' more' WHEN bool_or(event_id % 3 = 0) THEN event_type || chr(10) || event_type || ' more' ELSE event_type END AS definition, count(*) AS merged
FROM e JOIN l USING (user_id, event_type) GROUP BY user_id, event_type""",
    "round_robin_cap": """
WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn, min(event_id) OVER (PARTITION BY user_id, event_type) AS f, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn, f) AS turn FROM r)
SELECT user_id, event_type, event_id, greatest(n - 20, 0) AS omitted FROM t WHERE turn <= 20""",
    "notes_overflow": """
WITH m AS (SELECT conv_id, list(lpad(CAST(turn AS VARCHAR), 3, '0') || ' ' || text ORDER BY turn) AS m FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(CASE WHEN len(m) > 3 THEN list_concat(list_concat(m[1:2], [CAST(len(m) - 2 AS VARCHAR) || ' further entries omitted']), ['note']) ELSE list_concat(m, ['note']) END, '|') AS entries FROM m""",
    "coverage_gaps": """
WITH s AS (SELECT conv_id, turn AS o, CASE WHEN role = 'system' THEN turn + 2 WHEN lead(turn) OVER w IS NOT NULL THEN turn + 1 END AS nx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT *, coalesce(lag(nx) OVER w, 0) AS due, lead(o) OVER w IS NULL AS l FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY o))
SELECT conv_id, CASE WHEN bool_or(due <> o) THEN 'GAP' WHEN bool_or(l AND nx IS NOT NULL) THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS code FROM d GROUP BY 1""",
    "conflict_pairs": f"""WITH {_ASSESS}, e AS (SELECT * FROM a WHERE basis = 'explicit' AND usage IN ('used', 'planned') AND role <> 'unclear')
SELECT x.study, x.value, x.role, x.ord AS "left", y.ord AS "right" FROM e x JOIN e y ON x.study = y.study AND x.value = y.value AND x.role = y.role AND x.ord < y.ord
WHERE x.linkage <> y.linkage OR (NOT list_has_any(x.types, y.types) AND NOT x.linkage AND NOT y.linkage)""",
    "suitability_status": f"WITH {_SUITABLE} SELECT study_id, status, suitability, disjoint FROM s",
    "row_selection": f"""WITH {_SUITABLE} SELECT study_id, CAST(CASE suitability WHEN 'matched' THEN 0 WHEN 'partial' THEN 1 WHEN 'possible' THEN 2 WHEN 'other_type' THEN 3 ELSE 4 END AS INT) AS priority, true AS eligible, (SELECT count(*) FROM s) <= 5 AS shown,
  CASE WHEN (SELECT count(*) FROM s WHERE status <> 'complete') > 0 THEN 'screening_incomplete' WHEN (SELECT count(*) FROM s) > 5 THEN 'needs_selection' ELSE 'ready' END AS state FROM s""",
    "comparison_pivot": "WITH r AS (SELECT c_nationkey AS n, CAST(count(*) AS VARCHAR) AS customers, max(c_name) AS last_name, min(c_mktsegment) AS segment FROM customer GROUP BY 1), u AS (SELECT n, unnest(['customers', 'last_name', 'segment', 'remark']) AS attribute, unnest([customers, last_name, segment, NULL]) AS v FROM r) SELECT attribute, " + ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN v END), '未確認') AS study_{n}" for n in NATIONS) + " FROM u GROUP BY attribute",
}
