"""Queries over document structure and search inside documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sections as D
from ..operators import state
from ..sources import pages as P
from .common import canon, table, toks

SEARCHED = ("avec", "with", "die", "para")


def section_chunks(spark, sf_dir):
    """Documents as three chapters of their own text, which has no headings: every rule of the sectioniser has hand-made tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    heads = F.array(*map(F.lit, ("1.1 Study design", "2.1 Outcomes", "3. REFERENCES")))
    pages = P.paged(docs).withColumn("text", F.concat(F.element_at(heads, F.pmod(F.col("page") - 1, F.lit(3)).cast("int") + 1), F.lit("\n"), F.col("text")))
    return D.sections(pages).select("doc_id", "section_id", "page", "section", "role", "relevant", "role_basis", F.array_join("warnings", ",").alias("warnings"), F.sha2("text", 256).alias("text_sha256"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def chapter_asof(spark, sf_dir):
    head = F.when(F.col("role") == "user", T.canonical(F.col("text")))
    return D.carried(_turns(spark, sf_dir), "conv_id", "turn", head, "chapter").select("conv_id", "turn", "chapter")


def section_search(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.format_string("s%04d", "turn").alias("section_id"), F.col("turn").alias("page"), F.col("text").alias("section"), F.lag("text").over(w).alias("parent_section"), F.when(F.col("role") == "system", "background").otherwise("design").alias("role"), "text")
    terms = spark.createDataFrame([(t,) for t in SEARCHED], "term string")
    return D.top_sections(D.section_scores(chunks, terms), 5).select("doc_id", "section_id", "score", "rank")


def continuations(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("half", (F.col("turn") / 2).cast("int"))
    chunks = turns.select("conv_id", "turn", F.when(F.col("half") % 2 == 0, "even").otherwise("odd").alias("title"))
    hits = turns.where(F.length("text") > 800).select("conv_id", "turn", F.length("text").alias("score"))
    return D.continuations(chunks, hits, 3, "conv_id", "turn", "title")


def _ordered(spark, sf_dir, order):
    own = F.array_sort(F.collect_list(F.struct(*order, F.length("text").alias("chars"))))
    return _turns(spark, sf_dir).groupBy("conv_id").agg(own.alias("items"))


def greedy_batches(spark, sf_dir):
    rows = _ordered(spark, sf_dir, ["turn"]).withColumn("batches", state.greedy_batches(F.col("items"), "chars", 2000))
    return rows.select("conv_id", F.explode(F.arrays_zip(F.col("items.turn").alias("turn"), F.col("batches").alias("batch"))).alias("x")).select("conv_id", "x.turn", "x.batch")


def char_budget(spark, sf_dir):
    rows = _ordered(spark, sf_dir, [(-F.length("text")).alias("k"), F.col("turn")]).withColumn("kept", state.fitted(F.col("items"), "chars", 2500))
    return rows.select("conv_id", F.explode(F.arrays_zip(F.col("items.turn").alias("turn"), F.col("kept").alias("kept"))).alias("x")).select("conv_id", "x.turn", "x.kept")


def outline_paging(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("heading"))
    return D.paged_outline(rows, F.col("turn"), 2, 3).select("doc_id", "turn", "ordinal", "next_offset")


def language_test(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    share = D.english_share(T.tokens(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", F.round(share, 6).alias("share"), F.coalesce(share >= 0.08, F.lit(False)).alias("english"))


def reading_set(spark, sf_dir):
    """Pages as chunks: long ones are relevant, every third is an appendix called by the page's letter, and every text cites one."""
    docs = table(spark, sf_dir, "documents")
    letter = F.char(F.lit(65) + F.pmod(F.col("page"), F.lit(7)))
    chunks = P.paged(docs.select("doc_id", "text")).select(
        "doc_id", F.col("page").cast("string").alias("section_id"), "page", (F.length("text") >= 2000).alias("relevant"), F.when(F.col("page") % 3 == 0, "appendix").otherwise("methods").alias("role"), F.concat(F.lit("Appendix "), letter).alias("section"), F.when(F.col("page") % 9 == 0, "Code list").otherwise("Chapter").alias("chapter"),
        F.lit(None).cast("string").alias("chapter_path"), F.concat("text", F.lit(" see Annex "), F.lower(F.char(F.lit(65) + F.pmod(F.col("doc_id"), F.lit(7)).cast("int")))).alias("text"),
    )
    return D.reading_set(chunks).select("doc_id", "page", "role")


def _outline(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    title = F.when(F.col("turn") % 5 == 2, "List of tables").otherwise(F.concat("role", F.lit("  "), F.col("turn")))
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), (F.length("text") % 3 + 1).cast("int").alias("level"), title.alias("title"), (F.col("turn") * 2 + 1).cast("int").alias("page"))


def outline_paths(spark, sf_dir):
    return D.outline_paths(_outline(spark, sf_dir))


def page_chapters(spark, sf_dir):
    """The chapter of every page: two pages to a turn, and outlines that begin on the first of them."""
    turns = _turns(spark, sf_dir)
    pages = turns.select(F.col("conv_id").alias("doc_id"), F.explode(F.array((F.col("turn") * 2).cast("int"), (F.col("turn") * 2 + 1).cast("int"))).alias("page"))
    return D.page_chapters(pages, D.outline_paths(_outline(spark, sf_dir)))


def _contents(spark, sf_dir):
    """Lines of a contents page that call each turn by its first line, with a number of one level, of two, or without; and the
    turns three pages later, long ones five."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "turn", F.trim(F.regexp_replace(F.element_at(F.split("text", "\n"), 1), r"[.\s]+$", "")).alias("head"), (F.length("text") > 700).alias("long")).where("head <> ''")
    own, kind = F.col("turn").cast("string"), F.col("turn") % 3
    name = F.concat(F.when(kind == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit(". "))).when(kind == 1, F.concat(own, F.lit(".1 "))).otherwise(""), "head")
    entry = turns.select("doc_id", F.lit(1).alias("page"), (F.col("turn") + 1).cast("int").alias("line"), F.concat(name, F.lit(" ..... "), (F.col("turn") + 1).cast("string")).alias("text"))
    body = turns.select("doc_id", (F.col("turn") + F.when(F.col("long"), 6).otherwise(4)).cast("int").alias("page"), F.lit(1).alias("line"), name.alias("text"))
    return entry.union(body)


def contents_offset(spark, sf_dir):
    return D.contents_offset(_contents(spark, sf_dir))


def contents_outline(spark, sf_dir):
    return D.contents_outline(_contents(spark, sf_dir)).select("doc_id", "ord", "level", "title", "page")


def neighbour_lift(spark, sf_dir):
    """Turns as sections 1.k.j, every third as the section 1.k above them; they are named by their text, and score by a number."""
    turns = _turns(spark, sf_dir)
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.format_string("s%04d", "turn").alias("section_id"), F.col("turn").alias("page"), F.concat(F.lit("part "), F.col("text")).alias("section"), F.when(F.col("turn") % 3 == 0, F.array(F.lit(1), (F.col("turn") / 3).cast("int"))).otherwise(F.array(F.lit(1), (F.col("turn") / 3).cast("int"), F.col("turn").cast("int"))).alias("number"), F.when(F.col("role") == "system", "background").otherwise("methods").alias("role"), "text")
    scored = chunks.select("doc_id", "section_id", "page", (F.length("text") % 7).cast("double").alias("score"))
    return D.lifted(chunks, scored, spark.createDataFrame([(t,) for t in SEARCHED], "term string"))


def heading_titles(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.format_string("s%04d", "turn").alias("section_id"), F.concat(F.lit("Top / "), F.col("role")).alias("chapter_path"), F.lit("Top").alias("chapter_top"), F.concat(F.lit("part "), (F.col("turn") % 2).cast("string")).alias("section"))
    titles = D.heading_texts(chunks)
    given = titles.select("doc_id", "title", F.concat(F.lit(" "), F.upper("title")).alias("translation")).union(titles.where("ord = 1").select("doc_id", F.lit("no such title"), F.lit("x")))
    return titles.join(D.clean_translations(titles, given), ["doc_id", "title"]).select("doc_id", "ord", "title", "translation")


QUERIES = {f.__name__: f for f in (section_chunks, chapter_asof, section_search, continuations, greedy_batches, char_budget, outline_paging, language_test, reading_set, outline_paths, page_chapters, contents_offset, contents_outline, neighbour_lift, heading_titles)}

_HAS = lambda text, t: f"contains(' ' || {text} || ' ', ' {t} ')"


def _mention(text: str, t: str) -> str:
    other = t[:-1] if t.endswith("s") and len(t) >= 4 else f"{t}s" if len(t) >= 4 else None
    return f"CAST({_HAS(text, t)}" + (f" OR {_HAS(text, other)}" if other else "") + " AS INT)"


_SCORE = " + ".join(f"{_mention('x', t)} * (1 + 4 * {_mention('s', t)} + 3 * {_mention('c', t)})" for t in SEARCHED)
_ENGLISH = ", ".join(f"'{w}'" for w in sorted(D.ENGLISH))
_OUTLINE = """
o AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS ord, CAST(length(text) % 3 + 1 AS INT) AS level, CASE WHEN turn % 5 = 2 THEN 'List of tables' ELSE role || ' ' || turn END AS title, CAST(turn * 2 + 1 AS INT) AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
walk AS (
  SELECT doc_id, ord, level, title, page, k, title <> 'List of tables' AS kept, CASE WHEN title = 'List of tables' THEN level END AS nav, CASE WHEN title <> 'List of tables' THEN [{'l': level, 't': title}] ELSE [] END AS up FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.ord, o.level, o.title, o.page, o.k, NOT coalesce(o.level > w.nav, false) AND o.title <> 'List of tables', CASE WHEN o.level > w.nav THEN w.nav WHEN o.title = 'List of tables' THEN o.level END,
    CASE WHEN NOT coalesce(o.level > w.nav, false) AND o.title <> 'List of tables' THEN list_append(list_filter(w.up, lambda a: a.l < o.level), {'l': o.level, 't': o.title}) ELSE w.up END
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1),
paths AS (SELECT doc_id, ord, page, title, list_transform(up, lambda a: a.t) AS anc FROM walk WHERE kept)"""
_FORM = r"^\s*((?:[1-9]\d?|[IVX]{1,4})(?:\.\d{1,2})*\.?)?\s*(\S.*?)\s*(?:\.{3,}|…+)\s*(\d{1,3})\s*$"
_CONTENTS = rf"""
h AS (SELECT conv_id AS doc_id, turn, trim(regexp_replace(split_part(text, chr(10), 1), '[.\s]+$', '')) AS head, length(text) > 700 AS big FROM conversations),
g AS (SELECT *, CASE turn % 3 WHEN 0 THEN (turn + 1) || '. ' WHEN 1 THEN turn || '.1 ' ELSE '' END || head AS t FROM h WHERE head <> ''),
l AS (SELECT *, t || ' ..... ' || (turn + 1) AS line FROM g),
e AS (SELECT doc_id, turn, coalesce(regexp_extract(line, '{_FORM}', 1), '') AS number, regexp_extract(line, '{_FORM}', 2) AS title, CAST(regexp_extract(line, '{_FORM}', 3) AS INT) AS printed FROM l WHERE regexp_matches(line, '{_FORM}')),
en AS (SELECT *, {canon("number || ' ' || title")} AS name FROM e WHERE doc_id IN (SELECT doc_id FROM e GROUP BY 1 HAVING count(*) >= 3)),
b AS (SELECT DISTINCT doc_id, turn + CASE WHEN big THEN 6 ELSE 4 END AS page, {canon("t")} AS name FROM g),
f AS (SELECT DISTINCT en.doc_id, turn, b.page - printed AS off FROM en JOIN b ON b.doc_id = en.doc_id AND b.name = en.name AND b.name <> ''),
n AS (SELECT doc_id, off, count(*) AS n, min(turn) AS first FROM f GROUP BY ALL),
best AS (SELECT doc_id, min({{'n': -n, 'f': first, 'o': off}}) AS x FROM n GROUP BY 1 HAVING max(n) >= 3 AND max(n) >= 0.4 * (SELECT count(*) FROM en WHERE en.doc_id = n.doc_id))"""
SQL = {
    "chapter_asof": f"""
WITH h AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN {canon('text')} END AS head FROM conversations)
SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM h""",
    "section_search": f"""
WITH t AS (SELECT conv_id, turn, role, {canon('text')} AS x, {canon('text')} AS s, coalesce(lag({canon('text')}) OVER (PARTITION BY conv_id ORDER BY turn), '') AS c FROM conversations),
v AS (SELECT conv_id AS doc_id, turn, 's' || lpad(CAST(turn AS VARCHAR), 4, '0') AS section_id, round(({_SCORE}) * CASE WHEN role = 'system' THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END, 4) AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, turn, section_id) AS rank FROM v WHERE score > 0)
SELECT doc_id, section_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
    "continuations": """
WITH t AS (SELECT conv_id, turn, length(text) AS n, (turn // 2) % 2 AS title FROM conversations),
e AS (SELECT *, CASE WHEN lag(title) OVER w IS NOT DISTINCT FROM title AND lag(turn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS edge FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(edge) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM e)
SELECT r.conv_id, r.turn, CAST(max(h.n) AS INT) AS score, CAST(max(CAST(r.turn = h.turn AS INT)) AS INT) AS is_hit
FROM r JOIN r h ON h.conv_id = r.conv_id AND h.run = r.run AND h.n > 800 AND abs(r.turn - h.turn) <= 3 GROUP BY ALL""",
    "greedy_batches": """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
b AS (
  SELECT conv_id, turn, k, 0 AS batch, n AS total FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN b.total + t.n > 2000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.total + t.n > 2000 THEN t.n ELSE b.total + t.n END
  FROM b JOIN t ON t.conv_id = b.conv_id AND t.k = b.k + 1)
SELECT conv_id, turn, CAST(batch AS INT) AS batch FROM b""",
    "char_budget": """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations),
b AS (
  SELECT conv_id, turn, k, true AS kept, n AS total FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.k, b.total + t.n <= 2500, CASE WHEN b.total + t.n <= 2500 THEN b.total + t.n ELSE b.total END
  FROM b JOIN t ON t.conv_id = b.conv_id AND t.k = b.k + 1)
SELECT conv_id, turn, kept FROM b""",
    "outline_paging": """
WITH t AS (SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT doc_id, turn, CAST(ordinal AS INT) AS ordinal, CASE WHEN n > 5 THEN CAST(5 AS INT) END AS next_offset FROM t WHERE ordinal BETWEEN 2 AND 4""",
    "language_test": f"""
WITH t AS (SELECT doc_id, list_filter({toks("coalesce(text, '')")}, lambda w: regexp_full_match(w, '[a-z]+')) AS w FROM documents),
s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({_ENGLISH})))::DOUBLE / nullif(len(w), 0) AS share FROM t)
SELECT doc_id, round(share, 6) AS share, coalesce(share >= 0.08, false) AS english FROM s""",
    "reading_set": """
WITH p AS (SELECT doc_id, CAST(unnest(generate_series(1, greatest(1, CAST(ceil(length(text) / 3000.0) AS INT)))) AS INT) AS page, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, page, length(substr(text, (page - 1) * 3000 + 1, 3000)) >= 2000 AS relevant, CASE WHEN page % 3 = 0 THEN 'appendix' ELSE 'methods' END AS role FROM p)
SELECT doc_id, page, role FROM c WHERE relevant AND (role = 'methods' OR page % 9 = 0 OR page % 7 = doc_id % 7)""",
    "outline_paths": f"WITH RECURSIVE {_OUTLINE} SELECT doc_id, ord, page, title, list_extract(anc, 1) AS top, array_to_string(anc, ' / ') AS path FROM paths",
    "page_chapters": f"""WITH RECURSIVE {_OUTLINE}, pages_ AS (SELECT conv_id AS doc_id, CAST(unnest([turn * 2, turn * 2 + 1]) AS INT) AS page FROM conversations)
SELECT g.doc_id, g.page, p.title AS chapter, p.anc[1] AS chapter_top, array_to_string(p.anc, ' / ') AS chapter_path FROM pages_ g ASOF LEFT JOIN paths p ON p.doc_id = g.doc_id AND p.page <= g.page""",
    "contents_offset": f"WITH {_CONTENTS} SELECT doc_id, CAST(x.o AS INT) AS offset FROM best",
    "contents_outline": rf"""WITH {_CONTENTS},
near AS (SELECT en.doc_id, turn, min({{'d': abs(b.page - printed - x.o), 'p': b.page}}) AS m FROM en JOIN best USING (doc_id) JOIN b ON b.doc_id = en.doc_id AND b.name = en.name AND b.name <> '' AND abs(b.page - printed - x.o) <= 1 GROUP BY ALL),
p AS (SELECT en.*, m.p AS page, CASE WHEN number <> '' THEN CASE WHEN CAST(coalesce(nullif(regexp_extract(number, '^(\d+)', 1), ''), '1') AS INT) > 30 THEN 0 ELSE len(string_split(rtrim(number, '.'), '.')) END END AS depth FROM en JOIN near USING (doc_id, turn) WHERE NOT regexp_matches(title, '(?i)^(?:table|figure|fig\.)\s*[A-Z]?\d'))
SELECT doc_id, CAST(row_number() OVER w AS INT) AS ord, CAST(greatest(1, coalesce(depth, last_value(depth IGNORE NULLS) OVER w + 1, 1)) AS INT) AS level, trim(number || ' ' || title) AS title, CAST(page AS INT) AS page FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "neighbour_lift": f"""
WITH c AS (SELECT conv_id AS doc_id, turn, CAST(turn / 3 - 0.499999 AS INT) AS up, 'part ' || text AS section, length(text) AS n, CAST(length(text) % 7 AS DOUBLE) AS score, role = 'system' AS quiet, {canon("'part ' || text")} AS s FROM conversations),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, run) AS chars FROM (SELECT *, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY turn) AS run FROM (SELECT *, section IS DISTINCT FROM lag(section) OVER (PARTITION BY doc_id ORDER BY turn) AS edge FROM c))),
a AS (SELECT * FROM r WHERE turn % 3 <> 0 AND NOT quiet AND chars <= 1000 AND ({' OR '.join('CAST(' + _mention('s', t) + ' AS BOOLEAN)' for t in SEARCHED)})),
t AS (SELECT r.doc_id, r.turn, max(a.score) - 0.5 AS goal FROM r JOIN a ON a.doc_id = r.doc_id AND a.up = r.up AND a.section <> r.section AND a.turn <> r.turn WHERE NOT r.quiet AND r.turn % 3 <> 0 GROUP BY ALL)
SELECT r.doc_id, 's' || lpad(CAST(r.turn AS VARCHAR), 4, '0') AS section_id, r.turn AS page, greatest(r.score, coalesce(t.goal, r.score)) AS score, t.goal > r.score AS raised FROM r LEFT JOIN t ON t.doc_id = r.doc_id AND t.turn = r.turn""",
    "heading_titles": """
WITH c AS (SELECT conv_id, turn, unnest(['Top', role, 'Top', 'part ' || (turn % 2)]) AS title, unnest([0, 1, 2, 3]) AS i FROM conversations), f AS (SELECT conv_id, title, min({'t': turn, 'i': i}) AS f FROM c GROUP BY ALL)
SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY f) AS INT) AS ord, title, upper(title) AS translation FROM f""",
}
