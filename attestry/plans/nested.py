"""Queries over nested analyses: every turn of a conversation as a record whose facts quote its sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import nested as N
from .common import fold, table

PARTS = r"[.!?]+\s*"
WORD = r"[\p{L}\p{N}]+"


def _analyses(spark, sf_dir):
    """conv_id, turn, a: sentences as evidence of a design, of criteria two blocks deep, of outcomes, and of sources under the first
    word of the sentence behind them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.filter(F.split(F.coalesce("text", F.lit("")), PARTS), lambda x: x != "").alias("s"))
    page = (F.col("turn") + 1).cast("long")
    quote = lambda text, section, mark: F.struct(page.alias("page"), section.cast("string").alias("section"), text.alias("quote"), mark.cast("string").alias("server"))
    none, first = F.lit(None), lambda x: F.regexp_extract(x, f"({WORD})", 1)
    fact = lambda value, *quotes: F.struct(value.alias("value"), F.array(*quotes).alias("evidence"))
    size = F.size("s")

    def source(x, i):
        usage = F.element_at(F.array(*map(F.lit, ("used", "planned", "candidate", "unclear"))), (i % 4) + 1)
        behind = F.get("s", F.when(i + 1 < size, i + 1).otherwise(0))
        return F.struct(first(behind).alias("value"), usage.alias("usage"), F.array("role").alias("types"), F.lit("outcome").alias("role"), F.when(i % 3 == 0, "explicit").otherwise("inferred").alias("basis"), (i % 5 == 0).alias("requires_linkage"), x.alias("definition"), F.array(quote(x, none, F.lit("page"))).alias("evidence"))

    some = F.filter("s", lambda x, i: i == 0)
    design = F.struct(F.col("role").alias("value"), F.transform(some, lambda x: quote(x, none, F.lit("page"))).alias("evidence"))
    windows = F.struct(F.array(page).alias("figure_pages"), F.transform("s", lambda x: fact(x, quote(x, F.lit("1 Time"), none), quote(first(x), none, F.lit("source_name")))).alias("time_windows"))
    cohort = F.struct(F.transform("s", lambda x: fact(first(x), quote(x, F.lit("2 Cohort"), F.lit("page")))).alias("inclusion_criteria"), F.when(size > 1, fact(F.lit("index"), quote(F.get("s", 1), none, none))).alias("index_date"), windows.alias("design_schema"))
    record = F.struct(design.alias("study_design"), cohort.alias("cohort"), F.transform("s", lambda x: fact(F.upper(first(x)), quote(x, none, none))).alias("outcomes"), F.transform("s", source).alias("source_assessments"), F.array("role").alias("missing_information"))
    return rows.select("conv_id", "turn", record.alias("a"))


def _quotes(df):
    kind = df.schema["a"].dataType
    return N.listed(F.col("a"), kind, N.is_evidence, N.FACT["evidence"].dataType.elementType)


def nested_marks(spark, sf_dir):
    """Quotes of each record at any depth, those that had a mark, those that have one when foreign marks are gone."""
    rows = _analyses(spark, sf_dir)
    before = F.size(F.filter(_quotes(rows), lambda x: x["node"]["server"].isNotNull()))
    cleaned = rows.select("conv_id", "turn", before.alias("marked"), N.without_marks(F.col("a"), rows.schema["a"].dataType).alias("a"))
    quotes = _quotes(cleaned)
    return cleaned.select("conv_id", "turn", "marked", F.size(quotes).alias("quotes"), F.size(F.filter(quotes, lambda x: x["node"]["server"].isNotNull())).alias("left"), F.sha2(F.array_join(F.transform(quotes, lambda x: x["node"]["quote"]), "|"), 256).alias("quotes_sha256"))


def nested_quotes(spark, sf_dir):
    """Facts that are left where quotes of fewer than eight characters go, by field."""
    rows = _analyses(spark, sf_dir)
    kept = rows.select("conv_id", "turn", N.without_short_quotes(F.col("a"), rows.schema["a"].dataType).alias("a"))
    return kept.select("conv_id", "turn", F.col("a.study_design").isNotNull().alias("design"), F.col("a.cohort.index_date").isNotNull().alias("index_date"), F.size("a.cohort.inclusion_criteria").alias("criteria"), F.size("a.cohort.design_schema.time_windows").alias("windows"), F.size("a.outcomes").alias("outcomes"), F.size("a.source_assessments").alias("sources"), F.size(_quotes(kept)).alias("quotes"))


def nested_refused(spark, sf_dir):
    """Facts that do not stand: their path and why; a source has to be named by one of its quotes."""
    rows = _analyses(spark, sf_dir)
    return rows.select("conv_id", "turn", F.explode(N.refused(F.col("a"), rows.schema["a"].dataType)).alias("x")).select("conv_id", "turn", "x.path", "x.code")


def nested_merge(spark, sf_dir):
    """The records of a conversation's turns merged in their order."""
    out = N.merged_batches(_analyses(spark, sf_dir), "conv_id", "turn", "a")
    entry = lambda x: F.concat_ws(":", x["value"], x["usage"], x["basis"], x["requires_linkage"].cast("string"), F.size(x["evidence"]).cast("string"))
    return out.select(
        "conv_id", F.col("a.study_design.value").alias("design"), F.size("a.study_design.evidence").alias("design_quotes"), F.col("a.cohort.index_date.value").alias("index_date"), F.size("a.outcomes").alias("outcomes"), F.size("a.cohort.inclusion_criteria").alias("criteria"),
        F.size("a.cohort.design_schema.figure_pages").alias("pages"), F.size("a.missing_information").alias("missing"), F.size("a.source_assessments").alias("sources"), F.sha2(F.array_join(F.transform("a.source_assessments", entry), ";"), 256).alias("sources_sha256"),
    )


QUERIES = {f.__name__: f for f in (nested_marks, nested_quotes, nested_refused, nested_merge)}

_S = rf"s AS (SELECT conv_id, turn, role, list_filter(string_split_regex(coalesce(text, ''), '{PARTS}'), lambda x: x <> '') AS s FROM conversations)"
_FIRST = "regexp_extract({}, '(" + WORD.replace("{", "{{").replace("}", "}}") + ")', 1)"
_LEN = r"length(trim(regexp_replace(replace({}, chr(173), ''), '\s+', ' ', 'g')))"
_LONG = f"len(list_filter(s, lambda x: {_LEN.format('x')} >= 8))"
_LONG_FIRST = f"len(list_filter(s, lambda x: {_LEN.format(_FIRST.format('x'))} >= 8))"
#: Sentences with their place, and the first word of the one behind, which names their source.
_ROWS = f"{_S}, i AS (SELECT conv_id, turn, role, s, x, k, {_FIRST.format('s[CASE WHEN k + 1 < len(s) THEN k + 2 ELSE 1 END]')} AS behind FROM (SELECT *, unnest(s) AS x, unnest(generate_series(0, len(s) - 1)) AS k FROM s WHERE len(s) > 0))"
_FACTS = f"""
f AS (
  SELECT conv_id, turn, 'study_design' AS path, CASE WHEN len(s) = 0 THEN 'NO_EVIDENCE' WHEN {_LEN.format('s[1]')} < 8 THEN 'QUOTE_TOO_SHORT' END AS code FROM s
  UNION ALL SELECT conv_id, turn, 'cohort.index_date', CASE WHEN {_LEN.format('s[2]')} < 8 THEN 'QUOTE_TOO_SHORT' END FROM s WHERE len(s) > 1
  UNION ALL SELECT conv_id, turn, p || '[' || k || ']', CASE WHEN {_LEN.format('x')} < 8 THEN 'QUOTE_TOO_SHORT' END FROM i, (VALUES ('cohort.inclusion_criteria'), ('outcomes')) v(p)
  UNION ALL SELECT conv_id, turn, 'cohort.design_schema.time_windows[' || k || ']', CASE WHEN {_LEN.format('x')} < 8 OR {_LEN.format(_FIRST.format('x'))} < 8 THEN 'QUOTE_TOO_SHORT' END FROM i
  UNION ALL SELECT conv_id, turn, 'source_assessments[' || k || ']', CASE WHEN {_LEN.format('x')} < 8 THEN 'QUOTE_TOO_SHORT' WHEN NOT list_contains(regexp_extract_all({fold('x')}, '{WORD}'), {fold('behind')}) OR behind = '' THEN 'SOURCE_NOT_NAMED' END FROM i
)"""
SQL = {
    "nested_marks": f"""WITH {_S} SELECT conv_id, turn, CAST(least(len(s), 1) + 3 * len(s) AS INT) AS marked, CAST(least(len(s), 1) + 5 * len(s) + CASE WHEN len(s) > 1 THEN 1 ELSE 0 END AS INT) AS quotes, 0 AS left,
  sha256(array_to_string(list_concat(s[1:1], s, CASE WHEN len(s) > 1 THEN [s[2]] ELSE [] END, flatten(list_transform(s, lambda x: [x, {_FIRST.format('x')}])), s, s), '|')) AS quotes_sha256 FROM s""",
    "nested_quotes": f"""WITH {_S}, n AS (SELECT *, {_LONG} AS n, {_LONG_FIRST} AS w, len(s) > 0 AND {_LEN.format("coalesce(s[1], '')")} >= 8 AS d, len(s) > 1 AND {_LEN.format("coalesce(s[2], '')")} >= 8 AS x FROM s)
SELECT conv_id, turn, d AS design, x AS index_date, CAST(n AS INT) AS criteria, CAST(n AS INT) AS windows, CAST(n AS INT) AS outcomes, CAST(n AS INT) AS sources, CAST(4 * n + w + d::INT + x::INT AS INT) AS quotes FROM n""",
    "nested_refused": f"WITH {_ROWS}, {_FACTS} SELECT conv_id, turn, path, code FROM f WHERE code IS NOT NULL",
    "nested_merge": f"""
WITH {_ROWS},
e AS (
  SELECT conv_id, {fold('behind')} AS key, role, arg_min(behind, turn * 1000000 + k) AS value, min(turn * 1000000 + k) AS o, max(CASE k % 4 WHEN 1 THEN 3 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS u, bool_or(k % 3 = 0) AS explicit, bool_or(k % 5 = 0) AS linkage,
    least(8, count(DISTINCT {{'p': turn, 'q': x}})) AS quotes FROM i GROUP BY ALL),
src AS (SELECT conv_id, count(*) AS sources, string_agg(concat_ws(':', value, ['unclear', 'candidate', 'used', 'planned'][u + 1], CASE WHEN explicit THEN 'explicit' ELSE 'inferred' END, linkage::VARCHAR, quotes::VARCHAR), ';' ORDER BY o) AS t FROM e GROUP BY conv_id),
fold_ AS (SELECT conv_id, count(DISTINCT {fold(_FIRST.format('x'))}) AS outcomes FROM i GROUP BY conv_id),
base AS (
  SELECT conv_id, substr(string_agg(role, chr(10) ORDER BY turn), 1, 4000) AS design, count(DISTINCT turn) AS pages, count(DISTINCT role) AS missing, bool_or(len(s) > 1) AS index_date,
    least(8, count(*) FILTER (len(s) > 0)) AS quotes FROM s GROUP BY conv_id)
SELECT b.conv_id, design, CAST(quotes AS INT) AS design_quotes, CASE WHEN index_date THEN 'index' END AS index_date, CAST(coalesce(outcomes, 0) AS INT) AS outcomes, CAST(coalesce(outcomes, 0) AS INT) AS criteria, CAST(pages AS INT) AS pages, CAST(missing AS INT) AS missing,
  CAST(coalesce(sources, 0) AS INT) AS sources, sha256(coalesce(t, '')) AS sources_sha256 FROM base b LEFT JOIN src ON src.conv_id = b.conv_id LEFT JOIN fold_ ON fold_.conv_id = b.conv_id""",
}
