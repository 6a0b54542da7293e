"""Merging of partial answers, quotas, notes, conflicts, suitability and the comparison table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import text as T

MOST_QUOTES, MOST_VALUE = 8, 4000
# fixed values: how strongly a source is used
USAGE = {"planned": 3, "used": 2, "candidate": 1, "unclear": 0}


def entry_key(value: Column, role: Column, types: Column) -> Column:
    """Entries that are one: value without case and punctuation, role, and the set of types."""
    return F.concat_ws("\x1f", T.norm(value), F.coalesce(role, F.lit("")), F.array_join(F.array_sort(F.array_distinct(F.coalesce(types, F.array().cast("array<string>")))), ","))


def merged_entries(entries: DataFrame, by: Sequence[str], key: Column, order: str) -> DataFrame:
    """One row per entry: the first spelling, quotes of all (MOST_QUOTES), the strongest usage, explicit over inferred, any linkage.

    entries has value, usage, basis, linkage, definition, quote and the columns of `by`; order gives the first. The groups
    pre-aggregate but for the quotes, of which each task keeps the distinct ones.
    """
    rank = F.element_at(F.create_map(*[x for u, n in USAGE.items() for x in (F.lit(u), F.lit(n))]), F.col("usage"))
    quotes = F.array_sort(F.collect_set(F.when(F.col("quote").isNotNull(), F.struct(F.col(order).alias("o"), "quote"))))
    definitions = F.array_sort(F.collect_set(F.when(F.coalesce("definition", F.lit("")) != "", F.struct(F.col(order).alias("o"), "definition"))))
    rows = entries.withColumn("_key", key).groupBy(*by, "_key").agg(
        F.min_by("value", order).alias("value"), F.min(order).alias("first"), F.max_by("usage", F.struct(rank, -F.col(order))).alias("usage"), F.max((F.col("basis") == "explicit").cast("int")).alias("_e"), F.bool_or("linkage").alias("linkage"), quotes.alias("_q"), definitions.alias("_d"), F.count(F.lit(1)).alias("merged"),
    )
    # a definition is added unless what is there contains it
    text = F.aggregate(F.transform("_d", lambda x: x["definition"]), F.lit(""), lambda acc, d: F.when(acc == "", d).when(acc.contains(d), acc).otherwise(F.concat(acc, F.lit("\n"), d)))
    return rows.select(*by, "value", "first", "usage", F.when(F.col("_e") == 1, "explicit").otherwise("inferred").alias("basis"), "linkage", F.slice(F.array_distinct(F.transform("_q", lambda x: x["quote"])), 1, MOST_QUOTES).alias("quotes"), F.substring(text, 1, MOST_VALUE).alias("definition"), "merged")


def round_robin(rows: DataFrame, by: str, batch: str, order: str, limit: int) -> DataFrame:
    """At most `limit` rows of each group, taken in turn from its batches in the order of their first rows; adds kept and omitted."""
    own = Window.partitionBy(by, batch)
    ranked = rows.withColumns({"_rn": F.row_number().over(own.orderBy(order)), "_first": F.min(order).over(own)})
    turn = Window.partitionBy(by).orderBy("_rn", "_first")
    return ranked.withColumn("_turn", F.row_number().over(turn)).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(Window.partitionBy(by)) - limit, F.lit(0))).where(F.col("_turn") <= limit).drop("_rn", "_first", "_turn")


def notes_within(missing: Column, notes: Column, limit: int) -> Column:
    """All notes and as many entries as fit; where some do not, the last entry says how many."""
    room = F.greatest(F.lit(limit) - F.size(notes), F.lit(0))
    over = F.size(missing) > room
    cut = F.greatest(room - 1, F.lit(0))
    text = F.array(F.concat((F.size(missing) - cut).cast("string"), F.lit(" further entries omitted")))
    return F.when(over & (room > 0), F.concat(F.slice(missing, F.lit(1), cut), text, notes)).when(over, notes).otherwise(F.concat(missing, notes))


def conflict_pairs(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Pairs (left before right in their order) of explicit, used or planned assessments of one value, role and definition that
    disagree: on linkage, or with types that do not meet and no linkage. Assessments of an unclear role are left out.

    rows has by, order, value, role, definition, linkage, types, usage and basis. What is said is first grouped by what it is
    said about, so groups that agree never meet; only pairs that disagree are made, and each of them is a result.
    """
    own = rows.where("basis = 'explicit' and usage in ('used', 'planned') and role <> 'unclear'")
    agree = [by, "value", "role", "definition"]
    kinds = own.groupBy(*agree, F.array_sort("types").alias("types"), "linkage").agg(F.array_sort(F.collect_list(order)).alias("ords"))
    a, b = kinds.alias("a"), kinds.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in agree]
    said = lambda s: F.struct(F.array_join(f"{s}.types", ","), F.col(f"{s}.linkage"))
    unlike = (F.col("a.linkage") != F.col("b.linkage")) | (~F.arrays_overlap("a.types", "b.types") & ~F.col("a.linkage") & ~F.col("b.linkage"))
    met = a.join(b, [*on, said("a") < said("b")]).where(unlike).select(*(F.col(f"a.{c}").alias(c) for c in agree), F.explode("a.ords").alias("x"), F.col("b.ords").alias("ys"))
    return met.select(*agree, "x", F.explode("ys").alias("y")).select(*agree, F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))


# fixed values: order of the suitability states in a list
PRIORITY = {"matched": 0, "partial": 1, "possible": 2, "other_type": 3, "unknown": 4, "conflicting": 4, "not_requested": 0}
REASONS = {
    "not_requested": "no source type was asked for", "matched": "an explicit source of the type supports the role without linkage", "partial": "the type contributes, but linked data are needed too",
    "possible": "the type is inferred, not stated", "other_type": "explicit sources for the role are of other types", "unknown": "reading, type, usage or role is not confirmed", "conflicting": "explicit assessments disagree",
}


def suitability(requested: Column, complete: Column, conflicting: Column, matched: Column, partial: Column, possible: Column, other: Column) -> Column:
    """State of a study's sources for a question, the first that holds."""
    return (
        F.when(~requested, "not_requested").when(~complete, "unknown").when(conflicting, "conflicting").when(matched, "matched")
        .when(partial, "partial").when(possible, "possible").when(other, "other_type").otherwise("unknown")
    )


def assessed(rows: DataFrame, assessments: DataFrame, types: Sequence[str] | None, role: str = "any", key: str = "study_id") -> DataFrame:
    """rows (key, status, catalogue_types) with suitability, reason and disjoint, from assessments (key, ord, value, role,
    definition, linkage, types, usage, basis, answered).

    Only assessments that answer the question (answered) and are of its role decide; all explicit ones tell which types a
    protocol has, for disjoint: whether the catalogue names types and the protocol others. types None: none were asked for.
    """
    wanted = F.array(*map(F.lit, types or ())).cast("array<string>")
    relevant = F.col("answered") & (F.lit(role == "any") | (F.col("role") == role))
    usable = relevant & F.col("usage").isin("used", "planned") & (F.col("role") != "unclear")
    explicit = usable & (F.col("basis") == "explicit")
    of_type = F.arrays_overlap("types", wanted)
    clash = conflict_pairs(assessments.where(relevant), key, "ord").select(key, F.lit(True).alias("_c")).distinct()
    told = assessments.groupBy(key).agg(
        F.bool_or(explicit & of_type & ~F.col("linkage")).alias("_m"), F.bool_or(explicit & of_type).alias("_p"), F.bool_or(usable & of_type).alias("_q"), F.bool_or(explicit).alias("_e"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("basis") == "explicit", F.col("types"))))).alias("_t"),
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    out = rows.join(told, key, "left").join(clash, key, "left")
    state = suitability(F.lit(types is not None), no(F.col("status") == "complete"), no("_c"), no("_m"), no("_p"), no("_q"), no("_e"))
    disjoint = no((F.size("catalogue_types") > 0) & (F.size("_t") > 0) & ~F.arrays_overlap("catalogue_types", "_t"))
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("suitability"))
    return out.withColumns({"suitability": state, "disjoint": disjoint}).withColumn("reason", reason).drop("_m", "_p", "_q", "_e", "_t", "_c")


def selected(rows: DataFrame, only: bool, order: str, limit: int = 5, ids: Sequence[str] | None = None, key: str = "study_id") -> tuple[DataFrame, str]:
    """Rows by the priority of their suitability, ties in their order, with eligible and shown, and the state of the selection.

    only keeps the matched ones eligible. Chosen ids are shown, or else all eligible ones if there are at most limit, or else
    none; ids must be distinct, eligible, at most limit, and all rows complete.
    """
    rank = F.element_at(F.create_map(*[x for s, n in PRIORITY.items() for x in (F.lit(s), F.lit(n))]), F.col("suitability"))
    ranked = rows.withColumns({"priority": rank, "eligible": (F.col("suitability") == "matched") if only else F.lit(True)})
    told = ranked.agg(F.count_if("eligible").alias("n"), F.count_if(F.col("status") != "complete").alias("open"), F.count_if(F.col("eligible") & F.col(key).isin(*(ids or ()))).alias("chosen")).first()
    if ids is not None:
        if not ids or len(set(ids)) != len(ids) or len(ids) > limit or told.chosen != len(ids):
            raise EngineError("INVALID_INPUT", "select distinct eligible studies within the limit")
        if told.open:
            raise EngineError("INCOMPLETE_SCREENING", "finish screening before a selection")
    shown = F.col("eligible") & (F.col(key).isin(*ids) if ids else F.lit(told.n <= limit))
    state = "screening_incomplete" if told.open else "needs_selection" if told.n > limit and not ids else "no_confirmed_matches" if not told.n else "ready"
    return ranked.withColumn("shown", shown).orderBy("priority", order), state


def transposed(rows: DataFrame, studies: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Attributes as rows and the given studies as columns; empty cells say so."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes)))
    wide = rows.select("study", pairs.alias("x")).select("study", "x.*").groupBy("attribute").pivot("study", list(studies)).agg(F.first("value", ignorenulls=True))
    return wide.select("attribute", *(F.coalesce(T.cell(F.nullif(F.col(f"`{s}`"), F.lit(""))), F.lit("")).alias(s) for s in studies)).select("attribute", *(F.when(F.col(f"`{s}`") == "", "未確認").otherwise(F.col(f"`{s}`")).alias(s) for s in studies))


def cited_pages(evidence: Column) -> Column:
    """Pages of the quotes that state something, in their order, and apart from them those of quotes that only name a source; where
    there are only these, they are the pages."""
    pages = lambda own: F.array_join(F.transform(F.filter(evidence, own), lambda e: e["page"].cast("string")), ", ")
    stated, naming = pages(lambda e: ~F.coalesce(e["server"] == "source_name", F.lit(False))), pages(lambda e: F.coalesce(e["server"] == "source_name", F.lit(False)))
    return F.when(stated == "", F.concat(F.lit("p. "), naming)).when(naming == "", F.concat(F.lit("p. "), stated)).otherwise(F.concat(F.lit("p. "), stated, F.lit("; 名前の記載 p. "), naming))


def match_text(basis: Column, terms: Column, category: Column) -> Column:
    """Why a study is a candidate: terms, those of a category marked; another text where all are, or where it is an analogue."""
    marked = F.array_join(F.transform(terms, lambda t: F.when(F.array_contains(category, t), F.concat(t, F.lit("（カテゴリー語）"))).otherwise(t)), ", ")
    only = (F.size(category) > 0) & (F.size(F.array_except(terms, category)) == 0)
    return F.when(basis == "analogous", F.concat(F.lit("analogue: "), F.array_join(terms, ", "))).when(only, F.concat(F.lit("category only: "), F.array_join(terms, ", "))).otherwise(F.concat(F.lit("concept: "), marked))
