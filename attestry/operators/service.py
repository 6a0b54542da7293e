"""What a service does around the core: budgets, fallbacks, refreshes, queues, expiry, audits, summaries, comparison files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import text as T
from .medicines import GENERIC

BUDGET = 100


def within_term_budget(names: DataFrame, budget: int = BUDGET, question: str = "question") -> DataFrame:
    """Names added to a question's blocks, class names first, then in the order of block, query and name, up to the budget.

    names (question, block, query, ord, name, is_class). A name that a question has already counts once, at its first place.
    """
    first = Window.partitionBy(question, "name").orderBy(F.desc("is_class"), "block", "query", "ord")
    once = names.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    w = Window.partitionBy(question).orderBy(F.desc("is_class"), "block", "query", "ord", "name")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget)


def class_conflicts(members: DataFrame) -> DataFrame:
    """code, labels, omitted: members whose code carries several labels are left out and told once."""
    seen = members.groupBy("code").agg(F.array_sort(F.collect_set(T.canonical(F.col("label")))).alias("labels"))
    return seen.select("code", "labels", (F.size("labels") > 1).alias("omitted"))


def class_analogues(typed: DataFrame, labels: DataFrame, found: DataFrame | None = None, key: str = "query") -> DataFrame:
    """key, term, relation for a medicine's code of seven signs that a query is and that found nothing: the catalogue's name of its
    class of five signs, or of four where that has none, as broader; names of the class's other codes as siblings.

    labels (code, label) are the catalogue's, found has the queries that did find something. Only names are told, of ASCII, up to
    150 characters, that mean something without their class.
    """
    own = typed.select(key, F.upper(F.trim(F.col(key))).alias("code")).where(F.col("code").rlike(r"^[A-Z]\d{2}[A-Z]{2}\d{2}$"))
    if found is not None:
        own = own.join(found.select(key), key, "left_anti")
    five, four = F.substring("code", 1, 5), F.substring("code", 1, 4)
    named = own.join(labels.select(F.col("code").alias("_5"), F.col("label").alias("_l5")), five == F.col("_5"), "left").join(labels.select(F.col("code").alias("_4"), F.col("label").alias("_l4")), four == F.col("_4"), "left")
    broader = named.select(key, F.coalesce(F.nullif("_l5", F.lit("")), "_l4").alias("term"), F.lit("broader").alias("relation"))
    leaves = labels.where(F.length("code") == 7).select(F.col("code").alias("_leaf"), five.alias("_class"), F.col("label").alias("term"))
    siblings = own.withColumn("_class", five).join(leaves, "_class").where("_leaf <> code").select(key, "term", F.lit("sibling").alias("relation"))
    return broader.union(siblings).where((F.coalesce("term", F.lit("")) != "") & T.is_ascii(F.col("term")) & (F.length("term") <= 150) & ~F.col("term").rlike(GENERIC)).distinct()


def fallback_state(hits: Column, filtered: Column, analogous_terms: Column, analogous_hits: Column) -> Column:
    """Why a search found nothing: filters took the hits, there is nothing like it to look for, there is, or nothing matches."""
    return F.when(hits > 0, None).when(filtered > 0, "concept_filtered_out").when(analogous_terms == 0, "no_analogous_terms").when(analogous_hits > 0, "available").otherwise("no_matches")


def refreshed(old: DataFrame, new: DataFrame, export_only: Sequence[str], key: str = "study_id") -> DataFrame:
    """A re-read page over a stored row: fields that only exports supply survive a blank, and so does a row the page lacks."""
    names = [c for c in old.columns if c != key]
    rows = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in names)).join(new.select(key, *(F.col(c).alias(f"_n_{c}") for c in names if c in new.columns), F.lit(True).alias("_new")), key, "full")
    value = lambda c: F.col(f"_o_{c}") if c not in new.columns else F.coalesce(F.nullif(F.col(f"_n_{c}"), F.lit("")), F.col(f"_o_{c}")) if c in export_only else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    return rows.select(key, *(value(c).alias(c) for c in names))


def unexpired(entries: DataFrame, now, ttl: str = "ttl_seconds", stored: str = "stored_at", expected: str = "sha256", actual: str = "actual_sha256") -> DataFrame:
    """Cache entries that are still valid at a given time and hold what they should."""
    return entries.where((F.unix_micros(F.col(stored).cast("timestamp")) + F.col(ttl).cast("long") * 1_000_000 > F.unix_micros(F.lit(now))) & F.col(expected).eqNullSafe(F.col(actual)))


def pending(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a queue: everything that no earlier run finished."""
    return queue.join(done.select(key).distinct(), key, "left_anti")


def checkpointed(batches: DataFrame, finished: DataFrame) -> DataFrame:
    """Batches with the signature of their texts and whether a finished one with this signature can be used again."""
    signed = batches.withColumn("signature", F.substring(F.sha2(F.to_json("texts"), 256), 1, 32))
    return signed.join(finished.select("signature", F.lit(True).alias("_f")).distinct(), "signature", "left").withColumn("reused", F.coalesce("_f", F.lit(False))).drop("_f")


def batch_turn(parts: DataFrame, by: str, limit: int) -> DataFrame:
    """Answers of several batches merged to one list: equal ones once, then in turn from each batch, with a count of the rest."""
    from .merging import round_robin

    first = Window.partitionBy(by, T.norm(F.col("value"))).orderBy("ord")
    once = parts.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    return round_robin(once, by, "batch", "ord", limit)


def summary_row(newest: Column, state: Column, dictionary: Column) -> Column:
    """What to do next with a catalogue."""
    return F.when(newest.isNull(), "import").when(state == "stale", "update").when(dictionary == "missing", "refresh_dictionary").otherwise("none")


def newer_version(current: Column, published: Column) -> Column:
    return T.version_key(published) > T.version_key(current)


def update_state(previous: dict, outcome: dict, carried: Sequence[str] = ("last_success", "catalogue_date", "app_version")) -> dict:
    """The record of an update run; what it does not say of the carried keys stays from the run before."""
    return {**{k: previous[k] for k in carried if k in previous}, **outcome}


def pair_argument(value: str, what: str = "CODE") -> tuple[str, str]:
    """SYSTEM:CODE or TERM:RELATION, divided at the last colon."""
    left, colon, right = value.rpartition(":")
    if not colon or not left.strip() or not right.strip():
        raise EngineError("INVALID_ARGUMENT", f"expected a pair with a colon for {what}")
    return left.strip(), right.strip()


def proposed_codes(rows: DataFrame, most: int = 40) -> DataFrame:
    """Codes that an outside planner proposes: well-formed, marked as unverified, not more than `most` a question."""
    code = F.upper(F.trim("code"))
    ok = F.when(F.col("system") == "ATC", code.rlike(r"^[A-Z]\d{2}([A-Z]([A-Z](\d{2})?)?)?$")).when(F.col("system") == "ICD-10", code.rlike(r"^[A-Z]\d{2}(\.?\d{1,2})?$")).otherwise(code != "")
    w = Window.partitionBy("question").orderBy("ord")
    return rows.where(ok).withColumns({"code": code, "origin": F.lit("llm"), "verified": F.lit(False), "_rn": F.row_number().over(w)}).where(F.col("_rn") <= most).drop("_rn")


def strategies(lists: DataFrame) -> DataFrame:
    """Ranked lists of a question by strategy: all query lists fused, and of several blocks only what every block has.

    lists (question, strategy, block, list, id, rank); every strategy's number of blocks is taken from its own rows.
    """
    fused = lists.groupBy("question", "strategy", "block", "id").agg(F.sum(1 / (F.lit(20) + F.col("rank"))).alias("s"))
    blocks = lists.groupBy("question", "strategy").agg(F.countDistinct("block").alias("n"))
    both = fused.groupBy("question", "strategy", "id").agg(F.count(F.lit(1)).alias("b"), F.sum("s").alias("s")).join(blocks, ["question", "strategy"]).where("b = n")
    w = Window.partitionBy("question", "strategy").orderBy(F.desc("s"), F.col("id").cast("string"))
    return both.select("question", "strategy", "id", F.round("s", 6).alias("fused"), F.row_number().over(w).alias("rank"))


def served_check(items: DataFrame, pages: DataFrame, chunks: DataFrame, rejected: Sequence[str]) -> DataFrame:
    """item_id and what holds of its passage: on its page, in one section, in the reading set, in a role that may support it."""
    on = items.join(pages, ["doc_id", "page"], "left").withColumn("on_page", F.coalesce(F.regexp_like("text", F.col("pattern")), F.lit(False))).drop("text")
    seen = on.join(chunks.select("doc_id", "page", "section_id", "relevant", "role", F.col("text").alias("_t")), ["doc_id", "page"], "left").withColumn("_in", F.coalesce(F.regexp_like("_t", F.col("pattern")), F.lit(False)))
    return seen.groupBy("item_id").agg(F.max("on_page").alias("on_page"), (F.count_if(F.col("_in")) == 1).alias("one_section"), F.max(F.col("_in") & F.col("relevant")).alias("served"), F.max(F.col("_in") & ~F.col("role").isin(*rejected)).alias("accepted"))


def thresholds(graded: DataFrame, minimum: dict[str, int], maximum: dict[str, int], key: str = "doc_id") -> DataFrame:
    """Documents whose totals fall below a minimum or exceed a maximum, with the names of the measures."""
    bad = [F.when(F.col(c) < n, F.lit(f"{c} < {n}")) for c, n in minimum.items()] + [F.when(F.col(c) > n, F.lit(f"{c} > {n}")) for c, n in maximum.items()]
    return graded.select(key, F.filter(F.array(*bad), lambda x: x.isNotNull()).alias("failed")).where(F.size("failed") > 0)


def comparison_markdown(title: str, header: Sequence[str], rows: Iterable[Sequence[str]]) -> str:
    """A Markdown file of the transposed table; cells are escaped already."""
    out = [f"# {title}", "", "| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return "\n".join([*out, *("| " + " | ".join(r) + " |" for r in rows), ""])


def collected(rows: DataFrame, answers: DataFrame, key: str = "study_id") -> DataFrame:
    """Rows of a comparison with their answers: complete, stale where the fingerprint changed, or pending."""
    j = rows.join(answers.select(key, F.col("fingerprint").alias("_f"), "answer"), key, "left")
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("_f").isNull(), "pending").when(F.col("_f") != F.col("fingerprint"), "stale").otherwise("complete")
    return j.withColumn("state", state).withColumn("answer", F.when(F.col("state") == "complete", F.col("answer"))).drop("_f")


def cache_key(parts: Sequence[object]) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(list(parts), ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def cap_notes(rows: DataFrame, by: str, field_: str, batch: str, limits: dict[str, int]) -> DataFrame:
    """by, note: for each list of a record (field_) that is over its limit, how many entries are left out and whence the kept ones come."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col(field_))
    n = rows.where(F.col(field_).isin(*limits)).groupBy(by, field_).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(batch).alias("b")).withColumn("limit", limit).where("n > limit")
    whence = F.when(F.col("b") > 1, F.format_string("in turn from %d batches", "b")).otherwise("from the beginning")
    return n.select(by, F.concat(F.col(field_), F.format_string(": %d of %d kept, ", "limit", "n"), whence).alias("note"))


def tallied(log: DataFrame, code: str = "code") -> DataFrame:
    """code, n of an outcome log; null codes are successes, no document is an outcome of its own, the rest are errors."""
    kind = F.when(F.col(code).isNull(), "fetched").when(F.col(code) == "PROTOCOL_NOT_FOUND", "no_protocol").otherwise(F.concat(F.lit("error:"), F.col(code)))
    return log.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def retry_delay(value: Column, attempt: Column, now) -> Column:
    """Seconds to wait before another try: what a header says, as seconds or as a date; else 2, 5 and then 15. Never negative."""
    seconds = value.try_cast("double")
    at = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(at) - F.unix_micros(F.lit(now))) / 1_000_000
    floor = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return F.coalesce(floor(seconds), floor(until), F.element_at(F.array(F.lit(2.0), F.lit(5.0), F.lit(15.0)), F.least(attempt, F.lit(2)) + 1))


def observed_totals(observations: DataFrame, studies: DataFrame, key: str = "study_id") -> DataFrame:
    """One row: how many observations are of studies that are there, and how many of these have medicines (exposures)."""
    own = observations.join(studies.select(key), key, "left_semi")
    return own.agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.coalesce(F.size("exposures"), F.lit(0)) > 0).alias("with_exposures"))


def needing_index(studies: DataFrame, analyses: DataFrame, observations: DataFrame, key: str = "study_id") -> DataFrame:
    """Studies with an analysis or an observation: what a refreshed catalogue indexes anew."""
    return studies.join(analyses.select(key).union(observations.select(key)).distinct(), key, "left_semi")


def summed(graded: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row: the totals of per-document measures, and the number of documents."""
    return graded.agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c).alias(c) for c in measures))


def prepared(candidates: DataFrame, sources: DataFrame, most: int, key: str = "study_id") -> DataFrame:
    """Rows of a new comparison: every candidate, with its source or the error that took its place; more than `most` are refused."""
    if not 1 <= candidates.limit(most + 1).count() <= most:
        raise EngineError("NEEDS_NARROWING", f"1 to {most} candidates")
    j = candidates.join(sources, key, "left")
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("fingerprint").isNull(), "pending").otherwise("needs_processing")
    return j.withColumn("status", state)


def pending_tools(rows: DataFrame, analyses: DataFrame, answers: DataFrame, key: str = "study_id") -> DataFrame:
    """Rows of a comparison with what is done of each: an analysis of another fingerprint is an error, one of another reading does
    not count, a row with analysis and answer is complete, and any other says what to run next.

    rows (key, fingerprint, reading), analyses (key, fingerprint, reading), answers (key); one row for each key.
    """
    a = analyses.select(key, F.col("fingerprint").alias("_f"), F.col("reading").alias("_r"))
    j = rows.join(a, key, "left").join(answers.select(key, F.lit(True).alias("_w")), key, "left")
    read = F.coalesce(F.col("_r") == F.col("reading"), F.lit(False))
    changed, has, told = read & (F.col("_f") != F.col("fingerprint")), read & (F.col("_f") == F.col("fingerprint")), F.coalesce("_w", F.lit(False))
    status = F.when(F.col("fingerprint").isNull(), "pending").when(changed, "error").when(has & told, "complete").otherwise("needs_processing")
    tool = F.when(F.col("status") == "needs_processing", F.when(~has, "analyze").otherwise("answer"))
    return j.withColumn("status", status).withColumn("tool", tool).withColumn("error", F.when(F.col("status") == "error", "COMPARISON_SOURCE_CHANGED")).drop("_f", "_r", "_w")


#: What of an observation travels between databases.
SHAREABLE = ("protocol_found", "text_layer", "exposures", "exposure_rules", "backfill_done")


def shareable(observation: Column) -> Column:
    """The part of an observation (a map) that travels: no local ids, no error codes."""
    return F.map_filter(observation, lambda k, _: k.isin(*SHAREABLE))


def analysis_view(analyses: DataFrame, key: str = "study_id") -> DataFrame:
    """key and a number for each part of an analysis: the size of a list, and 1 or 0 for a single fact."""
    parts = [f for f in analyses.schema.fields if f.name != key]
    size = lambda f: F.coalesce(F.size(f.name), F.lit(0)) if f.dataType.typeName() == "array" else F.col(f.name).isNotNull().cast("int")
    return analyses.select(key, *(F.greatest(size(f), F.lit(0)).alias(f.name) for f in parts))


def expansion_view(terms: DataFrame, key: str = "query_id") -> DataFrame:
    """key and the terms of an expansion (key, term, kind, ord, and detail, a relation or a code's system) by kind, formatted."""
    shown = F.when(F.col("kind") == "analogous", F.concat("term", F.lit(" ("), "detail", F.lit(")"))).when(F.col("kind") == "code", F.concat("detail", F.lit(":"), "term")).otherwise(F.col("term"))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "t")))), lambda x: x["t"]).alias(kind)
    return terms.withColumn("t", shown).groupBy(key).agg(*(of(k) for k in ("english", "related", "analogous", "code")))


def planned(questions: DataFrame, terms: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """key, queries, target_role, status of a search plan: what an expansion adds (key, term, ord), or where it adds nothing the
    question itself if it is ASCII. A question in another language that no concept covers, or that gives no query, needs a translation."""
    own = terms.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("_t"))
    rows = questions.join(own, key, "left")
    ascii_ = T.is_ascii(F.col(text))
    queries = F.array_distinct(F.coalesce("_t", F.when(ascii_ & (F.trim(text) != ""), F.array(text)), F.array().cast("array<string>")))
    role = F.when(F.lower(text).contains("outcome") | F.col(text).contains("アウトカム"), "outcome").otherwise("unspecified")
    return rows.select(key, queries.alias("queries"), role.alias("target_role"), F.when((F.size(queries) == 0) | (~ascii_ & F.col("_t").isNull()), "needs_client_translation").otherwise("planned").alias("status"))
