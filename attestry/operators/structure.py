"""How well a reading of documents finds their structure: headings against outlines, chapters of the template, labelled passages and
checklists, and what two readings gain and lose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .mining import run_diff
from .sections import TITLES

#: A line of contents, by its dots, and a numbered title.
LEADER, NUMBERED = r"\.{4,}\s*\d+", r"^((?:[1-9]\d?|[IVX]{1,4})(?:\.\d{1,2})*)\.?\s+(\S.{2,109})$"
COUNTS = ("gold", "gold_detected", "gold_top", "gold_top_detected", "detected", "detected_unsupported")


def named(rows: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, page, name: the different lines or titles of pages in normal form, empty ones left out."""
    return rows.select(key, "page", T.canonical(F.col(text)).alias("name")).where("name <> ''").distinct()


def printed_headings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, name: the different headings of chunks (key, page, section, text) that print them, not those carried over."""
    own = chunks.where(T.normalize_quote(F.col("text")).contains(T.normalize_quote(F.col("section"))))
    return named(own, "section", key)


def families(pages: DataFrame, studies: DataFrame, generic: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """key, family of documents (studies: key, study_id, marked): those that look alike are never in both halves of a split.

    Marked ones are one family. Else the first word of four letters that is not generic, of the first line of each page, is a page's
    header; the most common one, of equal ones that of the earliest page, names the family if half of the pages have it. Other
    documents, and those without pages, are a family of their study.
    """
    line = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    words = F.filter(F.regexp_extract_all(F.lower(line), F.lit("([a-z]{4,})"), 1), lambda w: ~w.isin(*generic) if generic else F.lit(True))
    heads = pages.select(key, "page", F.get(words, F.lit(0)).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
    known = F.when(F.col("word").isNotNull(), F.struct("n", (-F.col("first")).alias("first"), "word"))
    best = heads.groupBy(key).agg(F.sum("n").alias("pages"), F.max(known).alias("b"))
    own = F.when(F.col("marked"), F.lit("marked")).when(F.col("b.n") * 2 >= F.col("pages"), F.concat(F.lit("header:"), F.col("b.word"))).otherwise(F.concat(F.lit("study:"), F.col("study_id").cast("string")))
    return studies.join(best, key, "left").select(key, own.alias("family"))


def _agreement(lines: DataFrame, outline: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """One row for each name that an outline or a reading has on a page: whether the outline has it, at its top, whether it is read.

    An outline's title counts where a line of its page prints it. Titles and headings are grouped with the lines, so the three
    tables are shuffled once by the same key and none is joined.
    """
    spelt = F.trim(F.regexp_replace("title", r"\s+", " "))
    flags = lambda line, gold, top, seen: [F.lit(v).alias(n) if isinstance(v, bool) else v.alias(n) for n, v in (("line", line), ("gold", gold), ("top", top), ("seen", seen))]
    own = lines.select(key, "page", T.canonical(F.col("text")).alias("name"), *flags(True, False, False, False))
    told = outline.select(key, "page", T.canonical(spelt).alias("name"), *flags(False, True, F.col("level") == 1, False))
    read = detected.select(key, "page", "name", *flags(False, False, False, True))
    return _agreed(own.unionByName(told).unionByName(read), key)


MARKS = ("line", "gold", "top", "seen")


def _agreed(marks: DataFrame, *keys: str) -> DataFrame:
    """_agreement() of marks (keys, page, name, MARKS): what a line, an entry of the outline and a reading say of a name of a page."""
    every = marks.where("name <> ''").groupBy(*keys, "page", "name").agg(*(F.bool_or(n).alias(n) for n in MARKS))
    return every.select(*keys, "page", "name", (F.col("gold") & F.col("line")).alias("gold"), (F.col("top") & F.col("line")).alias("top"), "seen").where("gold or seen")


def marked_agreement(marks: DataFrame, *keys: str) -> DataFrame:
    """heading_agreement() of marks (keys, page, name in normal form, MARKS), for those who have lines, outline and reading in one
    table, of one reading or of several that a key tells apart: names are brought to their normal form once for all."""
    return _counted(_agreed(marks, *keys), *keys)


def heading_agreement(lines: DataFrame, outline: DataFrame, detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and COUNTS: headings of the outline (key, level, title, page) that stand on their page, how many of them and of its top
    level a reading detected (key, page, name), and how many it detected that the outline has not.

    lines (key, page, text). Documents with neither outline nor heading have no row; nulls are no names; repeated ones count once.
    """
    return _counted(_agreement(lines, outline, detected, key), key)


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    gold, top, seen = F.col("gold"), F.col("top"), F.col("seen")
    found = {"gold": gold, "gold_detected": gold & seen, "gold_top": top, "gold_top_detected": top & seen, "detected": seen, "detected_unsupported": seen & ~gold}
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in found.items()))


def missed_headings(lines: DataFrame, outline: DataFrame, detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, name of headings of the outline that stand on their page and were not detected."""
    return _agreement(lines, outline, detected, key).where("gold and not seen").select(key, "page", "name")


def template_lines(lines: DataFrame, detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lines, detected: numbered titles of the template on pages other than contents pages, and how many are headings.

    Lines count as often as they stand.
    """
    contents = lines.where(F.col("text").rlike(LEADER)).select(key, "page").distinct()
    own = lines.where(F.col("text").rlike(NUMBERED) & T.canonical(F.regexp_extract("text", NUMBERED, 2)).isin(*TITLES)).join(contents, [key, "page"], "left_anti")
    seen = detected.select(key, "page", "name").distinct().withColumn("_seen", F.lit(True))
    rows = own.select(key, "page", T.canonical(F.trim("text")).alias("name")).join(seen, [key, "page", "name"], "left")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count_if("_seen").alias("detected"))


def passage_checks(passages: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The passages (passage_id, key, page, quote) with found: a chunk of its page holds it whole, and read: such a chunk is read.

    chunks (key, page, text, read). A passage of a page without chunks is not found; an empty one stands in every chunk.
    """
    own = passages.select("passage_id", key, "page", T.normalize_quote(F.col("quote")).alias("_q"))
    told = chunks.select(key, "page", T.normalize_quote(F.col("text")).alias("_t"), "read")
    holds = F.coalesce(F.col("_t").contains(F.col("_q")), F.lit(False))
    hits = own.join(told, [key, "page"], "left").groupBy("passage_id", key, "page").agg(F.bool_or(holds).alias("found"), F.bool_or(holds & F.coalesce("read", F.lit(False))).alias("read"))
    return passages.join(hits, ["passage_id", key, "page"])


def checklist_spans(spans: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunks, read_chunks, read_chars of labelled checklists (key, start_page, end_page, start_text).

    chunks (key, section_id, page, text, read). A checklist begins with the first chunk of its first page that holds its start, or
    where none does with that page.
    """
    rows = spans.join(chunks, key).where(F.col("page").between(F.col("start_page"), F.col("end_page")))
    holds = (F.col("page") == F.col("start_page")) & T.normalize_quote(F.col("text")).contains(T.normalize_quote(F.col("start_text")))
    start = rows.groupBy(key, "start_page", "end_page", "start_text").agg(F.min(F.when(holds, F.col("section_id"))).alias("_start"), F.collect_list(F.struct("section_id", F.length("text").alias("n"), "read")).alias("c"))
    inside = F.filter("c", lambda c: c["section_id"] >= F.coalesce("_start", F.lit("")))
    read = F.filter(inside, lambda c: F.coalesce(c["read"], F.lit(False)))
    return start.select(key, "start_page", F.size(inside).cast("long").alias("chunks"), F.size(read).cast("long").alias("read_chunks"), F.aggregate(read, F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("read_chars"))


def changes(before: DataFrame, after: DataFrame, family: DataFrame, measures: Sequence[str], key: str = "doc_id") -> DataFrame:
    """family, measure, documents, before, after, gained, lost of two readings' measures, summed over the documents of a family.

    family (key, family). A document that one reading lacks counts as nothing there; gains and losses are those of single
    documents, so that they do not cancel out.
    """
    long = lambda df: df.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("n")) for m in measures))).alias("x")).select(key, "x.*")
    return _by_family(run_diff(long(before), long(after), [key, "measure"], "n"), family, key)


def changed(readings: DataFrame, family: DataFrame, measures: Sequence[str], key: str = "doc_id") -> DataFrame:
    """changes() of readings in one table (key, later: whether it is the second reading, measures): one grouping, no join of the two."""
    each = readings.select(key, "later", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("n")) for m in measures))).alias("x")).select(key, "later", "x.*")
    of = lambda later: F.coalesce(F.sum(F.when(F.col("later") == later, F.col("n"))), F.lit(0))
    b, a = F.col("before"), F.col("after")
    both = each.groupBy(key, "measure").agg(of(False).alias("before"), of(True).alias("after"))
    return _by_family(both.withColumns({"gained": F.greatest(a - b, F.lit(0)), "lost": F.greatest(b - a, F.lit(0))}), family, key)


def _by_family(each: DataFrame, family: DataFrame, key: str) -> DataFrame:
    sums = (F.sum(n).alias(n) for n in ("before", "after", "gained", "lost"))
    return each.join(family, key).groupBy("family", "measure").agg(F.count(F.lit(1)).alias("documents"), *sums)
