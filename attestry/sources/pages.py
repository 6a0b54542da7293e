"""Web pages, paged documents and dictionaries: markup fields, links, form-feed pages, concept and medicine files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import text as T

CONCEPT_SCHEMA = "array<struct<concept_id:string,input_terms:array<string>,english_terms:array<string>,related_terms:array<string>,code_candidates:array<struct<system:string,code:string,vocabulary_version:string,relation:string>>,analogous_terms:array<struct<term:string,relation:string>>>>"
MEDICINE_SCHEMA = "struct<data:array<struct<category:string,name_of_medicine:string,international_non_proprietary_name_common_name:string,atc_code_human:string,medicine_url:string>>>"
PAGE_CHARS, MOST_PAGES, LEAST_TEXT, MOST_TEXT = 3000, 1500, 150, 5_000_000


def plain(html: Column) -> Column:
    """Text of a piece of markup, entities of the five reserved signs read."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_fields(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, label, value for the title, first heading, language and footer of a page; only those that are there."""
    tag = lambda name: plain(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1))
    parts = {"title": tag("title"), "h1": tag("h1"), "footer": tag("footer"), "lang": F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in parts.items())))
    return pages.select(key, each.alias("x")).select(key, "x.label", "x.value").where("value <> ''")


def link_cards(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, href, text of every link, the first of each address."""
    hrefs, texts = (F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>'), k) for k in (1, 2))
    first = F.filter(F.transform(hrefs, lambda h, i: F.struct(i.alias("ord"), h.alias("href"), (F.array_position(hrefs, h) == i + 1).alias("first"))), lambda x: x["first"])
    return pages.select(key, F.explode(first).alias("x"), texts.alias("t")).select(key, "x.ord", "x.href", plain(F.element_at("t", F.col("x.ord") + 1)).alias("text"))


def paged(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = PAGE_CHARS) -> DataFrame:
    """key, page (from 1), text: pages divided by form feeds, or where there is none windows of some characters."""
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(chars)), lambda s: F.substring(F.col(text), s + 1, F.lit(chars)))
    pages = F.when(F.col(text).contains("\f"), F.split(text, "\f")).otherwise(windows)
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(pages).alias("p", "text")).select(key, (F.col("p") + 1).alias("page"), "text")


def page_errors(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that cannot be read: too many pages, hardly any text, or too much of it."""
    sums = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"))
    code = F.when(F.col("pages") > MOST_PAGES, "DOCUMENT_TOO_LONG").when(F.col("chars") < LEAST_TEXT, "OCR_REQUIRED").when(F.col("chars") > MOST_TEXT, "DOCUMENT_TOO_LARGE")
    return sums.withColumn("error", code).where("error is not null")


def text_layer(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """full, partial where half the pages or more have under 50 characters, none where all have no text."""
    thin, empty = F.avg((F.length("text") < 50).cast("double")), F.avg((F.trim("text") == "").cast("double"))
    return pages.groupBy(key).agg(F.when(empty == 1, "none").when(thin >= 0.5, "partial").otherwise("full").alias("text_layer"))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """concept_id, term, kind, source_file of a concept dictionary, one row per term."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", CONCEPT_SCHEMA).alias("c"), F.col("_metadata.file_name").alias("source_file"))
    if raw.where("c is null or size(c) > 3000").limit(1).count():
        raise EngineError("DICTIONARY_ERROR", "a dictionary is a list of at most 3000 concepts")
    each = raw.select("source_file", F.explode("c").alias("c"))

    def told(kind: str):
        return lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind"))

    kinds = [F.transform(F.coalesce(f"c.{k}", F.array().cast("array<string>")), told(k)) for k in ("input_terms", "english_terms", "related_terms")]
    return each.select(F.col("c.concept_id").alias("concept_id"), F.explode(F.concat(*kinds)).alias("x"), "source_file").select("concept_id", "x.term", "x.kind", "source_file")


def medicines(raw: DataFrame, value: str = "value") -> DataFrame:
    """name, ingredients, code of the human medicines of a register."""
    each = raw.select(F.explode(F.from_json(value, MEDICINE_SCHEMA)["data"]).alias("m"))
    kept = each.where("lower(m.category) = 'human' and trim(m.name_of_medicine) <> '' and trim(m.international_non_proprietary_name_common_name) <> ''")
    return kept.select(F.trim("m.name_of_medicine").alias("name"), T.split_values(F.col("m.international_non_proprietary_name_common_name")).alias("ingredients"), F.nullif(F.regexp_extract("m.atc_code_human", r"^([A-Z]\d{2}[A-Z]{2}\d{2})$", 1), F.lit("")).alias("code"))


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """https to one of the hosts, no other port, no user."""
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(*hosts) & F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~F.try_parse_url(url, F.lit("AUTHORITY")).rlike(r":(?!443$)\d+$")
    return F.coalesce(ok, F.lit(False))
