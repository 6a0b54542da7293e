"""Catalogue exports: delimited files whose headers are resolved by alias, validated rows, keyed upserts with provenance."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import EngineError
from ..functions import text as T

# fixed values: internal fields and the headers of exports that may hold them, the first that is there; further columns of a
# role; columns that say whether a protocol is listed; and public columns whose text is searched
ALIASES: dict[str, tuple[str, ...]] = {
    "study_id": ("study id", "study identifier", "id"), "title": ("official title and acronym", "study title", "title"), "study_type": ("study type", "type of study"), "study_designs": ("non interventional study design", "study design", "study designs"), "description": ("study description", "description"),
    "eupas_number": ("eu pas number", "eupas number"), "status": ("study status", "status"), "network": ("darwin eu study", "darwin eu"), "countries": ("study countries", "countries"), "data_source_types": ("data sources types", "data source type", "data source types"),
    "catalogue_data_sources": ("data sources", "data source s", "data source name", "data source names"), "conditions": ("medicinal condition to be studied", "medical condition", "conditions"), "outcomes": ("outcomes", "outcome"),
    "exposures": ("study drug international non proprietary name inn or common name", "medicinal product name", "inn"), "objective": ("main study objective", "objective"),
}
MORE = {"conditions": ("additional medical condition s",), "exposures": ("medicinal product name", "medicinal product name other", "anatomical therapeutic chemical atc code"), "catalogue_data_sources": ("other linked data sources",), "study_designs": ("non interventional study design other",)}
PROTOCOL = ("protocol file s", "protocol file s uri", "protocol url", "initial protocol file uri", "updated protocol file s uri")
SEARCHED = (
    "study topic", "scope of the study", "data collection methods", "study design", "main study objective", "non interventional study design other", "medicinal product name", "medicinal product name other", "study drug international non proprietary name inn or common name",
    "anatomical therapeutic chemical atc code", "medicinal condition to be studied", "additional medical condition s", "short description of the study population", "setting", "comparators", "outcomes", "data analysis plan", "other linked data sources",
)
LISTS = ("countries", "data_source_types", "catalogue_data_sources", "study_designs", "conditions", "exposures")
#: Values of the study type that are in scope, in normal form.
IN_SCOPE = ("non interventional", "non interventional study")
KINDS = ("claims", "ehr", "registry")
SNIFFED, MOST_BYTES = 16_384, 50 << 20


def normalized_header(text: str) -> str:
    return T.python_canonical(text) or ""


def sniffed_delimiter(sample: str) -> str:
    """Of comma, semicolon and tab the one that divides the most lines of a sample alike, outside quotes; comma if none does."""
    lines = [x for x in re.sub(r'"(?:[^"]|"")*"', "", sample).splitlines() if x.strip()]
    if not lines:
        return ","

    def worth(d: str) -> tuple[int, int, bool]:
        n = lines[0].count(d)
        return (sum(x.count(d) == n for x in lines) if n else 0, n, d == ",")

    best = max((",", ";", "\t"), key=worth)
    return best if lines[0].count(best) else ","


def resolved_headers(headers: Sequence[str], column_map: dict[str, str] | None = None) -> tuple[dict[str, int], list[str]]:
    """Position of the column of each field, and the headers that occur more than once.

    Of a repeated header the last column counts. A caller's map must name known fields and existing headers.
    """
    at = {normalized_header(h): k for k, h in enumerate(headers)}
    out = {f: at[a] for f, names in ALIASES.items() for a in [next((n for n in names if n in at), None)] if a is not None}
    for name, header in (column_map or {}).items():
        if name not in ALIASES:
            raise EngineError("CSV_COLUMN_MAP_ERROR", f"unknown field {name}")
        if normalized_header(header) not in at:
            raise EngineError("CSV_COLUMN_MAP_ERROR", f"no column {header}")
        out[name] = at[normalized_header(header)]
    repeated = [h for h, n in Counter(map(normalized_header, headers)).items() if n > 1 and h]
    return out, repeated


def resolved_table(headers: DataFrame, file: str = "file") -> DataFrame:
    """file, field, header, position: resolved_headers() for the headers (file, position, header) of many exports at once; a header
    that a file has more than once is told under the field (repeated) with position -1."""
    spark = headers.sparkSession
    aliases = spark.createDataFrame([(f, a, k) for f, names in ALIASES.items() for k, a in enumerate(names)], "field string, _h string, _k int")
    own = headers.withColumn("_h", T.canonical(F.col("header"))).groupBy(file, "_h").agg(F.max(F.struct("position", "header")).alias("x"), F.count(F.lit(1)).alias("n"))
    best = own.join(F.broadcast(aliases), "_h").groupBy(file, "field").agg(F.min_by("x", "_k").alias("x"))
    again = own.where("n > 1 and _h <> ''").select(file, F.lit("(repeated)").alias("field"), F.col("_h").alias("header"), F.lit(-1).alias("position"))
    return best.select(file, "field", "x.header", F.col("x.position").cast("int").alias("position")).unionByName(again)


def kind_of(name: str) -> str | None:
    """The one kind that a file name holds as a word; none if it holds several."""
    found = set(re.split(r"[_\-. ]+", PurePosixPath(name).name.lower())) & set(KINDS)
    return found.pop() if len(found) == 1 else None


@dataclass
class Import:
    rows: DataFrame
    excluded: DataFrame
    kind: str | None
    warnings: list[str] = field(default_factory=list)
    has_types: bool = False


def guarded(spark: SparkSession, name: str, folders: Sequence[str]) -> tuple[str, str | None]:
    """The path of an export by its bare name in the first of the folders (studies, source_type, root) that has it, and its kind.

    A name is a .csv without a path, a file has 1 byte to 50 MiB, and one in source_type carries its kind in its name.
    """
    if not name or len(name) > 255 or PurePosixPath(name).name != name or not name.lower().endswith(".csv") or name.startswith("."):
        raise EngineError("INVALID_INPUT", "the name of a CSV file in an import folder")
    for folder in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        kind = kind_of(name)
        if PurePosixPath(folder).name == "source_type" and kind is None:
            raise EngineError("INVALID_INPUT", "the name of a filtered export holds its type")
        if not 0 < fs.getFileStatus(p).getLen() <= MOST_BYTES:
            raise EngineError("CSV_SCHEMA_ERROR", "a file of 1 byte to 50 MiB")
        return f"{folder}/{name}", kind
    raise EngineError("CSV_NOT_FOUND", name)


def read_catalogue(spark: SparkSession, path: str, column_map: dict[str, str] | None = None, kind: str | None = None) -> Import:
    """Typed rows of one export; nothing is returned if any row is bad.

    Only the first lines are read on the driver. Ids are up to 20 digits and unique, titles of rows in scope are not blank, and
    all is UTF-8. Conditions, exposures, sources and designs are the distinct values of their columns in order; the text that is
    searched is that of the public columns only, each once.
    """
    kind = kind or kind_of(path)
    head = [r.value for r in spark.read.text(path).limit(200).collect()]
    if not head or not head[0]:
        raise EngineError("CSV_SCHEMA_ERROR", "no header")
    line = head[0].removeprefix("\ufeff")
    sep = sniffed_delimiter("\n".join([line, *head[1:]])[:SNIFFED])
    headers = next(csv.reader([line], delimiter=sep))
    at, repeated = resolved_headers(headers, column_map)
    if missing := {"study_id", "title", "study_type"} - set(at):
        raise EngineError("CSV_SCHEMA_ERROR", f"no column for {sorted(missing)}")
    names = {normalized_header(h): k for k, h in enumerate(headers)}
    schema = S.StructType([S.StructField(f"c{k}", S.StringType()) for k in range(len(headers))])
    raw = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding="UTF-8", enforceSchema=True)
    cell = lambda k: F.trim(F.coalesce(F.col(f"c{k}"), F.lit("")))
    value = {f: cell(k) for f, k in at.items()}
    columns = []
    for f in ALIASES:
        own = [value[f]] if f in value else []
        more = [cell(names[h]) for h in MORE.get(f, ()) if h in names and names[h] != at.get(f)]
        if f == "network":
            columns.append(T.tri_state(value[f]).alias(f) if own else F.lit(None).cast("boolean").alias(f))
        elif f in LISTS:
            columns.append((F.array_distinct(F.flatten(F.array(*map(T.split_values, own + more)))) if own + more else F.array().cast("array<string>")).alias(f))
        elif f == "eupas_number":
            columns.append((F.nullif(value[f], F.lit("")) if own else F.lit(None).cast("string")).alias(f))
        else:
            columns.append((value[f] if own else F.lit(None).cast("string") if f != "outcomes" else F.lit("")).alias(f))
    columns.append(T.any_filled([cell(names[h]) for h in PROTOCOL if h in names]).alias("protocol_listed"))
    searched = [cell(names[h]) for h in SEARCHED if h in names]
    search = F.trim(F.array_join(F.array_distinct(F.array(*searched)), "\n")) if searched else F.lit("")
    rows = raw.select(*columns, search.alias("search_text"), F.exists(F.array(*(F.col(f"c{k}") for k in range(len(headers)))), lambda x: F.coalesce(x.contains("\ufffd"), F.lit(False))).alias("_bad")).withColumn("in_scope", T.norm(F.coalesce("study_type", F.lit(""))).isin(*IN_SCOPE))
    bad = rows.agg(F.count_if("_bad").alias("bytes"), F.count_if(~F.col("study_id").rlike(r"^\d{1,20}$")).alias("ids"), F.count_if(F.col("in_scope") & (F.col("title") == "")).alias("titles"), (F.count("study_id") - F.countDistinct("study_id")).alias("twice")).first()
    for code, n in (("CSV_SCHEMA_ERROR", bad.bytes), ("CSV_INVALID_ID", bad.ids), ("CSV_EMPTY_TITLE", bad.titles), ("CSV_DUPLICATE_ID", bad.twice)):
        if n:
            raise EngineError(code, f"{n} rows")
    warnings = [f"repeated header: {h}" for h in repeated]
    if "data_source_types" not in at and not kind:
        warnings.append("no column of data source types: import filtered exports to tag studies")
    return Import(rows.where("in_scope").drop("in_scope", "_bad"), rows.where("not in_scope").select("study_id"), kind, warnings, "data_source_types" in at)


def upserted(old: DataFrame, new: DataFrame, removed: DataFrame | None = None, key: str = "study_id") -> DataFrame:
    """new over old by key; rows that new does not name stay, removed ones go. One shuffle of each side on the key."""
    if removed is not None:
        old = old.join(removed.select(key).distinct(), key, "left_anti")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def tagged(old: DataFrame, new: DataFrame, kind: str | None, has_types: bool, key: str = "study_id", tags: str = "data_source_types") -> DataFrame:
    """new with its tags: a typed import adds its kind to the old ones, an untyped one without the column keeps them."""
    before = old.select(key, F.col(tags).alias("_old"))
    kept = F.coalesce("_old", F.array().cast("array<string>"))
    own = F.array_distinct(F.concat(kept, F.array(F.lit(kind)))) if kind else F.col(tags) if has_types else kept
    return new.join(before, key, "left").withColumn(tags, own).drop("_old")


def accumulated_tags(log: DataFrame, key: str, tag: str, order: str) -> DataFrame:
    """Distinct tags of each key in the order in which they were first seen."""
    first = log.groupBy(key, tag).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", tag))), lambda x: x[tag]).alias("tags"))


def newest_per_kind(log: DataFrame, kind: str, ts: str, now, ttl_seconds: int) -> DataFrame:
    """The newest entry of each kind with its age and whether it is current; now is given, never read from a clock."""
    newest = log.groupBy(kind).agg(F.max(ts).alias("newest"), F.count(F.lit(1)).alias("imports"))
    age = F.unix_micros(F.lit(now)) - F.unix_micros(F.col("newest").cast("timestamp"))
    return newest.withColumn("age_seconds", F.floor(age / 1_000_000)).withColumn("state", freshness(F.col("age_seconds"), ttl_seconds))


def freshness(age_seconds, ttl_seconds: int):
    return F.when(age_seconds.isNull(), "not_imported").when(age_seconds <= ttl_seconds, "current").otherwise("stale")


def imported_once(log: DataFrame, keys: Iterable[str] = ("checksum", "kind")) -> DataFrame:
    return log.dropDuplicates(list(keys))


def unmatched_terms(log: DataFrame, term: str, tool: str, ts: str) -> DataFrame:
    """Counter of each text with the first and last time and the tools."""
    return log.groupBy(term).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.array_sort(F.collect_set(tool)).alias("tools"))


def to_log(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries that are logged as unmatched, with their text on one line of up to 200 characters.

    Only where a dictionary is configured (dictionaries), for texts that are not blank and not ASCII, and that neither vocabulary
    groups (groups), concepts (concepts) nor medicines (medicines) match; these columns are numbers.
    """
    line = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 200)
    nothing = (F.col("groups") == 0) & (F.col("concepts") == 0) & (F.col("medicines") == 0)
    return queries.withColumn(text, line).where((F.col("dictionaries") > 0) & (F.col(text) != "") & ~T.is_ascii(F.col(text)) & nothing)


def export_day(name: F.Column, imported: F.Column) -> F.Column:
    """The day of an export: the eight digits that open its file name, else the day of its import."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d{8})_", 1), F.lit("")), F.date_format(imported, "yyyyMMdd"))


def replaced_if_newer(own: DataFrame, bundle: DataFrame, own_log: DataFrame, bundle_log: DataFrame, ts: str = "imported_at") -> DataFrame:
    """The bundle's table in place of one's own where its last import is newer; a table is replaced whole or not at all."""
    last = own_log.agg(F.max(ts).alias("_o")).join(bundle_log.agg(F.max(ts).alias("_b")))
    newer = last.select((F.col("_b").isNotNull() & (F.col("_o").isNull() | (F.col("_b") > F.col("_o")))).alias("_n"))
    mine = own.join(newer.where("not _n")).drop("_n")
    return mine.unionByName(bundle.join(newer.where("_n")).drop("_n"), allowMissingColumns=True)


def unmatched_summary(counters: DataFrame, term: str, k: int = 20) -> DataFrame:
    return counters.orderBy(F.desc("n"), F.asc("last_seen"), F.asc(term)).limit(k)


def latest_versions(docs: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """The document of each study to read: best kind, then by version if all of that kind have one, else by document date if
    all have one, else by any date. Later dates decide between equal versions, publication between equal document dates, and
    at last the largest url. A wanted version keeps only its documents.

    docs has the key, kind (updated before initial), version, document_date, published_date and url. Documents are aggregated
    by key in one pass: a struct of the sort key holds its row.
    """
    if version is not None:
        bare = lambda c: F.ltrim(F.lower(F.coalesce(c, F.lit(""))), F.lit("v"))
        docs = docs.where(bare(F.col("version")) == version.lower().lstrip("v"))
    names = [c for c in docs.columns if c != key]
    row = F.struct(*names)
    none = F.lit("")
    number = F.slice(F.concat(F.transform(F.split("version", r"\."), lambda x: x.try_cast("int")), F.array_repeat(F.lit(0), 8)), 1, 8)
    dates = F.coalesce("document_date", none), F.coalesce("published_date", none)
    updated = F.max(F.col("kind") == "updated")
    own = docs.join(docs.groupBy(key).agg(updated.alias("_u")), key).where(F.col("_u") == (F.col("kind") == "updated"))
    best = own.groupBy(key).agg(
        F.every(F.col("version").isNotNull()).alias("_v"), F.every(F.col("document_date").isNotNull()).alias("_d"),
        F.max_by(row, F.struct(number, *dates, "url")).alias("by_version"), F.max_by(row, F.struct(*dates, F.col("url"))).alias("by_date"), F.max_by(row, F.struct(F.coalesce("published_date", "document_date", none), F.col("url"))).alias("by_any"),
    )
    choice = F.when(F.col("_v"), F.col("by_version")).when(F.col("_d"), F.col("by_date")).otherwise(F.col("by_any"))
    reason = F.when(F.col("_v"), "version").when(F.col("_d"), "document_date").otherwise("published_date")
    return best.select(key, choice.alias("x"), reason.alias("reason")).select(key, "x.*", "reason")


def merged_observations(bundle: DataFrame, local: DataFrame, key: str, fields: Sequence[str], version: str = "version") -> DataFrame:
    """Field by field the value with the higher rule version, the local one at a tie; a field only one side has stays."""
    b, own = (x.select(key, F.col(version).alias(f"_{n}v"), *(F.col(f).alias(f"_{n}_{f}") for f in fields)) for n, x in (("b", bundle), ("l", local)))
    rows = b.join(own, key, "full")
    newer = F.coalesce(F.col("_bv") > F.col("_lv"), F.lit(False))
    return rows.select(key, *(F.when(newer, F.coalesce(f"_b_{f}", f"_l_{f}")).otherwise(F.coalesce(f"_l_{f}", f"_b_{f}")).alias(f) for f in fields), F.greatest("_bv", "_lv").alias(version))


def snapshot_exports(names: Sequence[str]) -> dict[str, str]:
    """The exports of a snapshot by kind: exactly one of the full catalogue (studies) and of each kind, all of one day."""
    out: dict[str, str] = {}
    days = set()
    for name in sorted(names):
        base = PurePosixPath(name).name
        kind = kind_of(base) or "studies"
        day = re.match(r"(\d{8})_", base)
        if not day or kind in out:
            raise EngineError("SNAPSHOT_INVALID", f"not one dated export of {kind}: {base}")
        out[kind] = name
        days.add(day[1])
    if set(out) != {"studies", *KINDS} or len(days) != 1:
        raise EngineError("SNAPSHOT_INVALID", "one export of studies and of each kind, of one day")
    return out
