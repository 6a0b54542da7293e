"""Writers: atomic tables, history, compaction, snapshots with a manifest, facts as HTML and comparisons as Markdown."""

from __future__ import annotations

import html
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a local session without one a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="attestry-")
    return _OWN[app]


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what reads it several times computes it once, and a lost executor costs no
    more than the step at hand. The folder is cleared between jobs."""
    path = f"{shared_dir(df.sparkSession)}/s-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write beside the table, then put the new folder in its place; a failed write leaves the old one.

    A crash between the two renames leaves the old table beside its place; recover() puts it back.
    """
    spark = df.sparkSession
    recover(spark, path)
    staging = f"{path}.{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(staging)
    new, fs = _fs(spark, staging)
    old, _ = _fs(spark, path)
    past, _ = _fs(spark, f"{path}.before")
    if fs.exists(old) and not fs.rename(old, past):
        raise EngineError("WRITE_FAILED", path)
    if not fs.rename(new, old):
        recover(spark, path)
        raise EngineError("WRITE_FAILED", path)
    fs.delete(past, True)


def recover(spark: SparkSession, path: str) -> None:
    """Put back a table that a crash left beside its place, or remove it where the new one had come."""
    own, fs = _fs(spark, path)
    past, _ = _fs(spark, f"{path}.before")
    if fs.exists(past):
        if fs.exists(own):
            fs.delete(past, True)
        elif not fs.rename(past, own):
            raise EngineError("WRITE_FAILED", path)


def compact(spark: SparkSession, path: str, files: int = 1) -> tuple[int, int]:
    """Rewrite a table in fewer files; bytes before and after."""
    p, fs = _fs(spark, path)
    before = fs.getContentSummary(p).getLength()
    replace_table(spark.read.parquet(path), path, files)
    return before, fs.getContentSummary(p).getLength()


def history_rows(current: DataFrame, new: DataFrame, key: str = "study_id") -> DataFrame:
    """Current rows that a save replaces by something else, under the hash of their body."""
    same = ["fingerprint", "body"]
    moved = current.join(new.select(key, *(F.col(c).alias(f"_{c}") for c in same)), key).where("not (fingerprint <=> _fingerprint and body <=> _body)")
    return moved.groupBy(F.sha2("body", 256).alias("snapshot_id")).agg(F.min(F.struct(key, *same)).alias("x")).select("snapshot_id", f"x.{key}", "x.fingerprint", "x.body")


def replace_rows(table: DataFrame, new: DataFrame, key: str = "study_id") -> DataFrame:
    """All rows of the keys in new are replaced by those of new."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def saved_batches(table: DataFrame, new: DataFrame, key: str = "study_id") -> DataFrame:
    """Batches (key, fingerprint, reading, kind, offset, body) with new ones over them: of the studies in new those of another
    fingerprint or reading go, since they can never be merged with these. A study has one fingerprint and reading in new."""
    same = [key, "fingerprint", "reading"]
    current = new.groupBy(key).agg(F.max(F.struct("fingerprint", "reading")).alias("_c"))
    kept = table.join(current, key, "left").where("_c is null or (_c.fingerprint <=> fingerprint and _c.reading <=> reading)").drop("_c")
    return kept.join(new.select(*same, "kind", "offset"), [*same, "kind", "offset"], "left_anti").unionByName(new)


def saved_readings(table: DataFrame, new: DataFrame, analyses: DataFrame, keep_parser: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Readings (protocol_id, reading, parser) with new ones over them, and the analyses (study_id, protocol_id) that stay: those of
    documents whose reading has changed are retired. A record that keep_parser wrote already stays."""
    old = table.select("protocol_id", F.col("reading").alias("_r"), F.col("parser").alias("_p"))
    told = new.join(old, "protocol_id", "left")
    if keep_parser is not None:
        told = told.where(~F.coalesce(F.col("_p") == keep_parser, F.lit(False)))
    changed = told.where(F.coalesce("_r", F.lit("")) != F.col("reading")).select("protocol_id")
    written = told.select("protocol_id", "reading", "parser")
    return table.join(written.select("protocol_id"), "protocol_id", "left_anti").unionByName(written), analyses.join(changed, "protocol_id", "left_anti")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, content hash of each table; the hash, a sum, does not depend on the order of rows and counts equal ones."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("hash")).select(F.lit(name).alias("name"), "rows", "hash")
        out = one if out is None else out.union(one)
    return out


def write_snapshot(tables: dict[str, DataFrame], path: str, date: str) -> None:
    """Each table and a manifest under snapshot=date."""
    for name, df in tables.items():
        replace_table(df, f"{path}/snapshot={date}/{name}")
    spark = next(iter(tables.values())).sparkSession
    replace_table(manifest({n: spark.read.parquet(f"{path}/snapshot={date}/{n}") for n in tables}), f"{path}/snapshot={date}/_manifest", 1)


def verify_snapshot(spark: SparkSession, path: str, date: str) -> None:
    """Raise unless every table has the rows and content of the manifest."""
    root = f"{path}/snapshot={date}"
    told = {r.name: (r.rows, r.hash) for r in spark.read.parquet(f"{root}/_manifest").collect()}
    found = {r.name: (r.rows, r.hash) for r in manifest({n: spark.read.parquet(f"{root}/{n}") for n in told}).collect()}
    if told != found:
        raise EngineError("SNAPSHOT_INVALID", ", ".join(sorted(n for n in told if told[n] != found.get(n))))


def facts_page(facts: Iterable) -> str:
    """A self-contained page of facts with their quotes, grouped by study and kind; rows come sorted by them. All text is escaped."""
    out, study, kind = ["<!doctype html><meta charset=utf-8><title>Facts</title>"], None, None
    for r in facts:
        if r.study_id != study:
            out.append(f"<h2>{html.escape(str(r.study_id))}</h2>")
            study, kind = r.study_id, None
        if r.item_kind != kind:
            out.append(f"<h3>{html.escape(r.item_kind)}</h3>")
            kind = r.item_kind
        out.append(f"<p>{html.escape(r.value or '')}</p>")
        out += [f"<blockquote>p. {e.page}: {html.escape(e.quote or '')}</blockquote>" for e in (r.evidence or ()) if e.quote]
    return "\n".join(out)


def write_comparison(rows: DataFrame, table: str, path: str) -> None:
    """A comparison's rows as JSON files, a folder for each study, and the table as Markdown; a later write replaces both."""
    rows.write.mode("overwrite").partitionBy("study").json(f"{path}/rows")
    rows.sparkSession.createDataFrame([(table,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/table")


def archived(files: DataFrame, study: str = "study_id") -> DataFrame:
    """Documents by their content (study_id, sha256, protocol_id, length, archived_at, content); equal contents of a study once, the
    first of them. files has study_id, content and archived_at."""
    own = files.withColumns({"sha256": F.sha2("content", 256), "length": F.length("content")})
    first = own.groupBy(study, "sha256").agg(F.min(F.struct("archived_at", "length", "content")).alias("x"))
    return first.select(study, "sha256", F.concat(F.lit("pdf_"), F.col(study).cast("string"), F.lit("_"), "sha256").alias("protocol_id"), "x.length", "x.archived_at", "x.content")


def loaded(archive: DataFrame, protocol_id: str) -> DataFrame:
    """A document of an archive whose content still has the checksum of its id."""
    return archive.where((F.col("protocol_id") == protocol_id) & (F.sha2("content", 256) == F.substring_index(F.lit(protocol_id), "_", -1)))


def remove_stale(spark: SparkSession, parent: str, prefix: str, now_ms: int, hours: float = 6) -> list[str]:
    """Delete work folders of a prefix whose newest file is older than some hours at a given time; returns their names."""
    p, fs = _fs(spark, parent)
    gone = []
    for status in fs.listStatus(p) if fs.exists(p) else ():
        path = status.getPath()
        if not status.isDirectory() or not path.getName().startswith(prefix):
            continue
        newest = max([status.getModificationTime(), *(x.getModificationTime() for x in fs.listStatus(path))])
        if newest < now_ms - hours * 3_600_000:
            fs.delete(path, True)
            gone.append(path.getName())
    return sorted(gone)
