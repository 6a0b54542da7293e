"""One object over a folder of tables: imports, search, screening, documents, evidence and facts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .errors import EngineError
from .functions import text as T
from .operators import evidence, expansion, increments, medicines, retrieval, sections
from .operators.commits import archived, bodies, removed_from_scope, retired
from .settings import Settings
from .sources import catalogue, pages, sinks, versions

#: Index fields and the columns that fill them, of the studies table and of saved analyses (with a dot); lists are joined.
FIELDS = {
    "title": ("title",), "metadata": ("description", "study_type", "status", "countries", "data_source_types", "search_text", "analysis.population", "analysis.comparator"), "design": ("study_designs", "analysis.study_design", "analysis.statistical_analysis"),
    "definitions": ("analysis.disease_definitions",), "data_sources": ("analysis.data_sources",), "condition": ("conditions",), "outcomes": ("outcomes", "analysis.outcomes"), "exposure": ("exposures", "analysis.exposure", "observed_exposures"), "objective": ("objective",),
}


#: Tables of analyses and of what was seen of a study's document.
ANALYSIS = "study_id string, item_kind string, value string"
OBSERVATION = "study_id string, protocol_found boolean, text_layer string, exposures array<struct<term:string,codes:array<string>,source:string>>"


@dataclass
class Engine:
    """A store of studies, analyses, observations, documents and their index. Every call that writes is one commit: readers see
    all of its tables or none, and a writer that another one has overtaken begins again on what that one left."""

    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        self.store = versions.Store(self.spark, self.root)

    def _table(self, name: str) -> DataFrame:
        return self.store.last().table(name)

    def import_catalogue(self, path: str, column_map: dict[str, str] | None = None, kind: str | None = None, at: datetime | None = None) -> dict:
        """Read an export, merge it into the studies, log it once per content and kind, and bring the index up to date.

        Studies that are no longer in scope go from studies, analyses and index, their analyses to the history. What was
        observed of a document stays. at is the time of the import.
        """
        new = catalogue.read_catalogue(self.spark, path, column_map, kind)
        own = new.rows.withColumn("study_id", F.trim("study_id"))
        checksum = self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        when = (at or datetime.now(timezone.utc)).astimezone(timezone.utc)
        n = own.count()
        log = self.spark.createDataFrame([(f"{checksum}:{new.kind}" if new.kind else checksum, checksum, new.kind, PurePosixPath(path).name, when, n)], "record string, checksum string, kind string, filename string, imported_at timestamp, studies long")

        def make(change: versions.Change) -> None:
            if change.base.has("studies"):
                rows = catalogue.tagged(change.base.table("studies"), own, new.kind, new.has_types)
            else:
                rows = own.withColumn("data_source_types", F.array(F.lit(new.kind)) if new.kind else F.col("data_source_types"))
            change.upsert("studies", rows, "study_id", new.excluded)
            removed_from_scope(change, new.excluded)
            change.upsert("imports", log, "record")
            self._index(change, own.select("study_id"), new.excluded)

        version = self.store.transact(make)
        return {"imported": n, "excluded": new.excluded.count(), "kind": new.kind, "checksum": checksum, "version": version.number, "warnings": new.warnings}

    def import_file(self, name: str, column_map: dict[str, str] | None = None, at: datetime | None = None) -> dict:
        """Import an export by its bare name from the folders studies, source_type and the root of the store's import folder."""
        path, kind = catalogue.guarded(self.spark, name, [f"{self.root}/import/studies", f"{self.root}/import/source_type", f"{self.root}/import"])
        return self.import_catalogue(path, column_map, kind, at)

    def import_all(self, files: Sequence[str]) -> list[dict]:
        """Import exports one after the other, untyped ones first, by name; tags accumulate in that order."""
        return [self.import_catalogue(f) for f in sorted(files, key=lambda f: (catalogue.kind_of(f) is not None, f))]

    def catalogue_status(self, now: datetime) -> DataFrame:
        """Each kind's newest import with its age and state; the full export is the kind studies."""
        log = self._table("imports").withColumn("kind", F.coalesce("kind", F.lit("studies")))
        return catalogue.newest_per_kind(log, "kind", "imported_at", now, self.settings.catalogue_ttl)

    def save_analyses(self, facts: DataFrame, readings: DataFrame | None = None) -> None:
        """Store facts (study_id, item_kind, value) of studies in place of those they had, and index their values.

        Facts that are replaced by others go to the history. readings (protocol_id, reading) says how the documents were read;
        where one is read another way by now, nothing is saved.
        """
        own = facts.select("study_id", "item_kind", "value")

        def make(change: versions.Change) -> None:
            if readings is not None:
                now = change.base.table("readings").select("protocol_id", F.col("reading").alias("_now")) if change.base.has("readings") else self.spark.createDataFrame([], "protocol_id string, _now string")
                other = readings.join(now, "protocol_id", "left").where(F.coalesce("_now", F.lit("")) != F.col("reading"))
                if other.limit(1).count():
                    raise EngineError("READING_CONTEXT_CHANGED", "documents are read another way than when they were analysed")
            if change.base.has("facts"):
                before, after = bodies(change.base.table("facts")), bodies(own)
                archived(change, before.join(after.withColumnRenamed("body", "_new"), "study_id").where("body <> _new").drop("_new"))
            change.upsert("facts", own, "study_id")
            self._index(change, own.select("study_id").distinct())

        self.store.transact(make)

    def save_readings(self, readings: DataFrame) -> None:
        """Store how documents are read (protocol_id, study_id, reading); analyses of documents whose reading has changed are retired."""

        def make(change: versions.Change) -> None:
            if change.base.has("readings"):
                before = change.base.table("readings").select("protocol_id", F.col("reading").alias("_before"))
                gone = readings.join(before, "protocol_id").where("reading <> _before").select("study_id").distinct()
                if change.base.has("facts"):
                    retired(change, gone)
                    self._index(change, gone)
            change.upsert("readings", readings, "protocol_id")

        self.store.transact(make)

    def observe(self, seen: DataFrame) -> None:
        """Store what was seen of studies' documents (columns of OBSERVATION) in place of what was, and index it."""

        def make(change: versions.Change) -> None:
            change.upsert("observations", seen, "study_id")
            self._index(change, seen.select("study_id").distinct())

        self.store.transact(make)

    def import_concepts(self, concepts: DataFrame, codes: DataFrame) -> None:
        """Store a dictionary: concepts (concept_id, term, kind, source_file) and codes (concept_id, system, code, source_file)."""

        def make(change: versions.Change) -> None:
            change.replace("concepts", concepts)
            change.replace("concept_codes", codes)

        self.store.transact(make)

    def refresh(self, bundle: Engine) -> bool:
        """Take studies, history and the log of a newer bundle, all in one commit, or nothing; what was observed is kept, with the
        bundle's where there is none. Returns whether the bundle was newer."""
        newest = lambda v: v.table("imports").agg(F.max("imported_at")).first()[0] if v.has("imports") else None
        theirs, took = bundle.store.last(), False

        def make(change: versions.Change) -> None:
            nonlocal took
            own, other = newest(change.base), newest(theirs)
            took = other is not None and (own is None or other > own)
            if not took:
                return
            ids = theirs.table("studies").select("study_id")
            gone = change.base.table("studies").select("study_id").join(ids, "study_id", "left_anti") if change.base.has("studies") else ids.limit(0)
            change.upsert("studies", theirs.table("studies"), "study_id", gone)
            removed_from_scope(change, gone)
            change.upsert("imports", theirs.table("imports"), "record")
            if theirs.has("observations"):
                new = theirs.table("observations")
                if change.base.has("observations"):
                    new = new.join(change.base.table("observations").select("study_id"), "study_id", "left_anti")
                change.upsert("observations", new, "study_id")
            self._index(change, ids, gone)

        self.store.transact(make)
        return took

    def _index(self, change: versions.Change, ids: DataFrame, removed: DataFrame | None = None) -> None:
        """Bring the index to some studies as the change has them, from their catalogue, analyses and observations."""
        if not (change.base.has("studies") or "studies" in change.state["tables"]):
            return
        keys = ids.distinct()
        studies = change.table("studies").join(keys, "study_id", "left_semi")
        if "facts" in change.state["tables"]:
            facts = change.table("facts").join(keys, "study_id", "left_semi").groupBy("study_id", "item_kind").agg(F.concat_ws(" ", F.array_sort(F.collect_list("value"))).alias("v"))
            wide = facts.groupBy("study_id").agg(F.map_from_entries(F.collect_list(F.struct("item_kind", "v"))).alias("_facts"))
            studies = studies.join(wide, "study_id", "left")
        if "observations" in change.state["tables"]:
            seen = change.table("observations").join(keys, "study_id", "left_semi").select("study_id", F.col("exposures").alias("_seen"))
            listed = F.size("exposures") > 0
            studies = studies.join(seen, "study_id", "left").withColumn("observed_exposures", F.flatten(F.transform(F.filter("_seen", lambda e: (e["source"] != "catalogue_text") | ~listed), lambda e: F.concat(F.array(e["term"]), e["codes"])))).drop("_seen")

        def part(name: str):
            if name.startswith("analysis."):
                kind = {"disease_definitions": "disease_definition", "data_sources": "data_source", "outcomes": "outcome"}.get(name[9:], name[9:])
                return F.element_at("_facts", kind) if "_facts" in studies.columns else None
            return F.col(name) if name in studies.columns else None

        columns = {f: F.concat_ws("\n", *[p for n in names if (p := part(n)) is not None]) for f, names in FIELDS.items()}
        flat = studies.select("study_id", *(c.alias(f) for f, c in columns.items()))
        increments.index_change(change, flat, {f: f for f in FIELDS}, removed, key="study_id")

    def compact(self) -> list[str]:
        """Rewrite the buckets of the index that many commits have touched; returns which."""
        done: list[str] = []
        self.store.transact(lambda change: done.extend(increments.compact_index(change)))
        return sorted(set(done))

    @property
    def index(self) -> retrieval.Index:
        return increments.LiveIndex(self.store.last())

    def _expansion(self, query: str, version: versions.Version) -> list[tuple[str, str, str]]:
        """term, kind, source that the stored dictionary adds to a query, at most PHRASES."""
        if not version.has("concepts"):
            return []
        asked = self.spark.createDataFrame([(0, query)], "query_id int, text string")
        concepts, codes = version.table("concepts"), version.table("concept_codes")
        told = expansion.expanded_terms(expansion.clinical(asked, concepts, codes), concepts, codes)
        return [(r.term, r.kind, r.source) for r in told.where(F.col("ord") <= expansion.PHRASES).orderBy("ord").collect()]

    @staticmethod
    def _groups(query: str, synonyms: Sequence[str], codes: Sequence[str]) -> list[retrieval.Group]:
        groups = expansion.phrase_groups(query, synonyms, codes)
        return [retrieval.Group(g.label, tuple(w for x in g.words for w in (T.python_canonical(x) or "").split()), g.near) for g in groups]

    def _concept(self, query: str, synonyms: Sequence[str], codes: Sequence[str], version: versions.Version) -> tuple[list[retrieval.Group], dict[str, str]]:
        """Search groups of a query with what its dictionary and the caller add, and where each added term is from."""
        told = self._expansion(query, version)
        sources = {t: s for t, k, s in told if k != "analogous"} | {t: "caller" for t in (*synonyms, *codes)}
        more = [t for t, k, _ in told if k in ("english", "related")]
        return self._groups(query, [*more, *synonyms], [*(t for t, k, _ in told if k == "code"), *codes]), sources

    def _matches(self, groups: list[retrieval.Group], role: str, index: retrieval.Index) -> DataFrame:
        fields = retrieval.ROLE_FIELDS[role]
        return retrieval.match(index.of([w for g in groups for w in g.words]), retrieval.compiled(self.spark, groups, fields), fields)

    def search(self, query: str, role: str = "any", limit: int | None = 20, facets: dict[str, tuple[str, ...]] | None = None, synonyms: Sequence[str] = (), codes: Sequence[str] = (), exclude: DataFrame | None = None, statuses: Sequence[str] = (), network_only: bool = False, analysed_only: bool = False) -> DataFrame:
        """Studies whose words stand together as the query's phrases do, or those of what the dictionary and the caller add, by score,
        with the terms each matched and where these are from; a blank query lists all. Without a limit all that match."""
        if role not in retrieval.ROLE_FIELDS or len(query) > 2000:
            raise EngineError("INVALID_INPUT", "role or query")
        version = self.store.last()
        studies = version.table("studies").withColumnRenamed("study_id", "id")
        if version.has("facts"):
            design = version.table("facts").where("item_kind = 'study_design'").groupBy(F.col("study_id").alias("id")).agg(F.min("value").alias("analysis_design"))
            studies = studies.join(design, "id", "left")
        analysed = None
        if analysed_only:
            analysed = version.table("facts").select(F.col("study_id").alias("id")).distinct() if version.has("facts") else studies.select("id").limit(0)
        request = retrieval.Request(facets=facets or {}, limit=limit, exclude=exclude, statuses=tuple(statuses), network_only=network_only, analysed=analysed)
        if not query.strip():
            none = F.array().cast("array<string>")
            return retrieval.search(studies.select("id", F.lit(0.0).alias("score"), none.alias("labels"), none.alias("label_sources")), studies, request)
        groups, sources = self._concept(query, synonyms, codes, version)
        index = increments.LiveIndex(version)
        found = retrieval.attribution(self._matches(groups, role, index))
        told = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv]) if sources else F.create_map().cast("map<string,string>")
        found = found.withColumn("label_sources", F.transform("labels", lambda t: expansion.term_source(t, F.try_element_at(told, t), F.lit(False))))
        return retrieval.search(retrieval.bm25(index, [w for g in groups for w in g.words]).join(found, "id"), studies, request)

    def concept_ids(self, query: str, role: str = "any", synonyms: Sequence[str] = (), codes: Sequence[str] = ()) -> DataFrame:
        """Ids of the studies that match the query's concept, before any filter."""
        version = self.store.last()
        groups, _ = self._concept(query, synonyms, codes, version)
        return self._matches(groups, role, increments.LiveIndex(version)).select("id").distinct()

    def analogous(self, query: str, terms: Sequence[str], role: str = "any", limit: int | None = 20, synonyms: Sequence[str] = (), codes: Sequence[str] = (), facets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
        """Studies that match terms like the query's concept, each as one phrase, and not the concept itself in any field."""
        groups = [retrieval.Group(t, tuple((T.python_canonical(t) or "").split())) for t in dict.fromkeys(terms) if (T.python_canonical(t) or "")]
        studies = self._table("studies").withColumnRenamed("study_id", "id")
        if not groups:
            none = F.array().cast("array<string>")
            return studies.where("false").select("id", F.lit(0.0).alias("score"), none.alias("labels"))
        own = self.concept_ids(query, "any", synonyms, codes)
        index = self.index
        found = retrieval.attribution(self._matches(groups, role, index))
        return retrieval.search(retrieval.bm25(index, [w for g in groups for w in g.words]).join(found, "id"), studies, retrieval.Request(exclude=own, limit=limit, facets=facets or {}))

    def enriched(self, found: DataFrame) -> DataFrame:
        """Results with what is known of each study: its analysis, what was observed of its document, and why it matched."""
        version, key = self.store.last(), F.col("study_id").alias("id")
        if version.has("facts"):
            data = version.table("facts").groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("item_kind") == "data_source", F.col("value")))).alias("data_sources"), F.lit(None).cast("string").alias("protocol_id"))
        else:
            data = self.spark.createDataFrame([], "id string, data_sources array<string>, protocol_id string")
        seen = version.table("observations") if version.has("observations") else self.spark.createDataFrame([], OBSERVATION)
        seen = seen.select(key, "protocol_found", "text_layer", F.col("exposures").alias("exposures_seen"))
        terms = found.select("id", F.col("labels").alias("terms"), F.map_from_arrays("labels", "label_sources").alias("sources"))
        rows = found.drop("labels", "label_sources").withColumnRenamed("exposures", "found_exposures")
        return retrieval.enriched(rows, data, seen, terms).withColumnRenamed("found_exposures", "exposures")

    def _kept(self, df: DataFrame) -> DataFrame:
        """df written to a work folder and read again, so that what is asked of it does not compute it again."""
        path = f"{self.root}/work/w-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self, now_ms: int, hours: float = 6) -> int:
        """Delete work folders and data that no version names, older than some hours at a given time."""
        return len(sinks.remove_stale(self.spark, f"{self.root}/work", "w-", now_ms, hours)) + self.store.vacuum(now_ms, hours=hours)

    def search_studies(self, query: str, limit: int = 5, terms: Sequence[str] = (), **options) -> dict:
        """A preview of a search with what to do next: results, total, state, facets and unknown counts, all of every match; where
        nothing is found, what stands in for the concept (the dictionary's terms, then the caller's) and why."""
        if not 1 <= limit <= 20:
            raise EngineError("INVALID_INPUT", "limit is 1 to 20")
        most, listed = self.settings.max_screening, self.settings.max_listed
        every = self._kept(self.search(query, limit=None, **options))
        best = [F.desc("score"), F.col("id").cast("string")]
        counts = retrieval.unknown_counts(every, ("countries", "data_source_types")).withColumn("status", retrieval.selection_status(F.col("total"), most)).first()
        ordered = every.orderBy(*best)
        out = {"query": query, **counts.asDict(), "results": self.enriched(ordered.limit(min(limit, most))).orderBy(*best), "facets": retrieval.facet_counts(every, ("countries", "data_source_types")), "conditions": retrieval.top_values(every, "conditions", listed), "candidates": ordered if counts.total <= listed else None}
        if not counts.total:
            out["fallback"] = self._fallback(query, terms, **options)
        return out

    def _fallback(self, query: str, terms: Sequence[str], role: str = "any", synonyms: Sequence[str] = (), codes: Sequence[str] = (), facets: dict[str, tuple[str, ...]] | None = None, **_) -> dict:
        """Why a search found nothing: filters took all studies of the concept, no term is known that stands in for it, or how many
        studies have one. Every count is of all studies."""
        before = self.concept_ids(query, role, synonyms, codes).count()
        known = [t for t, k, _ in self._expansion(query, self.store.last()) if k == "analogous"]
        first = {t.casefold(): t for t in reversed([*known, *terms])}
        asked = [t for t in first.values() if T.python_canonical(t)][::-1][: expansion.ANALOGOUS]
        near = self._kept(self.analogous(query, asked, role, None, synonyms, codes, facets))
        n = near.count()
        state = "concept_filtered_out" if before else "no_analogous_terms" if not asked else "available" if n else "no_matches"
        told = {r.t: r.n for r in near.select(F.explode("labels").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
        ordered = near.orderBy(F.desc("score"), F.col("id").cast("string"))
        return {"status": state, "before_filters": before, "total": n, "terms": {t: told.get(t, 0) for t in asked}, "candidates": ordered if n <= self.settings.max_listed else ordered.limit(self.settings.max_listed)}

    def compare(self, blocks: Sequence[retrieval.Block], request: retrieval.Request | None = None) -> DataFrame:
        """Candidates of a screening question, the most promising first."""
        studies = self._table("studies").withColumnRenamed("study_id", "id")
        found = retrieval.screened(self.index, studies, blocks, request or retrieval.Request())
        survey = T.folded(F.col("title")).contains("survey")
        fit = retrieval.type_fit(F.size("data_source_types") > 0, survey)
        none = F.lit(None)
        key = retrieval.order_key(none.cast("boolean"), none.cast("boolean"), none.cast("string"), F.col("protocol_listed"), F.col("specific_blocks"), F.col("role_blocks"), fit, F.col("fused"), F.col("id"))
        return found.orderBy(*key)

    def facets(self, names: Sequence[str] = ("countries", "data_source_types")) -> DataFrame:
        return retrieval.facet_counts(self._table("studies"), names)

    def add_documents(self, docs: DataFrame) -> None:
        """Store documents (doc_id, text) as sections; those there before are replaced."""
        new = sections.sections(pages.paged(docs))
        self.store.transact(lambda change: change.upsert("sections", new, "doc_id"))

    def outline(self, offset: int = 0, limit: int = 20) -> DataFrame:
        return sections.paged_outline(self._table("sections").where("section <> ''").select("doc_id", "section_id", "page", "section"), F.col("section_id"), offset, limit)

    def search_text(self, terms: Sequence[str], k: int = 10) -> DataFrame:
        few = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return sections.top_sections(sections.section_scores(self._table("sections"), few), k)

    def check_evidence(self, quotes: DataFrame) -> DataFrame:
        """quote_id, code of quotes (quote_id, doc_id, page, section, quote) that the stored sections do not support."""
        return evidence.evidence_errors(quotes, self._table("sections"))

    def register_functions(self) -> None:
        """SQL functions over whole Unicode: canonical(text), ingredient_set(text), names_it(quote, name), heading_role(line); and the
        table function document_sections(text), whose pages form feeds divide."""
        self.spark.udf.register("canonical", T.full_canonical)
        self.spark.udf.register("ingredient_set", medicines.ingredient_set)
        self.spark.udf.register("names_it", evidence.names_it)
        self.spark.udf.register("heading_role", heading_roles)
        self.spark.udtf.register("document_sections", F.udtf(DocumentSections, returnType="section_id string, page int, section string, role string, text string"))


@F.pandas_udf(S.StringType())
def heading_roles(lines: pd.Series) -> pd.Series:
    return lines.map(sections.heading_role)


class DocumentSections:
    """Sections of one text as rows."""

    def eval(self, text: str):
        for c in sections.chunked([(k + 1, t) for k, t in enumerate((text or "").split("\f"))]):
            yield c["section_id"], c["page"], c["section"], c["role"], c["text"]
