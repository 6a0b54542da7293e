"""The engine: counts over all matches, its log, what leaves the scope, history, readings, dictionary terms and fallbacks."""

from datetime import datetime, timezone

import pytest

from attestry.engine import OBSERVATION, Engine
from attestry.errors import EngineError

HEAD = "Study ID,Title,Study type,Study countries,Conditions,Medicinal product name\n"
SCOPE = "Non-interventional study"
FACTS = "study_id string, item_kind string, value string"


def write(path, rows):
    path.write_text(HEAD + "".join(f"{i},{t},{k},{c},{m},{e}\n" for i, t, k, c, m, e in rows), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    rows = [(k, f"Bleeding in cohort {k}", SCOPE, "España|UK" if k == 7 else "Spain", "bleeding", "") for k in range(1500)]
    rows += [(2000, "Thrombosis of veins", SCOPE, "South Korea", "thrombosis", ""), (2001, "Embolism", SCOPE, "France", "embolism", "")]
    own = Engine(spark, str(root / "db"))
    own.import_catalogue(write(root / "20240101_full.csv", rows), at=datetime(2024, 1, 2, tzinfo=timezone.utc))
    concepts = [("c1", "clotting", "input_terms", "d.json"), ("c1", "thrombosis", "english_terms", "d.json"), ("c2", "rupture", "input_terms", "d.json"), ("c2", "embolism", "analogous_terms", "d.json")]
    own.import_concepts(spark.createDataFrame(concepts, "concept_id string, term string, kind string, source_file string"), spark.createDataFrame([], "concept_id string, system string, code string, source_file string"))
    return own


def test_every_match_counts(engine):
    found = engine.search_studies("bleeding")
    assert (found["total"], found["status"], found["unknown_countries"]) == (1500, "needs_narrowing", 0) and found["candidates"] is None
    facets = {(r.facet, r.value): r.n for r in found["facets"].collect()}
    assert facets["countries", "Spain"] == 1499 and {r.value: r.n for r in found["conditions"].collect()} == {"bleeding": 1500}
    rows = found["results"].collect()
    assert len(rows) == 5 and rows[0].match_basis == "concept" and rows[0].matched_terms == ["bleeding"] and rows[0].sources == {"bleeding": "query"}


def test_countries_under_their_other_names(engine):
    assert engine.search("", facets={"countries": ("韓国",)}).count() == 1 and engine.search("bleeding", facets={"countries": ("great britain",)}).first().id == "7"


def test_dictionary_terms_and_fallbacks(engine):
    row = engine.search_studies("clotting")["results"].first()
    assert row.id == "2000" and row.sources == {"thrombosis": "dictionary:d.json"}
    told = engine.search_studies("rupture", terms=["thrombosis", "nothing"])["fallback"]
    assert (told["status"], told["before_filters"], told["total"], told["terms"]) == ("available", 0, 2, {"embolism": 1, "thrombosis": 1, "nothing": 0})
    gone = engine.search_studies("bleeding", facets={"countries": ("France",)})["fallback"]
    assert (gone["status"], gone["before_filters"]) == ("concept_filtered_out", 1500)
    assert engine.search_studies("unheard")["fallback"]["status"] == "no_analogous_terms"


def test_log_scope_history_and_readings(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "db"))
    first = [(1, "Alpha", SCOPE, "", "", ""), (2, "Beta", SCOPE, "", "", "Steron")]
    path = write(tmp_path / "20240101_claims_export.csv", first)
    told = own.import_catalogue(path, at=datetime(2024, 1, 2, tzinfo=timezone.utc))
    assert own.import_catalogue(path, at=datetime(2024, 1, 3, tzinfo=timezone.utc))["version"] == told["version"] + 1
    log = own._table("imports").collect()
    assert [(r.kind, r.studies, r.imported_at.day) for r in log] == [("claims", 2, 3)]
    facts = lambda *rows: spark.createDataFrame(list(rows), FACTS)
    own.save_readings(spark.createDataFrame([("p1", "1", "r1")], "protocol_id string, study_id string, reading string"))
    reading = lambda r: spark.createDataFrame([("p1", r)], "protocol_id string, reading string")
    own.save_analyses(facts(("1", "outcome", "falls"), ("2", "outcome", "pain")), reading("r1"))
    with pytest.raises(EngineError, match="READING_CONTEXT_CHANGED"):
        own.save_analyses(facts(("1", "outcome", "else")), reading("r2"))
    own.save_analyses(facts(("1", "outcome", "fractures")))
    own.save_analyses(facts(("1", "outcome", "fractures")))
    assert own._table("history").count() == 1 and [r.id for r in own.search("fractures").collect()] == ["1"] and own.search("falls").count() == 0
    own.observe(spark.createDataFrame([("2", True, "full", [("Steron", ["H02AB"], "catalogue_text"), ("Otheron", [], "protocol_pass_table")])], OBSERVATION))
    assert [r.id for r in own.search("otheron").collect()] == ["2"] and own.search("H02AB").count() == 0  # the catalogue lists a medicine itself
    own.import_catalogue(write(tmp_path / "20240201_full.csv", [(1, "Alpha", "Clinical trial", "", "", "")]))
    assert [r.study_id for r in own._table("studies").collect()] == ["2"] and {r.study_id for r in own._table("facts").collect()} == {"2"}
    assert own._table("history").count() == 2 and own.search("fractures").count() == 0 and own._table("observations").count() == 1
    assert {(r.kind, r.state) for r in own.catalogue_status(datetime(2024, 1, 10)).collect()} >= {("claims", "current")}
    assert own.tidy(now_ms=1 << 45) > 0 and own.search("pain").first().id == "2"


def test_a_newer_bundle_replaces_whole_tables(spark, tmp_path):
    own, bundle = Engine(spark, str(tmp_path / "own")), Engine(spark, str(tmp_path / "bundle"))
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    own.import_catalogue(write(tmp_path / "a.csv", [(1, "Alpha", SCOPE, "", "", ""), (2, "Beta", SCOPE, "", "", "")]), at=day(5))
    bundle.import_catalogue(write(tmp_path / "b.csv", [(2, "Beta revised", SCOPE, "", "", ""), (3, "Gamma", SCOPE, "", "", "")]), at=day(4))
    assert not own.refresh(bundle) and own.search("alpha").count() == 1
    bundle.import_catalogue(write(tmp_path / "c.csv", [(3, "Gamma ray", SCOPE, "", "", "")]), at=day(6))
    assert own.refresh(bundle) and own.search("alpha").count() == 0
    assert [r.id for r in own.search("revised").collect()] == ["2"] and [r.id for r in own.search("ray").collect()] == ["3"]
