"""Stores, guards, streams, registered functions and the engine on small input."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attestry.engine import Engine
from attestry.errors import EngineError
from attestry.operators import retrieval as R
from attestry.operators import service as V
from attestry.sources import catalogue as C
from attestry.sources import pages as P
from attestry.sources import sinks as K
from attestry.streaming import incremental as I

HEAD = "Study ID,Official title and acronym,Study type,Study countries,Data source types,Conditions,Outcomes,Medicinal product name,Anatomical Therapeutic Chemical (ATC) code,Main study objective,Protocol URL,Contact\n"
ROWS = (
    '1,Bone loss after steroids,Non-interventional study,USA,claims,Bone loss,fractures,Steron,(H02AB) STEROIDS,to count,http://x,secret person\n'
    '2,Survey of hearts,Non-interventional study,France|Spain,,Heart failure,death,,,,,\n3,"Steroids, twice",Non-interventional study,France,,Bone loss,pain after steroids,Steron|Other,,,,\n4,Trial,Clinical trial,,,,,,,,,\n'
)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    (root / "full.csv").write_text(HEAD + ROWS, encoding="utf-8")
    own = Engine(spark, str(root / "db"))
    own.import_catalogue(str(root / "full.csv"))
    own.save_analyses(spark.createDataFrame([("2", "outcome", "hospital admission for bone fracture"), ("2", "study_design", "cohort")], "study_id string, item_kind string, value string"))
    return own


def test_import_fills_all_columns(engine):
    row = engine._table("studies").where("study_id = '1'").first()
    assert (row.countries, row.conditions, row.exposures, row.protocol_listed) == (["USA"], ["Bone loss"], ["Steron", "(H02AB) STEROIDS"], True)
    assert "secret" not in row.search_text and row.objective == "to count" and engine._table("studies").count() == 3


def test_search_by_role_and_analysis(engine):
    assert [r.id for r in engine.search("bone fracture", role="outcome").collect()] == ["2"]
    assert {r.id for r in engine.search("steroids").collect()} == {"1", "3"} and engine.search("steroids", facets={"countries": ("France",)}).first().id == "3"
    assert engine.search("steroids").first().labels == ["steroids"] and engine.search(" ").count() == 3
    with pytest.raises(EngineError):
        engine.search("x", role="nope")


def test_search_service(engine):
    found = engine.search_studies("steroids")
    assert (found["total"], found["status"], found["unknown_data_source_types"]) == (2, "ready", 1) and {r.value for r in found["conditions"].collect()} == {"bone loss"}
    none = engine.search_studies("liver", terms=["heart failure"])
    assert none["status"] == "no_matches" and none["fallback"]["status"] == "available" and none["fallback"]["candidates"].first().id == "2"
    assert engine.search_studies("liver")["fallback"]["status"] == "no_analogous_terms" and engine.search_studies("liver", terms=["nothing"])["fallback"]["status"] == "no_matches"
    assert engine.search_studies("steroids", facets={"countries": ("Spain",)})["fallback"]["status"] == "concept_filtered_out"


def test_screening(engine):
    rows = engine.compare([R.Block(("bone loss",), role="condition"), R.Block(("steron", "steroids"), ("death",))]).collect()
    assert [r.id for r in rows] == ["1", "3"] and rows[0].specific_blocks == 2 and rows[0].role_blocks == 2
    with pytest.raises(EngineError):
        engine.compare([R.Block((" ",))])


def test_guards(spark, tmp_path):
    (tmp_path / "source_type").mkdir()
    (tmp_path / "source_type" / "x.csv").write_text("a")
    (tmp_path / "20240101_ehr.csv").write_text("a")
    (tmp_path / "none.csv").write_text("")
    folders = [str(tmp_path / "source_type"), str(tmp_path)]
    assert C.guarded(spark, "20240101_ehr.csv", folders) == (f"{tmp_path}/20240101_ehr.csv", "ehr")
    for name, code in (("../x.csv", "INVALID_INPUT"), ("x.txt", "INVALID_INPUT"), ("x.csv", "INVALID_INPUT"), ("none.csv", "CSV_SCHEMA_ERROR"), ("gone.csv", "CSV_NOT_FOUND")):
        with pytest.raises(EngineError, match=code):
            C.guarded(spark, name, folders)
    (tmp_path / "bad.csv").write_bytes(b"Study ID,Study title,Study type\n1,caf\xe9,Non-interventional\n")
    with pytest.raises(EngineError, match="CSV_SCHEMA_ERROR"):
        C.read_catalogue(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize(("sample", "want"), [("a;b;c\n1,5;2;3", ";"), ("a\tb\n1\t2", "\t"), ('"a;b",c\n1,2', ","), ("one", ","), ("", ",")])
def test_delimiters(sample, want):
    assert C.sniffed_delimiter(sample) == want


def test_tables_survive_a_crash_between_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    K.replace_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.before")
    K.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    K.replace_table(spark.range(5).repartition(4), path)
    before, after = K.compact(spark, path)
    assert after <= before and spark.read.parquet(path).count() == 5 and not (tmp_path / "t.before").exists()


def test_equal_rows_do_not_cancel_in_a_manifest(spark):
    of = lambda x: K.manifest({"t": spark.createDataFrame([(v,) for v in x], "v int")}).first().hash
    assert of([1, 1, 2]) != of([3, 3, 2]) and of([1, 2]) == of([2, 1])


def test_pages_of_facts_and_comparisons(spark, tmp_path):
    facts = [Row(study_id="1", item_kind="outcome", value="<b>x", evidence=[Row(page=2, quote="a & b")]), Row(study_id="1", item_kind="exposure", value="y", evidence=[])]
    page = K.facts_page(facts)
    assert "&lt;b&gt;x" in page and "p. 2: a &amp; b" in page and page.count("<h2>") == 1 and page.count("<h3>") == 2
    text = V.comparison_markdown("T", ["attribute", "1"], [["design", "cohort"]])
    K.write_comparison(spark.createDataFrame([("1", "complete")], "study string, status string"), text, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c/table"), wholetext=True).first().value.startswith("# T") and (tmp_path / "c/rows/study=1").exists()


def test_archive(spark):
    files = spark.createDataFrame([("1", bytearray(b"pdf"), 5), ("1", bytearray(b"pdf"), 3), ("1", bytearray(b"other"), 4)], "study_id string, content binary, archived_at long")
    own = K.archived(files)
    assert own.count() == 2
    row = own.where("length = 3").first()
    assert row.archived_at == 3 and K.loaded(own, row.protocol_id).count() == 1 and K.loaded(own, "pdf_1_00").count() == 0


def test_prepared_comparisons(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "study_id string")
    sources = spark.createDataFrame([("1", "f", None), ("2", None, "PROTOCOL_NOT_FOUND")], "study_id string, fingerprint string, error string")
    assert {r.study_id: r.status for r in V.prepared(rows, sources, 5).collect()} == {"1": "needs_processing", "2": "error", "3": "pending"}
    for n in (0, 2):
        with pytest.raises(EngineError):
            V.prepared(rows.limit(n) if n == 0 else rows, sources, 2)


def test_arguments_and_states():
    assert V.pair_argument("A:B:C") == ("A:B", "C") and V.update_state({"last_success": 1, "x": 2}, {"result": "same"}) == {"last_success": 1, "result": "same"}
    with pytest.raises(EngineError):
        V.pair_argument("nothing")
    assert V.cache_key(["a", 1]) == V.cache_key(["a", 1]) != V.cache_key(["a", 2])


def test_served_items(spark):
    items = spark.createDataFrame([(1, 1, 2, "age 18"), (2, 1, 2, "nowhere")], "item_id long, doc_id long, page int, pattern string")
    pages = spark.createDataFrame([(1, 2, "with age 18 or more")], "doc_id long, page int, text string")
    chunks = spark.createDataFrame([(1, 2, "s0001", True, "population", "with age 18 or more"), (1, 2, "s0002", True, "references", "else")], "doc_id long, page int, section_id string, relevant boolean, role string, text string")
    assert [tuple(r) for r in V.served_check(items, pages, chunks, ("references",)).orderBy("item_id").collect()] == [(1, True, True, True, True), (2, False, False, False, False)]


def test_registered_functions(spark, engine):
    engine.register_functions()
    row = spark.sql("SELECT canonical('Ｆull™ Width') AS c, ingredient_set('b (x, y) + a') AS i, names_it('the Blue List', 'blue list') AS n, heading_role('3 Outcomes') AS r").first()
    assert (row.c, row.i, row.n, row.r) == ("full width", ["a", "b x y"], True, "definitions")
    got = spark.sql("SELECT section, role FROM document_sections('1 STUDY DESIGN\nx')").collect()
    assert [(r.section, r.role) for r in got] == [("1 STUDY DESIGN", "methods")]


def test_streams_of_states(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "event_type", "ts", F.when(F.col("event_type") == "error", "rate_limit").otherwise("ok").alias("outcome"))
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = I.read_stream(spark, str(tmp_path / "in"), ev.schema, 10)
    newest = {tuple(r) for r in I.run_to_memory(I.newest_times(stream, "event_type", "ts"), "newest").collect()}
    assert newest == {tuple(r) for r in I.newest_times(ev, "event_type", "ts").collect()}
    from attestry.operators import state

    got = I.run_to_memory(I.backoff_stream(stream, "user_id", "event_id"), "states", "update").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in state.backoff(ev, "user_id", "event_id").collect()}
    once = I.run_to_memory(I.imported_once(stream.withColumn("checksum", F.col("user_id")).withColumn("kind", F.col("event_type")), "ts", late="400 days"), "once", "append")
    assert once.count() == ev.select("user_id", "event_type").distinct().count()


def test_settings():
    from attestry.settings import Settings

    assert Settings().max_screening == 5
    for bad in ({"max_listed": 0}, {"max_comparison": 1001}, {"catalogue_ttl": -1}):
        with pytest.raises(EngineError):
            Settings(**bad)


def test_stale_work_goes(spark, tmp_path):
    for name in ("work-a", "work-b", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_text("x")
    now = int((tmp_path / "work-a" / "f").stat().st_mtime * 1000)
    assert K.remove_stale(spark, str(tmp_path), "work-", now + 3_600_000) == [] and K.remove_stale(spark, str(tmp_path), "work-", now + 7 * 3_600_000) == ["work-a", "work-b"]
    assert (tmp_path / "other").exists()


def test_dictionaries(spark, tmp_path):
    import json

    concept = {"concept_id": "c1", "input_terms": ["heart"], "english_terms": ["cardiac"], "related_terms": [], "code_candidates": [{"system": "ICD-10", "code": "I50", "vocabulary_version": None, "relation": None}], "analogous_terms": [{"term": "vessel", "relation": "broader"}]}
    (tmp_path / "a.json").write_text(json.dumps([concept]))
    assert {(r.term, r.kind, r.source_file) for r in P.concepts(spark, str(tmp_path / "a.json")).collect()} >= {("heart", "input_terms", "a.json"), ("cardiac", "english_terms", "a.json")}
    raw = {"data": [{"category": "Human", "name_of_medicine": " Alpha ", "international_non_proprietary_name_common_name": "tin; zinc", "atc_code_human": "A01AA01", "medicine_url": "u"}, {"category": "Veterinary", "name_of_medicine": "B", "international_non_proprietary_name_common_name": "x", "atc_code_human": "", "medicine_url": "u"}]}
    assert [tuple(r) for r in P.medicines(spark.createDataFrame([(json.dumps(raw),)], "value string")).collect()] == [("Alpha", ["tin", "zinc"], "A01AA01")]


def test_exports_of_a_snapshot():
    names = [f"20240101_{k}_export.csv" for k in ("claims", "ehr", "registry")] + ["20240101_all.csv"]
    assert C.snapshot_exports(names)["studies"] == "20240101_all.csv" and set(C.snapshot_exports(names)) == {"studies", *C.KINDS}
    for bad in (names[:3], [*names, "20240101_more.csv"], [*names[:3], "20240102_all.csv"], [*names[:3], "all.csv"]):
        with pytest.raises(EngineError):
            C.snapshot_exports(bad)
