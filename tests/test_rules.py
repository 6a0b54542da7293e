"""Rules of single operators on hand-made input."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.errors import EngineError
from attestry.functions import text as T
from attestry.operators import evidence as E
from attestry.operators import expansion as X
from attestry.operators import medicines as N
from attestry.operators import merging as M
from attestry.operators import mining as G
from attestry.operators import retrieval as R
from attestry.operators import sections as D
from attestry.operators import state
from attestry.sources import catalogue as C
from attestry.sources import pages as P
from attestry.sources import sinks
from attestry.sources.versions import Store
from attestry.streaming import incremental as I


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_distances():
    words = tuple("abcdef")
    assert [R.Group("g", words[:n]).distance for n in (2, 5, 6)] == [3, 4, 5]
    assert R.Group("g", words[:2], 7).distance == 7 and R.Group("g", words[:2], 1).distance == 3


def test_near_against_brute_force(spark):
    import random

    r = random.Random(2)
    docs = [(k, " ".join(r.choice("abcdxyz") for _ in range(30))) for k in range(60)]
    group = R.Group("abc", ("a", "b", "c"), 4)
    index = R.postings(spark.createDataFrame(docs, "id long, text string"), {"title": "text"})
    got = {x.id for x in R.match(index, R.compiled(spark, [group])).collect()}
    want = {k for k, t in docs if any({"a", "b", "c"} <= set(t.split()[i : i + group.distance + 2]) and t.split()[i] in "abc" for i in range(30))}
    assert got == want and 0 < len(got) < 60


def test_an_index_for_some_terms(spark):
    docs = spark.createDataFrame([(1, "a b", "b c b"), (2, "", ""), (3, None, "c d"), (4, "e", None), (5, "a", "e e")], "id long, title string, text string")
    fields = {"title": "title", "definitions": "text"}
    index, order = R.index_for(docs, fields, ["b", "e", "b", "none"]), ["id", "dl", "field", "pos", "term"]
    want = R.postings(docs, fields).where("term in ('b', 'e')")
    assert sorted(map(tuple, index.rows.select(*order).collect())) == sorted(map(tuple, want.select(*order).collect()))
    assert index.total.first() == R.totals(docs, fields).first()


@pytest.mark.parametrize("name", ["near_match", "bm25_rank", "matched_terms", "search_filtered", "analogous_only", "screening", "search_enriched", "rrf_fusion", "screened_order"])
def test_a_query_for_some_terms_stores_no_index(spark, monkeypatch, name):
    from attestry.plans import common, retrieval

    def written(*_, **__):
        raise AssertionError("an index of all terms was written")

    dir_ = "/root/testdata/sf0.001"
    common.stored_index(spark, dir_)
    want = sorted(map(str, retrieval.QUERIES[name](spark, dir_).collect()))
    monkeypatch.setattr(common, "_STORED", {})
    monkeypatch.setattr(R, "write_index", written)
    assert sorted(map(str, retrieval.QUERIES[name](spark, dir_).collect())) == want


def test_grams_of_shared_words_only(spark, monkeypatch):
    import random

    r = random.Random(4)
    monkeypatch.setattr(G, "LEAST_SHARE", 0.2)
    common, rare = [f"w{k}" for k in range(12)], [f"x{k}" for k in range(400)]
    docs = [(k, 1 if k % 3 == 0 else None, None, [r.choice(common[:8] if k % 3 else common[4:]) if r.random() < 0.6 else r.choice(rare) for _ in range(25)]) for k in range(90)]
    df = spark.createDataFrame(docs, "id long, _a int, _k int, w array<string>")
    anchors = df.where("_a = 1")
    only = G.shared_words(anchors, "w", anchors.count())
    assert set(only) == {w for w in common + rare if sum(w in d[3] for d in docs if d[1]) >= 6} and 0 < len(only) < 20
    every, some = (G.ngrams(df, "w", (), keep=("_a", "_k"), only=o) for o in (None, only))
    found = [[tuple(x) for x in G.mined(g, anchors, total=90, least_odds=0.1).collect()] for g in (every, some)]
    assert found[0] == found[1] and any(" " in x[0] for x in found[0]) and some.count() < every.count() / 2
    assert G.shared_words(anchors.limit(0), "w", 0) == [] and G.ngrams(df, "w", (), keep=("_a", "_k"), only=[]).count() == 0


def test_unknown_field(spark):
    with pytest.raises(EngineError):
        R.compiled(spark, [R.Group("a", ("a",))], ("nope",))


def test_order_key_with_nulls(spark):
    rows = [("a", None, None, None, 1, 0.2), ("b", False, None, True, 9, 0.9), ("c", None, None, False, 1, 0.9), ("d", None, True, False, 1, 0.1), ("e", True, True, True, 2, 0.1)]
    df = spark.createDataFrame(rows, "id string, available boolean, found boolean, listed boolean, specific int, fused double")
    key = R.order_key(F.col("available"), F.col("found"), F.lit(None).cast("string"), F.col("listed"), F.col("specific"), F.col("specific") * 0, F.col("specific") * 0, F.col("fused"), F.col("id"))
    assert [x.id for x in df.orderBy(*key).collect()] == ["e", "a", "d", "c", "b"]


@pytest.mark.parametrize(("text", "want"), [("x_20240503-v2", "2024-05-03"), ("dated 03/05/2024.", "2024-05-03"), ("2024.13.40 then 20240102", "2024-01-02"), ("1999-01-01", None), ("2024-99-01", None)])
def test_dates(spark, text, want):
    assert one(spark, text, T.parse_date) == want


@pytest.mark.parametrize(("system", "code", "want"), [("ICD-10", "k358", ["K358", "K35.8"]), ("ICD-10-CM", "T81.4XXA", ["T81.4XXA", "T814XXA"]), ("icd10", "K35", ["K35"]), ("ICD-10", "not one", ["NOT ONE"]), ("ICD-9-CM", "041.9", ["041.9", "0419"]), ("ATC", "C07AB03", ["C07AB03"]), ("ICD-9", "E8199", ["E8199", "E819.9"])])
def test_code_variants(spark, system, code, want):
    row = spark.createDataFrame([(system, code)], "s string, c string").select(T.code_variants(F.col("s"), F.col("c")).alias("v")).first()
    assert row.v == want


@pytest.mark.parametrize(("text", "want"), [("III.2 Data flow", [3, 2]), ("3.2 Data flow", [3, 2]), ("VII. Results", [7]), ("0.5 mg", []), ("I think so", [1]), ("31.1 x", [])])
def test_section_numbers(spark, text, want):
    assert one(spark, text, T.section_number) == want
    assert list(D.section_number(text)) == want


def test_mentions_and_states(spark):
    df = spark.createDataFrame([("two bleeding events", "event"), ("the glass", "glas"), ("aged 2018", "18"), ("age ≥18", "18"), ("code K35.80", "K35.8")], "t string, q string")
    got = [tuple(r) for r in df.select(T.mentions(T.canonical(F.col("t")), T.canonical(F.col("q"))), T.states(F.col("t"), F.col("q"))).collect()]
    assert [g[0] for g in got[:2]] == [True, False]
    assert [g[1] for g in got[2:]] == [False, True, True]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB -\n\t\u00ad\u00a0ßΣςİ.", max_size=40))
def test_places_of_normal_forms(text):
    """Signs of the normal form come from places in order, and what stands between two of them has that normal form again."""
    flat, origin = E.origins(text)
    assert len(flat) == len(origin) and list(origin) == sorted(origin)
    for start in range(len(flat)):
        if flat[start] != " " and flat[start - 1 : start] != "s":
            cut = E.origins(text[origin[start] : origin[-1] + 1])[0]
            assert cut == flat[start:] or "İ" in text


def test_places_agree_with_columns(spark):
    texts = ["", " - ", "A -\n b\u00ad c", "x\u00a0\u2003y-\u3000z", "ΟΔΟΣ ΣΑΣ µ ſ STRAẞE İx", "\u00ad \u00ad-a -\u00ad b", "ﬁne \x1c end", "pre- \u00ad fix", None, "a" * 300_000 + " B"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.normalize_quote(F.col("t")).alias("n")).collect()
    assert {r.k: r.n for r in rows} == {k: None if t is None else E.origins(t)[0] for k, t in enumerate(texts)}


def test_forms_of_every_sign(spark):
    """canonical is full_canonical for every sign of two planes, but those that stand for several, newer ones and Cherokee."""
    signs = [chr(k) for r in (range(1, 0xD800), range(0xE000, 0x10000), range(0x1D400, 0x1D800)) for k in r]
    rows = spark.createDataFrame([(x,) for x in signs], "x string").select("x", T.canonical(F.concat(F.lit("a "), "x", F.lit(" b"))).alias("n")).collect()
    known = [r for r in rows if unicodedata.category(r.x) != "Cn" and unicodedata.ucd_3_2_0.category(r.x) != "Cn"]
    wrong = [r.x for r in known if r.n != T.python_canonical(f"a {r.x} b") and (len(unicodedata.normalize("NFKC", r.x).casefold()) == 1)]
    assert len(known) > 45_000 and [x for x in wrong if not "Ꭰ" <= x <= "Ᏼ"] == []


def test_forms_of_texts(spark):
    texts = ["ＩＣＤ－１０", "ﬁnal ﬀ", "ΟΔΟΣ", "ｱ ｶ", "𝐀𝟏", "x² ª µg", "Brand™x℠", "STRAẞE ß", "Ǆ_é"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.canonical(F.col("x")).alias("n"), T.tokens(F.col("x")).alias("t")).collect()
    assert {r.x: r.n for r in rows if r.x != "Ǆ_é"} == {x: T.python_canonical(x) for x in texts if x != "Ǆ_é"}
    marks = spark.createDataFrame([("e\u0301te\u0301 Tiếng ữ",)], "x string").select(T.tokens(F.col("x")).alias("t")).first().t
    assert marks == ["ete", "tieng", "u"]


def test_restoration_after_a_move(spark):
    page, quote = "Intro words; then \u201cThe  Quoted\n pas\u00adsage-\n Straße\u201d here", "the quoted passage-STRASSE"
    df = spark.createDataFrame([(page, quote)], "p string, q string")
    start, _, sha, size = E.quote_position(T.normalize_quote(F.col("p")), T.normalize_quote(F.col("q")))
    of = lambda p, n=size: E.restored(p, start, sha, n)
    row = df.select(of(F.col("p")).alias("a"), of(F.concat(F.lit("more "), F.col("p"))).alias("b"), of(F.lit("nothing")).alias("c"), of(F.lit(None).cast("string")).alias("d"), of(F.col("p"), F.lit(0)).alias("e")).first()
    printed = "The Quoted pas\u00adsage- Straße"
    assert tuple(row) == (printed, printed, None, None, None)


def test_first_place_of_a_moved_quote():
    """An earlier place inside words counts, as do quotes that begin and end inside words."""
    text = "xbone yard bone yard y"
    sha = E.digest("bone yard")
    assert E.place(text, 3, sha, 9) == 1 and E.place(text, None, E.digest("one ya"), 6) == 2
    assert E.place(text, 11, sha, 9) == 11 and E.place(text, 0, sha, 0) is None and E.place(text, 0, E.digest("zone"), 4) is None and E.place("ab", 0, sha, 9) is None


@pytest.mark.parametrize(
    ("text", "name", "want"),
    [
        ("the Danish | x | National Registry", "Danish National Registry", "Danish | x | National Registry"), ("ships data", "hip", None), ("Northern register; National list", "Northern National", None), ("anything", "()", None), ("North-Sea list", "north sea", "North-Sea"),
        ("North. Sea", "north sea", "North. Sea"), ("North x. Sea", "north sea", None), ("North a b c Sea", "north sea", "North a b c Sea"), ("North a b c d Sea", "north sea", None), ("North North Sea", "north sea", "North Sea"),
    ],
)
def test_name_spans(text, name, want):
    span = E.name_span(text, name)
    assert (text[span[0] : span[1]] if span else None) == want


def evidence(page, quote, section=None, server=None):
    return {"page": page, "section": section, "quote": quote, "server": server}


def test_quotes_are_repaired_or_dropped():
    pages = {1: "2 METHODS\nthe cohort enters in May", 2: "3 DATA\nThe Blue Registry holds claims. It is used here for all", 3: "REFERENCES\nthe Blue Registry of old times"}
    chunks = [(1, "2 METHODS", "methods", pages[1]), (2, "3 DATA", "data_sources", pages[2]), (3, "REFERENCES", "references", pages[3])]
    own = E.Document(pages, chunks)
    assert own.repaired("outcome", "x", [evidence(1, "the cohort enters", "wrong", "page")]) == ([evidence(1, "the cohort enters", "2 METHODS")], 0)
    assert own.repaired("outcome", "x", [evidence(2, "the cohort enters")])[0] == [evidence(1, "the cohort enters", None, "page")]
    assert own.repaired("outcome", "x", [evidence(3, "of old times")]) == ([], 1) and own.repaired("key_note", "x", [evidence(3, "of old times")])[1] == 0
    assert own.repaired("outcome", "x", [evidence(1, "nowhere at all"), evidence(1, "in May")])[1] == 2
    good, dropped = own.repaired("data_source", "Blue Registry", [evidence(2, "It is used here for all")])
    assert dropped == 0 and [e["server"] for e in good] == [None, "source_name"] and "Blue Registry" in good[1]["quote"]


def test_pruned_facts(spark):
    pages = spark.createDataFrame([(1, 1, "2 METHODS\nthe cohort enters in May"), (1, 2, "other words on this page")], "doc_id long, page int, text string")
    chunks = spark.createDataFrame([(1, 1, "2 METHODS", "methods", "2 METHODS\nthe cohort enters in May"), (1, 2, None, "unknown", "other words on this page")], "doc_id long, page int, section string, role string, text string")
    ev = "array<struct<page:long,section:string,quote:string,server:string>>"
    facts = spark.createDataFrame([(5, 1, "outcome", "v", [(2, None, "the cohort enters", None), (1, None, "never written", None)]), (6, 1, "outcome", "w", [(1, None, "never written", None)])], f"fact_id long, doc_id long, kind string, value string, evidence {ev}")
    got = {r.fact_id: (r.dropped, [(e.page, e.server) for e in r.evidence]) for r in E.pruned(facts, chunks, pages).collect()}
    assert got == {5: (1, [(1, "page")])}


def test_naming_quotes_by_hand(spark):
    shape = "fact_id long, doc_id long, value string, evidence array<struct<page:long,quote:string>>"
    facts = spark.createDataFrame([(1, 1, "Blue Registry", [(3, "it is linked to claims")]), (2, 1, "Blue Registry", [(2, "the Blue Registry is")]), (3, 1, "Green List", [(3, "no such name")])], shape)
    text = {1: "Blue Registry in the references", 2: "we use the Blue  Registry of claims", 5: "Blue Registry again"}
    chunks = spark.createDataFrame([(1, p, f"s{p:04d}", "references" if p == 1 else "methods", t) for p, t in text.items()], "doc_id long, page long, section_id string, role string, text string")
    assert [tuple(r) for r in E.naming_quotes(facts, chunks).collect()] == [(1, 2, "we use the Blue Registry of claims")]


def test_audit(spark):
    ev = "array<struct<page:long,quote:string>>"
    facts = spark.createDataFrame([(1, "data_source", "Blue Registry", [(1, "Blue Registry")]), (1, "exposure", "Tinacid 20 mg for 3 days", [(1, "tinacid daily for 3 days")])], f"doc_id long, kind string, value string, evidence {ev}")
    pages = spark.createDataFrame([(1, 1, "primary outcome: CCI"), (1, 2, "CCI only")], "doc_id long, page int, text string")
    listed = spark.createDataFrame([(1, "blue registry"), (1, "Green List")], "doc_id long, source string")
    assert sorted(r.note for r in E.audit_notes(facts, pages, listed).collect()) == ["listed sources not extracted: Green List", "removed passages near outcomes on pages 1", "terms of exposure without a quote: 20 mg"]


def test_greedy_batches_and_budget(spark):
    df = spark.createDataFrame([([(40,), (40,), (200,), (10,)],)], "x array<struct<n:int>>")
    row = df.select(state.greedy_batches(F.col("x"), "n", 100).alias("b"), state.fitted(F.col("x"), "n", 60).alias("k")).first()
    assert row.b == [0, 0, 1, 2] and row.k == [True, False, False, True]


def test_round_robin_is_a_queue(spark):
    rows = [(1, b, b * 100 + k) for b in range(2) for k in range(18)]
    got = [r.o for r in M.round_robin(spark.createDataFrame(rows, "g int, b int, o int"), "g", "b", "o", 20).orderBy("o").collect()]
    assert got == list(range(10)) + list(range(100, 110))


def test_suitability_order(spark):
    values = [(True, True, False, True, True, True, True), (True, True, False, False, True, True, True), (True, True, False, False, False, True, True), (True, True, True, True, True, True, True), (True, False, True, True, True, True, True), (True, True, False, False, False, False, True), (False, False, True, True, True, True, True), (True, True, False, False, False, False, False)]
    df = spark.createDataFrame(values, "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean")
    assert [r.s for r in df.select(M.suitability(*(F.col(c) for c in "abcdefg")).alias("s")).collect()] == ["matched", "partial", "possible", "conflicting", "unknown", "other_type", "not_requested", "unknown"]


def test_selection_of_rows(spark):
    rows = spark.createDataFrame([(k, "complete", s) for k, s in enumerate(["conflicting", "possible", "matched", "other_type", "unknown", "partial", "matched"])], "study_id long, status string, suitability string")
    ranked, state = M.selected(rows, False, "study_id")
    assert [r.study_id for r in ranked.collect()] == [2, 6, 5, 1, 3, 0, 4] and state == "needs_selection" and not any(r.shown for r in ranked.collect())
    ranked, state = M.selected(rows, True, "study_id")
    assert [r.study_id for r in ranked.where("shown").collect()] == [2, 6] and state == "ready"
    ranked, state = M.selected(rows, False, "study_id", ids=[5, 1])
    assert {r.study_id for r in ranked.where("shown").collect()} == {1, 5} and state == "ready"
    for ids in ([], [1, 1], [99], list(range(6))):
        with pytest.raises(EngineError):
            M.selected(rows, False, "study_id", ids=ids)
    assert M.selected(rows.where("false"), False, "study_id")[1] == "no_confirmed_matches"
    with pytest.raises(EngineError, match="INCOMPLETE"):
        M.selected(rows.withColumn("status", F.lit("pending")), False, "study_id", ids=[1])


def test_conflicts(spark):
    shape = "study long, ord long, value string, role string, definition string, linkage boolean, types array<string>, usage string, basis string"
    row = lambda o, link, types, usage="used", basis="explicit", role="outcome": (1, o, "v", role, "d", link, types, usage, basis)
    rows = [row(1, False, ["a"]), row(2, False, ["b"]), row(3, True, ["a"]), row(4, False, ["a", "b"]), row(5, False, ["b"], "candidate"), row(6, False, ["b"], basis="inferred"), row(7, True, ["z"], role="unclear"), row(8, False, ["a"])]
    got = {(r.left, r.right) for r in M.conflict_pairs(spark.createDataFrame(rows, shape), "study", "ord").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (3, 4), (2, 8), (3, 8)}


@pytest.mark.parametrize(("name", "want"), [("a (x, (y, z)) / b", ["a x y z", "b"]), ("one AND two with three", ["one", "three", "two"]), ("sandy + withal", ["sandy", "withal"]), ("c; c", ["c"]), ("", []), ("[p/q] r", ["p q r"])])
def test_ingredients_in_brackets(spark, name, want):
    assert one(spark, name, N.ingredients) == want == N.split_ingredients(name)
    assert N.split_ingredients(None) is None


@pytest.mark.parametrize(
    ("label", "have", "want"),
    [
        ("goldenrod (human)", ["human goldenrod (rDNA)"], "equivalent"), ("bluetin", ["redzinc", "bluetin"], "different"), ("bluetin and redzinc", ["redzinc citrate", "bluetin"], "equivalent"), ("antitin", ["tin"], "different"),
        ("virus vaccine", ["virus vaccine (H9N3)"], "broader"), ("virus vaccine (H9N3)", ["virus vaccine"], "narrower"), ("pox types 1, 2", ["pox (types 1, 2, 3)"], "different"), ("tin sodium", ["tin"], "equivalent"), ("", ["tin"], "different"),
    ],
)
def test_name_relations(spark, label, have, want):
    df = spark.createDataFrame([(label, have)], "a string, b array<string>")
    assert df.select(N.relation(F.col("a"), F.col("b"))).first()[0] == want


RECORDS = [(1, "Alpha (previously Beta)", ["tin"], ["A01AA01"]), (2, "Beta", ["zinc", "tin"], ["A01AA02"]), (3, "Gamma (previously Old)", ["lead sodium"], ["A01AB01"]), (4, "Delta", ["copper"], ["B02BB02"])]
LABELS = [("A01AA01", "tin"), ("A01AA02", "zinc and tin"), ("A01AA", "METALS"), ("A01AA09", "combinations"), ("B02BB02", "gold")]


def dictionary(spark):
    return spark.createDataFrame(RECORDS, "record_id long, product string, ingredients array<string>, codes array<string>"), spark.createDataFrame(LABELS, "code string, label string")


def test_products_of_one_ingredient_set(spark):
    records, _ = dictionary(spark)
    q = spark.createDataFrame([(n, n) for n in ("tin", "tin and zinc", "lead", "lead citrate", "gamma", "Beta", "zinc", "nothing")], "query_id string, name string")
    got = {}
    for r in N.same_products(q, records).collect():
        got.setdefault(r.query_id, set()).add(r.record_id)
    assert got == {"tin": {1}, "tin and zinc": {2}, "lead": {3}, "lead citrate": {3}, "gamma": {3}, "Beta": {2}}


def test_class_expansion(spark):
    records, labels = dictionary(spark)
    q = spark.createDataFrame([(n, n) for n in ("A01AA01", "a01aa", "tin", "B02BB", "zzz")], "query_id string, name string")
    got = {(r.query_id, r.term, r.tier) for r in N.class_expansion(q, labels, records).collect()}
    assert {x for x in got if x[0] == "a01aa"} == {("a01aa", "METALS", "own"), ("a01aa", "tin", "member"), ("a01aa", "zinc / tin", "member"), ("a01aa", "zinc and tin", "member")}
    assert {x for x in got if x[0] == "A01AA01"} == {("A01AA01", "tin", "own"), ("A01AA01", "A01AA", "category"), ("A01AA01", "METALS", "category")}
    assert ("tin", "A01AA", "category") in got and not any(x[0] == "tin" and x[1] == "tin" for x in got)
    assert {x for x in got if x[0] == "B02BB"} == {("B02BB", "gold", "member"), ("B02BB", "copper", "omitted")} and not any(x[0] == "zzz" for x in got)


def test_medicines_in_texts(spark):
    names = spark.createDataFrame([("tin acid", "Tin acid"), ("sonar", "Sonar"), ("nitric oxide", "NO"), ("tin", "Tin")], "name string, term string")
    texts = ["Use of TIN-ACID in cohorts", "The SONAR study of tin acid", "exhaled nitric oxide levels", "tin receptor blockers and Tin", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.term) for r in N.found_medicines(df, names).collect()} == {(0, "Tin acid"), (1, "Tin acid"), (3, "Tin")}


def test_medicines_of_a_field_table(spark):
    page = "Author: x\nActive substance: Tin acid (C03AA01), zinc\n (C03AB02); unknown (C07\nAB03)\nMedicinal product: Other\nResearch question: none"
    pages = spark.createDataFrame([(1, 1, "no table"), (1, 2, page), (1, 3, page)], "doc_id long, page int, text string")
    names = spark.createDataFrame([("tin acid", "Tin acid"), ("zinc", "Zinc")], "name string, term string")
    labels = spark.createDataFrame([("C03AA01", "tin acid"), ("C07AB03", "other name")], "code string, label string")
    got = {r.term: (r.page, r.codes) for r in N.table_medicines(pages, names, labels, spark.createDataFrame([("C03",), ("C07",)], "grp string")).collect()}
    assert got == {"Tin acid": (2, ["C03AA01"]), "Zinc": (2, ["C03AB02"])}


def test_log_odds_and_subsumption(spark):
    df = spark.range(1).select(T.log_odds_ratio(F.lit(5), F.lit(10), F.lit(45), F.lit(90)).alias("x"))
    assert abs(df.first().x) < 1e-9
    grams = spark.createDataFrame([("a b", 3), ("a b c", 3), ("b", 4), ("x", 3)], "gram string, a int")
    assert {r.gram for r in G.without_subsumed(grams).collect()} == {"a b c", "b", "x"}


def test_recall(spark):
    got = spark.createDataFrame([("q", "s", x) for x in "abe"], "question string, strategy string, id string")
    labels = spark.createDataFrame([("q", "a", "relevant"), ("q", "d", "relevant"), ("q", "b", "partial"), ("q", "c", "not")], "question string, id string, label string")
    row = G.recall(got, labels).first()
    assert (row.recall, row.precision, row.unjudged, row.recall_lenient) == (0.5, 0.5, 1, 0.667)


def test_import_and_merge(spark, tmp_path):
    head = '﻿Study ID;Official title and acronym;Study type;Countries;Study status\n'
    (tmp_path / "20240101_claims_export.csv").write_text(head + '1;"A ""quoted"" title";Non-interventional study;France|Spain;Ongoing\n2;B;Clinical trial;;\n', encoding="utf-8")
    got = C.read_catalogue(spark, str(tmp_path / "20240101_claims_export.csv"))
    row = got.rows.first()
    assert (got.kind, row.title, row.countries, got.excluded.count()) == ("claims", 'A "quoted" title', ["France", "Spain"], 1)
    old = spark.createDataFrame([("1", ["ehr"]), ("9", ["ehr"])], "study_id string, data_source_types array<string>")
    new = C.tagged(old, got.rows.select("study_id", "data_source_types"), "claims", True)
    merged = {r.study_id: r.data_source_types for r in C.upserted(old, new, got.excluded).collect()}
    assert merged == {"1": ["ehr", "claims"], "9": ["ehr"]}
    (tmp_path / "bad.csv").write_text("Study ID,Title,Study type\n1,A,Non-interventional\n1,B,Non-interventional\n", encoding="utf-8")
    with pytest.raises(EngineError, match="CSV_DUPLICATE_ID"):
        C.read_catalogue(spark, str(tmp_path / "bad.csv"))


def test_headers_and_kinds():
    at, repeated = C.resolved_headers(["ID", "Title", "Study type", "title"])
    assert at["title"] == 3 and repeated == ["title"]
    assert C.kind_of("20240101_claims_ehr.csv") is None and C.kind_of("x-registry.csv") == "registry"
    with pytest.raises(EngineError):
        C.resolved_headers(["ID"], {"title": "Nope"})


def test_latest_version(spark):
    shape = "study string, kind string, version string, document_date string, published_date string, url string"
    rows = [
        ("s", "updated", "2.0", None, "2024-09-01", "u1"), ("s", "updated", "10.0", None, "2024-01-01", "u2"), ("s", "updated", "4.0", None, None, "u3"), ("s", "initial", "99", None, None, "u4"),
        ("tie", "initial", "1", None, None, "a"), ("tie", "initial", "1.0", None, None, "b"), ("dates", "initial", None, "2024-01-02", "2024-01-05", "a"), ("dates", "initial", "3", "2024-01-02", "2024-02-01", "b"), ("any", "initial", None, None, "2023-01-01", "z"), ("any", "initial", None, "2024-01-01", None, "a"),
    ]
    got = {r.study: (r.url, r.reason) for r in C.latest_versions(spark.createDataFrame(rows, shape), "study").collect()}
    assert got == {"s": ("u2", "version"), "tie": ("b", "version"), "dates": ("b", "document_date"), "any": ("a", "published_date")}
    assert {r.study: r.url for r in C.latest_versions(spark.createDataFrame(rows, shape), "study", "v4.0").collect()} == {"s": "u3"}


def test_snapshot(spark, tmp_path):
    a = spark.range(5).toDF("x")
    sinks.write_snapshot({"a": a}, str(tmp_path / "s"), "20240101")
    sinks.verify_snapshot(spark, str(tmp_path / "s"), "20240101")
    sinks.replace_table(spark.range(4).toDF("x"), str(tmp_path / "s/snapshot=20240101/a"))
    with pytest.raises(EngineError):
        sinks.verify_snapshot(spark, str(tmp_path / "s"), "20240101")


def test_streams_equal_batches(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = I.read_stream(spark, str(tmp_path / "in"), ev.schema, 1)
    got = {tuple(r) for r in I.run_to_memory(I.counters(stream, "event_type", "ts"), "counted").collect()}
    assert got == {tuple(r) for r in I.counters(ev, "event_type", "ts").collect()}
    latest = ev.select("user_id", "event_id", "event_type")
    store = Store(spark, str(tmp_path / "out"))
    for _ in range(2):  # a replay changes nothing
        I.upsert_stream(I.read_stream(spark, str(tmp_path / "in"), ev.schema, 1).select("user_id", "event_id", "event_type"), store, "latest", "user_id", "event_id", str(tmp_path / f"c{_}")).awaitTermination()
    want = {r.user_id: r.e for r in latest.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    assert {r.user_id: r.event_id for r in store.last().table("latest").collect()} == want


def test_backoff(spark):
    outcomes = ["rate_limit", "ok", "rate_limit", "rate_limit", "rate_limit", "rate_limit", "rate_limit", "ok"]
    df = spark.createDataFrame([(1, k, o) for k, o in enumerate(outcomes)], "user_id long, o long, outcome string")
    row = state.backoff(df, "user_id", "o").first()
    assert (row.limits, row.pauses, row.stopped, row.done) == (6, 3, True, 1)


def test_engine(spark, tmp_path):
    from attestry.engine import Engine

    (tmp_path / "x_claims.csv").write_text("Study ID,Title,Study type,Conditions\n1,Liver injury after drug use,Non-interventional study,liver injury\n2,Heart,Non-interventional study,heart\n", encoding="utf-8")
    engine = Engine(spark, str(tmp_path / "db"))
    assert engine.import_catalogue(str(tmp_path / "x_claims.csv"))["imported"] == 2
    assert [r.id for r in engine.search("liver injury").collect()] == ["1"] and engine.search(" ").count() == 2
    engine.add_documents(spark.createDataFrame([(1, "2.1 Outcomes\nbleeding events were counted")], "doc_id long, text string"))
    assert engine.search_text(["event"]).count() == 1 and engine.outline().count() == 1
    bad = engine.check_evidence(spark.createDataFrame([(1, 1, 1, "2.1 Outcomes", "bleeding events were"), (2, 1, 1, None, "not written")], "quote_id long, doc_id long, page int, section string, quote string"))
    assert [tuple(r) for r in bad.collect()] == [(2, "QUOTE_NOT_FOUND")]


def test_no_cartesian_product(spark):
    from attestry.plans import registry

    for name in ("quote_containment", "vocab_expand", "class_members", "conflict_pairs", "near_match"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_grams_are_dealt_by_the_size_of_their_texts(spark, monkeypatch):
    from attestry.plans import evaluation

    told = "/root/testdata/sf0.001"
    want = sorted(map(tuple, evaluation.subsumption_dedupe(spark, told).collect()))
    docs = spark.createDataFrame([(k, f"alpha beta {k}") for k in range(9)] + [(9, None)], "id long, text string")
    assert G.parts_for(docs.limit(0), "text") == 1 and G.parts_for(docs, "text") == 1
    monkeypatch.setattr(G, "CHARS", 12)
    assert (parts := G.parts_for(docs, "text")) == 10
    grams = G.ngrams(docs.select("id", F.split(F.coalesce("text", F.lit("")), " ").alias("w")), "w", (), parts=parts)
    counts = G.gram_counts(grams, parts)
    assert counts.rdd.getNumPartitions() == 10
    assert {r.gram: r.a for r in counts.collect() if r.a > 1} == {"alpha": 9, "beta": 9, "alpha beta": 9}
    monkeypatch.setattr(G, "CHARS", 20_000)
    assert sorted(map(tuple, evaluation.subsumption_dedupe(spark, told).collect())) == want


def test_totals_of_a_stored_index_come_from_its_postings(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "a b c"), (2, "", "d"), (3, None, None), (4, "x", "")], "id long, title string, text string")
    fields = {"title": "title", "definitions": "text"}
    want = R.totals(docs, fields).first()
    none = R.totals(docs.limit(0), fields).first()
    monkeypatch.delattr(R, "totals")  # a second pass over the texts
    R.write_index(docs, fields, f"{tmp_path}/i")
    assert R.read_index(spark, f"{tmp_path}/i").total.first() == want
    assert R._stored_totals(R.postings(docs.limit(0), fields)).first() == none
