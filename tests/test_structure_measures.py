"""Readings against outlines, labels and each other."""

from attestry.operators import structure as Q

LINES = [(1, 1, "1. Study  design"), (1, 1, "Text"), (1, 2, "Results"), (1, 2, None), (1, 3, "7. Quality control"), (1, 3, "7.  Quality control"), (1, 4, "Contents"), (1, 4, "9. Study size ..... 12"), (1, 4, "9. Study size")]


def _tables(spark, detected):
    lines = spark.createDataFrame(LINES, "doc_id long, page int, text string")
    outline = spark.createDataFrame([(1, 1, "1. Study\ndesign", 1), (1, 2, "RESULTS", 2), (1, 1, "Elsewhere", 2), (1, 1, None, 2), (1, 2, "Text", 1), (1, 1, "text", 1)], "doc_id long, level int, title string, page int")
    return lines, outline, spark.createDataFrame(detected, "doc_id long, page int, name string")


def test_headings_against_an_outline(spark):
    tables = _tables(spark, [(1, 1, "1 study design"), (1, 1, "1 study design"), (1, 3, "7 quality control"), (2, 1, "alone")])
    got = {r.doc_id: tuple(r)[1:] for r in Q.heading_agreement(*tables).collect()}
    # gold: the chapter, Text (of both levels) and Results; Elsewhere is not printed
    assert got == {1: (3, 1, 2, 1, 2, 1), 2: (0, 0, 0, 0, 1, 1)}
    assert sorted((r.page, r.name) for r in Q.missed_headings(*tables).collect()) == [(1, "text"), (2, "results")]


def test_chapters_of_the_template(spark):
    lines, _, detected = _tables(spark, [(1, 3, "7 quality control")])
    assert [tuple(r) for r in Q.template_lines(lines, detected).collect()] == [(1, 3, 2)]
    assert [tuple(r) for r in Q.template_lines(lines, detected.where("page = 9")).collect()] == [(1, 3, 0)]


def test_headings_of_chunks(spark):
    chunks = spark.createDataFrame([(1, 1, "2 Aims", "2  AIMS and more"), (1, 2, "2 Aims", "goes on"), (1, 3, None, "x"), (1, 3, "--", "-- x")], "doc_id long, page int, section string, text string")
    assert [tuple(r) for r in Q.printed_headings(chunks).collect()] == [(1, 1, "2 aims")]


def test_families(spark):
    pages = [(1, 1, " \nThe Sponsor protocol"), (1, 2, "sponsor B"), (1, 3, "other page"), (1, 4, None), (2, 1, "Alpha one"), (2, 2, "gamma"), (2, 3, "delta"), (3, 1, "Sponsor"), (4, 1, ""), (5, 1, "beta one"), (5, 2, "alpha two")]
    ids = spark.createDataFrame([(k, f"s{k}", k == 3) for k in range(1, 7)], "doc_id long, study_id string, marked boolean")
    got = {r.doc_id: r.family for r in Q.families(spark.createDataFrame(pages, "doc_id long, page int, text string"), ids, ("protocol",)).collect()}
    # of equally common words that of the earliest page counts
    assert got == {1: "header:sponsor", 2: "study:s2", 3: "marked", 4: "study:s4", 5: "header:beta", 6: "study:s6"}


def test_passages_and_checklists(spark):
    chunks = spark.createDataFrame([(1, "s0001", 1, "Before", True), (1, "s0002", 1, "ENCePP check-\nlist: one", False), (1, "s0003", 2, "two 22", True), (1, "s0004", 3, "out", True), (1, "s0005", 1, None, None)], "doc_id long, section_id string, page int, text string, read boolean")
    passages = spark.createDataFrame([(1, 1, 1, "before"), (2, 1, 1, "encepp  Check-list"), (3, 1, 2, "before"), (4, 2, 1, "before"), (5, 1, 1, None)], "passage_id long, doc_id long, page int, quote string")
    assert {r.passage_id: (r.found, r.read) for r in Q.passage_checks(passages, chunks).collect()} == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False)}
    spans = spark.createDataFrame([(1, 1, 2, "encepp check-list")], "doc_id long, start_page int, end_page int, start_text string")
    assert [tuple(r) for r in Q.checklist_spans(spans, chunks.where("text is not null")).collect()] == [(1, 1, 2, 1, 6)]
    lost = spark.createDataFrame([(1, 1, 1, "nowhere")], "doc_id long, start_page int, end_page int, start_text string")
    assert [tuple(r) for r in Q.checklist_spans(lost, chunks.where("text is not null")).collect()] == [(1, 1, 2, 1, 6)]


def test_changes_do_not_cancel_out(spark):
    before = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, n long")
    after = spark.createDataFrame([(1, 1), (3, 2)], "doc_id long, n long")
    family = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "doc_id long, family string")
    assert [tuple(r) for r in Q.changes(before, after, family, ("n",)).collect()] == [("a", "n", 3, 4, 3, 2, 3)]


def test_two_readings_are_measured_in_one_pass(spark):
    from attestry.operators import structure as S
    from attestry.plans import structure as plans

    # (reading, document, page, name, line, gold, top, seen): one document that only the second reading has
    rows = [(False, 1, 0, "a", True, True, True, False), (False, 1, 0, "b", True, False, False, True), (True, 1, 0, "a", True, True, True, True), (True, 2, 0, "c", True, False, False, True), (True, 2, 1, "c", False, True, False, False), (True, 2, 1, "", True, True, True, True)]
    marks = spark.createDataFrame(rows, "later boolean, doc_id long, page int, name string, line boolean, gold boolean, top boolean, seen boolean")
    own = S.marked_agreement(marks, "doc_id", "later")
    family = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, family string")
    got = {tuple(r) for r in S.changed(own, family, S.COUNTS).collect()}
    apart = [own.where(c).drop("later") for c in ("not later", "later")]
    assert got == {tuple(r) for r in S.changes(*apart, family, S.COUNTS).collect()}
    assert ("x", "detected", 2, 1, 2, 1, 0) in got and ("x", "gold_top_detected", 2, 0, 1, 1, 0) in got
    plan = plans.structure_changes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and "FullOuter" not in plan
