"""Trees of pages, fields of nested lists, studies of three pages, cards of files."""

from attestry.sources import markup as M

DETAILS = """<html><body><dl><dt>Study ID</dt><dd>7</dd></dl>
<dl class=x><dt>Official title and acronym</dt><dd><p>A &lt;b&gt; &amp; <i>C</i><br>next</dd></dl>
<dl><dt>Study  countries</dt><dd><div class="field__item">Spain</div><div class="a field__item b">France<!-- x --> (part)</div></dd></dl>
<dl><dt>Outer</dt><dd>before <dl><dt>Inner:</dt><dd>within</dd></dl> after</dd></dl>
<dl><dt>Open<dd>left open</dl><dl><dt>no value</dt></dl>
<dl><dt>DARWIN EU® study</dt><dd>No</dd></dl><script>var t = "<dl><dt>a</dt><dd>b</dd></dl>"</script>
<a href="/study/7/data-management/">D</a><a href="https://other.org/x/study-documents">S</a><a href="data-management">no</a></body>"""


def _pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, html string")


def test_fields_of_lists_at_any_depth(spark):
    rows = M.fields(M.trees(_pages(spark, (1, DETAILS), (2, None), (3, "")))).orderBy("ord").collect()
    got = [(r.label, r["values"]) for r in rows]
    assert {r.page_id for r in rows} == {1}
    assert got == [
        ("study id", ["7"]), ("official title and acronym", ["A <b> & C next"]), ("study countries", ["Spain", "France (part)"]),
        ("outer", ["before Inner: within after"]), ("inner", ["within"]), ("open left open", ["left open"]), ("darwin eu study", ["No"]),
    ]


def test_tags(spark):
    html = "<ul><li>a<li>b<img src=x>c</ul></nothing><h1> T <b>x</b></h1><a href='/q?a=1&amp;b'>l</a><br/>tail"
    rows = M.tagged(M.trees(_pages(spark, (1, html))), ("h1", "li", "a")).collect()
    assert [(r.tag, r.ord, r.href, r.text) for r in rows] == [("h1", 0, None, "T x"), ("li", 0, None, "a b c"), ("li", 1, None, "b c"), ("a", 0, "/q?a=1&b", "l")]


def test_studies_of_three_pages(spark):
    methods = "<dl><dt>Study countries</dt><dd>Italy</dd></dl><dl><dt>Non-interventional study design</dt><dd><div class=field__item>Cohort</div></dd></dl>"
    data = "<dl><dt>Data source(s)</dt><dd>CPRD</dd></dl>"
    rows = [("7", 0, DETAILS), ("7", 1, methods), ("7", 2, data), ("8", 0, DETAILS), ("9", 0, None)]
    got = {r.study_id: r for r in M.study_records(spark.createDataFrame(rows, "study_id string, part int, html string"), "https://site.org").collect()}
    one = got["7"]
    assert (one.error, one.title, one.darwin_eu, one.countries, one.study_designs, one.catalogue_data_sources, one.source_url) == (None, "A <b> & C next", False, ["Italy"], ["Cohort"], ["CPRD"], "https://site.org/study/7")
    assert one.tabs == {"data-management": "https://site.org/study/7/data-management/", "study-documents": "https://other.org/x/study-documents"}
    assert got["8"].error == got["9"].error == "STUDY_NOT_FOUND" and got["8"].title is None


def test_cards_of_files(spark):
    html = """<div class="field-protocol-file"><div class="bcl-file"><span class="file-title">Protocol v1.2 2021-03-04</span><div><a href="/f/a%20b.pdf?x=1">get</a></div>
<span class="file-metadata">published 05/06/2022</span></div><a href="/f/alone.pdf">no card</a><div class="field__item"><a href="/f/plain_v3.PDF">x</a><a href="/f/page.html">y</a></div></div>
<div class="field-protocol-file-upd"><div class="field__item"><a href="/f/a%20b.pdf?x=1">again</a></div></div><div class="field-report-file"><div class="bcl-file"><a href="/f/r.pdf">r</a></div></div>"""
    rows = M.file_cards(M.trees(_pages(spark, (1, html))), "field-protocol-file", "https://site.org").orderBy("ord").collect()
    assert [(r.document_url, r.title, r.kind, r.version, str(r.document_date), str(r.published_date)) for r in rows] == [
        ("https://site.org/f/a%20b.pdf?x=1", "a b.pdf?x=1", "updated", None, "None", "None"),
        ("https://site.org/f/plain_v3.PDF", "plain_v3.PDF", "initial", "3", "None", "None"),
    ]
    once = html.replace("field-protocol-file-upd", "field-other")
    first = M.file_cards(M.trees(_pages(spark, (1, once))), "field-protocol-file", "https://site.org").orderBy("ord").first()
    assert (first.title, first.version, str(first.document_date), str(first.published_date)) == ("Protocol v1.2 2021-03-04", "1.2", "2021-03-04", "2022-06-05")


def test_studies_are_read_in_one_pass(spark):
    """Each page is parsed once, whatever the record asks of it, and pages of one small piece are dealt before."""
    rows = [(k, p, f"<dl><dt>Study ID</dt><dd>{k}</dd></dl><dl><dt>Official title and acronym</dt><dd>T{p}</dd></dl><a href='/x/data-management'>d</a>") for k in range(50) for p in range(3)]
    df = M.study_records(spark.createDataFrame(rows, "study_id string, part int, html string").coalesce(1), "https://s.org")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    got = {r.study_id: (r.title, r.tabs) for r in df.collect()}
    assert got == {str(k): ("T2", {"data-management": "https://s.org/x/data-management"}) for k in range(50)}


def test_arrays_of_a_page_are_bound_once(spark):
    """A rule that is read for every link is not put into the lambda of the links."""
    html = '<div class="field-protocol-file"><div class="bcl-file"><a href="/a.pdf">x</a><span class="file-title">T</span></div></div>'
    df = M.file_cards(M.trees(_pages(spark, (1, html))), "field-protocol-file", "https://s.org")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bcl-file") == 1 and plan.count("file-metadata") == 1
    assert [(r.document_url, r.title) for r in df.collect()] == [("https://s.org/a.pdf", "T")]
