"""Rules over nested analyses against plain Python over the same records."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attestry.operators import evidence as E
from attestry.operators import nested as N

EVIDENCE = "struct<page:long,section:string,quote:string,server:string>"
FACT = f"struct<value:string,evidence:array<{EVIDENCE}>>"
SOURCE = f"struct<value:string,usage:string,types:array<string>,role:string,basis:string,requires_linkage:boolean,definition:string,evidence:array<{EVIDENCE}>>"
ANALYSIS = f"struct<study_design:{FACT},cohort:struct<inclusion_criteria:array<{FACT}>,index_date:{FACT},design_schema:struct<figure_pages:array<int>,time_windows:array<{FACT}>>>,outcomes:array<{FACT}>,source_assessments:array<{SOURCE}>,missing_information:array<string>>"
LINES = ["Claims data of the national insurance were used", "short", "All patients aged 18 or more", "The registry; linked data", "Adults of the cohort"]


def record(r):
    quote = lambda: {"page": r.randrange(1, 5), "section": r.choice([None, "1 Aims"]), "quote": r.choice(LINES), "server": r.choice([None, "page"])}
    fact = lambda: {"value": r.choice(["Claims data", "claims, DATA!", "Registry", "cohort"]), "evidence": [quote() for _ in range(r.randrange(0, 4))]}
    maybe = lambda f: f() if r.random() < 0.7 else None
    source = lambda: {**fact(), "usage": r.choice(["used", "planned", "candidate", "unclear"]), "types": r.sample(["claims", "ehr"], r.randrange(1, 3)), "role": r.choice(["outcome", "exposure"]), "basis": r.choice(["explicit", "inferred"]), "requires_linkage": r.random() < 0.3, "definition": r.choice(["by code", "by text", "code"])}
    many = lambda f: [f() for _ in range(r.randrange(0, 4))]
    return {
        "study_design": maybe(fact), "cohort": maybe(lambda: {"inclusion_criteria": many(fact), "index_date": maybe(fact), "design_schema": maybe(lambda: {"figure_pages": many(lambda: r.randrange(3)), "time_windows": many(fact)})}),
        "outcomes": many(fact), "source_assessments": many(source), "missing_information": many(lambda: r.choice("abc")),
    }


@pytest.fixture(scope="module")
def records():
    r = random.Random(3)
    return [record(r) for _ in range(60)] + [dict.fromkeys(("study_design", "cohort", "outcomes", "source_assessments", "missing_information"))]


@pytest.fixture(scope="module")
def frame(spark, records):
    return spark.createDataFrame([(k, x) for k, x in enumerate(records)], f"id long, a {ANALYSIS}")


def walk(node, change):
    if isinstance(node, list):
        return [walk(x, change) for x in node]
    if not isinstance(node, dict):
        return node
    return change(node) if "quote" in node else {k: walk(v, change) for k, v in node.items()}


def found(df):
    plain = lambda v: {k: plain(x) for k, x in v.asDict().items()} if isinstance(v, Row) else [plain(x) for x in v] if isinstance(v, list) else v
    return {r[0]: plain(r[1]) for r in df.collect()}


def test_marks_go_at_every_depth(frame, records):
    got = found(frame.select("id", N.without_marks(F.col("a"), frame.schema["a"].dataType)))
    assert got == {k: walk(x, lambda e: {**e, "server": None}) for k, x in enumerate(records)}
    plan = frame.select(N.without_marks(F.col("a"), frame.schema["a"].dataType))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def short(node):
    if isinstance(node, list):
        return [y for x in node if (y := short(x)) is not None or not (isinstance(x, dict) and "evidence" in x)]
    if isinstance(node, dict) and "evidence" in node:
        good = [e for e in node["evidence"] if len(e["quote"]) >= 8][:8]
        return {**node, "evidence": good} if good else None
    return {k: short(v) for k, v in node.items()} if isinstance(node, dict) else node


def test_short_quotes_go_with_their_facts(frame, records):
    got = found(frame.select("id", N.without_short_quotes(F.col("a"), frame.schema["a"].dataType)))
    assert got == {k: short(x) for k, x in enumerate(records)}


def paths(node, path="", field=""):
    if isinstance(node, list):
        return [y for k, x in enumerate(node) for y in paths(x, f"{path}[{k}]", field)]
    if isinstance(node, dict):
        if "evidence" in node:
            return [(path, field, node)]
        return [y for k, x in node.items() for y in paths(x, f"{path}.{k}" if path else k, k)]
    return []


def test_refused_facts(frame, records):
    def code(field, fact):
        e = fact["evidence"]
        if not e:
            return "NO_EVIDENCE"
        if any(len(x["quote"]) < 8 for x in e):
            return "QUOTE_TOO_SHORT"
        return "SOURCE_NOT_NAMED" if field in N.SOURCE_FIELDS and not any(E.name_span(x["quote"], fact["value"]) for x in e) else None

    got = found(frame.select("id", N.refused(F.col("a"), frame.schema["a"].dataType)))
    want = {k: [{"path": p, "code": c} for p, f, x in paths(r) if (c := code(f, x))] for k, r in enumerate(records)}
    assert got == want and {c["code"] for r in got.values() for c in r} == {"NO_EVIDENCE", "QUOTE_TOO_SHORT", "SOURCE_NOT_NAMED"}


def test_names_as_the_scalar_rule_has_them(spark):
    r = random.Random(8)
    names = ["national claims", "claims", "data of claims", "a b", "x-y", "ß", "...", "claims claims"]
    pieces = ["national", "claims", "data", "of", "a", "b", "x", "y", "ß", "SS", "other", "new"]
    rows = []
    for k in range(1500):
        text = "".join(r.choice(pieces) + r.choice([" ", " ", " ", ", ", "; ", ". ", ".", "-", "_", "? "]) for _ in range(r.randrange(1, 9)))
        rows.append((k, text, r.choice(names)))
    got = dict(spark.createDataFrame(rows, "k long, t string, n string").select("k", N.names_it(F.col("t"), F.col("n"))).collect())
    wrong = [(t, n, got[k]) for k, t, n in rows if got[k] != (E.name_span(t, n) is not None)]
    assert not wrong, wrong[:5]


def key(x):
    import re

    return re.sub(r"[^\w]+", " ", x["value"].casefold()).strip(), x.get("role"), tuple(sorted(set(x.get("types") or ())))


def absorb(a, b):
    rank = {"unclear": 0, "candidate": 1, "used": 2, "planned": 3}
    out = {**a, "evidence": (a["evidence"] + [e for e in b["evidence"] if e not in a["evidence"]])}
    distinct = []
    for e in out["evidence"]:
        if e not in distinct:
            distinct.append(e)
    out["evidence"] = distinct[:8]
    if "usage" in a:
        out["usage"] = b["usage"] if rank[b["usage"]] > rank[a["usage"]] else a["usage"]
        out["basis"] = "explicit" if "explicit" in (a["basis"], b["basis"]) else a["basis"]
        out["requires_linkage"] = a["requires_linkage"] or b["requires_linkage"]
        out["definition"] = a["definition"] if b["definition"] in a["definition"] else a["definition"] + "\n" + b["definition"]
    return out


def merge(a, b):
    if isinstance(a, list) or isinstance(b, list):
        out = []
        for x in (a or []) + (b or []):
            same = next((k for k, y in enumerate(out) if (key(y) == key(x) if isinstance(x, dict) else y == x)), None)
            if same is None:
                out.append(x)
            elif isinstance(x, dict) and x != out[same]:
                out[same] = absorb(out[same], x)
        return out
    if a is None or b is None:
        side = b if a is None else a
        return merge({k: None for k in side}, side) if a is None and isinstance(side, dict) and "evidence" not in side else merge(side, {k: None for k in side}) if isinstance(side, dict) and "evidence" not in side else side
    if "evidence" in a:
        if a["value"] == b["value"]:
            return a
        both = absorb({"evidence": a["evidence"]}, {"evidence": b["evidence"]})["evidence"]
        return {"value": a["value"] + "\n" + b["value"], "evidence": both}
    return {k: merge(a[k], b[k]) for k in a}


def listless(node):
    """Null lists as empty ones, as a merge leaves them."""
    if isinstance(node, dict):
        return {k: ([] if v is None and k in ("inclusion_criteria", "time_windows", "figure_pages", "outcomes", "source_assessments", "missing_information") else listless(v)) for k, v in node.items()}
    return node


def test_batches_merge_in_order(spark, records):
    batches = [(k // 3, k % 3, x) for k, x in enumerate(records[:60])]
    df = spark.createDataFrame(batches, f"doc long, n int, a {ANALYSIS}")
    got = found(N.merged_batches(df, "doc", "n", "a"))
    for d in range(20):
        out = None
        for x in records[3 * d : 3 * d + 3]:
            out = merge(out, x)
        assert listless(got[d]) == listless(out)


def test_long_keys_merge(spark):
    """A key of 2,000 batches: no list is compared with itself, which took its cube."""
    kind = "outcomes array<struct<value:string,evidence:array<struct<page:bigint,quote:string>>>>, pages array<bigint>, seen array<struct<a:int,b:string>>, note struct<value:string,evidence:array<struct<page:bigint,quote:string>>>"
    one = lambda v, n: {"value": v, "evidence": [{"page": n, "quote": "q"}]}
    rows = [(1, n, {"outcomes": [one(f"v{n}", n), one(f"V{n % 7}", n), None], "pages": [n, n % 3, None], "seen": [{"a": n, "b": None}, None], "note": one("same", n)}) for n in range(2000)]
    rows += [(2, 0, None), (2, 1, {"outcomes": None, "pages": None, "seen": None, "note": None}), (None, 0, {"outcomes": [one("x", 1)], "pages": [1], "seen": [], "note": None})]
    got = {r.k: r.a for r in N.merged_batches(spark.createDataFrame(rows, f"k int, n int, a struct<{kind}>"), "k", "n", "a").collect()}
    a = got[1]
    assert [x and x.value for x in a.outcomes] == ["v0", None, *(f"v{n}" for n in range(1, 2000))]
    assert [e.page for e in a.outcomes[2].evidence] == [1, 8, 15, 22, 29, 36, 43, 50] and [e.page for e in a.outcomes[-1].evidence] == [1999]
    assert a.pages == [0, None, *range(1, 2000)] and [x and x.a for x in a.seen] == [0, None, *range(1, 2000)]
    assert a.note.value == "same" and [e.page for e in a.note.evidence] == [0]
    assert got[2].outcomes == got[2].pages == got[2].seen == [] and got[2].note is None
    assert [x.value for x in got[None].outcomes] == ["x"] and got[None].pages == [1]


def test_quotes_go_out_and_come_back(spark, frame, records):
    rows = N.evidence_rows(frame, "id", "a")
    moved = rows.where("server is null").withColumns({"page": F.col("page") + 100, "server": F.lit("page"), "section": F.lit(None).cast("string")})
    got = found(N.with_evidence(frame, moved, "id", "a").select("id", "a"))
    assert got == {k: walk(x, lambda e: {**e, "page": e["page"] + 100, "server": "page", "section": None} if e["server"] is None else e) for k, x in enumerate(records)}
