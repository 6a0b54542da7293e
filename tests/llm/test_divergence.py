"""The audit of sources against its SQL on small blocks, hard rows and exact numbers."""

import random
from fractions import Fraction

import duckdb
import numpy as np

from attestry.llm import divergence, queries

SHAPE = "doc_id long, text string, lang string, source string, term string, n long, part int, kept long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, s, "x", 1, 1, 1) for k, (t, g, s) in enumerate(rows)], SHAPE)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(k, *r) for k, r in enumerate(rows)])
    cursor = con.execute(queries.oracle_sql()["op12_source_divergence"])
    at = [c[0] for c in cursor.description]
    return sorted(tuple(r[at.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in cursor.fetchall())


def compared(spark, rows, **blocks):
    got = divergence.divergence(frame(spark, rows), **blocks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = sorted(map(tuple, got.collect()))
    assert found == by_sql(rows)
    return found


def hard(seed=3, n=400):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "e", "ou", "Ü", "ß", "né", "中", "ABC")]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "de", None, "xx"]), r.choice(["hot"] * 6 + [f"s{k}" for k in range(9)] + [None, "Ä", "z"])
        own = words[hash((source or "")[:1]) % 8 :][:40] if source else words
        rows.append((r.choice([" ", ", ", "1", "_"]).join(r.choice(own) for _ in range(r.randrange(40))), lang, source))
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("123 ,.", None, None), ("only one", "rare", "alone"), ("x", "rare", "two")]
    return rows + rows[:5] + [(" ".join(r.choice(words) for _ in range(30_000)), "en", "hot")]


def test_whole_and_in_small_blocks(spark):
    rows = hard()
    whole = compared(spark, rows)
    assert compared(spark, rows, terms=7, sources=3) == whole
    assert {p for _, _, p, *_ in whole} == {"pair", "term"} and any(g == "rare" and v == 0 for g, _, _, _, v, _ in whole)


def test_equal_values_are_ordered_by_item(spark):
    rows = [(" ".join(f"t{chr(97 + k)}" for k in range(20)), "en", s) for s in ("a", "b", "c") for _ in range(12)]
    rows += [("ta tb tc td", "en", "a")] * 3
    found = compared(spark, rows, terms=3)
    assert [i for _, s, p, i, *_ in sorted(found, key=lambda r: r[5]) if s == "a" and p == "term"] == ["ta", "tb", "tc", "td"]


def test_more_than_fifty_terms(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(140)]
    rows = [(" ".join(words), "en", s) for s in ("a", "b") for _ in range(30)] + [(" ".join(words[:k]), "en", "a") for k in range(1, 120, 3)]
    found = compared(spark, rows, terms=16)
    assert sum(s == "a" and p == "term" for _, s, p, *_ in found) == 50


def test_without_rows_or_columns(spark):
    assert compared(spark, []) == []
    assert divergence.divergence(spark.createDataFrame([(1,), (2,)], "doc_id long")).collect() == []


def test_a_text_of_several_pieces_is_one_document(spark):
    rows = [("ab " * 900_000 + "cd", "en", "long")] + [("ab", "en", "other")] * 29
    found = divergence.divergence(frame(spark, rows)).collect()
    assert {r.part: r.value for r in found if r.source == "long"} == {"pair": 0}  # ab is in thirty documents, cd in one


def test_probabilities_are_exact():
    r = random.Random(2)
    for _ in range(300):
        total, kept = r.randrange(10 ** r.randrange(1, 15)), r.randrange(1, 10**6)
        count = r.randrange(total + 1)
        got = divergence.probabilities(np.array([count]), np.array([total]), kept)[0]
        assert got == 1 + Fraction(1_000_000_000 * (count + 5), total + 5 * kept).__floor__()
