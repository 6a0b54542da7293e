"""The pipeline against a plain version that works document by document, and the queries against their SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from attestry.llm import decontam, langid, pii, queries

from .test_minhash import brute_components
from .test_operators import brute_hits, check_packing, frame, hard_rows, whole_ids

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    r = random.Random(6)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    item = " ".join("".join(r.choices("mnop", k=4)) for _ in range(20))
    rows = []
    for k in range(80):
        g = r.choice(list(letters))
        w = ["".join(r.choices(letters[g], k=5)) for _ in range(120)]
        if k % 9 == 0:
            w[10:10] = item.split()
        if k % 7 == 0:
            w.insert(5, "me@there.org")
        rows.append((k, " ".join(w), g, "s", 9))
    rows += [(100 + k, rows[k][1] + (" tail" if k % 2 else ""), rows[k][2], "s", 9) for k in range(20)]
    rows += [(200, None, None, "s", 0), (201, "12 34 !!", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    net = langid.fitted(docs)
    kept = {}
    for i, t, *_ in rows:
        (lang,), (score,) = net.texts([(t or "").encode()])
        if lang != "und" and score >= 0.3:
            kept[i] = t
    near = dict(brute_components(list(kept.items())))
    kept = {i: t for i, t in kept.items() if near[i] == i}
    for i, t in kept.items():
        kept[i] = re.sub(" ?" + re.escape(item), "", t)
    assert all(x[2] == 0 for x in brute_hits(list(kept.items()), [(1, item)]))
    for i in kept:
        while spans := pii.base_spans(kept[i]):
            kept[i] = pii.redacted(kept[i], spans)
    ids = whole_ids()
    sizes = {x.doc_id: x.doc_tokens for x in got}
    assert sizes == {i: len(ids(t)) + 1 for i, t in kept.items()}
    check_packing(got, list(kept.values()))


def test_pipeline_on_hard_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing column names; and no rows at all."""
    rows = [(i, t, g or "en") for i, t, g in hard_rows()]
    frame(spark, rows + rows[:5]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "same same same")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {x.doc_id for x in got} <= {i for i, _, _ in rows}
    spark.read.parquet(str(tmp_path / "documents.parquet")).where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert out.count() >= 0.8 * docs.count(), name


def test_clean_texts_are_kept_as_they_are(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r.n_hit for r in decontam.contamination(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    after = {r.doc_id: r.text for r in decontam.decontaminated(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert all(after[i] == t for i, t in before.items() if not found[i])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall())


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 14))
    assert np.all([callable(f) for f in queries.queries().values()])
