"""The registered queries and their SQL over small tables in which the operators find something."""

import random

import duckdb
import numpy as np

from attestry.llm import queries


def compare(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(tmp_path))
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall())
    rows = df.collect()
    assert sorted(columns) == sorted(df.columns) and sorted(str([r[c] for c in sorted(columns)]) for r in rows) == want
    return rows


def test_contaminated_documents(spark, tmp_path):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choices(words, k=r.choice([3, 8, 20, 30])))) for k in range(12)] + [(50, "..."), (51, None)]
    docs = []
    for k in range(60):
        w = r.choices(words, k=40)
        for _ in range(k % 4):
            at = r.randrange(40)
            w[at:at] = (r.choice(items[:12])[1]).upper().split()
        docs.append((k, r.choice([" ", ", ", "\n"]).join(w)))
    rows = compare(spark, tmp_path, "op6_decontamination", documents=spark.createDataFrame([*docs, (70, None), (71, "")], "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert sum(x.contaminated for x in rows) >= 10 and sum(x.n_items == 1 for x in rows) >= 5


def test_linked_vectors(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = []
    for c in range(8):
        center = r.normal(size=24)
        rows += [(100 * c + k, (center / np.linalg.norm(center) + 0.05 * r.normal(size=24)).tolist()) for k in range(12)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, rows[0][1]), (5003, [2 * x for x in rows[1][1]])]
    got = compare(spark, tmp_path, "op10_embedding_dedup", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sum(x.n_links > 0 for x in got) >= 90


def test_removed_passages(spark, tmp_path):
    r = random.Random(9)
    base = [f"p{k % 97}" for k in range(400)]
    docs = [(k, " ".join(base[r.randrange(300) :][: r.randrange(30, 160)] + [f"q{r.randrange(999)}" for _ in range(r.randrange(60))])) for k in range(40)]
    rows = compare(spark, tmp_path, "op8_substring_dedup", documents=spark.createDataFrame([*docs, (90, None)], "doc_id long, text string"))
    assert sum(x.n_removed > 0 for x in rows) >= 20
