"""Printed texts of held quotes: soft hyphens between blanks, separators that are no white space, quotes of one letter, sharp s in capitals."""

import hashlib

from attestry.plans import registry

PASSAGE = "Große well-known words of it"
PRINTED = {
    (1, 1): ("a Große ­ well-\nknown  words of it b", "Große well-known words of it"),
    (1, 2): ("a GROSSE WELL-KNOWN WORDS OF IT b", "GROSSE WELL-KNOWN WORDS OF IT"),
    (2, 3): ("no pass\x1cage of\nit", "pass\x1cage of it"),
    (3, 4): ("ZZ, z", "Z"),
    (4, 5): ("Mine, m", "M"),
}


def test_printed_text_is_that_of_the_page(spark, tmp_path):
    docs = [(d, t) for (_, d), (t, _) in PRINTED.items()]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "pass\x1cage of it"), (3, "z"), (4, "m")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.quote_id, r.doc_id): (r.at_place, r.after_move) for r in registry.queries()["quote_restore"](spark, str(tmp_path)).collect()}
    assert set(PRINTED) <= set(got)
    for at, (_, text) in PRINTED.items():
        assert got[at] == (hashlib.sha256(text.encode()).hexdigest(),) * 2, at
