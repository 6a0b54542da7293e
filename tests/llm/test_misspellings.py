"""Misspellings of terms that fitted() has learned."""

import random

import numpy as np

from attestry.llm import toxicity

ABUSE = ["grubby", "scoundrel", "wretch", "loser"]


def found(lexicon, words):
    codes = np.array([ord(c) for w in words for c in w])
    size = np.array([len(w) for w in words])
    hit, _, errors = lexicon.match(codes, np.cumsum(size) - size, size)
    return {words[k]: e for k, e in zip(hit.tolist(), errors.tolist(), strict=True)}


def learned(spark):
    r = random.Random(2)
    plain = [f"word{k}" for k in range(80)]
    rows = [(k, " ".join([*r.choices(plain, k=50), *(r.choices(ABUSE, k=3) if k % 5 < 2 else [])])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 < 2)) for k, _ in rows], "doc_id long, toxic int")
    return toxicity.fitted(docs, labels)


def test_learned_words_match_with_one_edit(spark):
    lexicon = learned(spark).lexicon
    wrong = {w[:k] + x + w[k + cut :] for w in ABUSE for k in range(len(w)) for cut, x in ((1, "q"), (1, ""), (0, "q"))}
    got = found(lexicon, sorted(wrong))
    assert set(got) == wrong
    assert found(lexicon, ABUSE) == dict.fromkeys(ABUSE, 0)
    assert not found(lexicon, ["gqqbby", "word7", "qqretch"])
