"""Near duplicates by shingles against all pairs."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from attestry.llm import minhash

from .test_operators import hard_rows


def brute_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    sets, parent = [brute_set(t) for _, t in docs], {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(docs[a][0]), find(docs[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, find(i)) for i, _ in docs)


def near_rows():
    """Pairs around the threshold, a chain, and a group of near copies."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10000)}"
    docs = [(i, t) for i, t, _ in hard_rows() if i is not None]
    for k in range(60):
        w = [word() for _ in range(200)]
        docs.append((1000 + 2 * k, " ".join(w)))
        for p in range(1 + k % 8):
            w[10 + 14 * p] = word()
        docs.append((1001 + 2 * k, " ".join(w)))
    w = [word() for _ in range(150)]
    for k in range(30):
        w[r.randrange(150)] = word()
        docs.append((2000 + k, " ".join(w)))
    return docs


@pytest.mark.parametrize("per", [7, 512])
def test_near_duplicates(spark, per, monkeypatch):
    monkeypatch.setattr(minhash, "PER", per)
    docs = near_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(df.repartition(3)).collect())
    assert got == brute_components(docs)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_stage_drops_what_is_similar(spark):
    """One to eight replaced words of 200; some similar pairs differ in more than four bits of a fingerprint."""
    docs = near_rows()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted({x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()})
    assert got == sorted({i for i, c in brute_components(docs) if i == c})


def test_pair_at_the_threshold():
    a = np.arange(9, dtype=np.uint64)
    assert [x.tolist() for x in minhash.similar([a, a[:8], a[1:9], a[:7]])] == [[0, 0, 1], [1, 2, 3]]


def test_bands_reach_the_threshold():
    r = np.random.default_rng(2)
    for n in (9, 90):
        sets = []
        for _ in range(3000):
            x = r.integers(0, 1 << 63, n + n // 9, dtype=np.uint64)
            sets += [np.unique(x[:n]), np.unique(x[n // 9 :])]
        m = minhash.minima(sets)
        assert (minhash.keys(m)[::2] == minhash.keys(m)[1::2]).any(1).all()
        assert ((minhash.signature(m)[::2] == minhash.signature(m)[1::2]).sum(1) >= minhash.AGREE).all()
