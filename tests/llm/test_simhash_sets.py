"""Candidates of the pipeline's near duplicates by SimHash: wide fingerprints, grids, and all pairs for comparison."""

import numpy as np
import pytest

import corpus_pipeline
from attestry.llm import minhash, simhash

from .test_minhash import brute_components, near_rows


def random_sets(r, sizes):
    return [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in sizes]


def similar_sets(r, n, both, one, other):
    out = []
    for _ in range(n):
        x = r.integers(0, 1 << 63, both + one + other, dtype=np.uint64)
        out += [np.unique(x[: both + one]), np.unique(np.append(x[:both], x[both + one :]))]
    return out


def test_stage_takes_candidates_by_simhash(spark, monkeypatch):
    """The stage's links come from grids over fingerprints: none without these grids, and MinHash has no part in them."""
    docs = near_rows()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(minhash, "candidates", None)
    got = sorted({x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()})
    assert got == sorted({i for i, c in brute_components(docs) if i == c})
    empty = spark.createDataFrame([], "node long, component long")
    monkeypatch.setattr(simhash, "met", lambda signed, least: empty)
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert {i for i, _ in docs if i >= 1000} <= got


@pytest.mark.parametrize("plan, per, least", [((0, 17, 34, 64), 40, 0), ((1, 17, 33, 128), 1 << 18, 0), ((4, 62, 117, 256), 1 << 18, 256)])
def test_similar_documents(spark, plan, per, least, monkeypatch):
    monkeypatch.setattr(simhash, "sheaf_plan", lambda n: plan)
    monkeypatch.setattr(simhash, "PER", per)
    monkeypatch.setattr(simhash, "ALL", least)
    docs = near_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x.doc_id, x.component_id) for x in simhash.similar_documents(df.repartition(3)).collect())
    assert got == brute_components(docs)
    assert simhash.similar_documents(df.where("false")).count() == 0


def test_wide_fingerprints():
    sets = random_sets(np.random.default_rng(1), (1, 2, 5, 254, 255, 256, 511, 3000))
    for x, fp in zip(sets, simhash.wide(sets), strict=True):
        for w in range(simhash.WIDE):
            bits = np.unpackbits(simhash.mix(x ^ simhash._WIDE[w]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            assert np.packbits(2 * bits.sum(0) > len(x), bitorder="little").view("<u8")[0] == fp[w]


@pytest.mark.parametrize("both, one, other", [(4, 0, 1), (12, 1, 2), (80, 10, 10), (80, 0, 20), (800, 100, 100)])
def test_pairs_at_the_threshold_meet(both, one, other):
    """Similarity 0.8, all sheaves of small tables: each pair of a thousand is met in a grid and is close enough."""
    r = np.random.default_rng(3)
    sets = similar_sets(r, 1000, both, one, other)
    fp = np.ascontiguousarray(simhash.wide(sets).T)
    size = np.array([len(x) for x in sets])
    _, own, more, fine = simhash.sheaf_plan(1000)
    pair = np.zeros(1000, bool)
    for k in range(more if size.min() <= simhash.FEW else own):
        e = simhash.embedded(fp)
        for g in simhash.segments_of(k, 0, fine)[1]:
            x = simhash.taken(e, g)
            pair |= x[::2] == x[1::2]
    i = np.arange(0, 2000, 2)
    most = np.where(np.minimum(size[i], size[i + 1]) <= simhash.FEW, simhash.FEW_BITS, simhash.WIDE_BITS)
    assert pair.all() and simhash.close(fp, simhash.embedded(fp), i, i + 1, most).all()


@pytest.mark.parametrize("crowd", [1, 32, 1 << 30])
def test_forest_against_all_pairs(crowd, monkeypatch):
    """A crowd of near copies, pairs and single rows; in one block and in two, cut to few pairs at a time."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.append(base[k % 9 :], r.integers(0, 1 << 63, k % 9, dtype=np.uint64))) for k in range(90)]
    sets += similar_sets(r, 60, 90, 4, 4) + random_sets(r, r.integers(1, 300, 80))
    at = r.permutation(len(sets))
    sets = [sets[k] for k in at]
    fp = np.ascontiguousarray(simhash.wide(sets).T)
    size = np.array([len(x) for x in sets])
    grids = [g for k in range(17) for g in simhash.segments_of(k, 0, 64)[1]]
    for block in (np.zeros(len(sets), np.int32), np.arange(len(sets), dtype=np.int32) % 2):
        i, j = np.triu_indices(len(sets), 1)
        fit = np.minimum(size[i], size[j]) * 10 >= np.maximum(size[i], size[j]) * 8
        fit &= sum(np.bitwise_count(fp[w][i] ^ fp[w][j]).astype(int) for w in range(simhash.WIDE)) <= np.where(np.minimum(size[i], size[j]) <= simhash.FEW, simhash.FEW_BITS, simhash.WIDE_BITS)
        if block.any():
            fit &= block[i] != block[j]
        want = simhash.united(np.arange(len(sets)), i[fit], j[fit])
        assert (simhash.forest(fp, size, block, grids, 0.8) == want).all()


def test_no_more_than_lost():
    for n in (10, 10**5, 10**6, 10**7, 10**8):
        coarse, own, more, fine = simhash.sheaf_plan(n)
        assert simhash.lost(simhash.APART, coarse, own, fine) <= simhash.LOST
        assert simhash.lost(simhash.FEW_APART, coarse, more, fine) <= simhash.LOST
