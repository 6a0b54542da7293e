"""Lattices against enumerated segmentations, and the query's counts and probabilities against brute force."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import lattice

SHAPE = "doc_id long, text string, lang string, score double, n long, word binary, row long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 0.5, 1, b"x", 1) for i, t, g in rows], SHAPE)


@pytest.fixture(scope="module")
def ranks(tmp_path_factory):
    """A small file of ranks: single letters but q, pairs, and pieces that begin words."""
    pieces = [bytes([b]) for b in range(256) if b != ord("q")] + [b"th", b"the", b" the", b" t", b"he", b"er", b"there", "é".encode(), b" ab", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"The", b"a b"]
    path = tmp_path_factory.mktemp("ranks") / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate(pieces)) + b"\n")
    return str(path)


def by_hand(word, scores):
    """Log of the sum over all segmentations, by recursion over what is left."""
    text = b" " + word
    known = {len(text): 0.0}
    for at in range(len(text) - 1, -1, -1):
        ways = [scores[text[at:e]] + known[e] for e in range(at + 1, len(text) + 1) if text[at:e] in scores]
        known[at] = math.log(math.fsum(math.exp(w - max(ways)) for w in ways)) + max(ways)
    return known[0]


def segmentations(text, scores):
    if not text:
        yield []
    for e in range(1, len(text) + 1):
        if text[:e] in scores:
            yield from ([text[:e], *rest] for rest in segmentations(text[e:], scores))


def test_vocabulary(ranks):
    v = lattice.Vocabulary(ranks)
    assert b"q" in v.pieces and b"The" not in v.pieces and b"A" not in v.pieces and b"a b" not in v.pieces and b"a" * 24 not in v.pieces
    assert math.isclose(np.exp(v.scores).sum(), 1)
    ids = v.arcs(np.frombuffer(b" there qu", np.uint8))
    found = {(e, n + 1): v.pieces[k] for (e, n), k in np.ndenumerate(ids) if k < len(v.pieces)}
    assert found[3, 4] == b" the" and found[5, 5] == b"there" and (6, 2) not in found and found[7, 1] == b"q"


@pytest.mark.parametrize("seed", range(3))
def test_sum_over_all_segmentations(ranks, seed):
    r = random.Random(seed)
    v = lattice.Vocabulary(ranks)
    scores = np.log(np.random.default_rng(seed).dirichlet(np.ones(len(v.pieces)), 2))
    of = [dict(zip(v.pieces, s)) for s in scores.tolist()]
    words = [("".join(r.choice("theraébq") for _ in range(r.randrange(1, 12)))).encode() for _ in range(60)] + [b"there", b"there", b"q"]
    got = lattice.Lattices(v, scores).log_probabilities(words)
    for w, row in zip(words, got):
        for k in range(2):
            assert math.isclose(row[k], by_hand(w, of[k]), rel_tol=1e-12)
            if len(w) < 8:
                assert math.isclose(row[k], math.log(math.fsum(math.exp(sum(of[k][p] for p in s)) for s in segmentations(b" " + w, of[k]))), rel_tol=1e-12)


def test_long_words_are_whole(ranks, monkeypatch):
    v = lattice.Vocabulary(ranks)
    scores = np.log(np.random.default_rng(1).dirichlet(np.ones(len(v.pieces)), 1))
    monkeypatch.setattr(lattice, "STEP", 50)
    words = [b"thethere" * 40, b"aaaaerhe" * 17, b"the"]
    got = lattice.Lattices(v, scores).log_probabilities(words)
    assert np.allclose(got[:, 0], [by_hand(w, dict(zip(v.pieces, scores[0].tolist()))) for w in words], rtol=1e-11)


def test_expected_counts(ranks):
    v = lattice.Vocabulary(ranks)
    scores = np.log(np.random.default_rng(4).dirichlet(np.ones(len(v.pieces)), 2))
    words, among = [b"there", b"the", b"abt"], np.array([[True, False], [True, True], [False, True]])
    got = lattice.Lattices(v, scores).expected(words, among)
    for k in range(2):
        of, want = dict(zip(v.pieces, scores[k].tolist())), Counter()
        for w, some in zip(words, among):
            ways = [(s, math.exp(sum(of[p] for p in s))) for s in segmentations(b" " + w, of)]
            for s, p in ways:
                for piece in s:
                    want[piece] += some[k] * p / sum(x for _, x in ways)
        assert np.allclose(got[k], [want[p] for p in v.pieces])


def rows():
    r = random.Random(5)
    en, de = ["the", "there", "Her", "a", "b,"], ["der", "éa", "und"]
    out = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        own = (en if lang == "en" else de) + [f"x{r.randrange(40)}"]
        out.append((k, r.choice([" ", "\n", "\t\v"]).join(r.choice(own) for _ in range(r.randrange(1, 30))), lang))
    return out + [(100, None, "en"), (101, "", None), (102, " \n", "fr"), (103, "q" * 400 + " the", "en"), (None, "no id at all", "de"), (7, out[7][1], "en"), (104, "the " * 2000, "de")]


def brute(data, v, model, kinds):
    counts, of = Counter(), {k: Counter() for k in range(len(kinds))}
    train = [(t, g) for i, t, g in data if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    for t, g in train:
        words = (t or "").encode().lower().split() + [b""]
        counts.update(words)
        of[kinds.index(g or "") if (g or "") in kinds else len(kinds) - 1].update(words)
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for _, t, _ in data:
        words = (t or "").encode().lower().split() + [b""]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        ways = []
        for k in range(len(kinds)):
            n, d, v_k = sum(of[k].values()), model.discount[k], len(of[k])
            scores = dict(zip(v.pieces, model.lattices.scores[k].tolist()))
            p = math.log10(of[k][b""] / counts[b""])
            for w in words:
                whole = max(0.0, of[k][w] - d) / n
                spelt = math.log(d * v_k / n) + by_hand(w, scores) if w else -math.inf
                p += float(np.logaddexp(math.log(whole) if whole else -math.inf, spelt)) / math.log(10)
            ways.append(p)
        top = max(ways)
        out.append((len(words), sum(counts[w] > 0 for w in words), total, base, top + math.log10(sum(10 ** (x - top) for x in ways))))
    return out


@pytest.mark.parametrize("most", [1000, 3])
def test_scores_against_brute_force(spark, ranks, most, monkeypatch):
    kept = []
    fit = lattice.fitted
    monkeypatch.setattr(lattice, "fitted", lambda *a: kept.append(fit(*a)) or kept[-1])
    data = rows()
    got = sorted(lattice.scored(frame(spark, data), ~lattice.held_out(), tokenizer=ranks, most=most, kinds=2).collect(), key=str)
    want = brute(data, lattice.Vocabulary(ranks), kept[0], ["en", "de"])
    want = sorted(((i, *x) for (i, *_), x in zip(data, want)), key=str)
    assert len(got) == len(data)
    by = lambda xs: sorted((x[0] is None, x[0] or 0, x[1], x[2], x[3], round(x[4], 6), round(x[5], 6)) for x in xs)
    assert by(got) == by(want)


def test_held_out_texts_teach_nothing(spark, ranks):
    data = rows()
    other = [(i, "entirely other words here", "en") if i is not None and zlib.crc32(str(i).encode()) % 7 == 2 else (i, t, g) for i, t, g in data]
    get = lambda d: {r.doc_id: r for r in lattice.scored(frame(spark, d), ~lattice.held_out(), tokenizer=ranks).where("doc_id < 100").collect()}
    a, b = get(data), get(other)
    same = [i for i, t, g in data if (i, t, g) in other and i is not None and i < 100 and i != 7]
    assert len(same) > 30 and all(math.isclose(a[i].score, b[i].score) and a[i].base_score == b[i].base_score for i in same)


def test_rounds_raise_the_likelihood(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lambda rounds: lattice.scored(df, ~lattice.held_out(), rounds=rounds).where(lattice.held_out()).agg(F.sum("score"), F.sum("n_tokens")).first()
    (first, n), (later, _) = held(0), held(2)
    assert later / n > first / n + 0.2


def test_no_rows_and_no_training_rows(spark, ranks):
    assert lattice.scored(frame(spark, []), ~lattice.held_out(), tokenizer=ranks).collect() == []
    got = lattice.scored(frame(spark, [(1, "the", "en"), (2, None, None)]), F.lit(False), tokenizer=ranks).orderBy("doc_id").collect()
    v = lattice.Vocabulary(ranks)
    half = math.log10(0.5)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(2, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert math.isclose(got[0].score, by_hand(b"the", dict(zip(v.pieces, v.scores.tolist()))) / math.log(10) + 2 * half) and math.isclose(got[1].score, half)
    assert len(lattice.scored(spark.createDataFrame([(1,)], "doc_id long"), ~lattice.held_out(), tokenizer=ranks).collect()) == 1
