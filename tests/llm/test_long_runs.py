"""Runs of one word that are longer than a symbol in one document and shorter in another, beside one passage."""

import random

import numpy as np

from attestry.llm import substrings
from attestry.llm.common import WORDS, word_hashes

from .test_operators import brute_kept, frame


def ruled(seed=3, n=40):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        passage = [f"w{r.randrange(30)}" for _ in range(r.randrange(44, 60))]
        rule = r.choice([["-"], ["=", "="], ["-", "+"]])
        for k in (20, r.randrange(2, 9), r.randrange(2, 30)):
            run = rule * k
            own = [f"o{r.randrange(10000)}" for _ in range(6)]
            out.append(" ".join(r.choice([own + run + passage + own, own + passage + run + own, own + run + passage + run + own])))
    return out


def test_equal_windows_have_one_anchor():
    texts = [x.encode() for x in ruled(n=400)]
    h, first = word_hashes(texts)
    _, start, count, key = substrings.stretches(h, first)
    off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    s = np.repeat(start, count) + off
    window = WORDS.spans(WORDS.prefix(h), s, s + substrings.WINDOW)
    keys = np.repeat(key, count)
    pairs = np.unique(np.stack([window, keys]), axis=1)
    assert len(np.unique(window)) == pairs.shape[1] < len(window)


def test_rules_of_different_lengths(spark):
    rows = [(k, t, "en") for k, t in enumerate(ruled())]
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.digests(frame(spark, rows)).collect())
    assert got == brute_kept([(i, t) for i, t, _ in rows]) and sum(x[2] for x in got) > 500
