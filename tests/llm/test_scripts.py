"""Toxic terms in every script and at every length."""

import random

import numpy as np
import pytest

from attestry.llm import toxicity


def found(lexicon, text):
    _, _, term, errors, _, _ = lexicon.hits([text])
    return sorted((lexicon.terms[t], int(e)) for t, e in zip(term, errors, strict=True))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("바보같은 사람", [("바보같은", 0)]), ("你是个笨蛋吗", [("笨蛋*", 0)]), ("mixed笨蛋", [("笨蛋*", 0)]), ("สวัสดีอีควายครับ", [("อีควาย*", 0)]),
        ("vequ" + "a" * 40, [("vequ*", 0)]), ("x" * 300, []), ("idi0t", [("idiot", 1)]), ("idiot" + "x" * 50, []), ("", []), ("जाहिलपन", [("जाहिल*", 0)]),
    ],
)
def test_scripts(text, want):
    lexicon = toxicity.Lexicon({"바보같은": 3.0, "vequ*": 1.0, "笨蛋*": 2.0, "idiot": 1.0, "อีควาย*": 2.0, "जाहिल*": 1.0})
    assert found(lexicon, text) == want


def test_quoted_in_corner_brackets():
    lexicon = toxicity.Lexicon({"笨蛋*": 2.0})
    plain, quoted = lexicon.features(["他是笨蛋", "他说「笨蛋」了"])
    assert plain[0] > 0 and quoted[0] == 0 and quoted[2] > 0


def test_terms_are_learned_and_found_in_runs_without_blanks(spark):
    r = random.Random(5)
    plain = [chr(0x4E00 + k) for k in range(200)]
    rows = [(k, "".join([*r.choices(plain, k=40), *(["魑魅"] if k % 4 == 0 else []), *r.choices(plain, k=40)])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(x.predicted == int(x.doc_id % 4 == 0) for x in got)


def test_one_insult_does_not_become_its_first_letters():
    toxic = [{"pathetic", f"w{k}"} for k in range(30)] + [{"wretch" + e, f"w{k}"} for k, e in enumerate(["ed", "es", "ing", "er", "ly"] * 6)]
    terms = toxicity.learned_terms(toxic, [{f"w{k}", "path"} for k in range(200)])
    assert "pathetic" in terms and "wretch*" in terms and not any(t.startswith("path") and t != "pathetic" for t in terms)


def test_long_words_take_few_steps():
    lexicon = toxicity.Lexicon({"vequ*": 1.0, "scum": 1.0})
    codes = toxicity.points("vequ" + "a" * 2_000_000)
    hit, _, _ = lexicon.match(codes, np.array([0]), np.array([len(codes)]))
    assert len(hit) == 1 and len(lexicon.sets) < 40
