"""The licence scan's gate loses nothing, and callers' columns stay."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.llm import licenses


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_gate_words_are_in_every_match(threshold):
    words = set(licenses.gate_words(licenses.TEMPLATES, threshold))
    rnd = random.Random(3)
    for _, text in licenses.TEMPLATES:
        grams = licenses.template_bigrams(text)
        t = len(grams)
        least = next(i for i in range(t + 1) if 2 * i / (i + t) >= threshold - 1e-12)
        # the fewest bigrams that still match, those without a gate word first
        held = lambda g: any(w in g for w in words)
        plain = [g for g in grams if not held(g)]
        assert len(plain) < least
        for _ in range(20):
            some = rnd.sample(grams, least)
            assert any(map(held, some))


def test_scan_with_and_without_gate(spark, monkeypatch):
    rnd = random.Random(6)
    pool = " ".join(text for _, text in licenses.TEMPLATES).split() + ["alpha", "beta", "\n", "\n\n"]
    texts = [None, "", "MIT", "Released under the MIT License."]
    for _, text in licenses.TEMPLATES:
        for keep in (1.0, 0.95, 0.9, 0.8, 0.6):
            kept = " ".join(w for w in text.split() if rnd.random() < keep)
            texts.append(rnd.choice(["", "x y\n", "x\n\n"]) + rnd.choice([kept, kept.upper()]) + rnd.choice(["", "\nz z"]))
    texts += [" ".join(rnd.choices(pool, k=rnd.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("_units", F.lit(5))
    gated = licenses.license_matches(df)
    assert gated.columns == ["doc_id", "text", "_units", "matches"]
    got = sorted(map(str, gated.collect()))
    monkeypatch.setattr(licenses, "gate_words", lambda *_: [""])
    assert got == sorted(map(str, licenses.license_matches(df).collect()))
    assert sum("dice" in r for r in got) > 50
