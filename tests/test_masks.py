"""Masks of texts with many values: taken piece by piece, the same as the fold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from parapet.functions import pii

BITS = [
    "bob@x.com", "jim.bob@x.com", "a.bob@x.co", " ", "  ", ", ", "\n", "(317) 740-8045", "317-740-8045",
    "1-317-740-8045", "9317-740-80451", "4111 2222 3333 4444", "4111222233334444", "10.0.255.1",
    "110.0.255.1", "10.0.255.12", "EMP-1234", "EMP-12345", "TEMP-1234", "ID1234 ", "DOB: 1/2/1999",
    "born 3-4-99", "dob:1/2/19995", "sk-abcdefghijklmnop1", "ghp_AAAAAAAAAAAAAAAAAAAA", "123-45-6789",
    "mailto:", "tel:", "word", "é", "x(555) 123-4567", "+1 317 740 8045", "2021", "v1.2", "%", "-", ".", "😀",
]


def folded(text, entities):
    for e in entities:
        text = text.replace(e.value, f"[{e.type.upper()}]")
    return text


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    return df.select("id", "text", pii.pii_scan(F.col("text")).alias("p")).collect()


@pytest.mark.parametrize("many,pieces", [(0, 64), (0, 1), (3, 64)])
def test_pieces_equal_the_fold(spark, monkeypatch, many, pieces):
    monkeypatch.setattr(pii, "_MANY_VALUES", many)
    monkeypatch.setattr(pii, "_MANY_PIECES", pieces)
    rnd = random.Random(many + pieces)
    texts = [
        "".join(rnd.choice(BITS) + rnd.choice(["", " ", " ", ", "]) for _ in range(rnd.randint(1, 40)))
        for _ in range(500)
    ]
    for row in scanned(spark, texts):
        assert row.p.masked_text == folded(row.text, row.p.entities), row.text


@pytest.mark.parametrize("make", [
    lambda i: f"user{i}@x.com and", lambda i: f"call 555-{i // 10000 + 100}-{i % 10000:04d},",
    lambda i: f"card 4111-2222-{i // 10000:04d}-{i % 10000:04d} or user{i}@x.com.",
])
def test_many_values_take_linear_time(spark, make):
    seconds = {}
    scanned(spark, [make(i) for i in range(40)])
    for n in (8000, 16000):
        text = " ".join(make(i) for i in range(n))
        t = time.time()
        row = scanned(spark, [text])[0]
        seconds[n] = time.time() - t
        if n == 8000:
            assert row.p.masked_text == folded(text, row.p.entities)
        assert len({e.value for e in row.p.entities}) >= n
    assert seconds[16000] < 3 * seconds[8000] + 1
