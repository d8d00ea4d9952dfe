"""Line dedup: bounds by parity bits drop no match, and wanted lines meet before their words."""

import random

from pyspark.sql import functions as F

from parapet.llm import line_dedup


def test_parity_bits_differ_in_no_more_than_the_words(spark):
    rnd, rows = random.Random(4), []
    for n in (1, 5, 40, 300):
        for change in (0, 1, n // 10, n // 3):
            a = {rnd.randrange(-(2**63), 2**63) for _ in range(n)}
            b = set(rnd.sample(sorted(a), n - change)) | {rnd.randrange(2**63) for _ in range(change)}
            rows.append((sorted(a), sorted(b), len(a ^ b)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, d int")
    parts = lambda c: [F.filter(c, line_dedup._two_bits(i)) for i in range(4)]
    apart = lambda x, y, low: F.bit_count(
        line_dedup._parity(x, low).bitwiseXOR(line_dedup._parity(y, low)))
    wide = sum((apart(x, y, 6) for x, y in zip(parts("a"), parts("b"))), F.lit(0))
    held = [F.size(p) for p in parts("a")]
    for r in df.select("d", apart(F.col("a"), F.col("b"), 0).alias("x"), wide.alias("y"),
                       sum(held, F.lit(0)).alias("n"), F.size("a").alias("size")).collect():
        assert r.x <= r.d and r.y <= r.d and r.n == r.size
        assert r.d or not (r.x or r.y)
    assert df.select(wide.alias("y")).agg(F.max("y")).first()[0] > 64  # long lines are told apart


def test_words_of_unlike_lines_do_not_travel(spark, monkeypatch):
    kept = {}

    def keep(df, name, own=line_dedup.keep):
        kept[name] = own(df, name)
        return kept[name]

    monkeypatch.setattr(line_dedup, "keep", keep)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    lines = [" ".join(rnd.sample(words, 150)) for _ in range(8)]
    lines.append(lines[0] + " extra")
    docs = spark.createDataFrame(list(enumerate(lines)), "doc long, text string")
    pairs = [(i, 0, j, 0) for i in range(9) for j in range(i)]
    pairs = spark.createDataFrame(pairs, "doc long, line_no int, doc2 long, line_no2 int")
    found = line_dedup._matched(pairs, docs, 80, "x").collect()
    assert [tuple(r) for r in found] == [(8, 0)]
    assert kept["x-near"].count() <= 3  # of 36
