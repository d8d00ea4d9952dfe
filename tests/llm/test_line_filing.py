"""Line dedup: common words are filed with their next one, and what lines meet stays in proportion."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.llm import line_dedup


def plain_removed(texts):
    kept, out = [], []
    for text in texts:
        words = set(text.split())
        out.append(any(100 * len(words & w) >= 80 * len(words | w) for w in kept if words))
        kept.append(words)
    return out


def near_copies(rnd, vocabulary, lines):
    """Lines of all lengths, each with copies some words away, around the bound."""
    out = []
    for _ in range(lines):
        words = rnd.sample(vocabulary, rnd.choice([1, 2, 3, 5, 8, 13, 30, 71, 74, 120]))
        out.append(words)
        for _ in range(2):
            copy = list(words)
            for _ in range(rnd.randint(0, 1 + len(words) // 4)):
                change = rnd.random()
                if change < 0.4 and len(copy) > 1:
                    copy.pop(rnd.randrange(len(copy)))
                elif change < 0.7:
                    copy.append(rnd.choice(vocabulary))
                else:
                    copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(copy)
    rnd.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("common", [0, 6, 20, 1023])
def test_common_words_lose_no_match(spark, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    texts = near_copies(random.Random(common), [f"w{i}" for i in range(150)], 130)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    found = {r.doc: r.removed for r in line_dedup.repeated_lines(docs).collect()}
    expected = plain_removed(texts)
    assert 100 < sum(expected) < len(texts) - 100
    assert found == dict(enumerate(expected))


def test_similar_sets_file_a_key_together(spark, monkeypatch):
    rnd, rows = random.Random(8), []
    for i in range(600):
        a = set(rnd.sample(range(2000), rnd.randint(2, 60)))
        b = set(a)
        while len(a & b) * 100 >= 80 * len(a | b):
            rows.append((i, sorted(a), sorted(b)))
            b = (b - {rnd.choice(sorted(b))}) if rnd.random() < 0.5 else b | {rnd.randrange(2000)}
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").where("a <> b")
    monkeypatch.setattr(line_dedup, "COMMON", 1)  # of rank 16: all but a few
    for name in ("a", "b"):
        ranked = F.transform(name, lambda w: F.when(w < 60, w).otherwise(w.bitwiseOR(F.lit(16 << 48))))
        df = df.withColumn("codes", F.sort_array(ranked)).withColumn("n", F.size("codes"))
        df = line_dedup._filed(df, 80).withColumn(f"filed_{name}", F.col("filed"))
        df = df.withColumn(f"single_{name}", F.col("single"))
    assert df.where("single_a < size(filed_a)").count() > 100
    assert df.where("single_a > 0").count() > 100
    assert df.where("not arrays_overlap(filed_a, filed_b)").count() == 0
    assert df.where("size(filed_a) > 0.4 * size(a) + 1").count() == 0


def test_common_words_gather_few_lines(spark, monkeypatch):
    rnd, words, met = random.Random(2), [f"w{i}" for i in range(1500)], []
    rows = [(i, " ".join(rnd.sample(words, 24))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    for common in (15, 1 << 30):
        monkeypatch.setattr(line_dedup, "COMMON", common)
        sets = line_dedup._ranked_sets(docs, line_dedup.rarity_table(docs), 80)
        each = sets.select(F.explode_outer("filed").alias("code")).groupBy("code").count()
        met.append(each.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0])
    assert met[0] * 20 < met[1]


def test_long_unlike_lines_are_no_pairs(spark, monkeypatch):
    pairs = {}

    def matched(df, docs, percent, name, own=line_dedup._matched):
        pairs[name] = df.count()
        return own(df, docs, percent, name)

    monkeypatch.setattr(line_dedup, "_matched", matched)
    rnd, words = random.Random(3), [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rnd.sample(words, 140))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    assert not line_dedup.repeated_lines(docs).where("removed").count()
    assert sum(pairs.values()) <= 20  # of 11175


def test_a_crowd_of_near_copies_is_a_pair_a_line(spark, monkeypatch):
    pairs = {}

    def matched(df, docs, percent, name, own=line_dedup._matched):
        pairs[name] = df.count()
        return own(df, docs, percent, name)

    monkeypatch.setattr(line_dedup, "_matched", matched)
    rnd, words = random.Random(5), [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*(w for w in words if rnd.random() > 0.04), f"x{i}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    found = {r.doc for r in line_dedup.repeated_lines(docs).where("removed").collect()}
    assert found == {i for i, gone in enumerate(plain_removed([t for _, t in rows])) if gone}
    assert pairs["star-lines"] < 300
