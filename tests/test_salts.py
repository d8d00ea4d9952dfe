"""Heavy pairs of key and word are salted, and only they."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.operators import grounding as G


def table(spark, one_key):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    said = [
        (i, 0 if one_key else i % 50, "It is the vpn that requires " + " ".join(rnd.sample(words, 6)) + ".")
        for i in range(2000)
    ]
    told = [(k, "vpn requires " + " ".join(words[: 20 + k % 9])) for k in range(1 if one_key else 50)]
    return (
        spark.createDataFrame(said, "id long, k long, response string"),
        spark.createDataFrame(told, "k long, source_text string"),
    )


@pytest.mark.parametrize("one_key", [True, False])
def test_salts_change_no_result(spark, one_key):
    said, told = table(spark, one_key)
    plain = G.grounding_join(said, told, ["id"], ["k"], fanout=1)
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, G.grounding_join(said, told, ["id"], ["k"]).collect())) == want
    assert sorted(map(str, G.grounding_join(said, told, ["id"], ["k"], share=0.002).collect())) == want


def test_no_part_above_the_share(spark):
    said, told = table(spark, True)
    left = G._claim_words(said, ["id"], ["k"], [], "response")
    right = G._source_words(told, ["k"], "source_text", None)
    share, n = 0.005, left.count()
    salted, repeated = G._salted(left, right, ["k", "_word"], ["id"], share)
    assert salted.count() == n
    sizes = salted.groupBy("k", "_word", "_salt").count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * share * n  # an even hash and a sampled count
    heavy = {r._word for r in left.groupBy("_word").count().filter(f"count > {3 * share * n}").collect()}
    spread = {r._word for r in salted.filter("_salt > 0").select("_word").distinct().collect()}
    assert heavy and heavy <= spread
    light = left.groupBy("_word").count().filter(f"count < {share * n / 3}").collect()
    assert not spread & {r._word for r in light}
    assert repeated.groupBy("k", "_word", "_salt").count().filter("count > 1").count() == 0
