"""Near duplicates: buckets of several components, and what moves for them."""

import random

from parapet.llm import minhash


def test_members_of_mixed_buckets_are_rows_once_a_hub(spark):
    rnd, rows, want = random.Random(3), [], set()
    component = {i: i % 7 if i < 60 else i for i in range(90)}
    for hub in range(0, 90, 9):
        for band in rnd.sample(range(108), 40):
            same = [i for i in component if component[i] == component[hub]]
            others = rnd.sample(range(90), rnd.randint(1, 4)) if rnd.random() < 0.3 else []
            ids = {hub, *rnd.sample(same, rnd.randint(0, len(same))), *others}
            if len(ids) > 1:
                rows += [(1000 * hub + band, band, len(ids), hub, 50, i, 40 + i) for i in ids]
            if len(ids) > 2 and len({component[i] for i in ids}) > 1:
                want |= {(hub, i, 40 + i, component[i]) for i in ids}
    crowd = spark.createDataFrame(rows, "key long, band int, size long, hub long, hn long, id long, n long")
    same = spark.createDataFrame([x for x in component.items() if x[0] < 60], "node long, component long")
    found = minhash._mixed(crowd, same).select("hub", "id", "n", "c").collect()
    assert len(found) == len(set(found))  # not a row for each bucket
    assert set(map(tuple, found)) == want


def test_whole_texts_are_not_shuffled_for_a_few_ids(spark, monkeypatch):
    plans, kept = {}, minhash.keep

    def keep(df, name):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(minhash, "keep", keep)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i % 3])) for i in range(12)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in minhash.near_duplicates(docs, width=2).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in ("side", "texts"):
        assert "LeftSemi, BuildRight" in plans[name] and "BroadcastHashJoin" in plans[name], plans[name]
