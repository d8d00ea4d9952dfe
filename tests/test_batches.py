"""Batches of ranks and callers' tokenizers."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parapet.operators.batches import epoch_batches, read_batches, write_batches
from parapet.operators.epochs import epoch_plan
from parapet.operators.sequences import shape_sequences
from parapet.operators.tokenizers import byte_tokenizer, file_tokenizer, tokenizer

VOCABULARIES = "/opt/tokenizers"


@pytest.mark.parametrize("n,world,batch,block", [(1000, 7, 4, 5), (3, 8, 2, 1), (0, 2, 2, 1), (64, 1, 64, 4096)])
def test_batches_follow_the_plan(spark, tmp_path, n, world, batch, block):
    samples = spark.range(n).withColumn("body", F.concat(F.lit("b"), "id"))
    made = epoch_batches(samples, ["id"], 2, world, batch, steps_per_block=block)
    write_batches(made, str(tmp_path / "b"))
    plan = epoch_plan(samples, ["id"], 2, world, batch)
    names = ["id", "body", "position", "rank", "step", "batch_no"]
    if not n:
        assert made.collect() == []
        return
    back = read_batches(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, back.select(names).collect())) == sorted(map(tuple, plan.select(names).collect()))
    assert back.filter(F.col("slot") != F.col("step") % batch).count() == 0
    one = read_batches(spark, str(tmp_path / "b"), rank=world - 1, start_step=3).select("step").collect()
    want = plan.filter(f"rank = {world - 1} and step >= 3").select("step").collect()
    assert sorted(one) == sorted(want)


def test_batches_move_once_and_files_are_in_order(spark, tmp_path):
    samples = spark.range(4000).withColumn("body", F.repeat(F.lit("x"), 50))
    made = epoch_batches(samples, ["id"], 1, 3, 4, steps_per_block=100)
    plan = made._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x and "block" in x]
    assert len(moved) == 1  # the others carry buckets and counts
    write_batches(made, str(tmp_path / "b"))
    folders = sorted((tmp_path / "b").glob("rank=*/block=*"))
    assert len(folders) > 30
    for folder in folders[:12]:
        for file in folder.glob("*.parquet"):
            steps = [r.step for r in spark.read.parquet(str(file)).collect()]
            assert steps == sorted(steps) and steps[-1] - steps[0] < 250


def test_byte_tokenizer(spark):
    texts = ["ab", "", None, "é😀", "x" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string").repartition(2)
    rows = {r.id: r for r in shape_sequences(df, 8, tokenizer=byte_tokenizer()).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert rows[i].input_ids is None
            continue
        ids = [b + 2 for b in text.encode()][:8]
        assert rows[i].input_ids == ids + [0] * (8 - len(ids))
        assert rows[i].labels == ids + [-100] * (8 - len(ids))


def test_tokenizer_is_made_once_a_task(spark, tmp_path):
    log = str(tmp_path / "made")

    def make():
        with open(log, "a") as f:
            f.write("x\n")
        return lambda texts: [[len(t)] for t in texts]

    df = spark.range(1000).select(F.col("id").cast("string").alias("prompt")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert shape_sequences(df, 1, tokenizer=tokenizer(make)).count() == 1000
        got = shape_sequences(df, 1, tokenizer=tokenizer(make)).agg(F.sum(F.col("input_ids")[0])).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sum(len(str(i)) for i in range(1000))
    assert len(open(log).read().split()) <= 2


def test_ids_in_arrays_stay_arrays():
    texts = pd.Series(["ab", None, ""])
    (made,) = byte_tokenizer().func(iter([texts]))
    assert isinstance(made[0], np.ndarray) and made[0].tolist() == [99, 100]
    assert made[1] is None and len(made[2]) == 0
    (made,) = tokenizer(lambda: lambda texts: [["7", 8.0] for _ in texts]).func(iter([texts]))
    assert made[0] == [7, 8]


def test_vocabulary_file(spark):
    tokenizers = pytest.importorskip("tokenizers")
    file = f"{VOCABULARIES}/byte_bpe_50k.json"
    if not os.path.exists(file):
        pytest.skip("no vocabulary file")
    plain = tokenizers.Tokenizer.from_file(file)
    texts = ["Hello there, world.", "", "été 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
    rows = {r.id: r for r in shape_sequences(df, 16, tokenizer=file_tokenizer(file)).collect()}
    for i, text in enumerate(texts):
        ids = plain.encode(text, add_special_tokens=False).ids[:16]
        assert rows[i].input_ids == ids + [0] * (16 - len(ids))


def test_files_grow_in_size_not_in_number(spark):
    samples = spark.range(20_000)
    made = epoch_batches(samples, ["id"], 2, 2, 4, steps_per_block=1)
    names = ["id", "position", "rank", "step", "batch_no"]
    plan = epoch_plan(samples, ["id"], 2, 2, 4)
    assert sorted(map(tuple, made.select(names).collect())) == sorted(map(tuple, plan.select(names).collect()))
    assert 500 < made.select("block").distinct().count() <= 1024  # 10,000 before


def test_files_of_blocks_are_written_by_many_tasks(spark):
    made = epoch_batches(spark.range(4000), ["id"], 1, 3, 4, steps_per_block=100)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # else adaptive execution gives them all to one task
