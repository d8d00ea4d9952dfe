"""Registered queries against their SQL on the smallest tables, and the shape of their plans."""

import os
import re

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from parapet.catalog.oracle import ORACLE
from parapet.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= queries().keys() and ORACLE.keys() <= oracle_sql().keys()


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["conv_id", "turn"] and df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    wrong, _ = compare.differences(spark, con, name, SF)
    assert wrong is None, wrong


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("guard_stream")])
def test_no_all_pairs_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    allowed = {"Python"} if name == "sequences_tokenized" else set()  # a caller's tokenizer
    for operator in {"CartesianProduct", "BroadcastNestedLoopJoin", "Python", "CollectLimit"} - allowed:
        assert operator not in plan


# Rows that reach one task: one row per task, or at most one per digest or sketch bucket.
BOUNDED_SINGLE = {
    "corpus_summary", "dataset_size", "epoch_plan", "vocabulary", "sequences", "raw_summary",
    "grounding_history", "grounding_attached", "output_guard_join",
}


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("guard_stream")])
def test_single_task_stages_are_bounded(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert ("SinglePartition" in plan) <= (name in BOUNDED_SINGLE)


@pytest.mark.parametrize(
    "name, exchanges",
    [("pii_mask", 0), ("toxicity_scores", 0), ("input_guard", 0), ("guard_messages", 0),
     ("clean_text", 0), ("chunks", 0), ("instruction_pairs", 0), ("prompts", 0)],
)
def test_text_work_does_not_shuffle(spark, name, exchanges):
    plan = plan_of(queries()[name](spark, SF))
    assert len(re.findall(r"Exchange \w+", plan)) == exchanges


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(queries()["pii_mask"](spark, SF))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)
    plan = plan_of(queries()["input_guard"](spark, SF))
    assert re.search(r"PushedFilters: \[IsNotNull\(role\), EqualTo\(role,user\)\]", plan)
    plan = plan_of(queries()["epoch_plan"](spark, SF))
    assert set(re.findall(r"ReadSchema: (\S+)", plan)) == {"struct<doc_id:bigint>"}


@pytest.mark.parametrize("name", ["pii_entities", "guarded_exchanges_grounded", "chunks"])
def test_patterns_run_once_per_row(spark, name):
    """Each text column's scan for one type stands once in the plan, in no pushed-down filter."""
    plan = plan_of(queries()[name](spark, SF))
    texts = 2 if name.startswith("guarded") else 1
    if name == "chunks":
        assert plan.count("split(") == 1
    else:
        assert plan.count("regexp_extract_all") == 8 * texts
    assert not re.search(r"Filter .*(regexp|RLIKE)", plan)


def test_steps_are_rolled_up_once(spark):
    df = queries()["run_metrics"](spark, SF)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("partial_avg") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("name", ["epoch_plan", "vocabulary", "grounding_history", "run_metrics"])
def test_results_do_not_depend_on_partitions(spark, name):
    query = queries()[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df = query(spark, SF)
            results.append(compare.rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
