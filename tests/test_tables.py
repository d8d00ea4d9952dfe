"""Table operators: joins, hot keys, pairing, reports, plans of epochs, metrics, vocabulary."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parapet.functions.grounding import grounding
from parapet.operators.epochs import epoch_plan
from parapet.operators.exchanges import guard_report, guarded_exchanges, pair_turns
from parapet.operators.grounding import _claim_words, grounding_join, guard_outputs_join
from parapet.operators.guards import guard_outputs, with_pii, with_toxicity
from parapet.operators.metrics import run_metrics, run_totals
from parapet.operators.reports import pii_by_type, toxicity_by_category
from parapet.operators.sequences import (
    encode_words,
    format_prompts,
    shape_sequences,
    vocabulary,
)

WORDS = "the vpn is a portal requires token. reset has days and users 90 login uses key".split()


def _text(rnd, n):
    return ". ".join(" ".join(rnd.choices(WORDS, k=rnd.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def told(spark):
    """Responses by key, a third of them and of the sources under one key."""
    rnd = random.Random(11)
    responses, sources = [], []
    for i in range(240):
        key = 0 if i % 3 == 0 else i
        responses.append((i, key, _text(rnd, rnd.randint(0, 5)) if i % 17 else None))
        if i % 5:
            for seq in range(rnd.randint(0, 3)):
                sources.append((key, seq, _text(rnd, rnd.randint(0, 2))))
    return (
        spark.createDataFrame(responses, "rid int, key int, response string"),
        spark.createDataFrame(sources, "key int, seq int, source_text string"),
        responses,
        sources,
    )


@pytest.mark.parametrize("fanout", [None, 1, 3])
def test_grounding_join_equals_grounding_in_the_row(told, fanout):
    df, src, responses, sources = told
    lists = src.groupBy("key").agg(F.collect_list("source_text").alias("sources"))
    in_row = df.join(lists, "key", "left").select(
        "rid", grounding(F.col("response"), F.col("sources")).alias("grounding")
    )
    joined = grounding_join(df, src, ["rid"], key=["key"], fanout=fanout)
    a, b = ({r.rid: r.grounding for r in x.collect()} for x in (in_row, joined))
    keys = {key for key, *_ in sources}
    checked = {rid for rid, key, text in responses if text is not None and key in keys}
    assert {rid: a[rid] for rid in checked} == {rid: g for rid, g in b.items() if g is not None}


def test_what_responses_of_one_key_carry_is_spread(spark):
    rows = [(i, 0, f"The vpn {i} is up and running.") for i in range(3000)]
    df = spark.createDataFrame(rows, "rid int, key int, response string")
    parts = _claim_words(df, ["rid"], ["key"], ["response"], "response").filter("_row is not null")
    sizes = [r["count"] for r in parts.groupBy("key", "_word").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 3000 / 20


def test_pairing_reads_no_turn_twice_by_a_join(spark):
    df = spark.createDataFrame([(1, 0, "user", "q")], "conv_id int, turn int, role string, text string")
    plan = pair_turns(df)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") == 1


def test_only_earlier_sources_count(spark):
    rnd = random.Random(12)
    turns = [(c, t, _text(rnd, 3)) for c in range(6) for t in range(1 + 20 * (c == 0) + c)]
    df = spark.createDataFrame(turns, "c int, t int, response string")
    src = df.select("c", F.col("t").alias("seq"), F.col("response").alias("source_text"))
    got = grounding_join(df, src, ["c", "t"], key=["c"], before=("t", "seq"), fanout=2).collect()
    rows = [(c, t, x, [z for d, u, z in turns if d == c and u < t] or None) for c, t, x in turns]
    in_row = spark.createDataFrame(rows, "c int, t int, response string, sources array<string>")
    judged = F.when(F.col("sources").isNotNull(), grounding(F.col("response"), F.col("sources")))
    expected = in_row.select("c", "t", judged.alias("grounding")).collect()
    assert {(r.c, r.t): r.grounding for r in got} == {(r.c, r.t): r.grounding for r in expected}


def test_output_guard_with_a_source_table(told):
    df, src, *_ = told
    lists = src.groupBy("key").agg(F.collect_list("source_text").alias("sources"))
    in_row = guard_outputs(df.join(lists, "key", "left"), text="response", sources="sources")
    joined = guard_outputs_join(df, src, ["rid"], key=["key"])
    a = {r.rid: r.output for r in in_row.select("rid", "output").collect()}
    b = {r.rid: r.output for r in joined.select("rid", "output").collect()}
    assert a == b and len(a) == 240


def test_pairing(spark):
    rnd = random.Random(13)
    dense, gappy = [], []
    for conv in range(8):
        turn = 0
        for t in range(3000 if conv == 0 else rnd.randint(0, 9)):
            role = rnd.choice(["user", "assistant", "assistant", "user", "system"])
            turn += rnd.choice([1, 1, 2, 700])
            dense.append((conv, t, role, f"{conv}-{t}"))
            gappy.append((conv, turn, role, f"{conv}-{t}"))

    def expected(turns):
        out = set()
        for a, b in zip(turns, [*turns[1:], (None, 0, "", "")]):
            if a[2] == "user":
                answered = b[0] == a[0] and b[2] == "assistant"
                out.add((a[0], a[1], a[3], b[3] if answered else None))
        return out

    schema = "conv_id int, turn int, role string, text string"
    for turns, consecutive in [(dense, True), (dense, False), (gappy, False)]:
        df = spark.createDataFrame(turns, schema).repartition(5)
        got = [tuple(r) for r in pair_turns(df, consecutive).collect()]
        assert set(got) == expected(turns) and len(got) == len(set(got))


def test_exchanges_and_report(spark):
    df = spark.createDataFrame(
        [
            (1, "How do I set up VPN?", "Write to help@x.com"),
            (2, "jailbreak", "never shown"),
            (3, "hello", None),
            (4, "hello", "I will shoot"),
        ],
        "turn int, query string, response string",
    )
    guarded = guarded_exchanges(df)
    got = {r.turn: r for r in guarded.collect()}
    assert got[1].output.text == "Write to [EMAIL]"
    assert got[2].input.blocked and got[2].output is None
    assert got[3].output is None and not got[3].input.blocked
    assert got[4].output.blocked
    counts = {(r.stage, r.name, r.status): r.n for r in guard_report(guarded).collect()}
    assert counts == {
        ("input", "injection", "pass"): 3, ("input", "toxicity", "pass"): 3,
        ("input", "pii_input", "pass"): 3, ("input", "injection", "blocked"): 1,
        ("output", "toxicity", "pass"): 1, ("output", "pii_output", "scrubbed"): 1,
        ("output", "toxicity", "blocked"): 1,
    }


def test_type_and_category_reports(spark):
    df = spark.createDataFrame(
        [("a@b.co c@d.co 123-45-6789",), ("x@y.zz",), ("stupid idiot bomb",), (None,)], "text string"
    )
    types = {r.type: (r.n_entities, r.n_texts) for r in pii_by_type(with_pii(df)).collect()}
    assert types == {"email": (3, 2), "ssn": (1, 1)}
    flags = toxicity_by_category(with_toxicity(df)).collect()
    assert {r.category: (r.n_texts, r.n_matches) for r in flags} == {
        "threat": (1, 1), "harassment": (1, 2),
    }


@pytest.mark.parametrize("n, world, batch", [(10, 4, 2), (1, 7, 4), (3, 8, 1), (500, 3, 16), (8, 1, 4)])
def test_epoch_plan(spark, n, world, batch):
    df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
    got = sorted(epoch_plan(df, ["k"], 5, world, batch).collect(), key=lambda r: r.position)
    order = sorted(range(n), key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
    total = -(-n // world) * world
    assert [r.k for r in got] == [order[p % n] for p in range(total)]
    for p, r in enumerate(got):
        assert (r.position, r.rank, r.step) == (p, p % world, p // world)
        assert r.batch_no == p // world // batch


def test_epoch_plan_shape_and_reshuffle(spark):
    df = spark.range(10)
    plan = epoch_plan(df, ["id"], 0, 4, 2).collect()
    assert len(plan) == 12 and set(Counter(r["rank"] for r in plan).values()) == {3}
    sizes = Counter((r["rank"], r.batch_no) for r in plan)
    assert sorted(sizes.values()) == [1] * 4 + [2] * 4
    other = epoch_plan(df, ["id"], 1, 4, 2).collect()
    assert [r.id for r in plan] != [r.id for r in other]
    again = epoch_plan(df.repartition(7), ["id"], 0, 4, 2).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))


def test_run_metrics(spark):
    start = datetime(2024, 1, 1)
    losses = {"a": [3.0, 2.0, 2.0, 1.0], "b": [1.0]}
    steps = [
        (run, e, s, loss + d, start + timedelta(seconds=10 * e + s))
        for run, series in losses.items()
        for e, loss in enumerate(series, 1)
        for s, d in ((0, -0.5), (4, 0.5))
    ]
    steps.append(("c", 1, 0, None, start))
    df = spark.createDataFrame(steps, "run_id string, epoch int, step int, loss double, ts timestamp")
    got = {(r.run_id, r.epoch): r for r in run_metrics(df, dataset_size=100).collect()}
    assert [e for e in range(1, 5) if got["a", e].is_best] == [1, 2, 4]
    assert [got["a", e].loss for e in range(1, 5)] == losses["a"]
    assert (got["a", 1].time_s, got["a", 1].throughput) == (4.0, 25.0)
    assert (got["c", 1].loss, got["c", 1].throughput, got["c", 1].is_best) == (0.0, None, True)
    per_step = run_metrics(df, batch_size=6).filter("run_id = 'b'").first()
    assert per_step.throughput == 3.0


def test_diverged_epochs_are_never_the_best(spark):
    nan, inf = float("nan"), float("inf")
    losses = {"a": [nan, 3.0, nan, 2.0], "b": [inf, 1.0, inf, 0.5], "c": [nan], "d": [2.0, nan, 1.0]}
    steps = [(run, e, x, datetime(2024, 1, 1)) for run, xs in losses.items() for e, x in enumerate(xs)]
    df = spark.createDataFrame(steps, "run_id string, epoch int, loss double, ts timestamp")
    epochs = run_metrics(df)
    best = sorted((r.run_id, r.epoch) for r in epochs.filter("is_best").collect())
    assert best == [("a", 1), ("a", 3), ("b", 1), ("b", 3), ("d", 0), ("d", 2)]
    assert {(r.run_id, r.n_epochs, r.best_loss) for r in run_totals(epochs).collect()} == {
        ("a", 4, 2.0), ("b", 4, 0.5), ("c", 1, None), ("d", 3, 1.0)}


def test_best_epoch_of_a_long_run(spark):
    rnd = random.Random(14)
    losses = [round(1000 - e / 20 + rnd.random() * 40, 3) for e in range(9000)]
    df = spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double").selectExpr(
        "'r' as run_id", "epoch", "0 as step", "loss", "timestamp_seconds(epoch) as ts"
    )
    best, low = [], float("inf")
    for e, loss in enumerate(losses):
        if loss < low:
            low = loss
            best.append(e)
    got = run_metrics(df).filter("is_best").select("epoch").collect()
    assert sorted(r.epoch for r in got) == best


def test_vocabulary_and_encoding(spark):
    rnd = random.Random(15)
    long_word = "x" * 200
    texts = []
    for i in range(300):
        words = rnd.choices(WORDS, k=rnd.randint(0, 30)) + [f"w{rnd.randint(0, 400)}", long_word]
        texts.append((i, "  ".join(words)))
    df = spark.createDataFrame(texts, "k int, prompt string")
    vocab = vocabulary(df)
    count = Counter(w for _, t in texts for w in t.split())
    ranked = sorted(count, key=lambda w: (-count[w], hashlib.md5(w.encode()).hexdigest(), w))
    assert {r.word: (r.n, r.id) for r in vocab.collect()} == {
        w: (count[w], i + 2) for i, w in enumerate(ranked)
    }
    place = {w: i + 2 for i, w in enumerate(ranked)}
    small = vocab.filter(F.col("word") != "w7")
    got = {r.k: r.ids for r in encode_words(df, small, ["k"], max_length=12).collect()}
    for k, text in texts:
        assert got[k] == [1 if w == "w7" else place[w] for w in text.split()[:12]]


def test_samples_without_words_stay(spark):
    texts = [(1, "alpha beta"), (2, None), (3, ""), (4, "   "), (5, "beta")]
    df = spark.createDataFrame(texts, "k int, prompt string")
    got = {r.k: r.ids for r in encode_words(df, vocabulary(df), ["k"]).collect()}
    assert got == {1: [3, 2], 2: None, 3: [], 4: [], 5: [2]}
    shaped = {r.k: r.input_ids for r in shape_sequences(encode_words(df, vocabulary(df), ["k"]), 2).collect()}
    assert shaped == {1: [3, 2], 2: None, 3: [0, 0], 4: [0, 0], 5: [2, 0]}


def test_rare_words_meet_the_rest_of_the_vocabulary(spark, monkeypatch):
    from parapet.operators import sequences as S

    texts = [(i, f"a b w{i} w{i % 7} {'y' * 80}{i % 3}") for i in range(60)]
    df = spark.createDataFrame(texts, "k int, prompt string")
    vocab = vocabulary(df)
    whole = {r.k: r.ids for r in encode_words(df, vocab, ["k"]).collect()}
    monkeypatch.setattr(S, "_FREQUENT_WORDS", 4)
    split = {r.k: r.ids for r in encode_words(df, vocab, ["k"]).collect()}
    assert whole == split and len(whole) == 60


def test_sequences(spark):
    df = spark.createDataFrame(
        [(1, [5, 6, 7]), (2, list(range(1, 8))), (3, [0, 9]), (4, []), (5, None)],
        "k int, ids array<int>",
    )
    got = {r.k: r for r in shape_sequences(df, 5, pad_id=0).collect()}
    assert tuple(got[1])[1:] == ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0], [5, 6, 7, -100, -100])
    assert tuple(got[2])[1:] == ([1, 2, 3, 4, 5], [1] * 5, [1, 2, 3, 4, 5])
    assert tuple(got[3])[1:] == ([0, 9, 0, 0, 0], [1, 1, 0, 0, 0], [0, 9, -100, -100, -100])
    assert tuple(got[4])[1:] == ([0] * 5, [0] * 5, [-100] * 5)
    assert tuple(got[5])[1:] == (None, None, None)


def test_prompts_and_a_caller_tokenizer(spark):
    import pandas as pd

    df = spark.createDataFrame(
        [(1, "I", None, "O"), (2, "I", "", "O"), (3, "I", " \n", "O"), (4, "I", " x ", "O")],
        "k int, instruction string, input string, output string",
    )
    head = (
        "Below is an instruction that describes a task. Write a response that appropriately "
        "completes the request.\n\n### Instruction:\nI\n\n"
    )
    short, long = head + "### Response:\nO", head + "### Input:\n x \n\n### Response:\nO"
    got = format_prompts(df).orderBy("k")
    assert [r.prompt for r in got.collect()] == [short] * 3 + [long]

    @F.pandas_udf("array<int>")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(w) for w in t.split()])

    shaped = shape_sequences(got, 40, tokenizer=lengths).orderBy("k").collect()
    n = len(short.split())
    assert shaped[0].input_ids == [len(w) for w in short.split()] + [0] * (40 - n)
    assert sum(shaped[0].attention_mask) == n


def test_resolved_words_do_not_travel(spark):
    words = [("common", 2), ("rare", 2 + 131_072), ("rarer", 2 + 131_073)]
    vocab = spark.createDataFrame(words, "word string, id long")
    texts = [(1, "a", "rare common"), (1, None, "common rarer"), (None, None, "new rare common"), (2, "a", None), (3, "a", " ")]
    samples = spark.createDataFrame(texts, "doc long, part string, prompt string")
    made = encode_words(samples, vocab, ["doc", "part"])
    plan = made._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert moved and not any("_known" in columns or "_row" in columns for columns in moved)
    got = {(r.doc, r.part): r.ids for r in made.collect()}
    assert got == {
        (1, "a"): [131_074, 2], (1, None): [2, 131_075], (None, None): [1, 131_074, 2], (2, "a"): None, (3, "a"): [],
    }


def test_texts_do_not_move_to_be_encoded(spark, monkeypatch):
    from parapet.operators import sequences as S

    monkeypatch.setattr(S, "_SLICE", 7)  # many blocks, and samples that share a key in several
    monkeypatch.setattr(S, "_BLOCK_BYTES", 100)
    blanks = [" ", "\t", "\u00a0", "\u2003\x1c", "\u3000\n", "\x85"]
    rnd = random.Random(6)
    texts = [
        (i % 90 if i % 5 else None, rnd.choice(blanks).join(["", *rnd.choices(WORDS, k=rnd.randint(0, 9)), f"ä{i % 9}", ""]))
        for i in range(100)
    ]
    texts += [(1000, None), (1001, " "), (1002, None), (1002, None)]
    df = spark.createDataFrame(texts, "k int, prompt string")
    vocab = spark.createDataFrame(vocabulary(df).collect())
    place = {r.word: r.id for r in vocab.collect()}
    made = encode_words(df, vocab, ["k"], max_length=6)
    plan = made._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert moved and not any("_text" in columns or "prompt" in columns for columns in moved)
    want = {}
    for k, text in texts:
        words = enumerate((text or "").split()[:6])
        want.setdefault(k, [text is None, []])[1].extend((at, place[w]) for at, w in words)
    want = {k: None if none else [i for _, i in sorted(ids)] for k, (none, ids) in want.items()}
    got = made.collect()
    assert {r.k: r.ids for r in got} == want and len(got) == len(want)
