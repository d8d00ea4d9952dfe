"""Streams with state, and grounding of a stream against a table."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from parapet.catalog.queries import QUERIES
from parapet.operators.exchanges import guarded_exchanges, pair_turns
from parapet.operators.grounding import guard_outputs_join
from parapet.sources.messages import until_exit
from parapet.streaming.exchanges import (
    exchange_stream,
    grounded_batch,
    pair_stream,
    read_grounded,
    session_stream,
    write_grounded,
    write_stream,
)
from parapet.streaming.messages import read_message_stream

SCHEMA = "conv_id long, turn long, role string, text string, ts timestamp"
START = 1_704_067_200


def turn_rows(rnd, conversations=12, turns=9):
    texts = ["hi", "jailbreak now", "mail a@b.co", "you are an idiot, dumb and stupid", "the vpn is up", None]
    return [
        (c, t, "user" if t % 2 == 0 else rnd.choice(["assistant", "assistant", "system"]),
         rnd.choice(texts), START + 60 * t)
        for c in range(conversations) for t in range(turns) if t % 2 == 0 or rnd.random() < 0.8
    ]


def frame(spark, rows):
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, s long")
    return plain.select("conv_id", "turn", "role", "text", F.timestamp_seconds("s").alias("ts"))


def arrive(spark, parts, folder, transform, name=None):
    """Rows that come out after each part has arrived; every part is a run of its own."""
    name, out = name or f"s{uuid.uuid4().hex}", []
    for part in parts:
        frame(spark, part).write.mode("append").parquet(f"{folder}/in")
        rows = transform(read_message_stream(spark, f"{folder}/in", SCHEMA))
        query = write_stream(rows, f"{folder}/out", name, available_now=True)
        assert query.awaitTermination(300)
        out.append(spark.read.schema(rows.schema).parquet(f"{folder}/out"))
    return [sorted(map(str, df.filter("conv_id >= 0").collect())) for df in out[-1:]][0]


END = [(-1, 0, "user", "x", START + 10**8), (-1, 1, "assistant", "x", START + 10**8)]


def test_exchange_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = turn_rows(rnd)
    want = guarded_exchanges(pair_turns(frame(spark, rows), consecutive=True)).drop("ts")
    rnd.shuffle(rows)  # answers before their queries, and apart from them
    cut = len(rows) // 2
    got = arrive(
        spark, [rows[:cut], rows[cut:], END], str(tmp_path),
        lambda m: exchange_stream(m, delay="1 day").select(want.columns),
    )
    assert got == sorted(map(str, want.collect()))
    table = spark.read.parquet(str(tmp_path / "out")).filter("conv_id >= 0")
    blocked = table.filter("input.blocked")
    assert blocked.count() and blocked.filter("output is not null").count() == 0
    assert table.filter("response is null and output is not null").count() == 0


def test_late_and_missing_answers(spark, tmp_path):
    rows = [
        (1, 0, "user", "in time", START), (1, 1, "assistant", "a", START + 600),
        (2, 0, "user", "late", START), (2, 1, "assistant", "b", START + 601),
        (3, 0, "user", "never", START), (3, 2, "assistant", "not the next turn", START + 10),
        (4, 0, "user", "other role", START), (4, 1, "system", "c", START + 10),
    ]
    arrive(spark, [rows[::2], rows[1::2], END], str(tmp_path), lambda m: pair_stream(m, delay="1 hour"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("conv_id >= 0")
    assert {r.query: r.response for r in got.collect()} == {
        "in time": "a", "late": None, "never": None, "other role": None
    }


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    rows = turn_rows(random.Random(5), 4, 6)
    want = pair_turns(frame(spark, rows), consecutive=True)
    parts = [rows[i::3] for i in range(3)]
    got = arrive(
        spark, [*parts, END], str(tmp_path),
        lambda m: pair_stream(m, delay="1 day").drop("ts"), name=f"again{uuid.uuid4().hex}",
    )
    assert got == sorted(map(str, want.select("conv_id", "turn", "query", "response").collect()))


def test_sessions_end(spark, tmp_path):
    rnd = random.Random(7)
    words = ["hello", " Quit\n", "EXIT", "\tq", " ", "", "quit it", "hello", "hello", "hello", None]
    rows = [
        (c, t, rnd.choice(["user", "assistant"]), rnd.choice(words), START + 60 * t)
        for c in range(30) for t in range(12)
    ]
    want = []
    for c in range(30):
        for row in sorted(r for r in rows if r[0] == c):
            said = row[3].strip() if row[2] == "user" and row[3] is not None else row[3]
            if row[2] == "user" and said is not None and said.lower() in ("", "quit", "exit", "q"):
                break
            want.append((row[0], row[1], row[2], said))
    batch = until_exit(frame(spark, rows)).select("conv_id", "turn", "role", "text")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, batch.collect()), key=key) == want
    rnd.shuffle(rows)
    arrive(
        spark, [rows[:100], rows[100:], [(-1, 0, "user", "q", START + 10**8)]], str(tmp_path),
        lambda m: session_stream(m, delay="1 day"),
    )
    got = spark.read.parquet(str(tmp_path / "out")).filter("conv_id >= 0")
    got = got.select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert until_exit(frame(spark, rows).limit(0)).collect() == []


@pytest.fixture()
def told(spark):
    responses = [(i, f"The vpn is up {i}. It requires a{i} key and costs {i % 3} a@b.co.") for i in range(40)]
    sources = [(i % 20, f"vpn key {i} up requires costs") for i in range(60)]
    return (
        spark.createDataFrame(responses, "id long, response string"),
        spark.createDataFrame(sources, "id long, source_text string"),
    )


def test_grounded_stream_equals_batch(spark, told, tmp_path):
    responses, sources = told
    responses.repartition(4).write.parquet(str(tmp_path / "in"))
    want = guard_outputs_join(responses, sources, ["id"])
    stream = read_message_stream(spark, str(tmp_path / "in"), responses.schema, files_per_batch=1)
    name = f"g{uuid.uuid4().hex}"
    for _ in range(2):  # the second run finds nothing new
        query = write_grounded(stream, sources, str(tmp_path / "out"), name, ["id"], available_now=True)
        assert query.awaitTermination(300)
    got = read_grounded(spark, str(tmp_path / "out"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.filter("exists(output.checks, c -> c.name = 'hallucination')").count() > 0


def test_replayed_batch_adds_no_row(spark, told, tmp_path):
    responses, sources = told
    for _ in range(2):
        grounded_batch(responses, 3, sources, str(tmp_path / "out"), ["id"])
    grounded_batch(responses.limit(5), 4, sources, str(tmp_path / "out"), ["id"])
    assert read_grounded(spark, str(tmp_path / "out")).count() == 45


@pytest.mark.parametrize("query", ["guard_stream", "guard_stream_sources", "grounded_stream"])
def test_streams_of_a_table_in_parts(spark, tmp_path, query):
    texts = ["hi there, the vpn is up", "the vpn is up and it requires a key", "mail a@b.co", None]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", texts[(c + t) % 4]) for c in range(9) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    table.repartition(3).write.parquet(str(tmp_path / "parts" / "conversations.parquet"))
    (tmp_path / "file").mkdir()
    part = next((tmp_path / "one").glob("*.parquet"))
    (tmp_path / "file" / "conversations.parquet").write_bytes(part.read_bytes())
    got, want = (
        sorted(map(str, QUERIES[query](spark, str(tmp_path / f)).collect())) for f in ("parts", "file")
    )
    assert got == want and len(got) > 20
