"""Files in and out, messages, streams."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from parapet.functions.documents import decode_text, topic
from parapet.operators.documents import chunk_documents, corpus_summary, instruction_pairs
from parapet.operators.epochs import epoch_plan
from parapet.operators.guards import guard_messages
from parapet.operators.metrics import run_metrics
from parapet.plans.corpus import documents_to_pairs, prepare_corpus, training_sequences
from parapet.session import shared_folder
from parapet.sources.documents import read_documents
from parapet.sources.hidden import Folder
from parapet.sources.messages import clean_messages
from parapet.sources.samples import (
    dataset_size,
    read_samples,
    write_epoch_plan,
    write_history,
    write_samples,
)
from parapet.streaming.messages import guard_stream, read_message_stream, write_guarded


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "raw docs"
    (root / "deep" / "er").mkdir(parents=True)
    words = " ".join(f"w{i}" for i in range(600))
    files = {
        "a.md": b"# Title\r\n\r\n\r\n\r\nSome **bold** text with a [link](http://x).\rEnd",
        "deep/B.MD": words.encode(),
        "deep/er/c d.Text": "good\x80bad".encode("latin-1") + "� kept".encode(),
        "e.txt": b"",
        "f.pdf": b"skip me",
        "g.md.bak": b"skip me too",
        "_h.md": b"hidden",
        "deep/.i+j %20.TXT": b"with\r\na dot",
        "deep/_k=l.md": b"not hidden",
        "deep/.git/m/n.text": b"in a hidden folder",
        "deep/.git/o.png": b"skip",
        "p.md._COPYING_": b"skip",
        "deep/er/q+r {s}[t].md": b"",
    }
    (root / "deep" / ".git" / "m").mkdir(parents=True)
    for name, content in files.items():
        (root / name).write_bytes(content)
    return str(root)


def test_document_scan(spark, corpus):
    got = {r.source: r for r in read_documents(spark, corpus).collect()}
    assert sorted(got) == [
        ".i+j %20.TXT", "B.MD", "_h.md", "_k=l.md", "a.md", "c d.Text", "e.txt", "n.text", "q+r {s}[t].md",
    ]
    assert got["e.txt"].text == got["q+r {s}[t].md"].text == ""
    assert got["_h.md"].text == "hidden" and got["_h.md"].path.endswith("/raw docs/_h.md")
    assert got[".i+j %20.TXT"].text == "with\na dot"
    assert got["n.text"].path.endswith("/deep/.git/m/n.text")
    assert got["a.md"].text.startswith("# Title\n\n\n\nSome") and got["a.md"].text.endswith("\nEnd")
    assert got["c d.Text"].text == "goodbad� kept"
    assert got["B.MD"].path.endswith("/raw docs/deep/B.MD")
    assert read_documents(spark, corpus, partitions=3).count() == 9
    assert corpus_summary(read_documents(spark, corpus)).first().n_files == 9


def test_only_document_files_are_listed(spark, corpus):
    files = read_documents(spark, corpus).inputFiles()
    assert files and not any(f.endswith((".pdf", ".bak", ".png")) for f in files)


def test_folder_without_hidden_or_empty_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("one")
    assert [tuple(r)[1:] for r in read_documents(spark, str(tmp_path / "x")).collect()] == [("a.md", "one")]
    (tmp_path / "y").mkdir()
    assert read_documents(spark, str(tmp_path / "y")).collect() == []


def test_decoding_equals_python(spark):
    rnd = random.Random(21)
    pieces = [
        b"a", b"\r", b"\n", b"\r\n", b"\x80", b"\xff", b"\xe2", b"\xe2\x82", b"\xf0\x9f\x98",
        b"\xc0\xaf", b"\xed\xa0\x80", "é".encode(), "😀".encode(), "�".encode(),
        "﷐".encode(), b"0", b"1",
    ]
    values = [(i, b"".join(rnd.choices(pieces, k=rnd.randint(0, 12)))) for i in range(3000)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in values], "id int, content binary")
    got = {r.id: r.t for r in df.select("id", decode_text(F.col("content")).alias("t")).collect()}
    for i, raw in values:
        text = raw.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
        assert got[i] == text, raw


@pytest.mark.parametrize(
    "n, sizes",
    [(0, []), (20, []), (21, [21]), (450, [450]), (470, [470]), (471, [471, 21]),
     (500, [500, 50]), (501, [500, 51])],
)
def test_chunk_boundaries(spark, n, sizes):
    df = spark.createDataFrame([("p", "s", " ".join(["w"] * n))], "path string, source string, text string")
    chunks = chunk_documents(df)
    assert [r.n_words for r in chunks.orderBy("chunk_no").collect()] == sizes
    pairs = instruction_pairs(chunks).count()
    assert pairs == sum(2 if s > 50 else 1 for s in sizes)
    total = corpus_summary(df).first()
    assert tuple(total) == (1, len(sizes), pairs)


def test_chunk_parameters(spark):
    df = spark.createDataFrame([("p", "s", " ".join(["w"] * 99))], "path string, source string, text string")
    with pytest.raises(ValueError):
        chunk_documents(df, chunk_size=50, overlap=50)
    assert chunk_documents(df, chunk_size=20, overlap=5).count() == 0
    for size, overlap in [(30, 10), (60, 15), (51, 1)]:
        chunks = chunk_documents(df, chunk_size=size, overlap=overlap)
        total = corpus_summary(df, chunk_size=size, overlap=overlap).first()
        assert (total.n_chunks, total.n_pairs) == (chunks.count(), instruction_pairs(chunks).count())


def test_instruction_pairs(spark):
    long = "Reset, the VPN now please: ok. " + " ".join(f"word{i}" for i in range(60)) + "."
    df = spark.createDataFrame([("p", "s", long)], "path string, source string, text string")
    direct, summary = instruction_pairs(chunk_documents(df)).orderBy("pair_no").collect()
    about = "reset, the vpn now please: ok"
    assert direct.instruction == f"What does the documentation say about {about}?"
    assert (direct.input, direct.output) == ("", long)
    assert summary.instruction == f"Summarize the key points about {about}."
    assert summary.input == long and summary.output == long + "."


def test_topic(spark):
    cases = {
        "One two three four five six, seven.": "one two three four five six",
        "  A:;, . rest": "a",
        "no stop": "no stop",
        ".x": "",
        "": "",
        "ÉTÉ İx": "été i̇x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "chunk string")
    got = {r.chunk: r.t for r in df.select("chunk", topic(F.col("chunk")).alias("t")).collect()}
    assert got == cases


def test_corpus_to_jsonl_and_back(spark, corpus, tmp_path):
    out = str(tmp_path / "pairs")
    prepare_corpus(spark, corpus, out)
    back = read_samples(spark, out)
    made = documents_to_pairs(read_documents(spark, corpus))
    names = ["instruction", "input", "output", "source"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.select(*names).collect()))
    assert dataset_size(back).first().n_samples == made.count() == 4
    lines = [x for f in (tmp_path / "pairs").glob("part-*") for x in f.read_text().splitlines()]
    assert all(list(json.loads(x)) == names for x in lines)


def test_samples_reading_rules(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "s.jsonl").write_text(
        '{"instruction": "i", "output": "o"}\n\n   \n{"instruction": "j", "input": "x", "output": "p"}\n'
    )
    rows = read_samples(spark, str(tmp_path / "ok")).orderBy("instruction").collect()
    assert [(r.instruction, r.input, r.output) for r in rows] == [("i", None, "o"), ("j", "x", "p")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "s.jsonl").write_text('{"instruction": "i"\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        read_samples(spark, str(tmp_path / "bad")).collect()


def test_pairs_with_nulls_keep_their_keys(spark, tmp_path):
    df = spark.createDataFrame([("i", None, "o", "s")], "instruction string, input string, output string, source string")
    write_samples(df, str(tmp_path / "n"))
    line = "".join(f.read_text() for f in (tmp_path / "n").glob("part-*"))
    assert list(json.loads(line)) == ["instruction", "input", "output", "source"]


def test_training_sequences_from_files(spark, corpus, tmp_path):
    import pandas as pd

    @F.pandas_udf("array<int>")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(w) for w in t.split()])

    prepare_corpus(spark, corpus, str(tmp_path / "p"))
    rows = training_sequences(spark, str(tmp_path / "p"), lengths, max_length=8).collect()
    assert len(rows) == 4 and all(len(r.labels) == 8 for r in rows)


def test_history_and_plan_sinks(spark, tmp_path):
    steps = spark.createDataFrame(
        [("r", 1, 0, 2.0, "2024-01-01 00:00:00"), ("r", 1, 1, 1.0, "2024-01-01 00:00:02")],
        "run_id string, epoch int, step int, loss double, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    write_history(run_metrics(steps, batch_size=4), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).first().throughput == 4.0
    plan = epoch_plan(spark.range(50), ["id"], 1, 3, 4)
    write_epoch_plan(plan, str(tmp_path / "plan"))
    assert sorted(p.name for p in (tmp_path / "plan").glob("rank=*")) == [f"rank={r}" for r in range(3)]
    back = spark.read.parquet(str(tmp_path / "plan")).select(plan.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plan.collect()))


def test_messages(spark):
    values = [" hi\n", "", " \t", "quit", " EXIT ", "Q", "quit now", None, " q "]
    rows = [(v, role) for v in values for role in ("user", "assistant", None)]
    df = spark.createDataFrame(rows, "text string, role string")
    got = clean_messages(df).collect()
    assert [r.text for r in got if r.role == "user"] == ["hi", "quit now", None]
    for role in ("assistant", None):  # as they came
        assert [r.text for r in got if r.role == role] == values


def test_samples_without_a_field_fail(spark, tmp_path):
    (tmp_path / "s").mkdir()
    lines = ['{"instruction": "a", "output": "b"}', "", '{"instruction": "c"}']
    (tmp_path / "s" / "x.json").write_text("\n".join(lines))
    with pytest.raises(Exception, match="a sample has no output"):
        read_samples(spark, str(tmp_path / "s")).collect()


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(22)
    texts = ["hi ", "quit", "a@b.co", "jailbreak", "stupid idiot dumb", "The vpn is up", None, "bomb"]
    rows = [
        (i, i % 5, rnd.choice(["user", "assistant", "system"]), rnd.choice(texts)) for i in range(200)
    ]
    df = spark.createDataFrame(rows, "turn int, conv_id int, role string, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    known = [(c, [f"The vpn is up {c}", "x"]) for c in range(3)]
    src = spark.createDataFrame(known, "conv_id int, sources array<string>")

    out = str(tmp_path / "out")
    stream = read_message_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    for _ in range(2):  # the second run finds nothing new
        query = write_guarded(guard_stream(stream, sources=src), out, "t1", available_now=True)
        assert query.awaitTermination(120)
    batch = guard_messages(df.join(src, "conv_id", "left"), sources="sources")
    got = spark.read.parquet(out).select(batch.columns)
    other = "role <> 'user'"  # batch takes these as they are, and so does the stream
    assert sorted(map(str, got.filter(other).collect())) == sorted(map(str, batch.filter(other).collect()))
    asked = {(r.turn, r.text) for r in got.filter("role = 'user'").collect()}
    assert asked == {(t, x and x.strip()) for t, _, role, x in rows if role == "user" and x != "quit"}
    assert any(c.name == "hallucination" for r in got.collect() if r.output for c in r.output.checks)


def test_shared_folder(spark):
    class Bare:
        class conf:
            get = None

    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x") == f"{root}/x"
    Bare.conf.get = staticmethod(lambda key, *_: {"spark.sql.warehouse.dir": "/w"}.get(key))
    assert shared_folder(Bare, "x") == "/w/x"


def test_hidden_files_are_copied_at_the_same_time(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    for name in ("_a.md", ".b.txt", ".git/c.text", ".git/d.md"):
        (tmp_path / "in" / name).write_text(name)
    met, copy = threading.Barrier(4, timeout=60), Folder.copy

    def wait(self, source, target):
        met.wait()  # broken unless four copies are under way
        copy(self, source, target)

    monkeypatch.setattr(Folder, "copy", wait)
    got = read_documents(spark, str(tmp_path / "in")).collect()
    assert sorted((r.source, r.text) for r in got) == [
        (".b.txt", ".b.txt"), ("_a.md", "_a.md"), ("c.text", ".git/c.text"), ("d.md", ".git/d.md"),
    ]
