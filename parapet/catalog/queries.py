"""Registered queries over the given tables. Each takes the session and the table folder."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.catalog.probes import probed
from parapet.functions.documents import clean_text as clean
from parapet.functions.grounding import grounding
from parapet.functions.text import tokens
from parapet.functions.toxicity import injection_match
from parapet.operators.batches import epoch_batches, read_batches, write_batches
from parapet.operators.documents import chunk_documents, corpus_summary, instruction_pairs
from parapet.operators.epochs import epoch_plan
from parapet.operators.exchanges import guard_report, guarded_exchanges, pair_turns
from parapet.operators.grounding import grounding_join, guard_outputs_join
from parapet.operators.guards import (
    guard_inputs,
    guard_messages,
    guard_outputs,
    with_pii,
    with_toxicity,
)
from parapet.operators.long_documents import chunk_lines, read_document_lines
from parapet.operators.metrics import epoch_rollup, run_metrics, run_totals
from parapet.operators.reports import pii_by_type, toxicity_by_category
from parapet.operators.rows import unfold
from parapet.operators.sequences import (
    encode_words,
    format_prompts,
    shape_sequences,
    vocabulary,
)
from parapet.operators.tokenizers import byte_tokenizer
from parapet.session import shared_folder
from parapet.sources.documents import read_documents
from parapet.sources.hidden import Folder
from parapet.sources.messages import clean_messages, until_exit
from parapet.sources.samples import (
    dataset_size,
    read_history,
    read_samples,
    write_epoch_plan,
    write_history,
    write_samples,
)
from parapet.streaming.exchanges import (
    exchange_stream,
    read_grounded,
    session_stream,
    write_grounded,
    write_stream,
)
from parapet.streaming.messages import guard_stream, read_message_stream, write_guarded

DOC, TURN = ("doc_id",), ("conv_id", "turn")
SAMPLE = (*DOC, "chunk_no", "pair_no")
# Settings of the guards that differ from the defaults.
OWN_SETTINGS = {
    "injection_patterns": ("you are now free", "pirate", "the service"),
    "hallucination_threshold": 0.95,
    "toxicity_threshold": 0.2,
}


# --- tables ----------------------------------------------------------------------------
def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return _table(spark, sf, name).select(*columns)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, each with a probe appended."""
    docs = _texts(spark, sf, "documents", "doc_id", "source", "text")
    return docs.select("doc_id", "source", probed(F.col("text"), F.col("doc_id")).alias("text"))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations, each turn with a probe appended."""
    turns = _texts(spark, sf, "conversations", *TURN, "role", "text")
    key = F.col("conv_id") * 31 + F.col("turn")
    return turns.select(*TURN, "role", probed(F.col("text"), key).alias("text"))


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    """Query and response pairs; the turns of the given table are numbered without gaps."""
    return pair_turns(_conversations(spark, sf), consecutive=True)


def _exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Query and response pairs; sources are the query, and for some the response or half of it."""
    pairs = _paired(spark, sf)
    response = F.col("response")
    return pairs.withColumn(
        "sources", F.concat(F.array("query"), _own_sources(F.col("conv_id"), response))
    )


def _half(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))


def _own_sources(conv_id: Column, response: Column) -> Column:
    none = F.array().cast("array<string>")
    whole = F.when((conv_id % 2 == 0) & response.isNotNull(), F.array(response)).otherwise(none)
    half = F.when((conv_id % 3 == 0) & response.isNotNull(), F.array(_half(response)))
    return F.concat(whole, half.otherwise(none))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _conversations(spark, sf)
        .filter(F.col("role") == "assistant")
        .select(*TURN, F.col("text").alias("response"))
    )


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by conversation: every turn, and some responses or halves just before themselves."""
    told = _conversations(spark, sf)
    own = F.when(F.col("role") == "assistant", _own_sources(F.col("conv_id"), F.col("text")))
    own = F.transform(
        F.coalesce(own, F.array().cast("array<string>")),
        lambda t: F.struct((F.col("turn") - 1).alias("seq"), t.alias("source_text")),
    )
    turn = F.array(F.struct(F.col("turn").alias("seq"), F.col("text").alias("source_text")))
    return unfold(told, ["conv_id"], F.concat(turn, own), "s", "no").select(
        "conv_id", "s.seq", "s.source_text"
    )


def _attached(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by response: some responses whole, some by half, for the rest none."""
    said = _responses(spark, sf)
    own = _own_sources(F.col("conv_id"), F.col("response"))
    return unfold(said, TURN, own, "source_text", "seq")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _texts(spark, sf, "documents", "doc_id", "text")
    return instruction_pairs(chunk_documents(docs, DOC), DOC)


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return format_prompts(_pairs(spark, sf)).select(*SAMPLE, "prompt")


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Events as step metrics: the type is the run, the day the epoch, the value the loss."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return _table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), day.alias("epoch"),
        F.col("event_id").alias("step"), F.col("value").alias("loss"), "ts",
    )


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh shared folder."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


# --- flat views of result structs --------------------------------------------------------
def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _checks(guard: str) -> Column:
    listed = F.transform(
        F.col(f"{guard}.checks"), lambda c: F.concat_ws(":", c["name"], c["status"], c["details"])
    )
    return F.array_join(listed, ";")


def _flat_guard(guard: str, prefix: str = "") -> list[Column]:
    return [
        F.col(f"{guard}.blocked").alias(f"{prefix}blocked"),
        F.col(f"{guard}.text").alias(f"{prefix}text"),
        F.col(f"{guard}.reason").alias(f"{prefix}reason"),
        _checks(guard).alias(f"{prefix}checks"),
    ]


def _flat_grounding(g: str = "grounding") -> list[Column]:
    return [
        F.col(f"{g}.score").alias("score"),
        F.col(f"{g}.flagged").alias("flagged"),
        F.col(f"{g}.total_claims").cast("bigint").alias("total_claims"),
        F.col(f"{g}.supported_claims").cast("bigint").alias("supported_claims"),
        F.array_join(F.col(f"{g}.unsupported_claims"), " | ").alias("unsupported_claims"),
    ]


# --- personal data -----------------------------------------------------------------------
def pii_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = with_pii(_documents(spark, sf))
    return unfold(found, DOC, F.col("pii.entities"), "e", "entity_no").select(
        "doc_id", *_long("entity_no"), "e.type", "e.value",
        F.col("e.start").cast("bigint").alias("start_at"),
        F.col("e.end").cast("bigint").alias("end_at"),
    )


def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    return with_pii(_documents(spark, sf)).select(
        "doc_id", "pii.has_pii",
        F.size("pii.entities").cast("bigint").alias("n_entities"), "pii.masked_text",
    )


def pii_types(spark: SparkSession, sf: str) -> DataFrame:
    return pii_by_type(with_pii(_documents(spark, sf)))


# --- toxicity and injection --------------------------------------------------------------
def toxicity_scores(spark: SparkSession, sf: str) -> DataFrame:
    flags = F.transform(
        "toxicity.flagged_categories", lambda f: F.concat_ws("=", f["category"], f["matches"])
    )
    return with_toxicity(_documents(spark, sf)).select(
        "doc_id", "toxicity.is_toxic", "toxicity.score", F.array_join(flags, ",").alias("flagged")
    )


def toxicity_flags(spark: SparkSession, sf: str) -> DataFrame:
    scored = with_toxicity(_conversations(spark, sf))
    return unfold(scored, TURN, F.col("toxicity.flagged_categories"), "f", "no").select(
        *TURN, "f.category", "f.score", F.col("f.matches").cast("bigint").alias("matches")
    )


def toxicity_categories(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_by_category(with_toxicity(_documents(spark, sf)))


def injection_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return _conversations(spark, sf).select(
        *TURN, injection_match(F.lower("text")).alias("phrase")
    )


# --- guards --------------------------------------------------------------------------------
def input_guard(spark: SparkSession, sf: str) -> DataFrame:
    asked = _conversations(spark, sf).filter(F.col("role") == "user")
    return guard_inputs(asked).select(*TURN, *_flat_guard("input"))


def output_guard(spark: SparkSession, sf: str) -> DataFrame:
    answered = _exchanges(spark, sf)
    return guard_outputs(answered, text="response", sources="sources").select(
        *TURN, *_flat_guard("output")
    )


def output_guard_join(spark: SparkSession, sf: str) -> DataFrame:
    guarded = guard_outputs_join(_responses(spark, sf), _attached(spark, sf), TURN)
    return guarded.select(*TURN, *_flat_guard("output"))


def guarded_messages(spark: SparkSession, sf: str) -> DataFrame:
    return guard_messages(_conversations(spark, sf)).select(
        *TURN, "role", *_flat_guard("input", "input_"), *_flat_guard("output", "output_")
    )


def _streamed(spark: SparkSession, sf: str, sources: DataFrame | None = None) -> DataFrame:
    """The given conversations, led by blanks, as a guarded stream, landed and read back."""
    schema = _table(spark, sf, "conversations").schema
    stream = read_message_stream(spark, sf, schema, table="conversations.parquet")
    key = F.col("conv_id") * 31 + F.col("turn")
    salted = stream.withColumn("text", F.concat(F.lit("\n "), probed(F.col("text"), key)))
    out = _scratch(spark, "guarded-messages")
    query = write_guarded(
        guard_stream(salted, sources=sources), f"{out}/rows", f"guarded_{uuid.uuid4().hex}",
        available_now=True,
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        *TURN, "role", *_flat_guard("input", "input_"), *_flat_guard("output", "output_")
    )


def guarded_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf)


def guarded_stream_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The stream with a static table of sources: two queries of every conversation."""
    asked = _table(spark, sf, "conversations").filter("role = 'user'")
    two = F.array(F.min("text"), F.max("text"))
    return _streamed(spark, sf, asked.groupBy("conv_id").agg(two.alias("sources")))


def grounded_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as a stream, grounded batch by batch in the table of their sources."""
    schema = _table(spark, sf, "conversations").schema
    stream = read_message_stream(spark, sf, schema, table="conversations.parquet")
    key = F.col("conv_id") * 31 + F.col("turn")
    said = stream.filter("role = 'assistant'").select(*TURN, probed(F.col("text"), key).alias("response"))
    out = f"{_scratch(spark, 'grounded')}/rows"
    write_grounded(
        said, _attached(spark, sf), out, f"grounded_{uuid.uuid4().hex}", TURN, available_now=True
    ).awaitTermination()
    return read_grounded(spark, out).select(*TURN, *_flat_guard("output"))


# A stream's clock: a minute a turn from here on.
_START, _LATER = 1_704_067_200, 2_000_000_000


def _timed(turns: DataFrame, late: Column) -> DataFrame:
    """Turns with a time and the half of the arrivals they come in; ``late`` ones are an hour late."""
    seconds = F.lit(_START) + 60 * F.col("turn") + F.when(late, 3600).otherwise(0)
    return turns.select(
        *TURN, "role", "text", F.timestamp_seconds(seconds).alias("ts"),
        F.pmod(F.col("conv_id") + F.col("turn"), F.lit(2)).alias("half"),
    )


def _arriving(spark: SparkSession, turns: DataFrame, name: str, transform, columns: list) -> DataFrame:
    """What ``transform`` makes of the turns as a stream that is stopped half way and goes on.

    Answers come before their queries in every other case. A last message, long after the others,
    moves the watermark past all of them.
    """
    folder = _scratch(spark, name)
    stream_name = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    last = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("q").alias("text"), F.timestamp_seconds(F.lit(_LATER)).alias("ts"),
    )
    for half in (0, 1):
        arrived = turns.filter(F.col("half") == half).drop("half")
        if half:
            arrived = arrived.unionByName(last)
        arrived.write.mode("append").parquet(f"{folder}/in")
        stream = read_message_stream(spark, f"{folder}/in", arrived.schema)
        rows = transform(stream)
        write_stream(rows, f"{folder}/rows", stream_name, available_now=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows").filter("conv_id >= 0").select(*columns)


def exchanges_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Guarded exchanges of a stream; the answers of one conversation in seven come too late."""
    late = (F.col("role") == "assistant") & (F.col("conv_id") % 7 == 3)
    return _arriving(
        spark, _timed(_conversations(spark, sf), late), "exchange-stream",
        lambda m: exchange_stream(m, delay="30 days", patience="10 minutes"),
        [*TURN, *_flat_guard("input", "input_"), *_flat_guard("output", "output_")],
    )


def _ending(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, some of whose user turns say a word that ends the session."""
    turns = _conversations(spark, sf)
    words = F.array(*[F.lit(w) for w in (" Quit\n", "EXIT", "\tq ", "  ", "quit it")])
    word = F.get(words, (F.col("conv_id") % 5).cast("int"))
    says = (F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 4 == 3)
    return turns.withColumn("text", F.when(says, word).otherwise(F.col("text")))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return until_exit(_ending(spark, sf))


def sessions_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _arriving(
        spark, _timed(_ending(spark, sf), F.lit(False)), "session-stream",
        lambda m: session_stream(m, delay="30 days", session="30 days"), [*TURN, "role", "text"],
    )


# --- grounding -----------------------------------------------------------------------------
def grounding_rows(spark: SparkSession, sf: str) -> DataFrame:
    judged = _exchanges(spark, sf).withColumn(
        "grounding", grounding(F.col("response"), F.col("sources"))
    )
    return judged.select(*TURN, *_flat_grounding())


def grounding_history(spark: SparkSession, sf: str) -> DataFrame:
    """Each response against all earlier turns of its conversation."""
    judged = grounding_join(
        _responses(spark, sf), _history(spark, sf), TURN, key=["conv_id"],
        before=("turn", "seq"),
    )
    return judged.select(*TURN, *_flat_grounding())


def grounding_attached(spark: SparkSession, sf: str) -> DataFrame:
    """Each response against the source rows attached to it; null where there are none."""
    judged = grounding_join(_responses(spark, sf), _attached(spark, sf), TURN)
    return judged.select(*TURN, *_flat_grounding())


# --- exchanges -----------------------------------------------------------------------------
def paired_turns(spark: SparkSession, sf: str) -> DataFrame:
    return pair_turns(_table(spark, sf, "conversations"))


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    guarded = guarded_exchanges(_paired(spark, sf))
    return guarded.select(
        *TURN, *_flat_guard("input", "input_"), *_flat_guard("output", "output_")
    )


def exchanges_grounded(spark: SparkSession, sf: str) -> DataFrame:
    guarded = guarded_exchanges(_exchanges(spark, sf), sources="sources")
    return guarded.select(
        *TURN, *_flat_guard("input", "input_"), *_flat_guard("output", "output_")
    )


def check_report(spark: SparkSession, sf: str) -> DataFrame:
    return guard_report(guarded_exchanges(_exchanges(spark, sf), sources="sources"))


def configured_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Guarded exchanges with injection phrases and thresholds of the caller's own."""
    guarded = guarded_exchanges(_exchanges(spark, sf), OWN_SETTINGS, sources="sources")
    return guarded.select(
        *TURN, *_flat_guard("input", "input_"), *_flat_guard("output", "output_")
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with surrounding blanks; each conversation also gets an exit word in both roles."""
    turns = _texts(spark, sf, "conversations", *TURN, "role", "text")
    words = F.array(*[F.lit(w) for w in (" Quit\n", "EXIT", "\tq ", "  ", "quit it")])
    word = F.get(words, (F.col("conv_id") % 5).cast("int"))
    blanks = F.concat(F.lit(" \n"), F.col("text"), F.lit("\t "))
    said = turns.select(*TURN, "role", blanks.alias("text"))
    for no, role in ((-1, "user"), (-2, "assistant")):
        left = turns.filter("turn = 0").select(
            "conv_id", F.lit(no).cast("bigint").alias("turn"), F.lit(role).alias("role"),
            word.alias("text"),
        )
        said = said.unionByName(left)
    return clean_messages(said)


# --- documents -----------------------------------------------------------------------------
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "documents", "doc_id", "text").select("doc_id", clean(F.col("text")).alias("text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _texts(spark, sf, "documents", "doc_id", "text")
    return chunk_documents(docs, DOC).select("doc_id", *_long("chunk_no"), "chunk", *_long("n_words"))


def chunks_short(spark: SparkSession, sf: str) -> DataFrame:
    docs = _texts(spark, sf, "documents", "doc_id", "text")
    cut = chunk_documents(docs, DOC, chunk_size=60, overlap=15)
    return cut.select("doc_id", *_long("chunk_no"), "chunk", *_long("n_words"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select(
        "doc_id", *_long("chunk_no", "pair_no"), "instruction", "input", "output"
    )


# Names of files in the folders in turn: plain, hidden, upper case, with other line ends, with
# malformed bytes. Every folder also has an empty one.
_FILE_NAMES = ("a.md", "_b.md", ".c.txt", "D.TXT", "e.text", "f.md")
_OTHER_LINES, _MALFORMED = 4, 5


def _raw_folder(spark: SparkSession, sf: str) -> str:
    """Documents written as files, 64 to a file, a folder each."""
    folder = f"{_scratch(spark, 'raw-documents')}/files"
    docs = _texts(spark, sf, "documents", "doc_id", "text")
    docs = docs.select("doc_id", "text", F.floor(F.col("doc_id") / 64).alias("folder"))
    kind = F.col("folder") % len(_FILE_NAMES)
    broken = F.concat("text", F.unhex(F.lit("FFC3")).cast("string"))
    other = F.concat(F.coalesce("text", F.lit("")), F.lit("\r"))  # before the writer's line end
    text = F.when(kind == _MALFORMED, broken).when(kind == _OTHER_LINES, other).otherwise(F.col("text"))
    placed = docs.withColumn("text", text).filter("folder is not null")
    placed = placed.repartition("folder").sortWithinPartitions("folder", "doc_id")
    placed.select("folder", "text").write.partitionBy("folder").text(folder)
    files = Folder(spark, folder)

    def named(part: str) -> None:
        parent = posixpath.dirname(part)
        number = int(parent.rsplit("=", 1)[1])
        files.rename(part, f"{parent}/{_FILE_NAMES[number % len(_FILE_NAMES)]}")
        files.touch(f"{parent}/empty.md")

    files.each(named, files.paths("/folder=*/part-*"))
    return folder


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Document files of all kinds of names, read back."""
    return read_documents(spark, _raw_folder(spark, sf)).select(
        F.regexp_extract("path", r"folder=(\d+)", 1).cast("bigint").alias("folder"), "source",
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"),
    )


def raw_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the same files."""
    return corpus_summary(read_documents(spark, _raw_folder(spark, sf)))


def chunks_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of files that are read as lines: documents written one after the other, 64 to a file."""
    folder = f"{_scratch(spark, 'long-documents')}/files"
    docs = _texts(spark, sf, "documents", "doc_id", "text")
    docs = docs.select("doc_id", "text", F.floor(F.col("doc_id") / 64).alias("folder"))
    placed = docs.repartition("folder").sortWithinPartitions("folder", "doc_id")
    placed.select("folder", "text").write.partitionBy("folder").text(folder)
    return chunk_lines(read_document_lines(spark, folder)).select(
        F.regexp_extract("path", r"folder=(\d+)", 1).cast("bigint").alias("folder"),
        *_long("chunk_no"), F.md5("chunk").alias("digest"), *_long("n_words"),
    )


def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_summary(_texts(spark, sf, "documents", "doc_id", "text"))


def samples_file(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs written as JSON lines and read back."""
    folder = _scratch(spark, "samples")
    docs = _texts(spark, sf, "documents", "doc_id", "source", "text")
    key = ("doc_id", "source")
    write_samples(instruction_pairs(chunk_documents(docs, key), key), f"{folder}/rows")
    return read_samples(spark, f"{folder}/rows")


def samples_blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Samples as JSON lines with blank and white lines between them, read back."""
    folder = _scratch(spark, "samples")
    docs = _texts(spark, sf, "documents", "doc_id", "source", "text")
    made = instruction_pairs(chunk_documents(docs, ("doc_id", "source")), ("doc_id", "source"))
    line = F.to_json(F.struct("instruction", "input", "output", "source"))
    blanks = F.concat(F.lit("\n \t\n"), line, F.lit("\n"))
    made.select(blanks.alias("value")).write.text(f"{folder}/rows")
    return read_samples(spark, f"{folder}/rows")


# --- training sequences ----------------------------------------------------------------------
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf).select("doc_id", *_long("chunk_no", "pair_no"), "prompt")


def sample_count(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_size(_pairs(spark, sf))


def word_ids(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(_prompts(spark, sf)).select("word", "n", *_long("id"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of the default length, also of a null, empty or blank prompt for each document."""
    docs = _table(spark, sf, "documents")
    bare = F.get(F.array(F.lit(None), F.lit(""), F.lit(" \n")), (F.col("doc_id") % 3).cast("int"))
    none = docs.select(
        (-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit(0).alias("pair_no"),
        bare.alias("prompt"),
    )
    folder = _scratch(spark, "vocabulary")
    _prompts(spark, sf).write.parquet(f"{folder}/prompts")
    ready = spark.read.parquet(f"{folder}/prompts")
    vocabulary(ready).write.parquet(f"{folder}/words")
    ids = encode_words(ready.unionByName(none), spark.read.parquet(f"{folder}/words"), SAMPLE)
    shaped = shape_sequences(ids)
    return shaped.select(
        "doc_id", *_long("chunk_no", "pair_no"),
        *[F.md5(F.array_join(c, " ")).alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )


def sequences_tokenized(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of a tokenizer of the caller's own."""
    shaped = shape_sequences(_prompts(spark, sf), tokenizer=byte_tokenizer())
    return shaped.select(
        "doc_id", *_long("chunk_no", "pair_no"),
        *[F.md5(F.array_join(c, " ")).alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )


def rank_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batches of five ranks, stored and read again: their sequences in order."""
    samples = _prompts(spark, sf).withColumn("ids", F.transform(tokens(F.col("prompt")), F.length))
    scratch = _scratch(spark, "batches")
    folder = f"{scratch}/rows"
    # Stored, as placing samples reads them twice: their keys first, to count.
    shape_sequences(samples, max_length=64).drop("prompt").write.parquet(f"{scratch}/ready")
    ready = spark.read.parquet(f"{scratch}/ready")
    write_batches(epoch_batches(ready, SAMPLE, 3, 5, 4, steps_per_block=64), folder)
    text = F.concat_ws(" ", F.concat_ws(":", *SAMPLE), F.array_join("input_ids", " "), F.array_join("labels", " "))
    rows = F.array_sort(F.collect_list(F.struct("slot", text.alias("text"))))
    batches = read_batches(spark, folder).groupBy("rank", "batch_no").agg(rows.alias("rows"))
    return batches.select(
        *_long("rank", "batch_no"), F.size("rows").cast("bigint").alias("n"),
        F.md5(F.array_join(F.col("rows.text"), ";")).alias("digest"),
    )


def _epoch_plan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id")
    return epoch_plan(docs, DOC, epoch=3, world_size=7, batch_size=4)


def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    plan = _epoch_plan(spark, sf)
    return plan.select("doc_id", *_long("position", "rank", "step", "batch_no"))


def epoch_plan_file(spark: SparkSession, sf: str) -> DataFrame:
    """The epoch plan, written by rank and read back."""
    folder = f"{_scratch(spark, 'epoch-plan')}/rows"
    write_epoch_plan(_epoch_plan(spark, sf), folder)
    plan = spark.read.parquet(folder)
    return plan.select("doc_id", *_long("position", "rank", "step", "batch_no"))


# --- run metrics -----------------------------------------------------------------------------
def _metric_columns(*more: str) -> list:
    return [
        "run_id", *_long("epoch"), F.round("loss", 6).alias("loss"),
        F.round("time_s", 3).alias("time_s"), F.round("throughput", 9).alias("throughput"), *more,
    ]


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    return epoch_rollup(_steps(spark, sf), batch_size=4).select(*_metric_columns())


def _best(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of runs of which some epochs diverge: no number, or an infinite loss."""
    diverged = F.when(F.col("epoch") % 7 == 1, float("nan")).when(
        F.col("epoch") % 5 == 2, float("inf")
    )
    steps = _steps(spark, sf).withColumn("loss", F.coalesce(diverged, "loss"))
    size = dataset_size(_table(spark, sf, "documents")).first()["n_samples"]
    return run_metrics(steps, dataset_size=size)


def _finite(name: str) -> Column:
    return F.when(F.abs(name) < float("inf"), F.round(name, 6)).alias(name)


def best_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).withColumn("loss", _finite("loss")).select(*_metric_columns("is_best"))


def history_file(spark: SparkSession, sf: str) -> DataFrame:
    """The history of the runs as JSON lines, written and read back."""
    folder = f"{_scratch(spark, 'history')}/rows"
    write_history(epoch_rollup(_steps(spark, sf), batch_size=4), folder)
    return read_history(spark, folder).select(*_metric_columns())


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return run_totals(_best(spark, sf)).select(
        "run_id", "n_epochs", F.round("best_loss", 6).alias("best_loss"),
        F.round("total_time_s", 3).alias("total_time_s"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pii_entities": pii_entities,
    "pii_mask": pii_mask,
    "pii_by_type": pii_types,
    "toxicity_scores": toxicity_scores,
    "toxicity_flags": toxicity_flags,
    "toxicity_by_category": toxicity_categories,
    "injection_first_match": injection_first_match,
    "input_guard": input_guard,
    "output_guard": output_guard,
    "output_guard_join": output_guard_join,
    "guard_messages": guarded_messages,
    "guard_stream": guarded_stream,
    "guard_stream_sources": guarded_stream_sources,
    "grounded_stream": grounded_stream,
    "exchange_stream": exchanges_stream,
    "guards_configured": configured_guards,
    "grounding_rows": grounding_rows,
    "grounding_history": grounding_history,
    "grounding_attached": grounding_attached,
    "pair_turns": paired_turns,
    "guarded_exchanges": exchanges,
    "guarded_exchanges_grounded": exchanges_grounded,
    "guard_report": check_report,
    "clean_messages": messages,
    "session_messages": sessions,
    "session_stream": sessions_stream,
    "clean_text": clean_text,
    "chunks": chunks,
    "chunks_short": chunks_short,
    "chunks_of_lines": chunks_of_lines,
    "instruction_pairs": pairs,
    "raw_documents": raw_documents,
    "raw_summary": raw_summary,
    "corpus_summary": corpus_totals,
    "samples_jsonl": samples_file,
    "samples_blank_lines": samples_blank_lines,
    "prompts": prompts,
    "dataset_size": sample_count,
    "vocabulary": word_ids,
    "sequences": sequences,
    "sequences_tokenized": sequences_tokenized,
    "rank_batches": rank_batches,
    "epoch_plan": epoch_order,
    "epoch_plan_file": epoch_plan_file,
    "run_history": run_history,
    "history_file": history_file,
    "run_metrics": best_epochs,
    "run_totals": totals,
}
