"""Benchmark decontamination: documents that hold a whole window of consecutive benchmark words.

A window of an item occurs in a document only if its rarest word does, at the window's offset. So
each window is filed under that one word (the prefix a full containment needs), documents' words are
joined with it, the position bounds the window's place in the document, and the words there are
compared in full. Rarity is the word's count over all documents. Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import if_small, keep
from parapet.operators.rows import unfold

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmarks up to this many bytes of windows are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, split at ASCII characters but digits and letters."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, key, win): each item's distinct windows; a shorter item is one window."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    w = w.where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(window - 1)))
    cut = F.transform(starts, lambda i: F.slice("w", i, F.lit(window)))
    cut = w.select("item_id", F.explode(F.array_distinct(cut)).alias("win"))
    return cut.select("item_id", F.sha1(F.array_join("win", " ")).alias("key"), "win").distinct()


def _maybe_broadcast(small: bool):
    return F.broadcast if small else lambda df: df


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, digest, start, len, key): every place of ``docs`` (doc_id, text) with a window."""
    wins = keep(windows.select("key", "win").dropDuplicates(["key"]), "windows")
    bound = wins.agg(F.sum(F.length(F.array_join("win", " ")) + 64).alias("b")).first()["b"] or 0
    small = bound * 4 <= BROADCAST_BYTES
    hint = _maybe_broadcast(small)

    text = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    spread = wins.select("key", F.posexplode("win").alias("at", "word"))
    vocabulary = spread.select("word").distinct()
    seen = unfold(text, [], F.col("w"), "word", "pos").select("word")
    if small:  # words outside the benchmark go before they are counted
        seen = seen.join(hint(vocabulary), "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = keep(counts.join(hint(vocabulary), "word", "left_semi"), "word-counts")
    rare = (
        spread.join(counts, "word", "left")
        .groupBy("key")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word", "at")).alias("r"))
        .join(wins, "key")
        .select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), "key", "win",
                F.size("win").alias("len"))
    )
    rare = keep(rare, "rare-words")
    kept = ["doc_id", "digest", "w", F.size("w").alias("n")]
    placed = unfold(text, kept, F.col("w"), "word", "pos")
    start, inside = F.col("pos") - F.col("at"), F.expr("pos >= at and pos - at + len <= n")
    out = ["doc_id", "digest", "start", "len", "key"]
    if small:
        found = placed.join(hint(rare), "word").where(inside)
        found = found.where(F.slice("w", start + 1, F.col("len")) == F.col("win"))
        return keep(found.withColumn("start", start).select(*out).distinct(), "hits")
    found = placed.drop("w").join(rare.drop("win"), "word").where(inside)
    found = found.withColumn("start", start).select(*out).distinct().alias("f")
    back = text.dropDuplicates(["doc_id", "digest"]).alias("t")
    same = F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.digest") == F.col("t.digest"))
    found = found.join(back, same).select("f.*", "t.w").join(wins, "key")
    found = found.where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("win"))
    return keep(found.select(*out), "hits")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A word is hit inside any occurrence of an item's window; ``n_items`` counts items with an
    occurring window, ``items_sha256`` is the hex digest of their ids, sorted as strings and joined
    by commas. Null and empty texts have no words; without items nothing is hit. Repeated rows get
    the same result each; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = keep(item_windows(items, window, item_col, item_text_col), "item-windows")
    hits, doc = window_hits(docs, windows), ["doc_id", "digest"]
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.len - 1)))
    spans = hits.groupBy(*doc).agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    spans = spans.select(*doc, F.size(F.array_distinct(places)).alias("n_hit"))
    named = hits.select(*doc, "key").distinct().join(windows.select("key", "item_id"), "key")
    named = named.groupBy(*doc).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"),
                       F.size(words(F.col("text"))).cast("long").alias("n_words"))
    for side in (spans, named):
        side = side.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
        on = rows["doc_id"].eqNullSafe(side["_id"]) & (rows["digest"] == side["_digest"])
        rows = rows.join(side, on, "left").drop("_id", "_digest")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, **names) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    windows = item_windows(items, window, names.get("item_col", "item_id"),
                           names.get("item_text_col", "text"))
    hits = window_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                       keep(windows, "item-windows"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    hits = if_small(keep(hits, "contaminated"), 64)
    on = docs[id_col].eqNullSafe(hits["_id"]) & (F.xxhash64(docs[text_col]) == hits["_digest"])
    return docs.join(hits, on, "left_anti")
