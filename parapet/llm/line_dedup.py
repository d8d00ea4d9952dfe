"""Line dedup by an exact set-similarity join of the lines' word sets.

1. Words are ranked by rarity. The counts behind it are kept in a table of fixed size, by hash, so
   the order is the same for all lines and what every task reads does not grow with the corpus.
2. Lines with the same word set are one class, known by its first line in (doc_id, line_no) order.
3. Each class files the rarest words of its set, as many as a similar set must share one of (the
   prefix). A word common in the corpus is filed together with its next one instead, further down
   (:func:`_filed`), so that what is filed under one key does not grow with the corpus.
4. A class is first compared with the closest, by parity, of the earliest classes filed under its
   words. Where these are too different, or the closest turns out to be, it meets all earlier ones.
   So a crowd of near copies costs one comparison each, and no match is missed.
5. Size and position bounds, and a bound on the difference from 64 bits of parity of each set (128
   of long ones), go before the comparison of whole word sets; 256 bits of those still wanted go
   before their words.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parapet.llm.common import SMALL_BYTES, if_small, keep, keep_by
from parapet.operators.rows import unfold

#: Entries of the rarity table. Words that share one share its count, which only costs selectivity.
RARITY_SLOTS = 1 << 18
#: Words whose slot counts as many are common.
COMMON = 1023
#: Sets of more words carry 128 bits of parity: 64 are about as often set as not whatever differs.
LONG = 72
_LINE = ["doc", "line_no"]
_OWN = ["n", "bits", "half"]


def line_words(line: Column) -> Column:
    """Words of a line, with repeats: white space parts them, capitals count as small letters."""
    # Most lines hold blanks alone, and one plain character needs no pattern.
    plain = F.split(F.lower(line), " ")
    words = F.when(line.rlike(r"[\x09-\x0D]"), F.split(F.lower(line), r"[\x20\x09-\x0D]+")).otherwise(plain)
    return F.array_remove(words, "")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, line) of a table (doc, text)."""
    return unfold(docs, ["doc"], F.split("text", "\n"), "line", "line_no")


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(RARITY_SLOTS - 1)).cast("int")


def rarity_table(docs: DataFrame) -> Column:
    """A constant array: for each hash slot, a rank that grows with the count of its words."""
    joined = F.replace("text", F.lit("\n"), F.lit(" "))
    seen = unfold(docs, [], line_words(joined), "word", "at")
    counts = seen.groupBy(_slot(F.xxhash64("word")).alias("slot"))
    rank = F.floor(F.log2(F.count(F.lit(1)) + 1) * 16).cast("int")
    found = counts.agg(rank.alias("rank")).toArrow()  # one row per slot
    ranks = np.zeros(RARITY_SLOTS, np.int64)
    ranks[found.column("slot").to_numpy()] = found.column("rank").to_numpy()
    listed = ",".join(map(str, ranks.tolist()))
    return F.split(F.lit(listed), ",").cast("array<int>")


def _parity(hashes: Column | str, low: int = 0) -> Column:
    """64 bits, of which each hash flips one, by its six bits from ``low`` on.

    Sets of hashes differ in as many members at least as their bits differ in.
    """
    one = F.lit(1).cast("long")
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function(
        "shiftleft", one, (F.shiftright(h, low) if low else h).bitwiseAND(F.lit(63)).cast("int"))))


def _filed(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` (codes, n) with ``filed``, of which the first ``single`` are words by themselves.

    Two similar sets share ``need`` words, so the first they share stands in the prefix of both. If
    it is rare, both file it. If not, they share no rare word, so the ``single`` rare ones of a set
    are all differences. Between the words they share stand few differences (at 75 percent or more
    fewer than shared words, by two), so some two they share are neighbours in both, the first such
    at ``last`` at most: each difference can part one pair, and one of the set itself takes a place.
    """
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    sets = sets.withColumn("prefix", F.col("n") - need + 1)
    rare = F.slice("codes", F.lit(1), F.col("prefix"))
    if percent >= 75:
        common = F.lit(int(16 * math.log2(COMMON + 1)) << 48)
        rare = F.filter(rare, lambda c: c < common)
    sets = sets.withColumn("rare", rare).withColumn("single", F.size("rare"))
    last = F.least("n", F.floor(F.col("n") * (2 * (100 - percent)) / 100).cast("int") + 2 - F.col("single"))
    pairs = F.when(F.col("single") < F.col("prefix"), F.greatest(last - 1 - F.col("single"), F.lit(0)))
    sets = sets.withColumn("pairs", F.coalesce(pairs, F.lit(0)))
    both = F.zip_with(
        F.slice("codes", F.col("single") + 1, F.col("pairs")),
        F.slice("codes", F.col("single") + 2, F.col("pairs")), lambda a, b: F.xxhash64(a, b))
    # What is filed is met again by 32 bits of its hash: more words may meet, none are missed.
    return sets.withColumn("filed", F.transform(F.concat("rare", both), lambda c: (
        c.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int")))


def _ranked_sets(docs: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """(doc, line_no, digest, n, bits, half, single, filed): each line's word set, and its prefix.

    ``half`` is the parity of about half the words of a long set, in the same places as in ``bits``.
    """
    hashes = F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w))
    # The rank goes into the upper bits, so that plain order is by rarity and then by hash.
    coded = F.transform(F.array_distinct(hashes), lambda h: F.shiftleft(F.coalesce(
        F.get(ranks, _slot(h)), F.lit(0)).cast("long"), 48).bitwiseOR(h.bitwiseAND(F.lit((1 << 48) - 1))))
    sets = _lines(docs).select(*_LINE, F.sort_array(coded).alias("codes"))
    sets = _filed(sets.withColumn("n", F.size("codes")), percent)
    half = _parity(F.filter("codes", lambda c: c.bitwiseAND(F.lit(64)) == 64))
    return sets.select(
        *_LINE, F.xxhash64("codes").alias("digest"), "n", _parity("codes").alias("bits"),
        F.when(F.col("n") > LONG, half).alias("half"), "single", "filed",
    )


def _may_reach(percent: int) -> Column:
    """Whether two sets that share a word at these places can reach the threshold.

    The words after it are all that can be shared besides; of the shorter set the word must lie in
    the part that a longer similar one has to meet. Sets differ by a word for each bit at least that
    their bitmaps differ in; the halves of two long ones are told apart.
    """
    need = f"ceil({percent} * (n + n2) / {100 + percent})"
    return F.expr(
        f"100 * least(n, n2) >= {percent} * greatest(n, n2) "
        f"AND least(n - pos, n2 - pos2) >= {need} "
        f"AND IF(n <= n2, pos <= n - {need}, pos2 <= n2 - {need}) "
        f"AND bit_count(bits ^ bits2) <= n + n2 - 2 * {need} "
        f"AND (half IS NULL OR half2 IS NULL OR bit_count(half ^ half2) "
        f"+ bit_count(bits ^ half ^ bits2 ^ half2) <= n + n2 - 2 * {need})"
    )


def _two_bits(i: int):
    """Whether the two bits of a hash that :func:`_parity` does not use make ``i``."""
    return lambda h: F.shiftright(h, 12).bitwiseAND(F.lit(3)) == i


def _matched(pairs: DataFrame, docs: DataFrame, percent: int, name: str) -> DataFrame:
    """(doc, line_no) of later lines whose word set reaches the threshold with the earlier one's.

    ``pairs`` has (doc, line_no) and an earlier (doc2, line_no2).
    """
    pairs = keep(pairs.distinct(), f"{name}-pairs")
    wanted = pairs.select(*_LINE).union(pairs.select("doc2", "line_no2")).distinct()
    wanted = keep(wanted, f"{name}-wanted")
    lines = _lines(docs.join(if_small(wanted.select("doc").distinct(), 64), "doc", "left_semi"))
    lines = lines.join(if_small(wanted, 96), _LINE, "left_semi")
    words = F.array_distinct(F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w)))
    # Wider bitmaps part most pairs before their words travel.
    quarter = [_parity(F.filter("w", _two_bits(i)), 6) for i in range(4)]
    words = lines.select(*_LINE, words.alias("w"))
    words = words.select("*", F.size("w").alias("n"), *(q.alias(f"p{i}") for i, q in enumerate(quarter)))
    words = keep(words, f"{name}-words")
    sketch = words.drop("w")
    other = sketch.select(*(F.col(c).alias(f"{c}2" if c in _LINE else f"{c}_2") for c in sketch.columns))
    differ = " + ".join(f"bit_count(p{i} ^ p{i}_2)" for i in range(4))
    need = f"ceil({percent} * (n + n_2) / {100 + percent})"
    near = pairs.join(sketch, _LINE).join(other, ["doc2", "line_no2"])
    near = near.where(f"{differ} <= n + n_2 - 2 * {need}")
    near = keep(near.select(*_LINE, "doc2", "line_no2"), f"{name}-near")
    words = words.select(*_LINE, "w")
    both = near.join(words, _LINE).join(words.toDF("doc2", "line_no2", "w2"), ["doc2", "line_no2"])
    shared = F.size(F.array_intersect("w", "w2"))
    union = F.size("w") + F.size("w2") - shared
    return keep(both.where(100 * shared >= percent * union).select(*_LINE).distinct(), name)


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc, line_no, removed) of every line with words of ``docs`` (doc, text).

    A line is removed if an earlier line, in (doc, line_no) order, has a word set of at least
    ``percent`` Jaccard similarity; the earlier one may be removed itself.
    """
    docs = docs.where("doc is not null and text is not null")
    sets = keep(_ranked_sets(docs, rarity_table(docs), percent), "line-sets").where("n > 0")
    key = ["digest", "n", "bits"]
    whole = F.min(F.struct(*_LINE, "half", "single", "filed")).alias("first")
    classes = sets.groupBy(*key).agg(whole).select("n", "bits", "first.*")
    filed = unfold(classes, [*_LINE, *_OWN, "single"], F.col("filed"), "code", "pos")
    # A pair of words may stand after others that are shared, so its place bounds nothing.
    filed = filed.withColumn("pos", F.expr("IF(pos < single, pos, 0)")).drop("single")
    code = Window.partitionBy("code").orderBy(*_LINE)
    met = F.lag("n").over(code).isNotNull() | F.lead("n").over(code).isNotNull()
    head = F.first(F.struct(*_LINE, *_OWN, "pos")).over(code)
    columns, pair = [*_LINE, *_OWN, "pos"], ["doc", "line_no", "doc2", "line_no2"]
    before = F.expr("doc2 < doc or doc2 = doc and line_no2 < line_no")
    judged = filed.withColumns({"met": met, "head": head}).where("met").select(
        "code", *columns, *(F.col(f"head.{c}").alias(f"{c}2") for c in columns)
    ).withColumn("star", before & _may_reach(percent))
    judged = judged.select("code", *columns, "star", *(
        F.when(F.col("star"), F.col(c)).alias(c) for c in ("doc2", "line_no2", "bits2")))
    judged = keep_by(judged, "filed-words", "code")
    stars = keep(judged.where("star").select("code", *columns, "doc2", "line_no2", "bits2"), "stars")
    # One star a line is tried, the closest by parity: a line has many in a crowd of near copies.
    closest = F.min(F.struct(F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))), "doc2", "line_no2"))
    tried = stars.groupBy(*_LINE).agg(closest.alias("star")).select(*_LINE, "star.doc2", "star.line_no2")
    found = _matched(tried, docs, percent, "star-lines")

    earlier = judged.select("code", *(F.col(c).alias(f"{c}2") for c in columns))
    failed = stars.join(found, _LINE, "left_anti").select("code", *columns)
    rest = judged.where("not star").select("code", *columns)
    rest = [open_.join(earlier, "code").where(before & _may_reach(percent)).select(*pair)
            for open_ in (rest, failed)]
    rest = keep(rest[0].union(rest[1]).distinct(), "rest-pairs").join(found, _LINE, "left_anti")
    found = found.union(_matched(rest, docs, percent, "rest-lines"))

    # Lines stay that are the first of their class and not found; repeated ids may differ in digest.
    first = sets.groupBy(*key).agg(F.min(F.struct(*_LINE)).alias("first")).select("first.*", "digest")
    stays = first.join(if_small(found, 64), _LINE, "left_anti").withColumn("stays", F.lit(True))
    rows = sets.select(*_LINE, "digest", F.lit(False).alias("stays")).union(
        stays.select(*_LINE, "digest", "stays"))
    rows = rows.repartition("doc").groupBy(*_LINE, "digest").agg(F.max("stays").alias("stays"))
    return rows.select(*_LINE, (~F.col("stays")).alias("removed"))


def _flags(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _worded, _removed): lines with words of each document, and the numbers of its
    removed ones."""
    found = repeated_lines(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), percent)
    found = found.groupBy(*_LINE).agg(F.max("removed").alias("removed"))
    gone = F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line_no"))))
    return found.groupBy("doc").agg(F.count("line_no").alias("_worded"), gone.alias("_removed")).select(
        F.col("doc").alias("_doc"), "_worded", "_removed")


def line_report(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) of every row of ``docs``.

    ``removed_lines`` lists the numbers of the removed lines, from 0, joined by commas. Null texts
    have no lines; lines without words are never removed, nor are lines of rows without an id.
    Rows that repeat an id have to repeat its text: they count as one document. Other columns are
    not read.
    """
    flags = _flags(docs, percent, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.size(F.split(
        F.col(text_col), "\n")).alias("_n"), F.col(text_col).isNull().alias("_null"))
    rows = rows.join(flags, rows["doc_id"] == flags["_doc"], "left")
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    return rows.select(
        "doc_id", F.when(F.col("_null"), 0).otherwise(F.col("_n")).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"),
    )


def drop_repeated_lines(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without lines that repeat earlier ones, and without the rows all of whose lines do.

    The columns are those of ``docs``; an ``n_chars`` column follows the text. Texts that lose no
    line, null and blank ones among them, stay as they are.
    """
    flags = keep(_flags(docs, percent, id_col, text_col).where(F.size("_removed") > 0), "flags")
    size = flags.agg(F.sum(F.size("_removed") * 8 + 64).alias("b")).first()["b"] or 0
    flags = F.broadcast(flags) if size <= SMALL_BYTES else flags
    rows = docs.join(flags, docs[id_col] == flags["_doc"], "left")
    rows = rows.where("_removed is null or size(_removed) < _worded")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(
        "_removed", i)), "\n")
    text = F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(left)
    rows = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        size = F.length(text_col).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(size))
    return rows.select(*docs.columns)
