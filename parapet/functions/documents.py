"""Documents to chunks to instruction pairs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.text import strip, tokens

# What a text must hold for any of the clean-up rewrites to change it.
_MARKS = ("# ", "](", "**", "\n\n\n")
PAIR = "struct<instruction:string,input:string,output:string>"


def decode_text(content: Column) -> Column:
    """UTF-8 bytes as text: malformed bytes dropped, every line end a single ``\\n``.

    Malformed bytes become U+FFFD and are then removed; a U+FFFD that the file really holds is
    set aside under an escape first, so it survives.
    """
    raw, bad, mark = content.cast("string"), "\ufffd", "\ufdd0"
    aside = F.replace(
        F.replace(raw, F.lit(mark), F.lit(mark + "0")), F.lit(bad), F.lit(mark + "1")
    )
    kept = F.replace(F.make_valid_utf8(aside), F.lit(bad), F.lit(""))
    back = F.replace(F.replace(kept, F.lit(mark + "1"), F.lit(bad)), F.lit(mark + "0"), F.lit(mark))
    plain = F.replace(F.make_valid_utf8(raw), F.lit(bad), F.lit(""))
    text = F.when(raw.contains(bad), back).otherwise(plain)
    return F.regexp_replace(text, r"\r\n?", "\n")


def clean_text(text: Column) -> Column:
    """Markdown headings, links, bold marks and runs of blank lines reduced to plain text.

    A text with none of the marks the rewrites need is passed on after byte searches alone.
    """
    rewritten, marked = text, F.lit(False)
    for pattern, replacement in lexicon.MARKDOWN_REWRITES:
        rewritten = F.regexp_replace(rewritten, pattern, replacement)
    for mark in _MARKS:
        marked = marked | text.contains(mark)
    return F.when(marked, rewritten).otherwise(text)


def word_chunks(
    words: Column,
    chunk_size: int = lexicon.CHUNK_WORDS,
    overlap: int = lexicon.CHUNK_OVERLAP,
) -> Column:
    """Overlapping windows over a word array: ``array<struct<chunk, n_words>>``.

    Windows start every ``chunk_size - overlap`` words; those of 20 words or fewer are left out,
    and a short tail is kept even where the window before it holds it already. Null for a null
    or empty array.
    """
    step = chunk_size - overlap
    if step <= 0:
        raise ValueError("chunk_size must be greater than overlap")
    # A window's length follows from its start, so short tails never become windows.
    last = F.size(words) - 1 - lexicon.CHUNK_MIN_WORDS
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))

    def window(start: Column) -> Column:
        part = F.slice(words, start + 1, chunk_size)
        return F.struct(
            F.array_join(part, " ").alias("chunk"),
            F.least(F.size(words) - start, F.lit(chunk_size)).alias("n_words"),
        )

    if chunk_size <= lexicon.CHUNK_MIN_WORDS:
        return F.when(last >= 0, F.array().cast("array<struct<chunk:string,n_words:int>>"))
    return F.transform(starts, window)


def topic(chunk: Column) -> Column:
    """First six words before the first full stop, in lower case, without end punctuation."""
    first = tokens(F.substring_index(chunk, ".", 1))
    prefix = F.lower(F.array_join(F.slice(first, 1, lexicon.TOPIC_WORDS), " "))
    return F.rtrim(prefix, F.lit(lexicon.TOPIC_TRIM))


def pairs_of_chunk(chunk: Column, about: Column, n_words: Column) -> Column:
    """The direct pair, and for chunks of more than 50 words the summary pair, in that order."""
    body = strip(chunk)

    def asked(wording: tuple[str, str]) -> Column:
        return F.concat(F.lit(wording[0]), about, F.lit(wording[1]))

    direct = F.struct(
        asked(lexicon.DIRECT_INSTRUCTION).alias("instruction"),
        F.lit("").alias("input"),
        body.alias("output"),
    ).cast(PAIR)
    summary = F.struct(
        asked(lexicon.SUMMARY_INSTRUCTION).alias("instruction"),
        body.alias("input"),
        F.concat(strip(F.substring_index(chunk, ". ", 2)), F.lit(".")).alias("output"),
    ).cast(PAIR)
    return F.when(n_words > lexicon.SUMMARY_MIN_WORDS, F.array(direct, summary)).otherwise(
        F.array(direct)
    )
