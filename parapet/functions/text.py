"""Text kernel: Python-equivalent whitespace, patterns and renderings as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ``str.split``/``str.strip`` see it: Unicode white space plus U+001C..U+001F.
_SPACE = r"\s\x1c-\x1f"
_WORD = r"[\p{L}\p{N}_]"
# Java only looks back over whole code points beyond U+FFFF where the look-behind names one, so
# one such letter stands in the class.
_BEFORE = "[\\p{L}\\p{N}_\U0001d49c]"
_BOUNDARY = f"(?:(?<={_BEFORE})(?!{_WORD})|(?<!{_BEFORE})(?={_WORD}))"

# Letters outside ASCII that match an ASCII letter when case is ignored: dotted and dotless i,
# long s, Kelvin sign, and the ASCII letters they match.
_FOLDING_LETTERS = ("\u0130", "\u0131", "\u017f", "\u212a")
_FOLDED_LETTERS = "iisk"


def any_case(letters: str) -> str:
    """A class of these letters in every form that matches when case is ignored.

    In a case-sensitive part of a pattern it is a table look-up in Java, where ignoring case
    folds each character of the text.
    """
    forms = set(letters.lower() + letters.upper())
    folds = zip(_FOLDING_LETTERS, _FOLDED_LETTERS)
    forms.update(x for x, ascii_form in folds if ascii_form in forms)
    return f"[{''.join(sorted(forms))}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def to_java(pattern: str, first: tuple[str, str | None] | None = None) -> str:
    """A case-insensitive Python ``str`` pattern as the Java pattern that matches the same text.

    Java's ``\\b`` and ``\\s`` differ from Python's outside ASCII, so both are spelled out, and the
    look-arounds that takes are kept away from most positions of a text: a leading boundary is
    tested after the literal behind it has matched, or after a look at the next character where
    ``first`` names the characters a match can start with, as a class of word characters, in all
    their cases, and a class of others or ``None``.
    """
    start, literal = "", ""
    if pattern.startswith(r"\b"):
        pattern = pattern[2:]
        literal = re.match(r"[A-Za-z]+(?![?*+{])|", pattern).group()
        if literal:
            pattern = pattern[len(literal) :]
            literal += f"(?<!{_BEFORE}{literal})"
        elif first:
            word, other = first
            start = f"(?={word})(?<!{_BEFORE})"
            if other:
                start = f"(?:{start}|(?={other})(?<={_BEFORE}))"
        else:
            start = _BOUNDARY
    return f"(?U){start}(?i){literal}{_spell_out(pattern)}"


def to_java_exact(pattern: str) -> str:
    """The same for a case-sensitive pattern."""
    return "(?U)" + _spell_out(pattern)


def _spell_out(pattern: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        last = i + len(token) == len(pattern)
        if token == "[" and not in_class:
            in_class = True
        elif token == "]":
            in_class = False
        if token == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
        elif token == r"\b":
            after_word = re.search(r"[A-Za-z]$|\\d(\{\d+(,\d+)?\})?$", pattern[:i])
            out.append(f"(?!{_WORD})" if last and after_word else _BOUNDARY)
        else:
            out.append(token)
        i += len(token)
    return "".join(out)


def required_words(pattern: str) -> list[str]:
    """Lower-case letter runs that every match of ``pattern`` contains.

    Optional parts, groups and character classes are removed first, so only mandatory
    literals remain; one-letter runs are too common to be worth a check. Long runs, which are
    rare in texts, come first.
    """
    plain = re.sub(r"\\[a-z]\+?", " ", pattern)
    plain = re.sub(r"\([^()]*\)\??", " ", plain)
    plain = re.sub(r"\[[^\]]*\]\??", " ", plain)
    return sorted((w.lower() for w in re.findall(r"[A-Za-z]{2,}", plain)), key=len, reverse=True)


def any_of(patterns: Iterable[str]) -> str:
    """One Java pattern that occurs in ``" " + text`` wherever one of the patterns occurs in text.

    Each pattern starts with a boundary and a letter, so a match follows a character that is no
    ASCII letter: most positions are ruled out by that one test, and the first letter then
    selects the few alternatives left. It may occur in more texts, as the boundaries are loose.
    """
    by_letter: dict[str, list[str]] = {}
    for pattern in patterns:
        bare = pattern.replace(r"\b", "").replace(r"\s", f"[{_SPACE}]")
        by_letter.setdefault(bare[0].lower(), []).append(bare[1:])
    options = [f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items()]
    return f"(?iU)[^a-z](?:{'|'.join(options)})"


def has_folding_letter(text: Column) -> Column:
    """True where the text holds a letter outside ASCII that matches an ASCII letter."""
    found = text.contains(_FOLDING_LETTERS[0])
    for letter in _FOLDING_LETTERS[1:]:
        found = found | text.contains(letter)
    return found


def fold_case(text: Column) -> Column:
    """Lower-case text in which letters that match an ASCII letter when case is ignored are ASCII.

    Only used for the literal pre-checks of ``matches``; the result may differ from
    ``lower(text)``.
    """
    plain = F.translate(text, "".join(_FOLDING_LETTERS), _FOLDED_LETTERS)
    return F.lower(F.when(has_folding_letter(text), plain).otherwise(text))


def matches(text: Column, folded: Column, pattern: str) -> Column:
    """True where the pattern occurs; ``folded`` is ``fold_case(text)``.

    A byte search for the pattern's literal words runs first and the regex only on texts
    that hold all of them.
    """
    hit = text.rlike(to_java(pattern))
    for word in reversed(required_words(pattern)):
        hit = folded.contains(word) & hit
    return hit


def tokens(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.array_remove(F.split(text, f"(?U)[{_SPACE}]+"), "")


def first_tokens(text: Column, count: int) -> Column:
    """The first ``count`` words; the rest of a long text is not split."""
    # One piece may be empty before leading whitespace, and the last one is the unsplit rest.
    pieces = F.split(text, f"(?U)[{_SPACE}]+", count + 2)
    return F.slice(F.array_remove(pieces, ""), 1, count)


def strip(text: Column) -> Column:
    """Text without leading and trailing whitespace (linear on long runs of blanks).

    Only a text that starts or ends with whitespace is rewritten.
    """
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    stripped = F.regexp_replace(
        text, rf"(?U)\A[{_SPACE}]++|(?=[{_SPACE}])(?<![{_SPACE}])[{_SPACE}]++\z", ""
    )
    return F.when(ends.rlike(f"(?U)[{_SPACE}]"), stripped).otherwise(text)


def sentences(text: Column) -> Column:
    """Stripped pieces between ``". "``; a line break ends a sentence too."""
    flat = F.replace(text, F.lit("\n"), F.lit(". "))
    return F.transform(F.split(flat, r"\. ", -1), strip)


def quoted_list(items: Column) -> Column:
    """``['a', 'b']`` for an array of plain words, ``[]`` when it is empty."""
    body = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    return F.when(F.size(items) > 0, body).otherwise(F.lit("[]"))


def two_decimals(score: Column) -> Column:
    """A double in [0, 1] with two decimals, rounded from its exact binary value, ties to even.

    ``score * 2^60`` is a whole number for every double of at least 2^-8, so the remainder
    against half a hundredth is exact; smaller scores are far from any tie.
    """
    one = 1 << 60
    scaled = (score * F.lit(float(one))).cast("bigint").cast("decimal(20,0)") * F.lit(100)
    whole = F.floor(scaled / F.lit(one).cast("decimal(20,0)")).cast("bigint")
    rest = scaled - whole.cast("decimal(20,0)") * F.lit(one).cast("decimal(20,0)")
    half = F.lit(one >> 1).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    hundredths = whole + up.cast("bigint")
    return F.concat(
        F.floor(hundredths / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
    )
