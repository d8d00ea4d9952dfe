"""Personal data: find, locate and mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import lexicon
from parapet.functions.text import any_case, has_folding_letter, let, to_java, to_java_exact

ENTITY = "struct<type:string,value:string,start:int,end:int>"
PII = f"struct<has_pii:boolean,entities:array<{ENTITY}>,masked_text:string,original_text:string>"

_NO_ENTITIES = f"array<{ENTITY}>"
_BLOCK = 128

# The word characters and the others a match of each type can start with.
_FIRST = {
    "email": ("[A-Za-z0-9_\u0130\u0131\u017f\u212a]", "[.%+-]"),
    "phone": (r"\d", "[+(]"),
    "ssn": (r"\d", None),
    "credit_card": (r"\d", None),
    "ip_address": (r"\d", None),
    "badge_id": (any_case("ebi"), None),
    "dob": (any_case("db"), None),
    "api_key": (any_case("sga"), None),
}

# What every match of a numeric type contains: a digit and then this.
_AFTER_DIGIT = {
    "phone": r"\d\d\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\d\d-\d\d-\d{4}",
    "credit_card": r"\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
    "ip_address": r"\.\d{1,3}\.\d{1,3}\.\d",
    "badge_id": r"(?<=[PpEeDd][-#]?\d)\d{3}",
    "dob": r"[/-]\d{1,2}[/-]\d{2}",
}


def _checks(text: Column, low: Column) -> tuple[Column, dict[str, Column]]:
    """Necessary conditions: for any type, and by type.

    The check for any type is a few byte searches and one regex pass that stops at digits only.
    """
    by_type = {k: text.rlike(to_java_exact(rf"\d{p}")) for k, p in _AFTER_DIGIT.items()}
    by_type["email"] = text.contains("@")
    by_type["api_key"] = (
        low.contains("sk-") | low.contains("ghp_") | low.contains("akia")
        | has_folding_letter(text)
    )
    numeric = text.rlike(to_java_exact(rf"\d(?:{'|'.join(_AFTER_DIGIT.values())})"))
    return by_type["email"] | by_type["api_key"] | numeric, by_type


def _located(part: Column) -> Column:
    """Entities with code point offsets from one type's matches and the pieces between them.

    Pieces and matches alternate, so a running sum of their lengths gives every offset; the piece
    after the last match has no partner. Sums run in blocks, since a fold copies what it has
    gathered at each step: the copies grow with a block and not with the text.
    """
    pieces = F.zip_with(
        part["found"], F.slice(part["gaps"], F.lit(1), F.size(part["found"])),
        lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g"), F.length(v).alias("n")),
    )

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["g"]
        end = start + piece["n"]
        entity = F.struct(
            part["kind"].alias("type"), piece["v"].alias("value"),
            start.alias("start"), end.alias("end"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(entity)).alias("out"))

    def block(every: Column, acc: Column, first: Column) -> Column:
        inner = F.struct(acc["at"].alias("at"), F.array().cast(_NO_ENTITIES).alias("out"))
        done = F.aggregate(F.slice(every, first, F.lit(_BLOCK)), inner, step)
        return let(done, lambda d: F.struct(
            d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")
        ))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_NO_ENTITIES}>").alias("out"))
    firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(part["found"])), F.lit(_BLOCK))
    return let(pieces, lambda every: F.aggregate(
        firsts, empty, lambda acc, first: block(every, acc, first), lambda acc: F.flatten(acc["out"])
    ))


def pii_entities(text: Column, low: Column | None = None) -> Column:
    """All entities of a text, by type in scan order, then by position; null for null.

    Types may overlap; every type scans the original text, and only texts that hold what a match
    of the type cannot do without. ``low`` is ``lower(text)`` where it is known.
    """
    worth, by_type = _checks(text, F.lower(text) if low is None else low)
    parts = []
    for kind, pattern in lexicon.PII_PATTERNS.items():
        java = to_java(pattern, _FIRST[kind])
        part = F.struct(
            F.lit(kind).alias("kind"),
            F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("found"),
            F.split(text, java, -1).alias("gaps"),
        )
        parts.append(F.when(by_type[kind], part))
    scanned = F.filter(F.array(*parts), lambda part: part.isNotNull())
    found = F.flatten(F.transform(scanned, _located))
    none = F.array().cast(_NO_ENTITIES)
    return F.when(worth, found).when(text.isNotNull(), none)


# --- masks ---------------------------------------------------------------------------------
# Texts of more different values than this are masked piece by piece.
_MANY_VALUES = 32
# Pieces that need the whole fold; a text with more of them is folded as a whole.
_MANY_PIECES = 64
_LETTER = r"[\p{L}\p{N}_]"
_NO_LETTER = r"[^\p{L}\p{N}_]"
_BLANK = r"[\s\x1c-\x1f]"
# No value holds one of these characters.
_FOREIGN = r"[^\p{L}\p{N}_.%+\-@|()/:#\s\x1c-\x1f]"
# Places that no value spans: behind a foreign character, and behind a blank, where it is followed
# by what may follow a blank in a value only if no value of the text holds a blank.
_CUT = rf"(?U)(?<={_FOREIGN})|(?<={_BLANK})(?![\d(:\s\x1c-\x1f])"
_CUT_AT_BLANKS = rf"(?U)(?<={_FOREIGN})|(?<={_BLANK})(?!{_BLANK})"
_SHORTEST = 6  # characters of the shortest value


def _fold(text: Column, steps: Column) -> Column:
    return F.aggregate(steps, text, lambda acc, s: F.replace(acc, s["value"], s["mask"]))


def _inner(values: Column) -> Column:
    """Values that stand inside others: among all ends of values, sorted, such a value is followed by
    a string that starts with it."""
    ends = F.flatten(F.transform(values, lambda v: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(v) - _SHORTEST + 1, F.lit(1))),
        lambda i: F.struct(v.substr(i, F.length(v)).alias("s"), (i > 1).alias("part")),
    )))

    def pairs(order: Column) -> Column:
        here = F.slice(order, F.lit(1), F.size(order) - 1)
        return F.zip_with(here, F.slice(order, F.lit(2), F.size(order) - 1), lambda a, b: F.when(
            ~a["part"] & b["s"].startswith(a["s"]), a["s"]
        ))

    found = let(F.array_sort(ends), pairs)
    return F.filter(found, lambda v: v.isNotNull())


def _by_pieces(text: Column, steps: Column) -> Column:
    """The fold, in one pass over the pieces between places that no value spans.

    A piece that holds what a value cannot do without is a value between characters that are no
    letters, or one of a few others, which are folded by themselves. Null where a text has too many of
    those, or values that start or end in no letter, or one value of two types: the fold is due.
    """
    key = lambda value, mask: F.concat(value, F.lit("\0"), mask)
    whole = {
        k: rf"\A(?:{to_java(p, _FIRST[k])})\z" for k, p in lexicon.PII_PATTERNS.items()
    }

    def mask_of(core: Column) -> Column:
        fits = [F.when(core.rlike(p), F.lit(f"[{k.upper()}]")) for k, p in whole.items()]
        return F.coalesce(*fits, F.lit(""))

    def piece(s: Column) -> Column:
        core = F.regexp_replace(
            s, rf"(?U)\A{_NO_LETTER}++|(?={_NO_LETTER})(?<!{_NO_LETTER}){_NO_LETTER}++\z", ""
        )
        worth, _ = _checks(s, F.lower(s))
        judged = let(core, lambda c: F.struct(s.alias("s"), c.alias("core"), mask_of(c).alias("mask")))
        plain = F.struct(
            s.alias("s"), F.lit(None).cast("string").alias("core"), F.lit(None).cast("string").alias("mask")
        )
        return F.when(worth, judged).otherwise(plain)

    def masked(pieces: Column, values: Column) -> Column:
        keys = F.filter(F.transform(pieces, lambda p: key(p["core"], p["mask"])), lambda k: k.isNotNull())
        known = F.transform(steps, lambda s: key(s["value"], s["mask"]))

        def around(inner: Column) -> Column:
            holds = F.filter(steps, lambda s: F.exists(
                inner, lambda v: s["value"].contains(v) & (s["value"] != v)
            ))
            return F.transform(holds, lambda s: key(s["value"], s["mask"]))

        def joined(odd: Column) -> Column:
            out = F.transform(pieces, lambda p: (
                F.when(p["core"].isNull(), p["s"])
                .when(F.array_contains(odd, key(p["core"], p["mask"])), _fold(p["s"], steps))
                .otherwise(F.replace(p["s"], p["core"], p["mask"]))
            ))
            return F.when(F.size(odd) <= _MANY_PIECES, F.array_join(out, ""))

        nested = let(_inner(values), lambda inner: F.when(F.size(inner) > 0, around(inner)).otherwise(
            F.array().cast("array<string>")
        ))
        return let(F.array_union(F.array_except(keys, known), nested), joined)

    def split(values: Column) -> Column:
        blank = F.exists(values, lambda v: v.rlike(rf"(?U){_BLANK}"))
        cut = F.when(blank, F.split(text, _CUT, -1)).otherwise(F.split(text, _CUT_AT_BLANKS, -1))
        edges = F.exists(values, lambda v: v.rlike(rf"(?U)\A{_NO_LETTER}|{_NO_LETTER}\z"))
        sound = ~edges & (F.size(F.array_distinct(values)) == F.size(values))
        return F.when(sound, let(F.transform(cut, piece), lambda pieces: masked(pieces, values)))

    return let(F.transform(steps, lambda s: s["value"]), split)


def mask_entities(text: Column, entities: Column) -> Column:
    """Replace every literal occurrence of each entity value, in order, by ``[TYPE]``.

    A value is replaced everywhere at its first turn and a mask never brings one back, so
    repeated entities are folded once. A fold costs values times length; a text of many values
    is taken piece by piece instead, which gives the same.
    """
    # strings are told apart by hashing, structs one by one; no value holds a NUL
    names = F.array_distinct(F.transform(
        entities, lambda e: F.concat(e["value"], F.lit("\0["), F.upper(e["type"]), F.lit("]"))
    ))
    steps = F.transform(names, lambda n: F.struct(
        F.substring_index(n, "\0", 1).alias("value"), F.substring_index(n, "\0", -1).alias("mask")
    ))
    replaced = let(steps, lambda every: F.when(
        F.size(every) > _MANY_VALUES, F.coalesce(_by_pieces(text, every), _fold(text, every))
    ).otherwise(_fold(text, every)))
    return F.when(F.size(entities) > 0, replaced).otherwise(text)


def pii_result(text: Column, entities: Column) -> Column:
    """The PII struct of a text whose entities are known."""
    return F.when(
        text.isNotNull(),
        F.struct(
            (F.size(entities) > 0).alias("has_pii"),
            entities.alias("entities"),
            mask_entities(text, entities).alias("masked_text"),
            text.alias("original_text"),
        ),
    )


def pii_scan(text: Column) -> Column:
    """PII struct of a text: ``has_pii``, ``entities``, ``masked_text``, ``original_text``."""
    entities = let(F.lower(text), lambda low: pii_entities(text, low))
    return let(entities, lambda found: pii_result(text, found))
