"""Personal data: plain formats by rule, written-out and unusual ones by boosted trees.

Base spans follow fixed rules by kind (``BASE``). Generators of high recall (``GENERATORS``) propose
further spans, which may overlap; trees judge each by its format and by the words beside it, and a
threshold by kind, set on unseen generated texts for a precision of ``PRECISION``, selects. A proposal
that starts inside a base span adds nothing and goes.

Everything on tables is Column expressions: the trees are unrolled into conditions. They are fitted on
the driver from ``TRAINING_TEXTS`` generated texts whose spans are known, as no table labels any.
Offsets are code points, ends exclusive. Patterns are possessive where a long run could make them try
again, so the time of a text grows with its length.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.functions.text import let
from parapet.llm.boosting import Trees, fit_trees

KINDS = ("email", "ip", "card", "phone")
TRAINING_TEXTS = 4000
PRECISION = 0.99

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: kind: (pattern, what a text must hold for a match). A match of the plain greedy pattern starts
#: where a run of its first class does, or where the match before ended.
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None),
    "card": (r"[0-9](?:[ -]?[0-9])++", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}

_AT = r"(?: ?[(\[{<] ?(?i:at) ?[)\]}>] ?| @ |@)"
_DOT = r"(?: ?[(\[{<] ?(?i:dot|\.) ?[)\]}>] ?| \. |\.)"
#: kind: patterns that propose spans.
GENERATORS = {
    "email": (
        rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,64}}+(?:{_DOT}[A-Za-z0-9-]{{1,64}}+){{1,6}}+",
        rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ (?i:at) [A-Za-z0-9-]{{1,64}}+(?: (?i:dot) [A-Za-z0-9-]{{1,64}}+){{1,6}}+",
    ),
    "ip": (
        rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}+(?![0-9])",
        r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Za-z:])",
    ),
    "card": (r"(?<![0-9A-Za-z])[0-9](?:[ ._/ -]?[0-9]){12,18}+(?![0-9A-Za-z])",),
    "phone": (
        r"(?<![0-9A-Za-z+])(?:\([0-9]{1,5}\)|[0-9]{1,8}+)(?:[ ./-]{1,2}+(?:\([0-9]{1,5}\)|[0-9]{2,8}+)){1,6}+(?![0-9A-Za-z])",
        r"\+[0-9]{1,3}[ .-]?\([0-9]{2,5}\)[ .-]?[0-9]{2,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    ),
}
#: A text without a match of this has no proposals.
_WORTH = r"[0-9@]|[(\[{<] ?(?i:at) ?[)\]}>]| (?i:dot) "

_BEFORE, _AFTER, _BLOCK = 32, 12, 128
_SPAN = "struct<kind:int,start:int,end:int,v:string,before:string,after:string>"


# --- spans ---------------------------------------------------------------------------------
def _scan(text: Column, kind: int, pattern: str) -> Column:
    """Matches with offsets and the text beside them, up to the matches before and after.

    Pieces and matches alternate, so running sums of lengths are the offsets. They are folded in
    blocks, as a fold copies what it has gathered at each step.
    """

    def located(parts: Column) -> Column:
        n = F.size(parts["found"])
        rows = F.arrays_zip(
            parts["found"].alias("v"),
            F.slice(parts["gaps"], F.lit(1), n).alias("gap"),
            F.slice(parts["gaps"], F.lit(2), n).alias("next"),
        )

        def step(acc: Column, row: Column) -> Column:
            start = acc["at"] + F.length(row["gap"])
            end = start + F.length(row["v"])
            span = F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), row["v"].alias("v"),
                F.substring(row["gap"], -_BEFORE, _BEFORE).alias("before"),
                F.substring(row["next"], 1, _AFTER).alias("after"),
            )
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        def block(every: Column, acc: Column, first: Column) -> Column:
            inner = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
            done = F.aggregate(F.slice(every, first, F.lit(_BLOCK)), inner, step)
            return let(done, lambda d: F.struct(
                d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")
            ))

        empty = F.struct(
            F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")
        )
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), n), F.lit(_BLOCK))
        return let(rows, lambda every: F.aggregate(
            firsts, empty, lambda acc, first: block(every, acc, first),
            lambda acc: F.flatten(acc["out"]),
        ))

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    return let(parts, lambda p: F.when(F.size(p["found"]) > 0, located(p)).otherwise(_none()))


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


_VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s["v"].rlike(rf"\A{_PART}\.{_PART}\.{_PART}\.{_PART}\z"),
    "card": lambda s: let(_digits(s["v"]), lambda d: F.length(d).between(16, 19) & _luhn(d)),
    "phone": lambda s: F.length(_digits(s["v"])).between(8, 15),
}


def _base(text: Column) -> Column:
    """Base spans by kind, then start."""
    kinds = []
    for no, (kind, (pattern, needs)) in enumerate(BASE.items()):
        found = F.filter(_scan(text, no, pattern), _VALID[kind])
        holds = text.contains(needs) if needs else text.rlike("[0-9]")
        kinds.append(F.when(holds, found).otherwise(_none()))
    return F.concat(*kinds)


def _proposals(text: Column) -> Column:
    scans = [_scan(text, KINDS.index(k), p) for k, patterns in GENERATORS.items() for p in patterns]
    phone = KINDS.index("phone")
    fits = lambda s: (s["kind"] != phone) | F.length(_digits(s["v"])).between(7, 15)
    return F.when(text.rlike(_WORTH), F.filter(F.concat(*scans), fits)).otherwise(_none())


# --- features ------------------------------------------------------------------------------
#: Words beside a span, in the languages of the tables, that speak for a kind or against any.
_SAYS = {
    "email": r"mail|courriel|correo|contact|write|address|reach",
    "ip": r"\bip\b|host|server|addr|node|ping|gateway|serveur|servidor",
    "card": r"card|visa|master|amex|carte|karte|tarjeta|credit|kredit|payment|paid",
    "phone": r"phone|tel\b|tel[.:]|tél|telefon|teléfono|call|fax|mobile|móvil|handy|cell|dial|appel|ruf",
    "other": r"isbn|order|invoice|version|\bv$|ref\b|\bno[.:]|sku|date|total|price|token|serial|page|section|born|\bmac\b|time",
}


def _features(s: Column) -> list[Column]:
    v, before, after = s["v"], s["before"], s["after"]
    groups = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, F.length)
    count = lambda chars: F.length(F.regexp_replace(v, f"[^{chars}]", ""))
    holds = lambda text, pattern: text.rlike(f"(?i){pattern}")
    shape = [
        F.length(v), count("0-9"), count("A-Za-z"), F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)),
        F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        count(" "), count("-"), count("."), count("/"), count(":"), count("()"), count(r"\[\]{}<>"),
        holds(v, "@"), holds(v, r"\bat\b"), holds(v, r"\bdot\b"), _luhn(_digits(v)),
        holds(v, r"\A[(]?0"), holds(v, r"\A00"), holds(v, r"\A[3-6]"), holds(v, r"\A(19|20)[0-9]{2}\b"),
        holds(v, r"\b(19|20)[0-9]{2}\z"), holds(v, r"\A97[89]"), holds(v, r"[a-z]{2,}\z"),
        holds(v, r"\A\D*(?:0*(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\D+|\z)){4}\z"),
    ]
    beside = [holds(before, pattern) for pattern in _SAYS.values()]
    beside += [
        holds(before, r"[a-z0-9]\z"), holds(before, r"[#$€£=]\s?\z"), holds(after, r"\A[.,]?[0-9]"),
        holds(after, r"\A\s?(?:%|€|\$|£|km|kg|mm|cm|eur|usd)"), holds(after, r"\A[a-z]"),
    ]
    return [s["kind"].cast("double"), *(c.cast("double") for c in (*shape, *beside))]


def _margin(trees: Trees, f: Column) -> Column:
    """The trees as conditions on the array ``f`` of features."""
    inner = trees.feature.shape[1]

    def node(tree: int, at: int) -> Column:
        if at >= inner:
            return F.lit(float(trees.step[tree][at - inner]))
        feature, limit = int(trees.feature[tree][at]), int(trees.limit[tree][at])
        if limit >= len(trees.edges[feature]):
            return node(tree, 2 * at + 1)
        edge = float(trees.edges[feature][limit])
        return F.when(F.get(f, F.lit(feature)) > edge, node(tree, 2 * at + 2)).otherwise(
            node(tree, 2 * at + 1)
        )

    total = F.lit(trees.base)
    for tree in range(len(trees.feature)):
        total = total + node(tree, 0)
    return total


# --- training ------------------------------------------------------------------------------
def _digit_text(rnd: random.Random, shape: str) -> str:
    return "".join(rnd.choice("0123456789") if c == "9" else c for c in shape)


def _with_luhn(rnd: random.Random, n: int, first: str) -> str:
    body = first + "".join(rnd.choice("0123456789") for _ in range(n - 1 - len(first)))
    for last in "0123456789":
        total = 0
        for i, c in enumerate(reversed(body + last)):
            d = int(c) * (1 + i % 2)
            total += d - 9 * (d > 9)
        if total % 10 == 0:
            return body + last
    raise AssertionError("one last digit always fits")


def _sample(rnd: random.Random) -> tuple[str, str, str, bool]:
    """(kind, words before, value, whether it is personal data)."""
    kind, good = rnd.choice(KINDS), rnd.random() < 0.5
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9)))
    none = ["", "", word(), f"{word()} {word()}"]
    other = ["ISBN", "order", "invoice no.", "version", "ref", "SKU", "date:", "total", "serial",
             "page", "section", "time", "born"]
    if kind == "email":
        at = rnd.choice([" (at) ", "(at)", " [at] ", " at ", "[at]", " @ ", " {at} ", " AT "])
        dot = " dot " if at in (" at ", " AT ") else rnd.choice([".", " (dot) ", "[dot]", " . ", " [.] "])
        if good:
            name = word() + rnd.choice(["", f".{word()}", str(rnd.randint(1, 99))])
            host = dot.join([word(), rnd.choice(["com", "org", "net", "de", "fr", "es", "co"])])
            return kind, rnd.choice([*none, "mail", "e-mail:", "write to", "contact", "correo"]), name + at + host, True
        value = rnd.choice([
            f"{word()} at {word()} dot {rnd.randint(1, 99)}", f"{word()} (at) {rnd.randint(1, 9)}.{rnd.randint(10, 99)}",
            f"{rnd.randint(1, 99)} @ {rnd.randint(1, 99)}.{rnd.randint(10, 99)}",
        ])
        return kind, rnd.choice([*none, *other]), value, False
    if kind == "ip":
        octets = [str(rnd.randint(0, rnd.choice([9, 255]))) for _ in range(4)]
        if good and rnd.random() < 0.6:
            return kind, rnd.choice([*none, "host", "ip", "server"]), rnd.choice(["[.]", " [.] ", "(.)", "[dot]", " (dot) "]).join(octets), True
        if good:
            groups = [f"{rnd.randrange(65536):x}" for _ in range(8)]
            value = rnd.choice([":".join(groups), f"2001:db8::{groups[0]}:{groups[1]}", f"fe80::{':'.join(groups[:4])}"])
            return kind, rnd.choice([*none, "host", "ip", "node"]), value, True
        value = rnd.choice([
            ":".join(f"{rnd.randrange(256):02x}" for _ in range(6)), _digit_text(rnd, "12:59:59:99"),
            _digit_text(rnd, "9. 9. 9. 9"), _digit_text(rnd, "9 . 9 . 99 . 999"),
            "[.]".join(str(rnd.randint(256, 999)) for _ in range(4)),
        ])
        return kind, rnd.choice([*none, *other, "mac"]), value, False
    if kind == "card":
        said = ["card", "Visa", "credit card:", "carte", "Karte", "tarjeta", "paid with"]
        if good and rnd.random() < 0.5:
            d = _with_luhn(rnd, 15, rnd.choice(["34", "37"]))
            sep = rnd.choice([" ", "-", "."])
            return kind, rnd.choice([*none, *said]), sep.join([d[:4], d[4:10], d[10:]]), True
        if good and rnd.random() < 0.6:
            d = _with_luhn(rnd, 16, rnd.choice("456"))
            sep = rnd.choice([".", "_", "/", " "])
            return kind, rnd.choice([*none, *said]), sep.join(d[i : i + 4] for i in range(0, 16, 4)), True
        if good:
            return kind, rnd.choice(said), _with_luhn(rnd, rnd.choice([13, 15]), rnd.choice("3456")), True
        value = rnd.choice([
            _digit_text(rnd, "9" * rnd.randint(13, 19)), _digit_text(rnd, "978-9-99-999999-9"),
            _digit_text(rnd, "1699999999999"), _digit_text(rnd, "9999 9999 9999 9999"),
            _digit_text(rnd, "99.99.9999 99.99.9999"), _digit_text(rnd, "9999-9999-9999-9999"),
            _digit_text(rnd, "9 999 999 999 999"),
        ])
        d, before = "".join(c for c in value if c.isdigit()), rnd.choice([*none, *other, *said[:2]])
        if (len(d) > 15 or before in said) and d == _with_luhn(rnd, len(d), d[:-1]):
            value = value[:-1] + str((int(value[-1]) + 1) % 10)  # by chance a valid one
        return kind, before, value, False
    if good and rnd.random() < 0.2:
        value = _digit_text(rnd, rnd.choice(["+9 (999) 999-9999", "+99 (99) 999 9999", "+9 (999) 999-999"]))
        return kind, rnd.choice(none), value, True
    if good:
        value = _digit_text(rnd, rnd.choice([
            "(999) 999-9999", "999-999-9999", "999.999.9999", "0999 999 9999", "00 49 99 9999 9999",
            "01 99 99 99 99", "030/9999999", "0999-9999999", "(0999) 999999", "999 999 9999", "699 99 99 99",
        ]))
        sure = value[0] in "(0"
        said = ["phone", "tel.", "call", "fax:", "mobile", "Telefon", "téléphone", "móvil", "dial"]
        return kind, rnd.choice([*none, *said] if sure else said), value, True
    value = rnd.choice([
        _digit_text(rnd, "20%d-0%d-19" % (rnd.randint(10, 29), rnd.randint(1, 9))),
        _digit_text(rnd, "19.09.2019"), _digit_text(rnd, "1%d/0%d/2009" % (rnd.randint(0, 9), rnd.randint(1, 9))),
        _digit_text(rnd, "1999-2009"), _digit_text(rnd, "9 999 999"), _digit_text(rnd, "978-9-99-999999-9"),
        _digit_text(rnd, "9.9.9999"), _digit_text(rnd, "99-99-99"), _digit_text(rnd, "99999999 9999 99"),
        _digit_text(rnd, "9999 9999 9999 9999"), _digit_text(rnd, "999.999.999"), _digit_text(rnd, "20 30 40"),
    ])
    return kind, rnd.choice([*none, *other]), value, False


def _training_rows(seed: int = 13) -> list[tuple[str, str, int, int, bool]]:
    """(text, kind, start, end, whether the span is personal data)."""
    rnd, rows = random.Random(seed), []
    prose = lambda: " ".join(
        "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 9))) for _ in range(rnd.randint(0, 8))
    )
    for _ in range(TRAINING_TEXTS):
        kind, said, value, good = _sample(rnd)
        before = " ".join(x for x in (prose(), said) if x)
        before += " " if before else ""
        after = rnd.choice(["", ".", ",", " " + prose(), ". " + prose(), "\n" + prose()])
        if not good and rnd.random() < 0.15:
            after = rnd.choice([" EUR", " %", " km", " €"])
        rows.append((before + value + after, kind, len(before), len(before) + len(value), good))
    return rows


@cache
def _model() -> tuple[Trees, tuple[float, ...]]:
    """Trees, and the least margin by kind. The same on every call: seeds are fixed."""
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(_training_rows())],
        "no int, text string, kind string, start int, end int, good boolean",
    )
    spans = rows.select("no", "kind", "start", "end", "good", F.explode(_proposals(F.col("text"))).alias("s"))
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1)
    same = F.least("end", "s.end") - F.greatest("start", "s.start")
    hit = F.col("good") & (names == F.col("kind")) & (
        10 * same >= 9 * (F.greatest("end", "s.end") - F.least("start", "s.start"))
    )
    found = spans.select("no", hit.cast("double").alias("y"), F.array(*_features(F.col("s"))).alias("f"))
    table = sorted(map(tuple, found.collect()))
    part = np.array([r[0] for r in table])
    y, x = np.array([r[1] for r in table]), np.array([r[2] for r in table])
    fit = part % 2 == 0
    trees = fit_trees(x[fit], y[fit], rounds=32, depth=4)
    margin, kind, truth = trees.margin(x[~fit]), x[~fit][:, 0], y[~fit]
    limits = []
    for no in range(len(KINDS)):
        # the least margin from which on the share of true spans is PRECISION, at least even odds
        order = np.argsort(-margin[kind == no], kind="stable")
        m, t = margin[kind == no][order], truth[kind == no][order]
        enough = np.flatnonzero(np.cumsum(t) >= PRECISION * np.arange(1, len(t) + 1))
        limits.append(max(0.0, float(m[enough[-1]])) if len(enough) else float("inf"))
    return trees, tuple(limits)


# --- the operator --------------------------------------------------------------------------
def _outside(base: Column, more: Column) -> Column:
    """The spans of ``more`` that start in no base span, without repeats, by start."""
    flag = lambda spans, own: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["kind"].alias("kind")
    ))
    kept = "array<struct<start:int,own:int,end:int,kind:int>>"

    def step(acc: Column, s: Column) -> Column:
        free = (s["own"] == 1) & (s["start"] >= acc["at"])
        return F.struct(
            F.when(s["own"] == 0, F.greatest(acc["at"], s["end"])).otherwise(acc["at"]).alias("at"),
            F.when(free, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
        )

    def block(every: Column, acc: Column, first: Column) -> Column:
        inner = F.struct(acc["at"].alias("at"), F.array().cast(kept).alias("out"))
        done = F.aggregate(F.slice(every, first, F.lit(_BLOCK)), inner, step)
        return let(done, lambda d: F.struct(
            d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")
        ))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kept}>").alias("out"))
    every = F.array_sort(F.concat(flag(base, 0), F.array_distinct(flag(more, 1))))
    scanned = let(every, lambda spans: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(spans)), F.lit(_BLOCK)), empty,
        lambda acc, first: block(spans, acc, first), lambda acc: F.flatten(acc["out"]),
    ))
    return F.when(F.size(more) > 0, scanned).otherwise(F.array().cast(kept))


def personal_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``more``: arrays of (kind, start, end), by kind in the order of
    ``KINDS``, then start.

    ``base`` follows the rules, ``more`` are further spans that the trees select. A null or empty
    text has none. Rows, their order and other columns stay, also repeated rows; columns of these
    two names are replaced.
    """
    trees, limits = _model()
    columns = [c for c in docs.columns if c not in ("base", "more")]
    whole = F.coalesce(F.col(text), F.lit(""))

    def chosen(proposed: Column) -> Column:
        least = F.array(*(F.lit(x) for x in limits))
        judged = F.transform(proposed, lambda s: let(
            F.array(*_features(s)),
            lambda f: F.struct(s.alias("s"), (_margin(trees, f) >= F.get(least, s["kind"])).alias("ok")),
        ))
        return F.transform(F.filter(judged, lambda j: j["ok"]), lambda j: j["s"])

    # ranges first and values gone: later columns are cheap to evaluate more than once
    slim = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")
    )))
    both = let(_base(whole), lambda base: let(chosen(_proposals(whole)), lambda more: F.struct(
        slim(base).alias("base"), slim(_outside(base, more)).alias("more")
    )))
    spans = let(both, lambda b: F.array(b))
    out = docs.select(*columns, F.explode(spans).alias("_spans"))
    return out.select(*columns, "_spans.base", "_spans.more")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def personal_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, counts of base spans by kind, their digest, and all spans as one string."""
    found = personal_spans(docs.select(F.col(id_col), F.col(text).alias("text")))
    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")

    counts = [count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return found.select(
        id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.array_distinct(F.concat("base", "more")))).alias("spans"),
    )


_PIECE = 2048


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``redacted``: the text with every span replaced by ``[KIND]``.

    Spans that overlap are replaced together, by the kind that starts first. Null stays null.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    columns = [c for c in docs.columns if c not in ("base", "more", "redacted")]
    found = personal_spans(docs, text)

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        # only the pieces that hold the range are touched
        first = F.floor(start / _PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor((end - 1) / _PIECE).cast("int") - first + 1)
        return F.when(end <= start, F.lit("")).otherwise(
            F.substring(F.array_join(some, ""), start - first * _PIECE + 1, end - start)
        )

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        part = F.struct(acc["at"].alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(part))).alias("out"),
        )

    parts = "array<struct<start:int,end:int,kind:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(parts).alias("out"))
    by_start = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), s["kind"].alias("kind")
    )))
    whole = F.col(text)
    pieces = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    joined = let(pieces, lambda p: let(F.aggregate(by_start, empty, step), lambda merged: F.concat(
        F.array_join(F.transform(merged["out"], lambda s: F.concat(
            cut(p, s["start"], s["end"]), F.get(names, s["kind"])
        )), ""),
        cut(p, merged["at"], F.length(whole)),
    )))
    changed = F.size("base") + F.size("more") > 0
    return found.select(*columns, F.when(changed, joined).otherwise(whole).alias("redacted"))
