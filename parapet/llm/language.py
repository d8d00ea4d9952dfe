"""Hierarchical language identification: the family first, then the language within it.

Texts become normalised counts of hashed byte trigrams. A one-versus-rest linear support vector
machine per family picks the family; one-versus-one machines, each trained on the texts of two
languages of that family only, then vote for the language. The machines learn from a bounded sample of labelled rows (``rows``,
spread evenly over the languages); every text is then scored in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import slices
from parapet.llm.hashing import mix

UNKNOWN = "und"
DIMENSIONS = 4096
#: Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi ur bn pa gu mr ne si",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv su mg",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "iranian": "fa ku ps tg",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_SLOT = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(1 << 32)).astype(np.uint32)
#: Bytes of a text once in lower case; digits, punctuation and white space all count as a blank.
_CODE = np.where(
    np.isin(np.arange(256), [*range(97, 123), *range(128, 256)]), np.arange(256), 32
).astype(np.uint16)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of trigram counts by hash slot, at length 1."""
    data = _CODE[np.frombuffer(b" %b " % text.lower().encode("utf-8", "replace"), np.uint8)]
    data = data[np.flatnonzero((data != 32) | (np.roll(data, 1) != 32))]  # runs of blanks are one
    if len(data) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    slot = _SLOT[data[:-2] << 8 | data[1:-1]] * np.uint32(31) + _SLOT[data[2:]]
    counts = np.sqrt(np.bincount(slot % DIMENSIONS, minlength=DIMENSIONS))
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def train_machines(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights (with a last row of offsets) of linear machines with squared hinge loss.

    ``y`` holds a column of -1 and 1 per machine; each side of a column weighs the same. Solved by
    accelerated gradient steps on all machines at once.
    """
    share = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1))
    share = (share * len(x)).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    look, pace, rate = w.copy(), 1.0, 1.0 / (1 / c + 2 * 2 * float(share.max()))
    rate *= 2  # rows have length sqrt(2) at most and spread over many slots
    for _ in range(steps):
        slack = y * np.maximum(0, 1 - y * margins(x, look)) * share
        fall = np.vstack([x.T @ slack, slack.sum(0)])
        new = look - rate * (look * (0.001 / c) - 2 / len(x) * fall)
        turn = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        look, w, pace = new + (pace - 1) / turn * (new - w), new, turn
    return w


def margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Margins of machines whose last weight is the offset."""
    return x @ weights[:-1] + weights[-1]


@dataclass(frozen=True)
class LanguageModel:
    """Weights of a machine per family, and of one per pair of languages within each family."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and the score of each row of ``x``."""
        near = _shares(margins(x, self.family_weights))
        pick, score = near.argmax(1), near.max(1)
        out = np.empty(len(x), object)
        for i, family in enumerate(self.families):
            at = np.flatnonzero(pick == i)
            inner = self._votes(family, x[at])
            out[at] = np.array(self.languages[family], object)[inner.argmax(1)]
            score[at] *= inner.max(1)
        return list(out), np.clip(score, 0, 1)

    def _votes(self, family: str, x: np.ndarray) -> np.ndarray:
        """Each language's mean share of its duels with the others of the family."""
        n = len(self.languages[family])
        if n == 1:
            return np.ones((len(x), 1))
        share = 1 / (1 + np.exp(-8 * margins(x, self.weights[family]).astype(np.float64)))
        votes = np.zeros((len(x), n))
        for k, (i, j) in enumerate(self.pairs[family]):
            votes[:, i] += share[:, k]
            votes[:, j] += 1 - share[:, k]
        return votes / (n - 1)


def _shares(margin: np.ndarray) -> np.ndarray:
    """Margins of rival machines as shares that add to 1."""
    e = np.exp(4 * (margin.astype(np.float64) - margin.max(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def _signs(values: np.ndarray, names: list[str]) -> np.ndarray:
    return np.where(values[:, None] == np.array(names, object)[None, :], 1, -1).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        langs, texts = batch.column(0), batch.column(1).to_pylist()
        rows = [features(t).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([langs, pa.array(rows, pa.binary())], ["lang", "x"])


def train_language_model(
    labelled: DataFrame, rows: int = 2400, id_col: str = "doc_id"
) -> LanguageModel | None:
    """A model from ``labelled`` (id, text, lang), or None without a usable row.

    Learns from at most about ``rows`` rows, as many of each language, chosen by a hash of the id.
    """
    usable = labelled.where("lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    each, place = rows / len(counts), F.pmod(F.xxhash64(id_col, "lang"), F.lit(1 << 30))
    limit = F.create_map(*(F.lit(v) for lang, n in counts.items()
                           for v in (lang, min(1.0, each / n) * (1 << 30))))
    sample = usable.where(place < limit[F.col("lang")]).select("lang", "text")
    taken = sample.mapInArrow(_featured, "lang string, x binary").toPandas()
    if taken.empty:  # few rows, none of them drawn
        taken = usable.select("lang", "text").limit(1).mapInArrow(
            _featured, "lang string, x binary"
        ).toPandas()
    taken = taken.sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(taken["x"]), np.float32).reshape(len(taken), DIMENSIONS)
    langs = taken["lang"].to_numpy(object)
    del taken
    groups = np.array([family_of(lang) for lang in langs], object)
    families = sorted(set(groups))
    languages, pairs, weights = {}, {}, {}
    for family in families:
        names = languages[family] = sorted(set(langs[groups == family]))
        pairs[family] = list(combinations(range(len(names)), 2))
        duels = [np.zeros((DIMENSIONS + 1, 0), np.float32)]
        for i, j in pairs[family]:
            at = np.flatnonzero((langs == names[i]) | (langs == names[j]))
            duels.append(train_machines(x[at], _signs(langs[at], [names[i]])))
        weights[family] = np.hstack(duels)
    top = train_machines(x, _signs(groups, families))
    return LanguageModel(families, top, languages, pairs, weights)


def _scored(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            if known:
                found, scores[known] = model.predict(np.stack([features(texts[i]) for i in known]))
                for i, lang in zip(known, found):
                    langs[i] = lang
            arrays = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    return run


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row is kept from learning: crc32 of its id as text, modulo ``folds``."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    return F.coalesce(rest == fold, F.lit(False))


def identify_languages(docs: DataFrame, rows: int = 2400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    Held-out rows teach nothing. ``lang_pred`` is a language of the learnt rows, or ``und`` with
    score 0 if the text is null or has no letter, or if no row could be learnt from. A null doc_id is
    not held out. Whole texts are read; other columns are not.
    """
    docs = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train_language_model(docs.where("not held_out"), rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(
        _scored(model), f"doc_id {kind}, lang_pred string, score double"
    )
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: list[str] | None = None, rows: int = 2400):
    """``docs`` without the texts whose language is ``und`` or not among ``languages``.

    The columns are those of ``docs``. Where no row could be learnt from, every text with a letter
    stays, unless ``languages`` asks for some, which then fails.
    """
    model = train_language_model(docs.where(~held_out()), rows)
    if model is None and languages is not None:
        raise ValueError("no labelled row to learn languages from")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if model is None:
                good = map(has_letter, batch.column("text").to_pylist())
                yield batch.filter(pa.array(good, pa.bool_()))
                continue
            texts = batch.select(["doc_id", "text"])
            langs = next(_scored(model)(iter([texts]))).column(1).to_pylist()
            good = [x != UNKNOWN and (languages is None or x in languages) for x in langs]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
