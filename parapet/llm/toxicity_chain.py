"""Toxicity categories by a chain of linear classifiers.

A logistic model per category; each also reads the probabilities of the categories before it, in
training those of models that have not seen the row (out of fold). The last link is the labelled
``toxic`` itself; the categories before it are weakly labelled: a toxic row that holds a word of the
category. Features are words and word beginnings, by hash, that tell toxic from other rows best.
Training takes a bounded, balanced sample of labelled rows; every text is scored in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import slices
from parapet.llm.hashing import lower_table, prefix_sums, span_hashes, spans

#: Words that mark a toxic text as of a category, in the order of the chain.
CATEGORIES = {
    "insult": "idiot moron stupid loser clown dumb fool jerk imbecile",
    "contempt": "pathetic worthless disgusting useless ridiculous repulsive",
    "dehumanising": "scum trash vermin garbage filth animal parasite",
    "threat": "kill die hurt destroy punch murder shoot",
}
LINKS = (*CATEGORIES, "toxic")
BEGINNINGS = (4, 5, 6)
ROWS, FEATURES, LEAST_Z, FOLDS = 6000, 1024, 5.0, 5

_LETTER = np.isin(lower_table(), [*range(97, 123), *range(128, 256)])


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a text's words (runs of letters) and their beginnings, with A-Z folded, and
    how dense each is: twice the count in a hundred words, short texts counting as longer ones."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    start, end = spans(data, ~_LETTER)
    sums = prefix_sums(data)
    out = [span_hashes(sums, start, end)]
    for size in BEGINNINGS:
        long = start[end - start > size]
        out.append(span_hashes(sums, long, long + size) ^ np.uint64(size))
    found, counts = np.unique(np.concatenate(out), return_counts=True)
    return found, np.minimum(2, 50 * counts / (len(start) + 50)).astype(np.float32)


def _word_hash(word: str) -> int:
    sums = prefix_sums(np.frombuffer(word.encode(), np.uint8))
    return int(span_hashes(sums, np.array([0]), np.array([len(word)]))[0])


_CATEGORY_HASHES = {
    name: np.array([_word_hash(w) for w in words.split()], np.uint64)
    for name, words in CATEGORIES.items()
}


@dataclass(frozen=True)
class ChainModel:
    """Sorted feature hashes, per link the weights of features, earlier links and an offset, and the
    probability of the last link from which a text counts as toxic."""

    features: np.ndarray
    weights: list[np.ndarray]
    threshold: float = 0.5

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """How dense each feature is in each text."""
        x = np.zeros((len(texts), len(self.features)), np.float32)
        for i, text in enumerate(texts):
            if text:
                own, dense = text_features(text)
                _, here, there = np.intersect1d(
                    self.features, own, assume_unique=True, return_indices=True
                )
                x[i, here] = dense[there]
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per link."""
        done = np.zeros((len(x), 0))
        for w in self.weights:
            margin = np.hstack([x, done, np.ones((len(x), 1))]) @ w
            done = np.hstack([done, (1 / (1 + np.exp(-margin)))[:, None]])
        return done


def _logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 80) -> np.ndarray:
    """Weights of logistic models of one target, one per column of row weights ``use``.

    Each model's two classes weigh the same; solved by accelerated gradient steps.
    """
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    sign = np.where(y > 0, 1, -1).astype(np.float32)[:, None]
    share = use.astype(np.float32)
    for side in (sign > 0, sign < 0):
        total = (share * side).sum(0)
        share = np.where(side, share / np.maximum(total, 1e-9) / 2, share)
    w = np.zeros((x.shape[1], use.shape[1]), np.float32)
    look, pace = w.copy(), 1.0
    rate = 4.0 / float((share.max(1) * (x * x).sum(1)).sum() + 1e-9)
    for _ in range(steps):
        slack = share * sign / (1 + np.exp(np.clip(sign * (x @ look), -30, 30)))
        new = look + rate * (x.T @ slack - 1e-3 * look)
        turn = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        look, w, pace = new + (pace - 1) / turn * (new - w), new, turn
    return w


def fit_chain(x: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> tuple[list, np.ndarray]:
    """Weights of each link, and the out-of-fold probabilities of each row."""
    use = np.stack([*(folds != k for k in range(FOLDS)), np.ones(len(x), bool)], axis=1)
    weights, done = [], np.zeros((len(x), 0))
    for y in targets.T:
        full = np.hstack([x, done])
        if y.min() == y.max():  # nothing to learn: the one known answer, all but surely
            w = np.zeros((full.shape[1] + 1, FOLDS + 1), np.float32)
            w[-1] = 6.0 if y.max() > 0 else -6.0
        else:
            w = _logistic(full, y, use)
        margin = np.hstack([full, np.ones((len(x), 1))]) @ w
        unseen = margin[np.arange(len(x)), folds]
        done = np.hstack([done, (1 / (1 + np.exp(-unseen)))[:, None]])
        weights.append(w[:, -1])
    return weights, done


def best_threshold(unseen: np.ndarray, toxic: np.ndarray) -> float:
    """The hundredth from 0.1 to 0.9 of the best F1 on unseen rows; of equal ones that nearest 0.5."""
    def rank(t: float) -> tuple:
        hit = unseen >= t
        return 2 * (hit & toxic).sum() / max(1, hit.sum() + toxic.sum()), -abs(t - 0.5)

    return max((i / 100 for i in range(10, 91)), key=rank)


def _sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``rows`` labelled rows, half of them toxic."""
    known = labels.where("toxic in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    limit = F.lit(0.0)
    for value, n in counts.items():
        limit = F.when(F.col("toxic") == value, min(1.0, rows / 2 / n) * (1 << 30)).otherwise(limit)
    drawn = F.broadcast(known.where(place < limit))  # at most about ``rows`` ids
    return docs.select("doc_id", "text").where("text is not null").join(drawn, "doc_id")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = text_features(text)[0].view(np.int64)
            arrays = [pa.array(found), pa.array(np.full(len(found), toxic, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["feature", "toxic"])


def _telling(sample: DataFrame, positives: int, negatives: int, most: int) -> np.ndarray:
    """The features whose shares among toxic and other rows differ most, by their z value."""
    counts = sample.select("text", "toxic").mapInArrow(_listed, "feature long, toxic int")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("toxic").alias("n"))
    share = F.col("n") / F.lit(positives + negatives)
    gap = F.col("a") / positives - (F.col("n") - F.col("a")) / negatives
    z = F.abs(gap) / F.sqrt(share * (1.000001 - share) * (1 / positives + 1 / negatives))
    top = counts.select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z)
    top = top.orderBy(F.desc("z"), "feature").limit(most).select("feature").toPandas()
    return np.sort(top["feature"].to_numpy(np.int64).view(np.uint64))


def _vectors(features: np.ndarray):
    shell = ChainModel(features, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, toxic = (batch.column(i).to_pylist() for i in range(3))
            rows, kinds = [], []
            for i, text in enumerate(texts):
                own, _ = text_features(text)
                kinds.append([bool(toxic[i] and np.isin(h, own).any())
                              for h in _CATEGORY_HASHES.values()])
                rows.append(shell.rows([text])[0].tobytes())
            arrays = [pa.array([str(i) for i in ids]), pa.array(toxic, pa.int32()), pa.array(rows),
                      pa.array(kinds, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "toxic", "x", "kinds"])

    return run


def train_chain(
    docs: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES
) -> ChainModel | None:
    """A chain from labelled documents, or None unless toxic and other rows are there to learn from."""
    sample = _sampled(docs, labels, rows)
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    chosen = _telling(sample, counts[1], counts[0], features)
    taken = sample.select("doc_id", "text", "toxic").mapInArrow(
        _vectors(chosen), "id string, toxic int, x binary, kinds array<boolean>"
    ).toPandas()
    taken = taken.sort_values(["id", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(taken["x"]), np.float32).reshape(len(taken), len(chosen))
    kinds = np.array(taken["kinds"].tolist(), float).reshape(len(taken), len(CATEGORIES))
    targets = np.hstack([kinds, taken["toxic"].to_numpy(float)[:, None]])
    folds = np.random.default_rng(3).permutation(len(x)) % FOLDS
    weights, unseen = fit_chain(x, targets, folds)
    return ChainModel(chosen, weights, best_threshold(unseen[:, -1], targets[:, -1] > 0))


def _scored(model: ChainModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            p = np.zeros((len(texts), len(LINKS)))
            at = [i for i, text in enumerate(texts) if text and model is not None]
            if at:
                p[at] = model.probabilities(model.rows([texts[i] for i in at]))
            arrays = [batch.column(0), *(pa.array(c) for c in p.T)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *LINKS])

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float | None = None, rows: int = ROWS
) -> DataFrame:
    """(doc_id, p_<category>..., p_toxic, toxic) of every row of ``docs`` (doc_id, text).

    A text is toxic from ``threshold`` on, by default the one that serves unseen labelled rows best.
    ``labels`` (doc_id, toxic 0 or 1) teach; an id labelled both ways counts as toxic, labels without
    an id or a document teach nothing. Null and empty texts have probability 0, and so has every text
    if the labels do not hold both classes. Whole texts are read; other columns are not.
    """
    model = train_chain(docs, labels, rows)
    if threshold is None:
        threshold = model.threshold if model else 0.5
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{name} double" for name in LINKS)
    scored = docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, {columns}")
    return scored.select(
        "doc_id", *(F.col(name).alias(f"p_{name}") for name in LINKS),
        (F.col("toxic") >= threshold).alias("toxic"),
    )
