"""The corpus operators against brute force, on edge cases and on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from parapet.llm import (  # noqa: E402
    decontaminate,
    dom,
    html_main,
    language,
    licenses,
    line_dedup,
    minhash,
    packing,
    preferences,
    toxicity_chain,
    vectors,
)
from parapet.llm.catalog import LLM_QUERIES  # noqa: E402
from parapet.llm.common import components  # noqa: E402
from parapet.llm.hashing import shingle_set, word_hashes  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, line_no int, score string"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def documents(spark, texts, langs=None, ids=None):
    """A table of documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    langs = langs or [None] * len(texts)
    rows = [(i, t, g, "s", None if t is None else len(t), 1, "x") for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows_by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def prose(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


EDGES = [None, "", " \n\t ", "one", "One two", "one two", "\n\nlone line\n", "x " * 30_000, "日本 語"]


# --- queries -------------------------------------------------------------------------------
@needs_tables
def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in LLM_QUERIES)
    assert numbers == list(range(1, 11))
    assert {*LLM_QUERIES, "pipeline"} <= queries().keys()


@needs_tables
@pytest.mark.parametrize("name", [n for n in LLM_QUERIES if n in oracle_sql()])
def test_query_equals_sql(spark, name):
    wrong, _ = compare.differences(spark, compare.connect(SF), name, SF)
    assert wrong is None, wrong


# --- hashes and components -----------------------------------------------------------------
def test_word_hashes_follow_words():
    rnd = random.Random(1)
    text = "".join(rnd.choice(["Ab", "ab", "é", "É", " ", "\n", "\x0b", "x" * 9]) for _ in range(5000))
    words, seen = text.encode().split(), {}
    for word, hashed in zip(words, word_hashes(text), strict=True):
        assert seen.setdefault(word.lower(), hashed) == hashed
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_set("a b", 5)) == 1 and len(shingle_set("a b a b a b", 2)) == 2
    assert not len(shingle_set(None, 2)) and not len(shingle_set(" \n", 2))


def test_components_of_chains_stars_and_trees(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)]
    edges += [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    rnd.shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 line dedup --------------------------------------------------------------------------
def plain_lines(docs):
    """{doc: (lines with words, removed line numbers)} by comparing all pairs of lines."""
    kept, out = [], {}
    for doc, text in sorted((d, t) for d, t in docs if t is not None):
        gone = []
        for no, line in enumerate(text.split("\n")):
            words = set(re.split(r"[\x20\x09-\x0D]+", line.lower())) - {""}
            if words:
                if any(100 * len(words & w) >= 80 * len(words | w) for w in kept):
                    gone.append(no)
                kept.append(words)
        out[doc] = gone
    return out


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(7)
    pool = [prose(rnd, rnd.randint(1, 14), 60) for _ in range(60)]
    for line in list(pool):  # near copies around the threshold
        words = line.split()
        words[rnd.randrange(len(words))] = "new"
        pool.append(" ".join(words))
    texts = ["\n".join(rnd.choices([*pool, "", " "], k=rnd.randint(1, 9))) for _ in range(80)]
    texts += ["A b\nb a A\nc", *EDGES]
    docs = documents(spark, texts)
    expected = plain_lines(list(enumerate(texts)))
    found = rows_by_id(line_dedup.line_report(docs))
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert found[i].removed_lines == ",".join(map(str, expected.get(i, []))), i
        assert found[i].n_lines == (0 if text is None else text.count("\n") + 1)
    left = rows_by_id(line_dedup.drop_repeated_lines(docs))
    for i, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        kept = [x for no, x in enumerate(lines) if no not in expected.get(i, [])]
        if text is None or not expected[i]:
            assert left[i].text == text
        elif any(x.split() for x in kept):
            assert left[i].text == "\n".join(kept) and left[i].n_chars == len(left[i].text)
        else:
            assert i not in left
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns


def test_line_dedup_of_repeated_and_unnamed_rows(spark):
    docs = documents(spark, ["a b", "a b", "a b", "a b"], ids=[1, 1, None, 2])
    found = sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.line_report(docs).collect())
    assert found == [(0, 0), (1, 0), (1, 0), (2, 1)]
    empty = documents(spark, [])
    assert line_dedup.line_report(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0


# --- 2 near duplicates ---------------------------------------------------------------------
def near_texts(rnd):
    texts = []
    for size in (3, 6, 20, 80, 300):
        for _ in range(6):
            base = prose(rnd, size).split()
            texts.append(" ".join(base))
            for change in (1, 1, max(1, size // 40), max(1, size // 20), size // 8):
                words = list(base)
                for _ in range(change):
                    words[rnd.randrange(size)] = f"n{rnd.randrange(99)}"
                texts.append(" ".join(words))
    crowd = prose(rnd, 60)  # one passage in many texts, and a crowd around one source
    texts += [f"{prose(rnd, 25)} {crowd} {prose(rnd, 25)}" for _ in range(40)]
    base = prose(rnd, 120).split()
    for _ in range(50):
        words = list(base)
        for _ in range(rnd.randrange(12)):
            words[rnd.randrange(len(words))] = f"m{rnd.randrange(999)}"
        texts.append(" ".join(words))
    return [*texts, *EDGES, texts[3], texts[3].upper(), "ONE"]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rnd = random.Random(width)
    texts = near_texts(rnd)
    rnd.shuffle(texts)

    def shingles(text):
        words = (text or "").encode().lower().split()
        if len(words) < width:
            return frozenset([tuple(words)] if words else [])
        return frozenset(zip(*(words[i:] for i in range(width))))

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))

    def find(x):
        return x if group[x] == x else find(group[x])

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    found = rows_by_id(minhash.near_duplicates(documents(spark, texts), width=width))
    assert len(found) == len(texts)
    for i in range(len(texts)):
        assert found[i].n_shingles == len(sets[i])
        assert (found[i].component_id, found[i].kept) == (find(i), find(i) == i), texts[i]
    left = minhash.drop_near_duplicates(documents(spark, texts), width=width)
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_longer_bands_miss_no_more_than_the_first():
    picks, rnd = minhash.long_bands(), np.random.default_rng(12)
    agree = rnd.random((20_000, picks.max() + 1)) < 0.8
    assert (~agree[:, picks].all(2).any(1)).sum() <= 3  # 90 of them by 64 draws of 240 registers
    a = np.random.default_rng(1).integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], a[:100] ^ np.uint64(0x9E3779B97F4A7C15)])
    size = minhash.DRAWS * minhash.DRAWN
    same = minhash.registers(a, size, minhash.FRESH) == minhash.registers(b, size, minhash.FRESH)
    assert abs(same.mean() - 0.8) < 0.05 and same[picks].all(1).any()
    first, fresh = (minhash.registers(a, 240, start) for start in (1, minhash.FRESH))
    assert (first == fresh).mean() < 0.05


def test_near_duplicates_with_odd_ids(spark):
    docs = documents(spark, ["a b c", "a b c", "a b c", None], ids=[5, 5, None, None])
    rows = minhash.near_duplicates(docs, width=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True)]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_register_estimate_is_near_the_truth():
    rnd = np.random.default_rng(1)
    for size, share in ((60, 0.5), (400, 0.8), (3000, 0.9)):
        pool = rnd.integers(0, 2**63, 2 * size).astype(np.uint64)
        a, b = pool[:size], pool[int(size * (1 - share)) : int(size * (2 - share))]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = minhash.estimate(*(minhash.registers(x, 2000).tobytes() for x in (a, b)), size, size)
        assert abs(got - true) < 0.05


# --- 3 languages ---------------------------------------------------------------------------
def test_languages(spark):
    rnd = random.Random(2)
    vowels = {"en": ["the", "and", "wh", "th"], "de": ["ung", "sch", "ei", "ü"],
              "fr": ["eau", "é", "ou", "ç"], "es": ["ción", "ñ", "ll", "os"], "xx": ["qq", "zk", "w"]}
    langs = [rnd.choice(list(vowels)) for _ in range(400)]
    texts = [" ".join("".join(rnd.choices(vowels[g], k=rnd.randint(1, 4))) for _ in range(25)) for g in langs]
    odd = [None, "", "12 34", "the " * 50_000]
    docs = documents(spark, texts + odd, [*langs, "en", None, "fr", None])
    found = rows_by_id(language.identify_languages(docs))
    assert len(found) == len(texts) + 4
    right = [found[i].lang_pred == g for i, g in enumerate(langs) if found[i].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [found[400 + k].lang_pred for k in range(3)] == ["und"] * 3 and found[403].lang_pred == "en"
    import zlib
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(400), 403}


def test_languages_without_lessons(spark):
    rows = language.identify_languages(documents(spark, ["abc", None])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert language.identify_languages(documents(spark, [])).count() == 0
    same = documents(spark, ["abc def"] * 5, ["pt"] * 5, ids=[0, 0, None, 3, 4])
    assert {r.lang_pred for r in language.identify_languages(same).collect()} == {"pt"}


# --- 4 vectors -----------------------------------------------------------------------------
def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = [rnd.standard_normal(8) for _ in range(150)]
    x += [x[i % 40] * rnd.uniform(0.5, 2) + rnd.normal(0, 0.12, 8) for i in range(150)]
    x += [x[0].copy() for _ in range(5)] + [x[7] + rnd.normal(0, 0.02, 8) for _ in range(60)]
    labels = [int(v) for v in rnd.integers(0, 3, len(x))]
    rows = [(i, [float(t) for t in v], g, "x") for i, (v, g) in enumerate(zip(x, labels))]
    n = len(rows)
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [1.0, 2.0], [1e300] * 8]
    rows += [(n + i, v, 0, "x") for i, v in enumerate(odd)] + [(n + 9, list(x[0]), None, "x")]
    rows = [(i, v if v is None else [t if t is None else float(t) for t in v], g, s) for i, v, g, s in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string")
    found = rows_by_id(vectors.near_vectors(df.repartition(3)), "vec_id")
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array(labels)[:, None] == np.array(labels)[None, :]
    linked = (u @ u.T >= 0.93) & same
    np.fill_diagonal(linked, False)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], n).min(1))
        if (new == low).all():
            break
        low = new
    for i in range(n):
        assert (found[i].n_links, found[i].component_id) == (linked[i].sum(), low[i])
        assert found[i].kept == (low[i] == i)
    assert all(found[i].n_links == 0 and found[i].kept for i in found if i >= n)
    assert len(found) == len(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_windows_reach_over_partition_cuts(spark):
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal(16)
    rows = [(i, [float(t) for t in base + rnd.normal(0, 0.01, 16)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = vectors.near_vectors(df, passes=1, window=3).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.n_links, r.component_id) for r in found} == {(299, 0)}


def test_recall_of_large_labels():
    """Pairs at the threshold meet in windows, by the passes a label of this size and shape gets."""
    rnd = np.random.default_rng(8)
    n, pairs, dims, shared = 60_000, 400, 64, 1.2
    x = rnd.standard_normal((n, dims)).astype(np.float32)
    x[:, 0] += shared * dims**0.5  # a mean direction that all share
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rnd.standard_normal((pairs, dims))
    d -= (d * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    x[pairs : 2 * pairs] = 0.9305 * x[:pairs] + (1 - 0.9305**2) ** 0.5 * d
    sample = x[:: n // vectors.SAMPLE].astype(np.float64)
    passes = vectors.passes_needed(sample, n, 0.93, vectors.WINDOW)
    assert passes > 16 and passes > vectors.passes_needed(sample, n // 10, 0.93, vectors.WINDOW)
    frame = pd.DataFrame({"unit": [row.astype(np.float64).tobytes() for row in x], "id": np.arange(n),
                          "grp": "a", "passes": passes})
    frame["centre"] = [sample.mean(0).astype(np.float32).tobytes()] * n
    met = np.zeros(pairs, bool)
    for p in range(passes):
        batch = next(vectors._signs([p], 64)(iter([pa.RecordBatch.from_pandas(frame)])))
        place = np.empty(n, int)
        place[np.argsort(np.array(batch["sign"].to_pylist(), "S8"), kind="stable")] = np.arange(n)
        met |= abs(place[:pairs] - place[pairs : 2 * pairs]) <= vectors.WINDOW
    assert met.mean() >= 0.995


def test_forest_connects_what_links_connect():
    rnd = np.random.default_rng(9)
    a, b = rnd.integers(0, 200, (2, 150))
    at = vectors._forest(200, a, b)

    def parts(links):
        low = list(range(200))
        for _ in range(200):
            for i, j in links:
                low[i] = low[j] = min(low[i], low[j])
        return low

    assert parts(zip_list := list(zip(a, b))) == parts([zip_list[i] for i in at])
    assert len(at) == 200 - len(set(parts(zip_list)))


# --- 5 toxicity ----------------------------------------------------------------------------
def test_toxicity(spark):
    rnd = random.Random(6)
    bad = ["idiot", "scum", "pathetic", "zlort", "zlortig"]
    texts, labels = [], []
    for i in range(600):
        words = prose(rnd, rnd.randint(15, 60)).split()
        if i % 5 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(bad)
        texts.append(" ".join(words))
        labels.append((i, 1 if i % 5 == 0 else 0))
    taught = spark.createDataFrame(
        [x for x in labels if x[0] % 2 == 0] + [(0, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    docs = documents(spark, [*texts, None, "", "idiot scum " * 20_000])
    found = rows_by_id(toxicity_chain.score_toxicity(docs, taught))
    wrong = [i for i, y in labels if i % 2 and found[i].toxic != bool(y)]
    assert len(wrong) <= 3
    assert not found[600].toxic and not found[601].toxic and found[602].toxic
    assert all(0 <= found[i][f"p_{k}"] <= 1 for i in found for k in toxicity_chain.LINKS)
    insults = [found[i].p_insult for i in range(1, 600, 2) if "idiot" in texts[i].split()]
    others = [found[i].p_insult for i in range(1, 600, 2) if i % 5]
    assert min(insults) > max(others)


def test_toxicity_without_lessons(spark):
    docs, none = documents(spark, ["a", None]), spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.toxic for r in toxicity_chain.score_toxicity(docs, none).collect())
    assert toxicity_chain.score_toxicity(documents(spark, []), none).count() == 0


def test_chain_links_read_unseen_predictions():
    rnd = np.random.default_rng(0)
    x = (rnd.random((300, 6)) < 0.3).astype(np.float32)
    first = x[:, 0]
    targets = np.stack([first, np.maximum(first, x[:, 1]), np.zeros(300)], axis=1)
    folds = np.arange(300) % toxicity_chain.FOLDS
    weights, unseen = toxicity_chain.fit_chain(x, targets, folds)
    assert [len(w) for w in weights] == [7, 8, 9]
    assert ((unseen[:, :2] > 0.5) == (targets[:, :2] > 0)).mean() > 0.95 and unseen[:, 2].max() < 0.01
    assert weights[1][6] > 0  # the second link leans on the first one's probability


# --- 6 pages -------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header><a href="/">Site</a></header><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies here.</p></div>
<article><h1>A &amp; B&nbsp;C</h1><p><b>First   line, with words enough to count.<br><p>Second &lt;block&gt;
 goes on and on, as it should.<div class="ad">Buy now</div><p>Third one &eacute;nds here, after all.</article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot, thank you.</p></div></section>
<form><input name=q><button>Go</button></form><aside class="sidebar"><p>Related things</p></aside>
<footer>&copy; all</footer></body></html>"""
MAIN = ("A & B C\nFirst line, with words enough to count.\nSecond <block> goes on and on, as it should.\n"
        "Third one énds here, after all.")


def test_pages(spark):
    pages = [PAGE, None, "", "<p>", "< 5 > 3", PAGE[:900] + "<p clas", "<div>" * 5000, PAGE]
    df = spark.createDataFrame([(i, f"u{i}", p, "t") for i, p in enumerate(pages)],
                               "page_id long, url string, html string, text string")
    found = rows_by_id(html_main.extract_pages(df), "page_id")
    assert found[0].text == found[7].text == MAIN
    assert all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in found.items())
    assert [found[i].text for i in (1, 2, 3, 6)] == [""] * 4
    assert html_main.extract_pages(df.limit(0)).count() == 0


def test_generated_pages_are_extracted():
    """Held-out accuracy over pages whose main text is known by construction."""
    rnd, model, right = random.Random(77), html_main.block_model(), 0
    for _ in range(200):
        page = html_main.read_page(html_main.training_page(rnd))
        truth = [True, *(html_main._labels(page)[1:] > 0)]
        odds = model.margin(html_main.block_features([page]))
        right += page.text(html_main.consistent_choice(page, list(odds))) == page.text(truth)
    assert right >= 180


@pytest.mark.parametrize(("source", "text"), [
    ('<p>One <svg class="i"/>two.</p><p>Three <svg><path d="M0"/>x</svg>four.</p>', "One two.\nThree four."),
    ("<p>A <math/>b <math><mi>x</mi></math> c.</p>", "A b x c."),
    ("<p>A <object data='v'>see the film</object> b.</p>", "A see the film b."),
    ("<div><p>A <svg>x</p><p>b.</p></div><p>c <svg>y</svg>d.</p>", "A\nb.\nc d."),
    ("<div>A <template>x <div>y</div></div><p>b.</p><template>z</template>", "A\nb."),
    ("<div>A <noscript>x</div><p>b.</p>", "A\nb."),
    ("<div>A <noscript><div>x</div></noscript> b.</div>", "A b."),
    ("<div>A <select><option>x<p>b.</p></div>", "A\nb."),
    ("<p>A <svg><foreignObject><p>x</p></foreignObject></svg>b.</p>", "A b."),
    ("<p title=it's>Hello there. It's fine <b>x</b></p>", "Hello there. It's fine x"),
    ('<p>5" disk <img alt="a > b">and <i class="w>x">y</i></p>', '5" disk and y'),
    ("<p 'odd>A.</p><p class = 'b>c'>d's.</p>", "A.\nd's."),
])
def test_odd_markup_loses_no_text(source, text):
    page = dom.read_page(f"<html><body>{source}</body></html>")
    assert page.text([True] * len(page.kind)) == text


def test_choice_is_consistent():
    page = html_main.read_page("<div><p>a</p><div><p>b</p></div></div><ul><li>c</ul>")
    rnd = random.Random(1)
    for _ in range(200):
        odds = [rnd.uniform(-3, 3) for _ in page.kind]
        keep = html_main.consistent_choice(page, odds)
        assert all(keep[page.parent[i]] or not keep[i] for i in range(1, len(keep)))
        best = max(
            sum(o for o, k in zip(odds[1:], mask) if k)
            for mask in ([bool(m >> i & 1) for i in range(len(keep) - 1)] for m in range(2 ** (len(keep) - 1)))
            if all(not k or page.parent[i + 1] == 0 or mask[page.parent[i + 1] - 1] for i, k in enumerate(mask))
        )
        assert abs(sum(o for o, k in zip(odds[1:], keep[1:]) if k) - best) < 1e-9


# --- 7 licences ----------------------------------------------------------------------------
def test_licenses(spark):
    mit = dict(reversed(licenses.TEMPLATES[:4]))["MIT"]
    texts = ["some other words come first\nreleased under THE mit license!", licenses.TEMPLATES[3][1].replace(" ", "\n\n\n"),
             "Licensed under CC BY-NC 4.0.\n" + "and so on " * 9 + "\nLicensed under CC BY 4.0.", "the MIT license is nice", mit, *EDGES]
    found = rows_by_id(licenses.scan_licenses(documents(spark, texts)))
    assert (found[0].licenses, found[0].best_dice, found[0].n_matches) == ("MIT", 1.0, 1)
    assert found[1].best_license == "MIT" and found[1].best_dice == 1.0
    assert found[2].licenses == "CC-BY-4.0,CC-BY-NC-4.0" and found[2].n_matches == 2
    assert all(found[i].n_matches == 0 and found[i].best_license is None for i in (3, *range(5, len(texts))))
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


# --- 8 decontamination ---------------------------------------------------------------------
def plain_contamination(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    doc, hit, named = words(text), set(), set()
    for item, own in items:
        own = words(own)
        for s in range(max(1, len(own) - window + 1) if own else 0):
            part = own[s : s + window]
            for at in range(len(doc) - len(part) + 1):
                if doc[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    named.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()
    return len(doc), len(hit), len(named), digest, bool(hit)


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_contamination_equals_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rnd = random.Random(9)
    items = [(i, prose(rnd, rnd.choice([1, 3, 9, 10, 11, 25]), 30)) for i in range(25)]
    items += [(98, None), (99, " ?! "), (7, items[3][1]), (40, items[3][1].upper())]
    texts = [prose(rnd, rnd.randint(0, 40), 30) for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] += "; " + rnd.choice(items)[1].upper() + " -- " + prose(rnd, 4, 30) if i else ""
    texts += [items[0][1] * 2, f"{items[4][1]}, {items[4][1]}", *EDGES]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, key string")
    found = rows_by_id(decontaminate.contamination(docs, bench))
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain_contamination(text, items)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i in found if not found[i].contaminated}
    assert not any(r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    twice = documents(spark, [texts[0], texts[61], texts[61]], ids=[None, 1, 1])
    assert sorted(r.n_hit for r in decontaminate.contamination(twice, bench).collect()) == sorted(
        plain_contamination(t, items)[1] for t in (texts[0], texts[61], texts[61]))


# --- 9 packing -----------------------------------------------------------------------------
def test_packing_is_an_exact_round_trip(spark):
    rnd = random.Random(3)
    texts = [" ".join(["w"] * rnd.choice([1, 5, 60, 511, 512, 900, 3000, 8191, 8192, 20_000])) for _ in range(120)]
    docs = documents(spark, [*texts, None, "", " ", texts[0]], ids=[*range(120), 500, 501, 502, 0])
    for shard in (20_000, 25):
        rows = packing.pack_documents(docs, shard_pieces=shard).collect()
        sizes, bins = {}, {}
        for r in rows:
            sizes.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
            bins.setdefault((r.shard, r.bin), []).append(r)
        for i, text in enumerate(texts):
            n, times = len(text.split()) + 1, 2 if i == 0 else 1
            assert Counter(sizes[i]) == Counter(
                {(s, min(8192, n - s)): times for s in range(0, n, 8192)})
        assert not {500, 501, 502} & sizes.keys()
        for part in bins.values():
            part.sort(key=lambda r: r.offset)
            ends = [r.offset + r.n_tokens for r in part]
            assert [r.offset for r in part] == [0, *ends[:-1]]
            fit = min(n for n in packing.LENGTHS if n >= ends[-1])
            assert {r.capacity for r in part} == {fit}
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_joint_lengths_cost_no_more_than_one_length():
    rnd = random.Random(8)
    for _ in range(20):
        sizes = sorted((min(8192, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(300)), reverse=True)
        _, final = packing.pack_sizes(sizes)
        cost = sum(map(packing.sequence_cost, final))
        _, used = packing._fill(sizes, packing.LENGTHS, 8192)
        assert cost <= sum(packing.sequence_cost(8192) for _ in used)
        assert sum(final) >= sum(sizes)


# --- 10 preferences ------------------------------------------------------------------------
def test_preferences(spark):
    def turns(*texts):
        return [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]

    cases = [
        (turns("q", "a", "r", "b"), turns("q", "a", "r", "c"), 3),
        (turns("q", "a"), turns("q", "a"), 2),
        (turns("q"), turns("q", "a"), 1),
        (turns("x"), turns("y"), 0),
        (None, turns("y"), 0),
        ([("user", None), (None, "z")], [("user", None), (None, "w")], 1),
    ]
    schema = ("id int, prompt string, chosen array<struct<role:string,text:string>>, "
              "rejected array<struct<role:string,text:string>>")
    df = spark.createDataFrame([(i, "old", a, b) for i, (a, b, _) in enumerate(cases)], schema)
    for i, r in rows_by_id(preferences.format_preferences(df), "id").items():
        a, b, n = cases[i]
        assert r.n_prompt_turns == n

        def shown(ts):
            return "".join(f"<|{role or 'unknown'}|>\n{text or ''}<|end|>\n" for role, text in ts)

        for done, own in ((r.chosen, a or []), (r.rejected, b or [])):
            assert r.prompt == shown(own[:n]) if own else n == 0
            assert done.text == shown(own[n:])
            assert sum(x.chars for x in done.runs) == len(done.text)
            at, learnt = 0, ""
            for run in done.runs:
                learnt += done.text[at : at + run.chars] if run.learn else ""
                at += run.chars
            assert learnt == "".join(f"{t or ''}<|end|>\n" for role, t in own[n:] if role == "assistant")


def test_preference_rows_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, kind string"
    rows = [(1, 0, "user", "q", "k"), (1, 1, "assistant", "a", "k"), (1, 1, "assistant", "a", "k"),
            (2, 0, "user", "q", "k"), (3, 0, "user", None, "k"), (3, None, "assistant", "z", "k"),
            (None, 0, "user", "q", "k"), (4, 0, None, None, "k")]
    found = preferences.preference_rows(spark.createDataFrame(rows, schema)).collect()
    assert {(r.kind, r.chosen_id, r.rejected_id, r.n_prompt_turns) for r in found} == {
        ("sibling", 1, 2, 1), ("echo", 1, 1, 1), ("echo", 3, 3, 0)}
    assert preferences.preference_rows(spark.createDataFrame([], schema)).count() == 0


# --- pipeline ------------------------------------------------------------------------------
def test_native_plans_run_no_python(spark):
    docs = documents(spark, ["a b c", "Released under the MIT License."])
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    talk = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    for df in (line_dedup.line_report(docs), licenses.scan_licenses(docs),
               decontaminate.contamination(docs, bench), preferences.preference_rows(talk)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"):
            assert word not in plan


@needs_tables
def test_pipeline_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "minhash_dedup", "decontamination", "packing"]
    for name in ("language_id", "line_dedup", "minhash_dedup", "decontamination"):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.keep(stages[name](spark, docs, SF), "t")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if t and any(map(str.isalpha, t))}
        elif name == "line_dedup":
            gone = plain_lines(list(before.items()))
            for i, text in before.items():
                left = [x for no, x in enumerate(text.split("\n")) if no not in gone[i]]
                assert after.get(i) == ("\n".join(left) if any(x.split() for x in left) else None)
        elif name == "decontamination":
            assert after == {i: t for i, t in before.items() if not plain_contamination(t, bench)[4]}
        else:
            assert after.items() <= before.items()
    packed = corpus_pipeline.run(spark, SF)
    total = {i: len(t.split()) + 1 for i, t in after.items() if t.split()}
    found = Counter()
    for r in packed.collect():
        found[r.doc_id] += r.n_tokens
    assert found.keys() == total.keys()
