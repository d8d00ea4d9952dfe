"""Near duplicates where rows of different texts share an id."""

import random

import pytest

from parapet.llm.minhash import near_duplicates


def plain(rows, width, percent):
    """Component by id: rows are linked by similar sets and by equal ids."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_rows_of_one_id_link_by_all_their_texts(spark, parts):
    rnd = random.Random(1)
    prose = lambda n: [f"w{rnd.randrange(500)}" for _ in range(n)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b = prose(60), prose(60)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (8, near(b)), (9, " ".join(prose(60)))]
    for i in range(20, 40):  # ids that repeat with texts near to those of others
        base = prose(50)
        rows += [(i, " ".join(base)), (i + 100, near(base)), (rnd.randrange(20, 40), near(base[::-1]))]
        rows += [(i + 200, " ".join(base[::-1]))]
    rows += [(5, None), (9, ""), (300, None)]
    rnd.shuffle(rows)
    want = plain(rows, 2, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = near_duplicates(df, width=2, percent=80).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert want[7] == want[8] == 5 and all(r.kept == (r.doc_id == r.component_id) for r in got)
