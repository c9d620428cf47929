from __future__ import annotations

import random

import numpy as np

from corpusloom.llm import leakage as K
from tests.conftest import rows

DOCS = "doc_id long, text string, item_id long, kind string"
ITEMS = "item_id long, text string, doc_id long"


def world():
    random.seed(9)
    vocab = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(15)]
    items = [(100 + i, " ".join(random.choices(vocab, k=random.randint(11, 40)))) for i in range(25)]
    items += [(200, items[0][1]), (201, "too short"), (202, ""), (203, None), (None, items[1][1])]
    docs = []
    for i in range(400):
        w = random.choices(vocab, k=random.randint(0, 120))
        if i % 3 == 0:
            src = items[random.randrange(25)][1].split()
            n = random.randint(10, 16)
            a = random.randrange(max(1, len(src) - n + 1))
            at = random.randrange(len(w) + 1)
            w[at:at] = src[a : a + n]
        docs.append((i, " ".join(w)))
    docs += [docs[0], (900, None), (901, ""), (None, items[0][1]), (902, items[2][1].upper().replace(" ", ", ") + "!"), (903, items[3][1].replace("w", "ẃ"))]
    return docs, items


def brute(docs, items):
    grams: dict = {}
    for i, t in items:
        if i is not None and t is not None:
            w = K.words_of(t)
            for k in range(len(w) - 11):
                grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        if d is not None and t is not None:
            w = K.words_of(t)
            for k in range(len(w) - 11):
                out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


def test_recall_against_brute_force(spark):
    docs, items = world()
    want = brute(docs, items)
    d = spark.createDataFrame([(*r, 1, "clash") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    got = {tuple(r) for r in K.found(d, i).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 30


def test_paraphrase_and_empty(spark):
    docs, items = world()
    changed = items[4][1].split()
    for k in range(5, len(changed), 7):
        changed[k] = "other"
    d = spark.createDataFrame([(*r, 1, "c") for r in [*docs, (950, " ".join(changed))]], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    kinds = {(r.doc_id, r.item_id): r.kind for r in K.leaks(d, i).collect()}
    assert len(changed) < 16 or kinds.get((950, 104)) in ("paraphrase", "exact")
    assert K.leaks(d, i.limit(0)).count() == 0 and K.found(d.limit(0), i).count() == 0


def test_common_subsequence_against_brute_force():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (30, 9)).astype(np.uint64), rng.integers(0, 4, (30, 7)).astype(np.uint64)

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q and p else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    assert K.common_subsequence(a, b).tolist() == [lcs(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_long_text(spark):
    _, items = world()
    filler = " ".join(random.Random(2).choices([f"z{k}" for k in range(500)], k=100_000))
    d = spark.createDataFrame([(1, filler + " " + items[0][1], 1, "c")], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items[:3]], ITEMS)
    n = len(items[0][1].split())
    assert rows(K.found(d, i)) == ([(1, 100)] if n >= 12 else [])


def test_paraphrases_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(60)]
    items = [(100 + i, " ".join(rng.choices(vocab, k=rng.randint(12, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randint(0, 90))
        for source in rng.sample(items, 2):  # often beside each other, one of them word by word
            part = source[1].split()[:20]
            if rng.random() < 0.6:
                part[5::6] = ["other"] * len(part[5::6])
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, " ".join(w)))
    want = brute(docs, items)
    for item, text in items:
        own = np.array(text.split())
        for at in range(0, len(own) - 11, 4):
            b = own[at : at + 16]
            for doc, t in docs:
                w = np.array(t.split())
                for k in range(max(1, len(w) - 23)):
                    a = w[k : k + 24]
                    if np.isin(b, a).sum() >= 0.8 * len(b) and lcs_of(a, b) >= 0.8 * len(b):
                        want.add((doc, item))
                        break
    d = spark.createDataFrame([(*r, 1, "c") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    got = {(r.doc_id, r.item_id) for r in K.leaks(d, i).collect()}
    assert got == want and len(want) > 100


def lcs_of(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rows_come_from_the_latent_search_only(spark):
    """Without candidates there is no row; recall of runs that stand alone in other text stays at 0.9 at least."""
    docs, items = world()
    d = spark.createDataFrame([(*r, 1, "c") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    assert K.found(d, i, candidate=1.01).count() == 0
    rng = random.Random(3)
    vocab = [f"u{k}" for k in range(900)]
    own = [(n, " ".join(rng.choices(vocab, k=60))) for n in range(120)]
    alone, want = [], set()
    for n in range(600):
        words, item = rng.choices(vocab, k=50), rng.randrange(120)
        a, at = rng.randrange(49), rng.randrange(51)
        words[at:at] = own[item][1].split()[a : a + 12]
        alone.append((n, " ".join(words)))
        want.add((n, item))
    frame = spark.createDataFrame([(*r, 1, "c") for r in alone], DOCS)
    latent = K.fit_latent(frame.select("doc_id", "text"), [t for _, t in own])
    index = K.index_items([n for n, _ in own], [t for _, t in own], latent)
    assert len(index.cells) > K.PROBES
    got = {(alone[t][0], x) for t, j, *_ in K._search([t for _, t in alone], latent, index, K.CANDIDATE, False) for x in index.items[j]}
    assert got >= want & got and len(got & want) >= 0.9 * len(want)


def test_paraphrases_must_hold_the_answers():
    text = "In the spring the mayor Tolka Ravi opened 37 schools near the river of the old town. Who opened the schools near the river?"
    assert K.fact_words(text) == {"tolka", "ravi", "37"}
    assert K.fact_words("The town is old. 12 people came") == {"12"} and K.fact_words("") == set() and K.fact_words("Why Ravi?") == set()
    rng = np.random.default_rng(0)
    latent = K.Latent(rng.standard_normal((K.BUCKETS, 8)).astype(np.float32), np.ones(8))
    index = K.index_items([1], [text], latent)
    other = "yes " * 10

    def kinds(changed):
        return {kind for _, _, kind, *_ in K._search([other + changed + other], latent, index, -1.0, True)}

    assert "paraphrase" in kinds("In the spring the mayor Tolka Ravi closed 37 schools near the river of the new town. ")
    assert "paraphrase" not in kinds("In the spring the mayor Anna Miro opened 12 schools beside the river of the old town. ")
