from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import domains as D
from corpusloom.operators import lexical as L
from corpusloom.operators import near as N
from corpusloom.operators import sampling as S
from tests.conftest import rows


def test_ngrams_stop_at_paragraphs(spark):
    df = spark.createDataFrame([(1, "A b c\n\nd a B"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    two = L.ngram_counts(L.sequences(df), 2).cache()
    assert rows(two) == [("a b", 2, 1), ("b c", 1, 1), ("d a", 1, 1)]
    assert rows(L.marginals(two)) == [("a", 2, 1), ("b", 1, 2), ("c", 0, 1), ("d", 1, 0)]
    assert L.ngram_counts(L.sequences(df.limit(0)), 3).count() == 0


def test_curves(spark):
    df = spark.createDataFrame([(i, "a " * (i % 3) + f"w{chr(97 + i)}") for i in range(9)], "doc_id long, text string")
    tok = L.tokens(df)
    v = L.vocabulary(tok)
    assert L.coverage(v, (1, 2)).orderBy("rank").collect()[-1]["share"] == 1.0
    last = L.vocabulary_growth(tok).orderBy(F.desc("part")).first()
    assert (last.documents, last.types) == (9, v.count())
    tf = sorted((r.tf for r in v.collect()), reverse=True)
    bins: dict = {}
    for rank, n in enumerate(tf, 1):
        bins.setdefault(math.floor(100 * math.log10(rank)), []).append((rank, n))
    want = {b: (round(sum(r for r, _ in x) / len(x), 6), round(sum(n for _, n in x) / len(x), 6)) for b, x in bins.items()}
    assert {r.bin: (r.rank, r.frequency) for r in L.zipf_bins(v).collect()} == want


def test_gini_ties_and_children(spark):
    vals = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 2, 2, 5])], "k long, v double")
    x = sorted([1, 1, 2, 2, 2, 5])
    want = 2 * sum((i + 1) * v for i, v in enumerate(x)) / (6 * sum(x)) - 7 / 6
    got = {r.metric: r.value for r in D.concentration(vals, "k", "v").collect()}
    assert got["gini"] == pytest.approx(want, abs=1e-6) and got["top_1"] == 5 and got["top_1000"] == 13
    dom = spark.createDataFrame([(1, "http://a.b", None, 0, 5, "x", "c"), (2, None, 1, 1, None, "x", "c"), (3, "c.d", 9, 1, 0, None, "c"), (3, "c.d", 1, 1, 4, "y", "c"), (None, "e", 1, 1, 1, "y", "c")], "id long, url string, parent_domain_id long, recursion_level int, request_count long, updated_at string, host string")
    canon = D.canonical_domains(dom)
    assert rows(D.children(canon)) == [(1, "a.b", 2, 4.0, 1)]
    assert rows(D.children_reconciliation(canon)) == [(3, 1, 0, 2, True)]
    assert rows(D.ancestors(canon, spark.createDataFrame([(3,), (77,)], "id long"))) == [(1,), (3,)]
    assert rows(D.levels(canon), "level", "domains", "requests") == [("0", 1, 5), ("1", 2, 4)]
    assert D.levels(D.canonical_domains(dom.limit(0))).count() == 0


def test_ancestors_are_never_cut(spark):
    canon = spark.createDataFrame([(i, i - 1 or None) for i in range(1, 6)], "id long, parent_domain_id long")
    wanted = spark.createDataFrame([(5,)], "id long")
    assert rows(D.ancestors(canon, wanted)) == [(i,) for i in range(1, 6)] == rows(D.ancestors(canon, wanted, rounds=4))
    with pytest.raises(RuntimeError):
        D.ancestors(canon, wanted, rounds=2)


def test_near_duplicates_against_brute_force(spark):
    random.seed(4)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)]
    texts = []
    for _ in range(12):
        base = random.choices(words, k=80)
        for _ in range(4):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(80)] = random.choice(words)
            texts.append(" ".join(w))
    texts += [texts[0], "short text", "", None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key long")
    grams = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in enumerate(texts) if t and len(t.split()) >= 50}
    first = {}
    for i, g in grams.items():
        first.setdefault(g, i)
    heads = sorted(first.values())
    want = [(a, b) for a in heads for b in heads if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.85]
    sets, members = N.shingle_sets(df)
    assert sorted(map(tuple, N.similar_sets(sets).select("a", "b").collect())) == want
    assert set(map(tuple, N.minhash_pairs(sets).select("a", "b").collect())) <= set(want)
    label = {i: i for i in heads}
    for _ in heads:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.class_id for r in N.near_groups(df).collect()}
    assert got == {i: label[first[g]] for i, g in grams.items()}
    assert N.near_groups(df.limit(0)).count() == 0


def test_all_near_groups_keeps_short_texts(spark):
    base = [f"w{chr(97 + k)}" for k in range(20)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(base[::-1]), "a b c d e", "a b c d e", "only four words here", "", None]
    long = [f"x{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(10)]
    texts += [" ".join(long), " ".join(long[:50] + ["new"] + long[51:90])]  # 81 of 101 shingles: between 0.80 and 0.85
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(N.all_near_groups(df)) == [(0, 0, 1), (1, 0, 1), (2, 2, 0), (3, 3, 0), (4, 3, 0), (5, 5, 0), (6, 6, 0), (8, 8, 1), (9, 8, 1)]


def test_gate_and_sample(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else None, i % 10 > 0) for i in range(100)], "id long, g string, good boolean")
    gate = {r.g: r for r in S.review_gate(df, "g", F.col("good")).collect()}
    assert gate["a"].reviewed == 90 and not gate["a"].approved and 0.81 < gate["a"].lower < 0.9
    one = rows(S.stratified_sample(df, "id", ["g"], 5), "id", "g")
    assert one == rows(S.stratified_sample(df.repartition(7), "id", ["g"], 5), "id", "g") and len(one) == 10
    assert S.broken({"x": (df, F.col("id") < 98)}).first()["violations"] == 2


def test_balanced_sample_takes_turns(spark):
    data = [(i, "big" if i < 500 else f"small{i % 7}" if i < 530 else None) for i in range(540)]
    df = spark.createDataFrame(data, "doc_id long, source string")
    got = S.balanced_sample(df, "doc_id", "source", 60).collect()
    assert len({r.doc_id for r in got}) == 60 and sum(r.drawn == "seeded" for r in got) == 30
    turns = [r.source for r in got if r.drawn == "turn"]
    assert len(set(turns)) == 9 and turns.count("big") <= 6
    assert S.balanced_sample(df.limit(0), "doc_id", "source", 10).count() == 0 and S.balanced_sample(df.limit(3), "doc_id", "source", 10).count() == 3
