from __future__ import annotations

import random

from corpusloom.operators import hierarchy as H
from tests.conftest import rows

SCHEMA = "id long, parent_domain_id long, updated_at string, root_id long, path string, waiting long"


def brute(parents: dict) -> dict:
    out = {}
    for i in parents:
        chain, x = [i], i
        while (p := parents[x]) in parents:
            if p in chain:
                ring = chain[chain.index(p) :]
                out[i] = (min(ring), -1, "cycle")
                break
            chain.append(p)
            x = p
        else:
            out[i] = (chain[-1], len(chain) - 1, "/".join(map(str, reversed(chain))))
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, -1, "clash", 9) for r in data], SCHEMA)


def test_random_forests_with_cycles(spark):
    random.seed(3)
    parents = {}
    for i in range(1, 120):
        parents[i] = random.choice([None, 999, *range(max(1, i - 4), i + 3)])
    tree = H.hierarchy(frame(spark, [(i, p, "2025-01-01") for i, p in parents.items()])).cache()
    assert {r.id: (r.root_id, r.depth, r.path) for r in tree.collect()} == brute(parents)
    good = {i: list(map(int, path.split("/"))) for i, (_, depth, path) in brute(parents).items() if depth >= 0}
    assert rows(H.descendants(tree)) == sorted(((a, i, len(c) - k - 1) for i, c in good.items() for k, a in enumerate(c[:-1])), key=lambda t: tuple((False, str(v)) for v in t))
    sizes = {i: sum(i in c for c in good.values()) for i in good}
    assert {r.id: r.subtree_size for r in tree.collect() if r.depth >= 0} == sizes


def test_hot_parents_are_split(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_CHILDREN", 3)
    parents = {i: (1 if i % 3 else max(1, i // 2)) for i in range(2, 60)} | {1: None}
    got = {r.id: (r.root_id, r.depth, r.path) for r in H.found(frame(spark, [(i, p, "x") for i, p in parents.items()])).collect()}
    assert got == brute(parents)


def test_latest_row_nulls_ties_and_self_parent(spark):
    data = [(1, 2, "2025-01-01"), (1, None, "2025-02-01"), (2, 1, None), (2, 1, "2024-01-01"), (3, 3, "x"), (4, 3, "x"), (None, 1, "x"), (5, 404, "x"), (6, None, "x"), (6, 5, "x"), (6, 5, "x")]
    got = {r.id: (r.root_id, r.depth, r.path) for r in H.found(frame(spark, data)).collect()}
    assert got == {1: (1, 0, "1"), 2: (1, 1, "1/2"), 3: (3, -1, "cycle"), 4: (3, -1, "cycle"), 5: (5, 0, "5"), 6: (5, 1, "5/6")}


def test_empty_and_chain(spark):
    assert H.found(frame(spark, [])).count() == 0
    got = {r.id: r.depth for r in H.found(frame(spark, [(i, i - 1 or None, "x") for i in range(1, 21)])).collect()}
    assert got == {i: i - 1 for i in range(1, 21)}


def test_descendants_below_cycles(spark):
    parents = {1: 2, 2: 1, 3: 2, 4: 3, 5: 4, 6: 3, 7: 7, 8: 7, 10: None, 11: 10}
    tree = H.hierarchy(frame(spark, [(i, p, "x") for i, p in parents.items()]))
    got = {tuple(r) for r in H.all_descendants(tree).collect()}
    assert got == {(2, 3, 1), (2, 4, 2), (3, 4, 1), (2, 5, 3), (3, 5, 2), (4, 5, 1), (2, 6, 2), (3, 6, 1), (7, 8, 1), (10, 11, 1)}


def test_peeling_in_one_task_and_in_many(spark, monkeypatch):
    random.seed(11)
    parents = {i: random.choice([None, 5, *range(max(1, i - 2), i + 1), i + 1]) for i in range(1, 90)}
    edges = spark.createDataFrame([(i, p if p in parents else None) for i, p in parents.items()], "id long, parent long")
    one = rows(H.peel(edges, 1))
    monkeypatch.setattr(H, "ONE_TASK", 0)
    assert rows(H.peel(edges, 2)) == one
    got = {r.id: (r.root_id, r.depth, r.path) for r in H.found(frame(spark, [(i, p, "x") for i, p in parents.items()])).collect()}
    assert got == brute(parents)
