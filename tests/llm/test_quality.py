from __future__ import annotations

import random

import numpy as np

from corpusloom.llm import quality as Q
from tests.conftest import rows

SCHEMA = "id long, text string, kind string, lines long"


def corpus():
    random.seed(4)
    out = []
    for i in range(300):
        kind, text = random.choice(Q.EXAMPLES)
        parts = text.split("\n")
        random.shuffle(parts)
        out.append((i, kind, "\n".join(parts)))
    return out


def test_kinds_of_inspected_examples(spark):
    data = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, _, t in data] + [(0, data[0][2], "clash", 1), (900, "", "c", 1), (901, " \n ", "c", 1), (902, None, "c", 1), (None, "x", "c", 1)], SCHEMA)
    out = {r.id: r.kind for r in Q.page_kinds(df).collect()}
    assert set(out) == {i for i, _, _ in data} | {900, 901} and out[900] is None and out[901] is None
    assert np.mean([out[i] == k for i, k, _ in data]) > 0.97
    assert all(k != "prose" for _, k in rows(Q.found(df)))


def test_two_thirds_rule():
    s = Q.statistics("The people of the town met on the bridge and spoke for a long time.\n- salt\n- bread")
    assert s["prose_share"] > 2 / 3 and s["list_share"] < 1 / 3 and s["lines"] == 3
    assert Q.statistics("")["lines"] == 0 and abs(sum(Q.statistics("a b. c\n1;2;3")[f"{k}_share"] for k in Q.KINDS) - 1) < 1e-9


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "- item number\n" * 100_000, "c", 1)], SCHEMA)
    assert Q.found(df.limit(0)).count() == 0
    assert Q.page_kinds(df).count() == 1
    m = Q.fit_mixture(Q.document_statistics(df.limit(0)))
    assert len(m.weight) == 1 and len(m.kinds) == 1


def test_the_mixture_decides(spark):
    """Kinds come from the components: with their kinds taken away nothing is found; and its rounds move the components."""
    data = corpus()
    stats = Q.document_statistics(spark.createDataFrame([(i, t, "c", 1) for i, _, t in data], SCHEMA)).cache()
    m = Q.fit_mixture(stats)
    assert {r.kind for r in Q.classify(stats, m).collect()} == set(Q.KINDS)
    assert abs(Q.fit_mixture(stats, rounds=0).mean - m.mean).max() > 0.1 and abs(m.weight.sum() - 1) < 1e-9
    m.kinds = ["prose"] * len(m.kinds)
    assert {r.kind for r in Q.classify(stats, m).collect()} == {"prose"}


def test_page_of_two_kinds(spark):
    prose = "The people of the town met on the bridge and spoke for a long time about the winter.\n"
    table = "Vela\t2019\t35%\tTolka\n"
    data = [(i, prose * 5 + table * 3, "c", 1) for i in range(6)] + [(10, prose + table * 30, "c", 1), (11, prose * 4 + table * 12, "c", 1)]
    out = {r.id: r for r in Q.page_kinds(spark.createDataFrame(data, SCHEMA)).collect()}
    assert out[0].kind == "prose" and out[10].kind == "table" and out[10].table_share > 2 / 3 and out[11].confidence < 2 / 3
    assert abs(sum(out[11][f"{k}_share"] for k in Q.KINDS) - 1) < 1e-9
