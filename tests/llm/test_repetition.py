from __future__ import annotations

import random
import re

import numpy as np

from corpusloom.llm import repetition as R
from tests.conftest import rows

SCHEMA = "id long, text string, share double"


def brute(text, n=5):
    w = re.findall(r"[^\W\d_]+", text.casefold())
    seen, hit = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit.update(range(i, i + n))
        seen.add(g)
    return len(hit) / len(w) if w else 0.0


def texts():
    random.seed(8)
    out = ["", " ", "one", "a a a a a a", "A b c d e, a B c d E", "straße strasse x y z straße STRASSE x y z"]
    for _ in range(150):
        words = random.choices("abcdefghij", k=random.randint(1, 60))
        words += words[: random.randint(0, 40)]
        out.append(" ".join(words))
    return out


def test_shares_and_sound_rules():
    ts = texts()
    w = R.Words(ts)
    want = np.array([brute(t) for t in ts])
    assert np.allclose(R.repeated_share(w), want)
    for rule in R.RULES.values():
        assert rule(w, 0.3, 5)[want >= 0.3].all()
    assert R.plan_order([]) == list(R.RULES)


def test_found(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(ts)] + [(3, ts[3], 0.5), (999, None, 0.5), (None, "a a a a a a", 0.5)], SCHEMA)
    assert sorted(r.id for r in R.repetitive(df, plan_rows=7).collect()) == [i for i, t in enumerate(ts) if brute(t) >= 0.3]
    prof = {r.id: r.repeated_share for r in R.repetition_profile(df).collect()}
    assert len(prof) == len(ts) and all(abs(prof[i] - brute(t)) < 1e-12 for i, t in enumerate(ts))
    assert R.repetitive(df.limit(0)).count() == 0


def test_long_text(spark):
    t = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta"], k=400_000))
    assert rows(R.repetitive(spark.createDataFrame([(1, t, 0.0)], SCHEMA)), "id") == [(1,)]
