from __future__ import annotations

import random

import numpy as np

from corpusloom.llm import encoding as E
from tests.conftest import rows

SCHEMA = "id long, text string, runs long, pair long"
CLEAN = ["A reunião já começou: às oito, não às nove — «é óbvio», disse José.", "La población eligió al niño más pequeño según el público…", "L'été à la forêt, où l'hôtel était très apprécié.", "ÇÃO EM MAIÚSCULAS É NORMAL À NOITE", "© 2024 Todos os direitos · café"]
WRONG = ("cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "cp850")


def garble(t, name):
    return t.encode("utf-8").decode(name, "replace").replace("�", "") if name != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in t.encode("utf-8"))


def test_maximum_scoring_segments_against_brute_force():
    random.seed(1)
    for _ in range(200):
        s = np.array([random.choice([-3, -1, 1, 2]) for _ in range(random.randint(1, 12))], float)
        got = E.segments(s)
        total = max((s[a:b].sum() for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        assert (max((s[a:b].sum() for a, b in got), default=0) == total) if total > 0 else not got
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_finds_and_restores(spark):
    random.seed(2)
    data = [(i, random.choice(CLEAN) + " " + random.choice(CLEAN)) for i in range(600)]
    bad = {}
    for k, name in enumerate(WRONG * 3):
        t = CLEAN[k % 3]
        bad[1000 + k] = t
        data.append((1000 + k, garble(t, name)))
    bad[2000] = CLEAN[1]
    data.append((2000, garble(garble(CLEAN[1], "cp1252"), "cp1252")))
    data += [(3000, "reuni�o"), (3001, None), (3002, ""), (None, "reuniÃ£o"), (0, data[0][1]), (3003, "É proibida, cafe»")]
    df = spark.createDataFrame([(*r, 1, 1) for r in data], SCHEMA)
    out = {r.id: r for r in E.repaired(df).collect()}
    assert set(out) == set(bad) | {3000}
    assert out[3000].lost == 1 and out[3000].restored == "reuni�o"
    assert sum(out[i].restored == t for i, t in bad.items()) >= 0.8 * len(bad)
    assert rows(E.found(df)) == sorted(((i,) for i in out), key=str)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "é" * 10 + "palavra é boa " * 200_000, 1, 1)], SCHEMA)
    assert E.found(df.limit(0)).count() == 0
    assert E.found(df).count() == 0


def test_classes_are_bounded_and_apart():
    cp = np.arange(0x110000)
    k = E._classes(cp)
    assert k.min() == 0 and k.max() == E.CLASSES - 1 and E.CLASSES**2 * 16 < 2.6e8
    assert (k[:0x600] == cp[:0x600]).all() and len(set(k[0x2000:0x2800].tolist())) == 0x800 and (np.diff(k) >= 0).all()
