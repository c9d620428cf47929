from __future__ import annotations

import random
import unicodedata

from corpusloom.llm import copies as C
from tests.conftest import rows

SCHEMA = "id long, text string, hi long, copies long"


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, 1) for r in data], SCHEMA)


def test_canonical():
    assert C.canonical("Ábc,  1-2!") == C.canonical(unicodedata.normalize("NFD", "áB C12")) == "ábc12"
    assert C.canonical("Straße") == C.canonical("STRASSE")
    assert C.canonical("Brand: X\nSize: 12,5") == C.canonical("size: 12.5 | BRAND:x") == C.canonical("Size: 12,5; Brand: X")
    assert C.canonical("Brand: X\nSize: 1") != C.canonical("Brand: 1\nSize: X")
    assert C.canonical("Brand: wide\n value\nSize: 1") == C.canonical("Size: 1\nBrand: wide value")
    assert C.canonical("one two\nthree") != C.canonical("three\none two")
    assert C.canonical(" .,;\n") == C.canonical("") == ""


def test_groups_hot_and_cold_against_brute_force(spark):
    random.seed(6)
    base = ["alpha beta", "gamma", "A: 1; B: 2", "delta 9", "!!", ""]
    data = []
    for i in range(300):
        t = random.choices(base, weights=[100, 5, 5, 3, 3, 3])[0]
        t = random.choice([t, t.upper(), t.replace(" ", "  \n"), f"«{t}»" if ":" not in t else t])
        data.append((i * 7 % 300, t))
    data += [*data[:20], (900, None), (None, "gamma"), (901, "single one")]
    by: dict = {}
    for i, t in data:
        if i is not None and t is not None and C.canonical(t):
            by.setdefault(C.canonical(t), set()).add(i)
    want = sorted((min(g), i) for g in by.values() for i in g if i != min(g))
    for hot in (5, 20_000):
        got = [tuple(r) for r in C.found(frame(spark, data), hot_rows=hot, salts=4).orderBy("kept_id", "copy_id").collect()]
        assert got == want
        assert {tuple(r) for r in C.copy_groups(frame(spark, data), hot_rows=hot).collect()} == {(min(g), len(g)) for g in by.values() if len(g) > 1}
    assert {tuple(r) for r in C.collapsed(frame(spark, data)).collect()} == {(min(g), len(g)) for g in by.values()}


def test_empty_and_long(spark):
    assert C.found(frame(spark, [])).count() == 0
    t = "word, " * 300_000
    assert rows(C.found(frame(spark, [(2, t), (1, t.upper().replace(",", "")), (3, t + "x")]))) == [(1, 2)]


def test_fields_whose_line_end_became_a_blank():
    page = "Brand: Mila Ravi\nCode: 7781\nOrigin: Tolka"
    for other in ("Brand: Mila Ravi Code: 7781\nOrigin: Tolka", "Brand: Mila Ravi Code: 7781 Origin: Tolka", "Origin: Tolka | Code: 7781 | Brand: Mila Ravi", "origin: tolka; brand: mila ravi code: 7781"):
        assert C.canonical(other) == C.canonical(page)
    assert C.canonical("Share this page: Feed Home: x") == C.canonical("Share this page: Feed home: X")
    a, b = "He said: no. She said: yes.", "She said: yes. He said: no."
    assert C.canonical(a) != C.canonical(b)
