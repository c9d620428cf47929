from __future__ import annotations

import random
import re

from corpusloom.llm import lines as L
from tests.conftest import rows

SCHEMA = "id long, domain_id long, text string, site string, hash long, salt int"


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 1, 1) for r in data], SCHEMA)


def canon(line):
    return re.sub(r"\d+", "0", " ".join(line.split()).casefold())


def brute(data):
    pages = {i: (s, t) for i, s, t in data if i is not None and s is not None and t is not None}
    size, count = {}, {}
    for s, t in pages.values():
        size[s] = size.get(s, 0) + bool(t.strip())
        for c in {canon(x) for x in t.split("\n") if re.search(r"[^\W\d_]", x)}:
            count[s, c] = count.get((s, c), 0) + 1
    return sorted((i, k) for i, (s, t) in pages.items() for k, x in enumerate(t.split("\n"), 1) if count.get((s, canon(x)), 0) >= max(8, 0.05 * size[s]))


def corpus():
    random.seed(2)
    shared = ["Share  this page", "© 2024 All rights", "back to top", "ad", "12 34", "everywhere the same"]
    data = []
    for i in range(400):
        site = random.choice([1, 1, 1, 2, 3, None])
        body = [f"own line {chr(97 + i % 26)}{chr(97 + i // 26)}", random.choice(shared), "everywhere the same", "EVERYWHERE the same ", "", "rare" if i % 60 == 0 else "x" * (i + 1)]
        random.shuffle(body)
        data.append((i, site, "\n".join(body).replace("2024", str(2000 + i % 9))))
    data += [data[0], data[1], (500, 1, None), (501, 1, ""), (502, 2, " \n "), (None, 1, "back to top"), (503, None, "back to top")]
    return data


def test_found_against_brute_force(spark):
    data = corpus()
    assert [tuple(r) for r in L.found(frame(spark, data)).orderBy("id", "line_no").collect()] == brute(data)


def test_cleaned_text(spark):
    data = corpus()
    drop: dict = {}
    for i, k in brute(data):
        drop.setdefault(i, set()).add(k)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n"), 1) if k not in drop.get(i, ())) for i, s, t in data if i is not None and t is not None}
    got = L.without_excess(frame(spark, data)).collect()
    assert {r.id: r.text for r in got} == want and sum(r.removed for r in got) == len(brute(data))


def test_empty_single_and_long(spark):
    assert L.found(frame(spark, [])).count() == 0
    assert L.found(frame(spark, [(1, 1, "a\n" * 50)])).count() == 0
    long = "\n".join(["word " * 20] * 20_000)
    assert L.found(frame(spark, [(i, 1, long if i == 0 else "word " * 20) for i in range(8)])).count() == 20_000 + 7
    assert rows(L.found(frame(spark, [(i, 9, None) for i in range(9)]))) == []


def test_the_false_discovery_control_decides(spark):
    """A line as frequent outside, below the bounds there, is no excess; without the control it would be one."""
    rng = random.Random(8)
    data, i = [], 0
    for site in range(40):
        for k in range(150):
            text = [f"own {site} {chr(97 + k % 26)}{chr(97 + k // 26)}"]
            if k < (8 if site == 0 else 7):  # 5.3 % of the pages of site 0, 4.7 % of all others
                text.append("back to top")
            if site == 1 and k < 60:
                text.append("a line of this site")
            rng.shuffle(text)
            data.append((i, site, "\n".join(text)))
            i += 1
    lines = L.line_table(frame(spark, data))
    got = {(r.site, r.pages) for r in L.excess_lines(lines).collect()}
    assert got == {("1", 60)}
    assert {(r.site, r.pages) for r in L.excess_lines(lines, fdr=1.0).collect()} == {("1", 60), ("0", 8)}


def test_significant_level():
    assert L.significant_level({}, 0.01) == L.P_LEVELS
    assert L.significant_level({0: 5, 3: 2}, 0.01) == L.P_LEVELS
    assert L.significant_level({0: 90, 1000: 10}, 0.01) == 1000
    assert L.significant_level({0: 5, 9: 2}, 1.0) == 9
