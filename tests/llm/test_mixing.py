from __future__ import annotations

import itertools
import random

from corpusloom.llm import mixing as M
from tests.conftest import rows

DOCS = "doc_id long, text string, source string, n_tokens long, part int"
TARGETS = "recipe string, source string, weight double, max_repeats int, size_factor double, copies int"


def test_knapsack_against_brute_force():
    random.seed(3)
    for _ in range(200):
        counts = {k: random.randint(0, 3) for k in random.sample(range(1, 12), 3)}
        cap = random.randint(0, 25)
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts.values()]) if (s := sum(k * x for k, x in zip(counts, c))) <= cap)
        take = M.knapsack(counts, cap)
        assert sum(k * n for k, n in take.items()) == best and all(n <= counts[k] for k, n in take.items())


def test_fit_budget_is_exact_where_lengths_allow():
    random.seed(4)
    counts = {k: random.randint(1, 400) for k in range(5, 300)}
    total = sum(k * n for k, n in counts.items())
    for budget in (0, 1, 7, 9_999, total // 3, total - 5, total, total + 10):
        take = M.fit_budget(counts, budget, window=2_000)
        size = sum(k * n for k, n in take.items())
        assert all(n <= counts[k] for k, n in take.items()) and size <= budget
        assert size == (0 if budget < 5 else min(budget, total)) or budget == total - 5
    assert M.fit_budget({}, 10) == {} and M.fit_budget({0: 5}, 10) == {}


def frames(spark):
    random.seed(5)
    docs = [(i, " ".join(random.choices(["alpha", "beta", "gamma delta"], k=random.randint(1, 30))), random.choice(["a", "a", "a", "b", "c"]), 1, 1) for i in range(600)]
    docs += [docs[0], (900, None, "a", 1, 1), (901, "", "a", 1, 1), (902, "x", None, 1, 1), (None, "x", "a", 1, 1)]
    targets = [("r", "a", 1.0, 2, 0.5, 1), ("r", "b", 2.0, 4, 0.5, 1), ("r", "c", 9.0, 1, 0.5, 1), ("r", "none", 1.0, 2, 0.5, 1), ("s", "b", 1.0, None, None, 1), (None, "a", 1.0, 1, 1.0, 1), ("s", None, 1.0, 1, 1.0, 1), ("s", "a", None, 1, 1.0, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


def test_mix_and_report(spark):
    docs, targets = frames(spark)
    got = rows(M.mix(docs, targets))
    assert got == rows(M.mix(docs.repartition(5), targets))
    assert all(n <= {"a": 2, "b": 4, "c": 1}[s] for r, s, _, _, n in got if r == "r")
    sums: dict = {}
    for r, s, _, tokens, n in got:
        sums[r, s] = sums.get((r, s), 0) + tokens * n
    report = {(x.recipe, x.source): x for x in M.report(docs, targets).collect()}
    assert {k: x.actual_tokens for k, x in report.items() if x.actual_tokens} == sums
    assert report["r", "none"].shortfall_tokens == report["r", "none"].target_tokens > 0
    assert abs(sum(x.actual_share for k, x in report.items() if k[0] == "r") - 1) < 1e-9
    assert report["r", "a"].shortfall_tokens == 0 and report["s", "b"].repeats == 1


def test_other_seed_and_empty(spark):
    docs, targets = frames(spark)
    assert rows(M.mix(docs, targets, seed=1)) != rows(M.mix(docs, targets, seed=2))
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0
    assert M.report(docs.limit(0), targets).filter("actual_tokens > 0").count() == 0


def test_counts_whole_texts(spark):
    df = spark.createDataFrame([(1, "alpha " * 200_000, "a", 1, 1)], DOCS)
    assert M.token_counts(df).first().n_tokens >= 200_000


def test_what_a_source_lacks_goes_to_the_others():
    assert M.fill(100, {"a": 1, "b": 1, "c": 2}, {"a": 10, "b": 1000, "c": 1000}) == {"a": 10, "b": 30, "c": 60}
    assert M.fill(100, {"a": 1, "b": 3}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert M.fill(100, {"a": 1, "none": 3}, {"a": 500, "none": 0}) == {"a": 100, "none": 0}
    assert M.fill(0, {"a": 1}, {"a": 5}) == {"a": 0} and M.fill(5, {}, {}) == {}


def test_the_whole_size_is_reached(spark):
    docs, targets = frames(spark)
    report = [x for x in M.report(docs, targets).collect() if x.recipe == "r"]
    wanted = sum(x.target_tokens for x in report)
    assert abs(sum(x.actual_tokens for x in report) - wanted) <= len(report)
    by = {x.source: x for x in report}
    assert by["c"].repeats == 1 and by["c"].shortfall_tokens > 0 and abs(by["b"].actual_tokens - 2 * by["a"].actual_tokens) <= 2
    assert by["a"].surplus_tokens > 0
