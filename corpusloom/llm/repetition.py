"""Repetition inside a single document, by a cascade of rules ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import chunks, map_batches

_WORD = regex.compile(r"\p{L}+")
RUN = 5
SHARE = 0.3
#: Documents that the planner times the rules on; this only orders rules and never changes a result.
PLAN_ROWS = 512


class Words:
    """The words of several texts as integer codes: ``code[start[i]:start[i + 1]]`` is text i."""

    def __init__(self, texts: list[str]):
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = _WORD.findall(t.casefold())
            sizes[i] = len(w)
            words += w
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.code = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64) if words else np.zeros(0, np.int64)
        self.size = sizes

    def take(self, keep: np.ndarray) -> Words:
        """The same words for the texts ``keep`` (positions) only."""
        out = object.__new__(Words)
        out.size = self.size[keep]
        out.start = np.concatenate(([0], np.cumsum(out.size)))
        out.code = self.code[np.repeat(self.start[keep] - out.start[:-1], out.size) + np.arange(out.start[-1])]
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)


def _repeats(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Of (owner, code) in order of position: True where the same pair stands earlier."""
    order = np.lexsort((code, owner)) if len(code) and code.max(initial=0) >= 1 << 40 else np.argsort((owner.astype(np.uint64) << np.uint64(40)) | code.astype(np.uint64), kind="stable")
    o, c = owner[order], code[order]
    again = np.zeros(len(code), bool)
    if len(code) > 1:
        again[order[1:]] = (o[1:] == o[:-1]) & (c[1:] == c[:-1])
    return again


def _runs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start position, owner and exact code of every run of ``n`` words that lies in one text."""
    if len(w.code) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = w.owner()
    pos = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    code = w.code[pos]
    for k in range(1, n):  # pairs of codes are renumbered step by step, so equal codes are equal runs
        code = pd.factorize(code * (int(w.code.max()) + 1) + w.code[pos + k])[0].astype(np.int64)
    return pos, owner[pos], code


def repeated_share(w: Words, n: int = RUN) -> np.ndarray:
    """Repeated words over all words of each text; 0 for a text without words.

    A word is repeated if it lies in a run of ``n`` words that also starts at an earlier word.
    """
    pos, owner, code = _runs(w, n)
    mark = np.zeros(len(w.code) + 1, np.int64)
    at = pos[_repeats(owner, code)]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    cover = (np.cumsum(mark)[:-1] > 0).astype(np.int64)
    total = np.bincount(w.owner(), weights=cover, minlength=len(w.size)) if len(cover) else np.zeros(len(w.size))
    return total / np.maximum(w.size, 1)


def rule_short(w: Words, share: float, n: int) -> np.ndarray:
    """May reach the share at all: a repeated run needs n + 1 words at least."""
    return w.size > n


def rule_words(w: Words, share: float, n: int) -> np.ndarray:
    """The words whose same word stands earlier bound the repeated words from above."""
    again = _repeats(w.owner(), w.code)
    return np.bincount(w.owner()[again], minlength=len(w.size)) >= share * w.size


def rule_pairs(w: Words, share: float, n: int) -> np.ndarray:
    """The same bound from pairs: each repeated word but one in n starts a repeated pair."""
    pos, owner, code = _runs(w, 2)
    hits = np.bincount(owner[_repeats(owner, code)], minlength=len(w.size))
    return hits * n >= share * w.size * (n - 1)


def rule_runs(w: Words, share: float, n: int) -> np.ndarray:
    """Each repeated run covers n words at most."""
    pos, owner, code = _runs(w, n)
    return np.bincount(owner[_repeats(owner, code)], minlength=len(w.size)) * n >= share * w.size


#: Every rule passes all true cases, so that their order changes the time only.
RULES: dict[str, Callable[[Words, float, int], np.ndarray]] = {"short": rule_short, "words": rule_words, "pairs": rule_pairs, "runs": rule_runs}


def plan_order(texts: list[str], share: float = SHARE, n: int = RUN) -> list[str]:
    """Rules by rejections per second on a sample; a rule that costs more than it saves is left out.

    Costs and selectivities are measured on words of the sample; an empty sample gives the
    declared order.
    """
    if not texts:
        return list(RULES)
    w = Words(texts)
    began = time.perf_counter()
    repeated_share(w, n)
    full = (time.perf_counter() - began) / len(texts)
    gain: dict[str, float] = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejected = 1 - rule(w, share, n).mean()
        cost = (time.perf_counter() - began) / len(texts)
        if rejected * full > cost or name == "short":
            gain[name] = rejected / max(cost, 1e-9)
    return sorted(gain, key=gain.get, reverse=True)


def _cascade(w: Words, order: list[str], share: float, n: int) -> np.ndarray:
    """Exact share of the texts that no rule rejects; nan for the others."""
    left = np.arange(len(w.size))
    for name in order:
        keep = RULES[name](w, share, n)
        if not keep.all():
            left, w = left[keep], w.take(np.flatnonzero(keep))
        if not len(left):
            break
    out = np.full(0, np.nan)
    return left, repeated_share(w, n) if len(left) else out


def _pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")


def repetitive(df: DataFrame, id_col: str = "id", text_col: str = "text", share: float = SHARE, run: int = RUN, plan_rows: int = PLAN_ROWS) -> DataFrame:
    """``(id, share)`` of each document whose repeated share is at least ``share``.

    A sample of ``plan_rows`` documents orders the rules by rejection per cost; each rule is a sound
    bound, and what passes all of them is decided by the exact share.  Null texts are no documents;
    empty texts have share 0; repeated rows of an id count once.
    """
    src = _pages(df, id_col, text_col)
    order = plan_order([r.text for r in src.select("text").limit(plan_rows).collect()], share, run)

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        out: dict[str, list] = {"id": [], "share": []}
        for a, b in chunks(texts):
            left, shares = _cascade(Words(texts[a:b]), order, share, run)
            hit = shares >= share if len(left) else np.zeros(0, bool)
            out["id"] += ids[a:b][left[hit]].tolist() if len(left) else []
            out["share"] += shares[hit].tolist() if len(left) else []
        return out

    return map_batches(src, "id long, share double", step).distinct()


def repetition_profile(df: DataFrame, id_col: str = "id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``(id, words, repeated_share)`` of every document, without the cascade."""

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(1).to_pylist()
        words, shares = [], []
        for a, b in chunks(texts):
            w = Words(texts[a:b])
            words += w.size.tolist()
            shares += repeated_share(w, run).tolist()
        return {"id": batch.column(0).to_pylist(), "words": words, "repeated_share": shares}

    return map_batches(_pages(df, id_col, text_col), "id long, words long, repeated_share double", step).distinct()
