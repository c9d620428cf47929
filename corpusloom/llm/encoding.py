"""Text garbled by a wrong character encoding: find it and restore the original where it can be had.

Three steps: (1) count adjacent character pairs over the whole corpus; (2) score the pairs of each
text by their mutual information and take the maximum-scoring segments of improbable pairs;
(3) test inverse mappings inside those segments only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import chunks, map_batches

#: Single-byte encodings in which UTF-8 bytes are commonly misread.
WRONG = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp1254", "cp1257", "iso8859-9", "koi8-r", "cp866")
#: First code points of ranges, and how many bits of a code point share a class there: the scripts and signs that
#: garbling makes are classes of their own, others share one per 64 or 4096.  So there are CLASSES classes at most,
#: and the table of all pairs, which goes to every worker, has CLASSES ** 2 entries of 16 bytes (251 MB) whatever the corpus.
RANGES = ((0, 0), (0x600, 6), (0x2000, 0), (0x2800, 12), (0x110000, 0))
#: Occurrences from which a character is one that the corpus knows.
KNOWN = 2
#: A pair is improbable below this association (natural logarithm).
ASSOCIATION = -9.0
UNSEEN = -32.0
REPLACEMENT = "�"
MAX_LEVELS = 3
#: Restored runs that a worker remembers.
MEMO = 100_000


_STARTS = np.array([a for a, _ in RANGES], np.int64)
_SHIFTS = np.array([b for _, b in RANGES], np.int64)
_BASES = np.concatenate(([0], np.cumsum((np.diff(_STARTS) + (1 << _SHIFTS[:-1]) - 1) >> _SHIFTS[:-1])))
CLASSES = int(_BASES[-1])


def _classes(cp: np.ndarray) -> np.ndarray:
    cp = cp.astype(np.int64)
    if not len(cp) or cp.max() < _STARTS[1]:
        return cp
    at = np.searchsorted(_STARTS, cp, side="right") - 1
    return _BASES[at] + ((cp - _STARTS[at]) >> _SHIFTS[at])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pair_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(pair, n)``: adjacent character pairs of all texts, ``pair`` being left class * CLASSES + right class.

    Pairs are counted inside each Arrow batch first, so that the shuffle carries distinct pairs only.
    Null and empty texts have none.
    """

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(0).to_pylist()
        keys, sums = [], []
        for a, b in chunks(texts):
            k = _classes(_code_points("\n".join(texts[a:b])))
            seen = np.flatnonzero(np.bincount(k, minlength=1))
            dense = np.zeros(int(seen.max(initial=0)) + 1, np.int64)
            dense[seen] = np.arange(len(seen))
            small, width = dense[k], len(seen)
            if width <= 3000:
                n = np.bincount(small[:-1] * width + small[1:], minlength=1)
                at = np.flatnonzero(n)
                n = n[at]
            else:
                at, n = np.unique(small[:-1] * width + small[1:], return_counts=True)
            keys.append(seen[at // width] * CLASSES + seen[at % width])
            sums.append(n)
        at, where = np.unique(np.concatenate(keys), return_inverse=True)
        return {"pair": at, "n": np.bincount(where, weights=np.concatenate(sums)).astype(np.int64)}

    src = df.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL AND text <> ''")
    return map_batches(src, "pair long, n long", step).groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class PairScores:
    """Association of character pairs, ln p(ab)^3 / (p(a) p(b)): mutual information that is not misled by rare characters."""

    pairs: np.ndarray
    score: np.ndarray
    known: frozenset[int] = field(default_factory=frozenset)

    @classmethod
    def fit(cls, counts: DataFrame) -> PairScores:
        rows = counts.toArrow()
        pair, n = rows.column("pair").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.float64)
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        total = max(n.sum(), 1.0)
        left, right = pair // CLASSES, pair % CLASSES
        one = np.bincount(left, weights=n, minlength=CLASSES) if len(pair) else np.ones(CLASSES)
        two = np.bincount(right, weights=n, minlength=CLASSES) if len(pair) else np.ones(CLASSES)
        score = 3 * np.log(n / total) - np.log(one[left] / total) - np.log(two[right] / total)
        common = np.flatnonzero(one >= KNOWN)
        return cls(pair, score, frozenset(common.tolist()))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * CLASSES + right
        if not len(self.pairs):
            return np.full(len(key), UNSEEN)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.score[at], UNSEEN)

    def mean(self, text: str) -> float:
        k = _classes(_code_points(text))
        return float(self.of(k[:-1], k[1:]).mean()) if len(k) > 1 else UNSEEN


@lru_cache(maxsize=None)
def _inverse(name: str) -> tuple[dict[int, int], re.Pattern]:
    """Characters of a wrong encoding to bytes, and a pattern for UTF-8 sequences misread in it.

    Bytes that the encoding leaves undefined stand for themselves, as C1 control characters.
    """
    table: dict[int, int] = {}
    chars: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        chars[b] = c
        table[ord(c)] = b
    group = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi)) + "]"
    tail = group(0x80, 0xC0)
    return table, re.compile(f"(?:{group(0xC2, 0xE0)}{tail}|{group(0xE0, 0xF0)}{tail}{{2}}|{group(0xF0, 0xF5)}{tail}{{3}})+")


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments of a sequence of scores, as half-open ranges in order.

    Candidate segments are kept with the running totals at both ends and merged while a later one
    still gains from an earlier one.
    """
    kept: list[tuple[float, float, int, int]] = []
    total = 0.0
    for i, s in enumerate(score.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        lo, hi, a, b = before, total, i, i + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= lo:
                j -= 1
            if j < 0 or kept[j][1] >= hi:
                break
            lo, a = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((lo, hi, a, b))
    return [(a, b) for _, _, a, b in kept]


def improbable(texts: list[str], scores: PairScores, threshold: float = ASSOCIATION) -> list[list[tuple[int, int]]]:
    """Improbable character runs of each text, as ranges of positions in it.

    Pairs of two ASCII characters belong to no garbling; they end a block, and inside each block
    of other pairs the maximum-scoring segments are taken.
    """
    joined = "\n".join(texts)
    cp = _code_points(joined)
    odd = cp >= 128
    at = np.flatnonzero(odd[:-1] | odd[1:])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(at):
        return out
    k = _classes(cp)
    score = threshold - scores.of(k[at], k[at + 1])
    block = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1, [len(at)]))
    best = np.maximum.reduceat(score, block[:-1])
    ends = np.cumsum([len(t) + 1 for t in texts])
    for b in np.flatnonzero(best > 0).tolist():
        lo, hi = int(block[b]), int(block[b + 1])
        first = int(at[lo])
        text = int(np.searchsorted(ends, first, side="right"))
        base = int(ends[text]) - len(texts[text]) - 1
        for a, z in [(0, 1)] if hi - lo == 1 else segments(score[lo:hi]):
            start = max(0, first + a - base)
            out[text].append((start, min(len(texts[text]), first + z + 1 - base)))
    return out


def readings(run: str) -> list[str]:
    """Everything that up to MAX_LEVELS inverse mappings make of ``run``, itself left out."""
    seen, last = {run}, [run]
    for _ in range(MAX_LEVELS):
        new = []
        for now in last:
            for name in WRONG:
                table, pattern = _inverse(name)

                def back(m: re.Match, table: dict[int, int] = table) -> str:
                    try:
                        return bytes(table[ord(c)] for c in m.group()).decode("utf-8")
                    except UnicodeDecodeError:
                        return m.group()

                if pattern.search(now) and (text := pattern.sub(back, now)) not in seen:
                    seen.add(text)
                    new.append(text)
        last = new
    seen.discard(run)
    return sorted(seen)


def restore_run(run: str, scores: PairScores, before: str = " ", after: str = " ") -> str | None:
    """The most probable reading of ``run`` under the inverse mappings; None if none is better.

    A reading counts only if it consists of characters the corpus knows and raises the mean
    association of the run within its surroundings.
    """
    best, value = None, None
    for text in readings(run):
        new = _classes(_code_points(text)).tolist()
        if not all(c < 128 or c in scores.known for c in new) or any(0x80 <= ord(c) < 0xA0 and c not in run for c in text):
            continue
        if value is None:
            value = scores.mean(before + run + after)
        if (v := scores.mean(before + text + after)) > value:
            best, value = text, v
    return best


def repair(text: str, runs: list[tuple[int, int]], scores: PairScores, memo: dict) -> tuple[str, int, int]:
    """Text with each garbled run restored, the number of garbled runs, and of those lost for good.

    A run that holds U+FFFD is garbled, but its bytes are gone: it stays as it is.  ``memo`` keeps
    the readings of runs met before.
    """
    out, last, hits, lost = [], 0, 0, 0
    merged: list[list[int]] = []
    for a, b in runs:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        run = text[a:b]
        if REPLACEMENT in run:
            hits += 1
            lost += 1
            continue
        key = (text[max(0, a - 1) : a] or " ", run, text[b : b + 1] or " ")
        if key not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = restore_run(run, scores, key[0], key[2])
        if memo[key] is not None:
            hits += 1
            out += [text[last:a], memo[key]]
            last = b
    return "".join([*out, text[last:]]), hits, lost


def repaired(df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = ASSOCIATION, with_text: bool = True) -> DataFrame:
    """``(id, runs, lost, restored)`` of each record with at least one garbled run.

    ``restored`` is the text with every run restored whose bytes can still be had (null if
    ``with_text`` is off).  Null and empty texts have no garbling; repeated rows of an id give one
    row; an empty input gives none.  The score table (at most CLASSES ** 2 pairs) is fitted over all
    rows and sent to the workers.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    fitted = PairScores.fit(pair_counts(df, text_col))
    sent = df.sparkSession.sparkContext.broadcast(fitted)

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        scores: PairScores = sent.value
        memo: dict = {}
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {"id": [], "runs": [], "lost": [], "restored": []}
        for a, b in chunks(texts):
            for i, t, runs in zip(ids[a:b], texts[a:b], improbable(texts[a:b], scores, threshold)):
                if runs:
                    text, hits, lost = repair(t, runs, scores, memo)
                    if hits:
                        for name, v in (("id", i), ("runs", hits), ("lost", lost), ("restored", text if with_text else None)):
                            out[name].append(v)
        return out

    rows = map_batches(src, "id long, runs long, lost long, restored string", step)
    return rows.dropDuplicates(["id"])


def found(df: DataFrame, **kw) -> DataFrame:
    """``(id)`` of each record with garbled characters."""
    return repaired(df, with_text=False, **kw).select("id")
