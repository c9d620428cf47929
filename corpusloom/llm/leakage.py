"""Evaluation texts leaking into training text, by latent semantic retrieval.

Passages become TF-IDF vectors over hashed words and word pairs; a distributed randomised singular
value decomposition gives a latent space.  The passages of the evaluation items are indexed there in
cells around centroids, and each document passage looks for candidates by cosine in the cells next to it.  Only
candidates are compared word by word, for a run of words that both hold.  Paraphrases are looked for by a
long common subsequence, with every pair of passages that shares enough words, whatever its cosine,
and must hold the names and numbers that may answer the item's question.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import chunks, map_batches
from corpusloom.session import materialize

#: Words that must stand consecutively in both texts.
RUN = 12
#: Passages of ITEM words start every STEP words, in documents as in items, so that each run of RUN words lies in one.
ITEM = 16
STEP = ITEM - RUN
#: Words of a document in which a paraphrase of an item passage must lie.
PASSAGE = 24
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
RANK = 192
#: Document passages that the latent space is fitted on at most; every passage is indexed.
SAMPLE_PASSAGES = 60_000
SAMPLE_PARTS = 4
#: Pieces in which the partial products of the tasks are added up before one matrix goes to the driver.
PIECES = 16
#: Cosine from which a pair of passages is a candidate.
CANDIDATE = 0.45
#: Item passages to a cell of the index, cells that each is put in, and cells that a document passage looks into.
CELL = 48
ASSIGNED = 2
PROBES = 8
#: Share of a passage's names and numbers, those of its question left out, that a paraphrase must hold.
ANSWER = 0.5
#: Share of the item passage that a common subsequence with PASSAGE words of a document must cover for a paraphrase.
PARAPHRASE = 0.8
#: Words of an item passage, those in the fewest item passages, by which paraphrase candidates are met; at most RUN.
RARE = 8

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits without case and accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return _WORD.findall(text.casefold())


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Tokens:
    """Words of several texts as 64-bit hashes, with their text and position."""

    def __init__(self, texts: list[str]):
        import xxhash

        words: list[str] = []
        size = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = words_of(t)
            size[i] = len(w)
            words += w
        code, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
        table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct), np.uint64, len(distinct))
        self.hash = table[code] if words else np.zeros(0, np.uint64)
        self.size = size
        self.start = np.concatenate(([0], np.cumsum(size)))

    def features(self) -> np.ndarray:
        """Two buckets for each word: its own, and that of the pair it begins (-1 at the end of a text)."""
        one = (_scramble(self.hash) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        two = np.full(len(one), -1, np.int64)
        if len(one) > 1:
            two[:-1] = (_scramble(_scramble(self.hash[:-1]) + self.hash[1:]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        last = (self.start[1:] - 1)[self.size > 0]
        two[last] = -1
        return np.stack([one, two], axis=1)

    def windows(self, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and last word (exclusive) of each passage; a text with fewer than RUN words has none."""
        n = np.where(self.size >= RUN, np.maximum((self.size - RUN) // stride, 0) + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        first = self.start[text] + k * stride
        return text, first, np.minimum(first + length, self.start[text + 1])

    def runs(self, n: int = RUN) -> np.ndarray:
        """Hash of the run of n words from each position; 0 where the text ends before."""
        out = np.zeros(len(self.hash), np.uint64)
        if len(out) >= n:
            h = self.hash[: len(out) - n + 1].copy()
            for k in range(1, n):
                h = _scramble(h) + self.hash[k : len(out) - n + 1 + k]
            out[: len(h)] = _scramble(h) | np.uint64(1)
            left = np.repeat(self.start[1:], self.size) - np.arange(len(out))
            out[left < n] = 0
        return out


def document_frequency(df: DataFrame) -> np.ndarray:
    """Passages that hold each bucket, over the passages of all documents."""

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(1).to_pylist()
        total = np.zeros(BUCKETS, np.int64)
        passages = 0
        for a, b in chunks(texts):
            tok = Tokens(texts[a:b])
            feats = tok.features()
            _, first, last = tok.windows(RUN, RUN)
            passages += len(first)
            owner = np.repeat(np.arange(len(first)), last - first)
            at = np.repeat(first - np.concatenate(([0], np.cumsum(last - first)[:-1])), last - first) + np.arange(len(owner))
            for c in (0, 1):
                f = feats[at, c]
                keys = np.unique(owner[f >= 0] * BUCKETS + f[f >= 0])
                total += np.bincount(keys % BUCKETS, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        return {"bucket": [-1, *seen.tolist()], "n": [passages, *total[seen].tolist()]}

    rows = map_batches(df, "bucket long, n long", step).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


@dataclass
class Latent:
    """Projection of weighted buckets into the latent space, and its singular values."""

    projection: np.ndarray
    singular: np.ndarray

    def vectors(self, tok: Tokens, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Unit vectors of passages that start at a multiple of STEP in their text; a pair counts where it begins in the passage."""
        rank = self.projection.shape[1]
        if not len(first):
            return np.zeros((0, rank), np.float32)
        # sums of STEP words each, from the start of each text on; a passage is a few of them
        blocks = -(-tok.size // STEP)
        before = np.concatenate(([0], np.cumsum(blocks)))
        start = np.repeat(tok.start[:-1], blocks) + (np.arange(before[-1]) - np.repeat(before[:-1], blocks)) * STEP
        table = np.concatenate((self.projection, np.zeros((1, rank), np.float32)))  # -1: no pair
        feats, sums = tok.features(), np.zeros((len(start) + 1, rank), np.float32)
        for lo in range(0, len(start), BLOCK):
            hi = min(lo + BLOCK, len(start))
            words = slice(int(start[lo]), int(start[hi]) if hi < len(start) else len(feats))
            each = table[feats[words, 0]]
            each += table[feats[words, 1]]
            sums[lo:hi] = np.add.reduceat(each, start[lo:hi] - start[lo], axis=0)
        text = np.searchsorted(tok.start, first, side="right") - 1
        at = before[text] + (first - tok.start[text]) // STEP
        n = -(-(last - first) // STEP)
        out = sums[at]
        for k in range(1, int(n.max())):
            out += sums[np.where(k < n, at + k, len(start))]
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return out


def _products(texts: list[str], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' (A basis) of the TF-IDF passages A of some texts."""
    out = np.zeros_like(basis)
    for a, b in chunks(texts, 500_000):
        tok = Tokens(texts[a:b])
        feats = tok.features()
        _, first, last = tok.windows(ITEM, ITEM)
        if not len(first):
            continue
        n = last - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        f = feats[at].reshape(-1)
        owner = np.repeat(np.arange(len(first)), 2 * n)
        f, owner = f[f >= 0], owner[f >= 0]
        w = idf[f]
        norm = np.sqrt(np.bincount(owner, weights=w * w))
        w = w / norm[owner]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
        y = np.concatenate([np.add.reduceat(basis[f[i:j]] * w[i:j, None], starts[lo:hi] - i, axis=0) for lo, hi, i, j in _groups(starts, len(f))]).astype(np.float32)
        order = np.argsort(f, kind="stable")
        f, w, owner = f[order], w[order].astype(np.float32), owner[order]
        for lo in range(0, len(f), BLOCK * 32):
            own = slice(lo, lo + BLOCK * 32)
            heads = np.concatenate(([0], np.flatnonzero(np.diff(f[own])) + 1))
            out[f[own][heads]] += np.add.reduceat(y[owner[own]] * w[own, None], heads, axis=0)
    return out


def _groups(starts: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """BLOCK passages at a time, as ranges of passages and of their features."""
    ends = [*range(0, len(starts), BLOCK), len(starts)]
    return [(lo, hi, int(starts[lo]), int(starts[hi]) if hi < len(starts) else size) for lo, hi in zip(ends, ends[1:])]


def _sum_of_products(docs: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``_products`` over all rows of ``docs``, added up on the workers in PIECES."""
    sent = docs.sparkSession.sparkContext.broadcast((idf, basis))
    height = BUCKETS // PIECES

    def run(batches):
        idf, basis = sent.value
        total = np.zeros_like(basis)
        for batch in batches:
            total += _products(batch.column(1).to_pylist(), idf, basis)
        pieces = [total[k * height : (k + 1) * height].tobytes() for k in range(PIECES)]
        yield pa.RecordBatch.from_pydict({"piece": list(range(PIECES)), "m": pieces}, schema=pa.schema([("piece", pa.int32()), ("m", pa.binary())]))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "m": [sum(np.frombuffer(m, np.float32) for m in rows["m"]).astype(np.float32).tobytes()]})

    out = np.zeros_like(basis)
    for r in docs.mapInArrow(run, "piece int, m binary").groupBy("piece").applyInPandas(add, "piece int, m binary").collect():
        out[r.piece * height : (r.piece + 1) * height] = np.frombuffer(r.m, np.float32).reshape(height, -1)
    sent.destroy()
    return out


def fit_latent(docs: DataFrame, items: list[str], rank: int = RANK, sample: int = SAMPLE_PASSAGES) -> Latent:
    """Randomised singular value decomposition of TF-IDF passages, by products with the matrix only.

    The weights come from all documents; the space is fitted on the item texts and on a sample of
    about ``sample`` document passages at most.  SAMPLE_PARTS tasks make partial products of fixed size,
    whose sum goes to the driver; nothing of the documents does.
    """
    df = document_frequency(docs)
    passages, seen = int(df[-1]), df[:-1]
    idf = (np.log((passages + 1) / (seen + 1)) + 1).astype(np.float32)
    part = min(1.0, sample * ITEM / max(passages * RUN, 1))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    few = materialize(picked, "latent-sample").repartition(SAMPLE_PARTS, "doc_id")
    basis = np.random.default_rng(7).standard_normal((BUCKETS, rank + 8), np.float32)
    for turn in range(3):
        basis = np.linalg.qr(basis)[0]
        total = _products(items, idf, basis) + _sum_of_products(few, idf, basis)
        if turn < 2:
            basis = total
    values, rotation = np.linalg.eigh((basis.T @ total + total.T @ basis) / 2)
    top = np.argsort(-values)[:rank]
    singular = np.sqrt(np.maximum(values[top], 0))
    top, singular = top[singular > 1e-6 * singular.max(initial=1e-9)], singular[singular > 1e-6 * singular.max(initial=1e-9)]
    # every direction counts alike: what all texts of a language share would else make them all near each other
    return Latent((idf[:, None] * (basis @ rotation[:, top]) / singular).astype(np.float32), singular)


@dataclass
class ItemIndex:
    """Distinct passages of the evaluation items: vectors, runs, and the items they stand in."""

    vectors: np.ndarray
    runs: np.ndarray
    words: np.ndarray
    items: list[list[int]]
    rare: tuple[np.ndarray, np.ndarray]
    need: np.ndarray
    facts: np.ndarray
    centroids: np.ndarray
    cells: list[np.ndarray]


_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_FACT = re.compile(r"\b[^\W\d_a-z]\w+|\d[\d.,]*")


def fact_words(text: str) -> set[str]:
    """Words of the names and numbers of an item's passage, which may answer its question; words of the question are none.

    The question is the last sentence if it ends in a question mark; a capital at the start of a sentence makes no name.
    """
    parts = _SENTENCE.split(text.strip())
    asked = set(words_of(parts.pop())) if parts[-1].rstrip(' "»”').endswith("?") else set()
    found = {w for p in parts for m in _FACT.finditer(p) if m.start() > 0 or m.group()[0].isdigit() for w in words_of(m.group())}
    return found - asked


def cells_of(vectors: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centroids of unit vectors, and the vectors that lie in each cell: each in those of its ASSIGNED nearest centroids."""
    k = max(1, len(vectors) // CELL)
    if k == 1:
        return vectors[:1].copy(), [np.arange(len(vectors))]
    centroids = vectors[np.random.default_rng(7).choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        near = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centroids).astype(np.float32)
    near = np.argpartition(-(vectors @ centroids.T), min(ASSIGNED, k) - 1, axis=1)[:, :ASSIGNED]
    return centroids, [np.flatnonzero((near == c).any(axis=1)) for c in range(k)]


def index_items(ids: list[int], texts: list[str], latent: Latent) -> ItemIndex:
    tok = Tokens(texts)
    text, first, last = tok.windows(ITEM, STEP)
    vectors, runs = latent.vectors(tok, first, last), tok.runs()
    keep: dict[bytes, int] = {}
    rows, items = [], []
    words = np.zeros((len(first), ITEM), np.uint64)
    for k, (t, a, b) in enumerate(zip(text, first, last)):
        words[k, : b - a] = tok.hash[a:b]
        key = words[k].tobytes()
        if key not in keep:
            keep[key] = len(rows)
            rows.append(k)
            items.append([])
        items[keep[key]].append(ids[t])
    width = STEP + 1
    table = np.zeros((len(rows), width), np.uint64)
    for j, k in enumerate(rows):
        n = min(width, last[k] - RUN + 1 - first[k])
        table[j, : max(n, 0)] = runs[first[k] : first[k] + max(n, 0)]
    kept = words[rows]
    facts = np.zeros(kept.shape, bool)
    named = [Tokens([" ".join(sorted(fact_words(t)))]).hash for t in texts]
    for j, k in enumerate(rows):
        facts[j] = np.isin(kept[j], named[text[k]]) & (kept[j] != 0)
    need = np.ceil(PARAPHRASE * (kept != 0).sum(axis=1) - 1e-9).astype(np.int64)
    return ItemIndex(vectors[rows], table, kept, items, rare_words(kept), need, facts, *cells_of(vectors[rows]))


def rare_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes, and the item passage of each: the RARE places of every passage whose words stand in the fewest."""
    code, distinct = pd.factorize(words.reshape(-1))
    often = np.bincount(code, minlength=len(distinct))[code].reshape(words.shape)
    often[words == 0] = np.iinfo(often.dtype).max
    at = np.argsort(often, axis=1, kind="stable")[:, :RARE]
    keys, owners = np.take_along_axis(words, at, axis=1).reshape(-1), np.repeat(np.arange(len(words)), at.shape[1])
    order = np.argsort(keys, kind="stable")
    return keys[order], owners[order]


#: Items that one pass over the documents compares with: the bound of what is sent to the workers.
ITEM_SLICE = 5_000
#: Passages compared at a time.
BLOCK = 1_000
#: Pairs of a window and an item passage that are counted, and that are compared word by word, at a time.
PAIRS = 4_000_000
LCS_PAIRS = 20_000


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows; 0 stands for no word."""
    best = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        diagonal = best[:, 0].copy()
        for j in range(1, best.shape[1]):
            up = best[:, j].copy()
            hit = (a[:, i] == b[:, j - 1]) & (a[:, i] != 0)
            best[:, j] = np.where(hit, diagonal + 1, np.maximum(up, best[:, j - 1]))
            diagonal = up
    return best[:, -1].astype(np.int64)


def _paraphrases(tok: Tokens, latent: Latent, index: ItemIndex) -> list[tuple[int, int, str, float, int, float | None]]:
    """As ``_search``: every item passage of which PASSAGE consecutive words of a text, wherever they begin, hold PARAPHRASE in order.

    No pair that qualifies is left out.  Each such run of words lies in one window of PASSAGE + RUN words, and an
    item passage may miss few of its words there, so few of its RARE ones; what passes that count gets
    the common subsequence, first with the window, then with the runs of PASSAGE words in it.
    """
    text, first, last = tok.windows(PASSAGE + RUN, RUN)
    keys, owners = index.rare
    hashes = np.concatenate((tok.hash, np.zeros(PASSAGE + RUN, np.uint64)))
    least = RARE - ((index.words != 0).sum(axis=1) - index.need)
    found_pairs: list[tuple[np.ndarray, ...]] = []
    step = max(1, PAIRS // len(index.items))
    for lo in range(0, len(first), step):
        part = slice(lo, min(lo + step, len(first)))
        at = first[part][:, None] + np.arange(PASSAGE + RUN)
        own = np.sort(np.where(at < last[part][:, None], hashes[at], 0), axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = 0  # each word of a window once
        left, right = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
        row, col = np.nonzero((right > left) & (own != 0))
        n = right[row, col] - left[row, col]
        held = np.zeros((len(own), len(index.items)), np.uint8)
        for a, b in _slices(n, PAIRS):
            m = n[a:b]
            place = np.repeat(left[row[a:b], col[a:b]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            np.add.at(held.reshape(-1), np.repeat(row[a:b], m) * held.shape[1] + owners[place], np.uint8(1))
        window, passage = np.nonzero(held >= least)
        for k in range(0, len(window), LCS_PAIRS):
            w, j = window[k : k + LCS_PAIRS] + lo, passage[k : k + LCS_PAIRS]
            at = first[w][:, None] + np.arange(PASSAGE + RUN)
            a = np.where(at < last[w][:, None], hashes[at], 0)
            enough = (a[:, :, None] == index.words[j][:, None, :]).any(axis=1).sum(axis=1) - (index.words[j] == 0).sum(axis=1) * (a == 0).any(axis=1) >= index.need[j]
            w, j, a = w[enough], j[enough], a[enough]
            long = common_subsequence(a, index.words[j]) >= index.need[j]
            w, j, a = w[long], j[long], a[long]
            inner = np.lib.stride_tricks.sliding_window_view(a, PASSAGE, axis=1).reshape(-1, PASSAGE)
            common = common_subsequence(inner, np.repeat(index.words[j], RUN + 1, axis=0)).reshape(-1, RUN + 1)
            best, shift = common.max(axis=1, initial=0), common.argmax(axis=1)
            hit = best >= index.need[j]
            found_pairs.append((w[hit], j[hit], best[hit], first[w[hit]] + shift[hit]))
    w, j, best, begin = map(np.concatenate, zip(*found_pairs)) if found_pairs else [np.zeros(0, np.int64)] * 4
    if not len(w):
        return []
    # the answer check: names and numbers of the item passage that stand among the PASSAGE words
    at = begin[:, None] + np.arange(PASSAGE)
    own = np.where(at < last[w][:, None], hashes[at], 0)
    facts = index.facts[j].sum(axis=1)
    held = ((own[:, :, None] == index.words[j][:, None, :]).any(axis=1) & index.facts[j]).sum(axis=1)
    share = held / np.maximum(facts, 1)
    keep = (facts == 0) | (share >= ANSWER)
    w, j, best, begin, facts, share = w[keep], j[keep], best[keep], begin[keep], facts[keep], share[keep]
    start = tok.start[text[w]]
    begin = start + (begin - start) // STEP * STEP
    cosine = np.einsum("ij,ij->i", latent.vectors(tok, begin, np.minimum(begin + PASSAGE, last[w])), index.vectors[j])
    return [(int(text[x]), int(y), "paraphrase", float(c), int(m), float(a) if n else None) for x, y, c, m, a, n in zip(w, j, cosine, best, share, facts)]


def _slices(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of ``sizes`` whose sums stay about ``limit``."""
    group = np.cumsum(sizes) // limit
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cut, cut[1:]) if b > a]


def candidates(vectors: np.ndarray, index: ItemIndex, least: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, item passages and cosines of the pairs that the search of the cells next to each passage meets, each once."""
    near = vectors @ index.centroids.T
    if near.shape[1] > probes:
        ranked = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        asked = np.zeros(near.shape, bool)
        np.put_along_axis(asked, ranked, True, axis=1)
    else:
        asked = np.ones(near.shape, bool)
    rows, cols, values = [], [], []
    for c, members in enumerate(index.cells):
        own = np.flatnonzero(asked[:, c])
        if len(own) and len(members):
            cosine = vectors[own] @ index.vectors[members].T
            r, m = np.nonzero(cosine >= least)
            rows.append(own[r])
            cols.append(members[m])
            values.append(cosine[r, m])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    row, col, value = map(np.concatenate, (rows, cols, values))
    _, once = np.unique(row * len(index.items) + col, return_index=True)  # a passage lies in several cells
    return row[once], col[once], value[once]


def _search(texts: list[str], latent: Latent, index: ItemIndex, candidate: float, paraphrases: bool) -> list[tuple[int, int, str, float, int, float | None]]:
    """(text, item passage, kind, cosine, words in common, share of answers) of each leak among some texts."""
    tok = Tokens(texts)
    text, first, last = tok.windows(ITEM, STEP)
    out: list[tuple[int, int, str, float, int, float | None]] = []
    if not len(first) or not len(index.items):
        return out
    vectors = latent.vectors(tok, first, last)
    runs = np.concatenate((tok.runs(), np.zeros(ITEM, np.uint64)))
    offsets = np.arange(STEP + 1)
    for lo in range(0, len(first), BLOCK):
        row, col, cosine = candidates(vectors[lo : lo + BLOCK], index, candidate)
        row = row + lo
        # the exact check of the candidates: a run of RUN words that both passages hold
        at = first[row][:, None] + offsets
        own = np.where(at + RUN <= last[row][:, None], runs[at], 0)
        same = ((own[:, :, None] == index.runs[col][:, None, :]) & (own[:, :, None] != 0)).any(axis=(1, 2))
        out += [(int(text[r]), int(c), "exact", float(v), RUN, None) for r, c, v in zip(row[same], col[same], cosine[same])]
    if paraphrases:
        out += _paraphrases(tok, latent, index)
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", candidate: float = CANDIDATE, paraphrases: bool = True) -> DataFrame:
    """``(doc_id, item_id, kind, cosine, words, answers)``: each document and item that share a passage.

    ``kind`` is ``exact`` where RUN consecutive words of the item stand in the document, else
    ``paraphrase`` where PASSAGE consecutive words of it share a common subsequence of PARAPHRASE of the
    words of any item passage and holds ANSWER of its names and numbers; ``words`` is the longest match seen, at least
    RUN for exact ones, and ``answers`` the largest share of names and numbers seen in a paraphrase (null if there
    are none).  Exact matches come from the latent search only: a pair below the cosine ``candidate``, or in none of
    the PROBES cells next to a document passage, is lost.  Rows with a null id or text
    take no part; texts of fewer than RUN words have no passage; ids that stand twice give one row.
    The items are the stated query set, indexed in slices of ITEM_SLICE.
    """
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    rows = sorted({(r.item_id, r.text) for r in own.toLocalIterator()})
    schema = "doc_id long, item_id long, kind string, cosine double, words long, answers double"
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    latent = fit_latent(docs, sorted({t for _, t in rows}))
    context = docs.sparkSession.sparkContext
    found_rows = None
    for lo in range(0, len(rows), ITEM_SLICE):
        part = rows[lo : lo + ITEM_SLICE]
        index = index_items([i for i, _ in part], [t for _, t in part], latent)
        sent = context.broadcast((latent, index))

        def step(batch: pa.RecordBatch, sent=sent) -> dict[str, list]:
            latent, index = sent.value
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            best: dict[tuple[int, int, str], list] = {}
            for a, b in chunks(texts, 300_000):
                for t, j, kind, cosine, words, answers in _search(texts[a:b], latent, index, candidate, paraphrases):
                    for item in index.items[j]:
                        x = best.setdefault((ids[a + t], item, kind), [cosine, words, answers])
                        x[0], x[1] = max(x[0], cosine), max(x[1], words)
                        x[2] = answers if x[2] is None else x[2] if answers is None else max(x[2], answers)
            out: dict[str, list] = {"doc_id": [], "item_id": [], "kind": [], "cosine": [], "words": [], "answers": []}
            for (doc, item, kind), (cosine, words, answers) in best.items():
                for name, v in zip(out, (doc, item, kind, cosine, words, answers)):
                    out[name].append(v)
            return out

        rows_here = map_batches(docs, schema, step)
        found_rows = rows_here if found_rows is None else found_rows.unionByName(rows_here)
    return found_rows.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"), F.max("cosine").alias("cosine"), F.max("words").alias("words"), F.max("answers").alias("answers"))


def found(documents: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``(doc_id, item_id)`` of each document and item that share RUN consecutive words, among the candidates of the latent search."""
    return leaks(documents, items, paraphrases=False, **kw).filter("kind = 'exact'").select("doc_id", "item_id")
