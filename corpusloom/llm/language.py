"""Language of documents and of their segments, by a linear-chain conditional random field.

Words are labelled from affix, n-gram and lexicon features with learned transitions; forward-backward
gives each word a distribution over languages, from which sentences, segments and documents get
theirs with a confidence.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import chunks, map_batches

LANGS = ("pt", "es", "en", "fr", "de", "it")
#: Usual spellings that name a language, without accents and case.
SPELLINGS = {
    "pt": "pt por portuguese portugues portugais portugiesisch portoghese",
    "es": "es spa spanish espanol castellano espanhol espagnol spanisch spagnolo",
    "en": "en eng english ingles anglais englisch inglese",
    "fr": "fr fra fre french francais frances franzosisch francese",
    "de": "de deu ger german deutsch aleman alemao allemand tedesco",
    "it": "it ita italian italiano italien italienisch",
}
_LABELS = {word: lang for lang, words in SPELLINGS.items() for word in words.split()}
#: Labelled documents of one language that the model is fitted on: the bound of its training sample.
MAX_PER_LANGUAGE = 300
#: Code points of a text that may enter that sample, which bounds its size; every text is labelled.
MAX_TRAINING_CHARS = 4_000
#: Spellings of labels, the most frequent first, that training looks at.
MAX_LABELS = 2000
BUCKETS = 1 << 18
MIN_WORDS = 8
#: Share of the log-odds that the weights start from; a word has about fifteen features that repeat each other.
START = 0.2

_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+(?=[^a-zà-ÿ])|\n\s*\n|\n(?=\s*[^\sa-zà-ÿ])")


#: Function words of each language, its lexicon.
LEXICON = {
    "pt": "não uma são com para pelo pela dos das nos nas mais mas também já até sobre entre depois sem seu sua foi está isso ele ela muito quando onde quem ainda os as ao aos",
    "es": "una los las del con para por pero más también ya hasta sobre entre después sin su fue está eso él ella muy cuando donde quien aún y el al lo unos sus según",
    "en": "the of and to in is was for with on that by this from which not are have been they their there would when who about after before into than its it he she we you",
    "fr": "les des une du dans pour avec sur est pas plus mais aussi été qui que sont par au aux cette ces son sa leur nous vous ils elle où très après avant chez sans encore",
    "de": "der die das und nicht ist mit von den dem ein eine auf für sich auch werden wird sind aus bei nach nur noch wie über zum zur aber oder wenn wir ihr haben seit",
    "it": "il gli della delle degli nella nel con per non più anche che sono una di da dal alla alle sul sulla questo questa è stato era dopo prima senza ancora loro molto dove",
}
_IN_LEXICON: dict[str, list[str]] = {}
for _lang, _words in LEXICON.items():
    for _word in _words.split():
        _IN_LEXICON.setdefault(_word, []).append("l" + _lang)


def label_language(label: str | None) -> str | None:
    """Language that a delivered label names: one of LANGS, ``other`` for another word, null if it names none.

    Case, accents and regions (``pt-BR``) do not matter.
    """
    if label is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", label.casefold()) if not unicodedata.combining(c)).strip()
    head = re.split(r"[-_\s(,;/]", plain, maxsplit=1)[0]
    if head in _LABELS:
        return _LABELS[head]
    return None if head in ("", "n", "na", "none", "null", "nan", "unknown", "und", "xx", "zxx", "mul", "mis", "unk", "undefined", "other") or not head.isalpha() else "other"


def sentences(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences of a text; a line end ends one unless the next line goes on in lower case."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def features(word: str) -> list[int]:
    """Hashed features of a word in lower case: itself, the lexicons that hold it, its affixes and its character trigrams."""
    w = word
    keys = ["w" + w, *_IN_LEXICON.get(w, ()), *("p" + w[:k] for k in (1, 2, 3) if len(w) > k), *("s" + w[-k:] for k in (1, 2, 3, 4) if len(w) > k)]
    edged = f"<{w}>"
    keys += ["g" + edged[i : i + 3] for i in range(len(edged) - 2)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys]


@dataclass
class Crf:
    """Emission weights by feature, and transitions inside a sentence and across sentence ends."""

    weights: np.ndarray
    inside: np.ndarray
    across: np.ndarray

    def emission(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LANGS)), np.float32)
        if words:
            lists = [features(w) for w in words]
            flat = np.fromiter((f for x in lists for f in x), np.int64)
            at = np.concatenate(([0], np.cumsum([len(x) for x in lists])[:-1]))
            out[:] = np.add.reduceat(self.weights[flat], at, axis=0)
        return out


class Sequences:
    """Word sequences of several texts, longest first, laid out step by step."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[self.order]
        longest = int(self.sizes.max(initial=0))
        self.active = np.searchsorted(-self.sizes, -np.arange(longest), side="left")
        self.at = [starts[: self.active[t]] + t for t in range(longest)]


def forward_backward(emission: np.ndarray, across: np.ndarray, seq: Sequences, inside_t: np.ndarray, across_t: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of each word; with ``pairs`` also the expected transitions of both kinds; and the log partition."""
    psi = np.exp(emission - emission.max(axis=1, keepdims=True))
    a, b = np.exp(inside_t), np.exp(across_t)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    logz = float(emission.max(axis=1).sum())
    for t, at in enumerate(seq.at):
        if t == 0:
            now = psi[at]
        else:
            prev = alpha[at - 1]
            now = np.where(across[at][:, None], prev @ b, prev @ a) * psi[at]
        total = now.sum(axis=1, keepdims=True)
        alpha[at] = now / total
        logz += float(np.log(total).sum())
    sums = [np.zeros_like(a), np.zeros_like(b)]
    for t in range(len(seq.at) - 1, 0, -1):
        at = seq.at[t]
        msg = psi[at] * beta[at]
        flag = across[at]
        back = np.where(flag[:, None], msg @ b.T, msg @ a.T)
        if pairs:
            prev = alpha[at - 1]
            scale = 1 / (prev * back).sum(axis=1)
            for k, m, keep in ((0, a, ~flag), (1, b, flag)):
                if keep.any():
                    sums[k] += m * np.einsum("i,ij,ik->jk", scale[keep], prev[keep], msg[keep])
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), sums[0], sums[1], logz


def _prepare(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Words, words of each text, sentence number of each word, starts of sentences, and the ranges of sentences."""
    words: list[str] = []
    sizes, number, ranges = [], [], []
    for t in texts:
        spans = sentences(t)
        ranges.append(spans)
        n = 0
        for k, (a, b) in enumerate(spans):
            own = _WORD.findall(t[a:b].lower())
            words += own
            number += [k] * len(own)
            n += len(own)
        sizes.append(n)
    size, no = np.array(sizes, np.int64), np.array(number, np.int64)
    start = np.zeros(len(no), bool)
    if len(no):
        first = np.zeros(len(no), bool)
        first[np.concatenate(([0], np.cumsum(size)[:-1]))[size > 0]] = True
        start[1:] = (no[1:] != no[:-1]) & ~first[1:]
    return words, size, no, start, ranges


def fit(texts: list[str], labels: list[int], rounds: int = 20, rate: float = 0.05, decay: float = 1e-5) -> Crf:
    """Maximum-likelihood fit by adaptive gradient steps from the features' log-odds, twice.

    First every word bears the label of its document; as labels may be wrong and texts mixed, the
    second fit bears for each sentence the language the first one gives it, which also teaches the
    transitions.  Without texts the weights are zero and all languages alike.
    """
    k = len(LANGS)
    crf = Crf(np.zeros((BUCKETS, k), np.float32), np.eye(k) * 2, np.eye(k))
    words, size, no, start, _ = _prepare(texts)
    if not words:
        return crf
    vocabulary = sorted(set(words))
    index = {w: i for i, w in enumerate(vocabulary)}
    code = np.array([index[w] for w in words])
    lists = [features(w) for w in vocabulary]
    flat = np.fromiter((f for x in lists for f in x), np.int64)
    at = np.concatenate(([0], np.cumsum([len(x) for x in lists])[:-1]))
    each = np.repeat(np.arange(len(vocabulary)), [len(x) for x in lists])
    owner = np.repeat(np.arange(len(texts)), size)
    seq = Sequences(size)
    gold = np.array(labels)[owner]
    sentence = np.cumsum(np.concatenate(([True], (no[1:] != no[:-1]) | (owner[1:] != owner[:-1])))) - 1
    for stage in range(2):
        g2 = np.full(crf.weights.shape, 1e-6)
        t2 = [np.full((k, k), 1e-6), np.full((k, k), 1e-6)]
        hot = np.zeros((len(words), k))
        hot[np.arange(len(words)), gold] = 1
        if stage == 0:
            by_word = np.stack([np.bincount(code, weights=hot[:, j], minlength=len(vocabulary)) for j in range(k)], axis=1)
            n = np.stack([np.bincount(flat, weights=by_word[each, j], minlength=BUCKETS) for j in range(k)], axis=1)
            share = (n + 1) / (n.sum(axis=0) + BUCKETS)
            odds = np.log(share) - np.log(share).mean(axis=1, keepdims=True)
            crf.weights = np.where(n.sum(axis=1, keepdims=True) > 0, START * odds, 0).astype(np.float32)
        step = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        seen = [np.zeros((k, k)), np.zeros((k, k))]
        for kind in (0, 1):
            s = step[start[step] == bool(kind)]
            np.add.at(seen[kind], (gold[s - 1], gold[s]), 1)
        for _ in range(rounds):
            word_scores = np.add.reduceat(crf.weights[flat], at, axis=0)
            post, in_sum, out_sum, _ = forward_backward(word_scores[code].astype(np.float64), start, seq, crf.inside, crf.across, True)
            diff = hot - post
            by_word = np.stack([np.bincount(code, weights=diff[:, j], minlength=len(vocabulary)) for j in range(k)], axis=1)
            grad = np.stack([np.bincount(flat, weights=by_word[each, j], minlength=BUCKETS) for j in range(k)], axis=1) / len(texts) - decay * crf.weights
            g2 += grad * grad
            crf.weights = (crf.weights + rate * grad / np.sqrt(g2)).astype(np.float32)
            for kind, (want, got) in enumerate(((seen[0], in_sum), (seen[1], out_sum))):
                g = (want - got) / len(texts)
                t2[kind] += g * g
                move = rate * g / np.sqrt(t2[kind])
                if kind:
                    crf.across = np.clip(crf.across + move, -6, 6)
                else:
                    crf.inside = np.clip(crf.inside + move, -6, 6)
        word_scores = np.add.reduceat(crf.weights[flat], at, axis=0)
        # the sentence's own evidence, without its neighbours
        score = np.stack([np.bincount(sentence, weights=word_scores[code, j]) for j in range(k)], axis=1)
        long = np.bincount(sentence) >= MIN_WORDS
        gold = np.where(long[sentence], score.argmax(axis=1)[sentence], gold)
    return crf


def training_rows(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int) -> tuple[list[str], list[int]]:
    """At most about ``per_language`` labelled texts of each language, chosen by a hash of their id."""
    names = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count("*").alias("n")).filter(F.col("n") > 0).orderBy(F.desc("n")).limit(MAX_LABELS).collect()}
    totals = dict.fromkeys(LANGS, 0)
    for name, n in names.items():
        lang = label_language(name)
        if lang in totals:
            totals[lang] += n
    rows = []
    for lang in LANGS:
        own = [n for n in names if n is not None and label_language(n) == lang]
        if own:
            part = min(1.0, per_language / totals[lang])
            pick = df.filter(F.col(label_col).isin(own) & (F.length(text_col) <= MAX_TRAINING_CHARS) & (F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(part * (1 << 30))))
            rows.append(pick.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.lit(LANGS.index(lang)).alias("k")).limit(2 * per_language))
    if not rows:
        return [], []
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    got = sorted(union.collect())
    return [r.t for r in got], [r.k for r in got]


def _tag(texts: list[str], crf: Crf, memo: dict[str, int], table: list[np.ndarray]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: the ranges of their sentences, sentence owner, words of each sentence, and posterior sums."""
    words, size, no, start, ranges = _prepare(texts)
    new = sorted({w for w in words if w not in memo})
    if new:
        if len(memo) > 500_000:
            memo.clear()
            table.clear()
            new = sorted(set(words))
        base = len(memo)
        table.append(crf.emission(new))
        memo.update((w, base + i) for i, w in enumerate(new))
        if len(table) > 1:
            table[:] = [np.concatenate(table)]
    counts = np.array([len(r) for r in ranges], np.int64)
    offset = np.concatenate(([0], np.cumsum(counts)))
    if not words:
        return ranges, np.repeat(np.arange(len(texts)), counts), np.zeros(offset[-1], np.int64), np.zeros((offset[-1], len(LANGS)))
    emission = table[0][np.fromiter((memo[w] for w in words), np.int64, len(words))]
    post, _, _, _ = forward_backward(emission.astype(np.float64), start, Sequences(size), crf.inside, crf.across)
    where = np.repeat(offset[:-1], size) + no
    sums = np.stack([np.bincount(where, weights=post[:, j], minlength=offset[-1]) for j in range(len(LANGS))], axis=1)
    return ranges, np.repeat(np.arange(len(texts)), counts), np.bincount(where, minlength=offset[-1]), sums


def _apply(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int, schema: str, emit) -> DataFrame:
    texts, labels = training_rows(df, id_col, text_col, label_col, per_language)
    sent = df.sparkSession.sparkContext.broadcast(fit(texts, labels))

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        crf = sent.value
        memo: dict[str, int] = {}
        table: list[np.ndarray] = []
        ids, bodies, names = (batch.column(i).to_pylist() for i in range(3))
        out: dict[str, list] = {part.split()[0]: [] for part in schema.split(", ")}
        for a, b in chunks(bodies, 1_000_000):
            ranges, owner, words, sums = _tag(bodies[a:b], crf, memo, table)
            emit(out, ids[a:b], names[a:b], ranges, owner, words, sums)
        return out

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return map_batches(src, schema, step)


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = MAX_PER_LANGUAGE, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, lang)``: the languages of each document whose label is missing or wrong or that mixes languages.

    A language counts if the document holds a whole sentence of ``min_words`` words in it; a document
    without such a sentence gives no row, and neither do null and empty texts.
    """

    def emit(out, ids, names, ranges, owner, words, sums) -> None:
        best = sums.argmax(axis=1)
        whole = words >= min_words
        mask = np.zeros((len(ids), len(LANGS)), bool)
        mask[owner[whole], best[whole]] = True
        for i, row in enumerate(mask):
            langs = [LANGS[j] for j in np.flatnonzero(row)]
            if langs and (len(langs) > 1 or label_language(names[i]) != langs[0]):
                out["doc_id"] += [ids[i]] * len(langs)
                out["lang"] += langs

    return _apply(df, id_col, text_col, label_col, per_language, "doc_id long, lang string", emit).distinct()


def document_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = MAX_PER_LANGUAGE) -> DataFrame:
    """``(doc_id, label, lang, confidence, words)`` of each document: the language of most of its words.

    A text without words has the language null and the confidence 0.
    """

    def emit(out, ids, names, ranges, owner, words, sums) -> None:
        total = np.zeros((len(ids), len(LANGS)))
        np.add.at(total, owner, sums)
        n = np.bincount(owner, weights=words, minlength=len(ids)).astype(np.int64)
        for i, row in enumerate(total):
            out["doc_id"].append(ids[i])
            out["label"].append(names[i])
            out["lang"].append(LANGS[int(row.argmax())] if n[i] else None)
            out["confidence"].append(float(row.max() / n[i]) if n[i] else 0.0)
            out["words"].append(int(n[i]))

    return _apply(df, id_col, text_col, label_col, per_language, "doc_id long, label string, lang string, confidence double, words long", emit)


def segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = MAX_PER_LANGUAGE) -> DataFrame:
    """``(doc_id, segment, start, end, lang, confidence, words)``: runs of sentences in one language.

    ``start`` and ``end`` are positions in the text; sentences without words belong to no segment.
    """

    def emit(out, ids, names, ranges, owner, words, sums) -> None:
        best, k = sums.argmax(axis=1), 0
        for i, spans in enumerate(ranges):
            last, no = None, 0
            for a, b in spans:
                n, lang = int(words[k]), int(best[k])
                if n and last is not None and last[2] == lang:
                    last[1], last[3], last[4] = b, last[3] + float(sums[k, lang]), last[4] + n
                elif n:
                    if last is not None:
                        _close(out, ids[i], no, last)
                        no += 1
                    last = [a, b, lang, float(sums[k, lang]), n]
                k += 1
            if last is not None:
                _close(out, ids[i], no, last)

    return _apply(df, id_col, text_col, label_col, per_language, "doc_id long, segment long, start long, end long, lang string, confidence double, words long", emit)


def _close(out: dict[str, list], doc: int, no: int, seg: list) -> None:
    for name, v in zip(("doc_id", "segment", "start", "end", "lang", "confidence", "words"), (doc, no, seg[0], seg[1], LANGS[seg[2]], seg[3] / seg[4], seg[4])):
        out[name].append(v)
