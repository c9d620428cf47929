from __future__ import annotations

import itertools
import random

import numpy as np

from corpusloom.llm import language as L
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, label string, words long"
SENTENCES = {
    "pt": ["A comissão da cidade não aprovou o orçamento porque o relatório ainda não chegou.", "O conselho já discutiu a obra com os moradores durante a reunião de ontem."],
    "es": ["La comisión de la ciudad no aprobó el presupuesto porque el informe todavía no llegó.", "El consejo ya discutió la obra con los vecinos durante la reunión de ayer."],
    "en": ["The committee of the town did not approve the budget because the report was late.", "The council has already discussed the work with the people during the meeting."],
    "fr": ["La commission de la ville n'a pas approuvé le budget parce que le rapport est en retard.", "Le conseil a déjà discuté le projet avec les habitants pendant la réunion d'hier."],
    "de": ["Der Ausschuss der Stadt hat den Haushalt nicht bewilligt weil der Bericht noch fehlt.", "Der Rat hat die Arbeit schon mit den Leuten während der Sitzung von gestern besprochen."],
    "it": ["La commissione della città non ha approvato il bilancio perché il rapporto non è arrivato.", "Il consiglio ha già discusso il lavoro con gli abitanti durante la riunione di ieri."],
}


def corpus(n=40):
    random.seed(1)
    out, i = [], 0
    for lang, own in SENTENCES.items():
        for _ in range(n):
            out.append((i, " ".join(random.choices(own, k=4)), lang))
            i += 1
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)


def test_labels():
    assert [L.label_language(x) for x in ("pt-BR", "Português", " EN ", "ger", "", None, "xx", "nl", "N/A", "-", "fr_CA")] == ["pt", "pt", "en", "de", None, None, None, "other", None, None, "fr"]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    k = len(L.LANGS)
    sizes = np.array([3, 1, 0, 4])
    em = rng.normal(size=(8, k))
    across = np.array([False, True, False, False, False, True, False, True])
    inside_t, across_t = rng.normal(size=(k, k)), rng.normal(size=(k, k))
    post, s_in, s_out, logz = L.forward_backward(em, across, L.Sequences(sizes), inside_t, across_t, True)
    want, z, pair = np.zeros_like(em), 0.0, np.zeros((2, k, k))
    at = 0
    for n in sizes:
        own, total, expect = np.zeros((n, k)), 0.0, np.zeros((2, k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            score = sum(em[at + t, y] for t, y in enumerate(path)) + sum((across_t if across[at + t] else inside_t)[path[t - 1], path[t]] for t in range(1, n))
            p = np.exp(score)
            total += p
            for t, y in enumerate(path):
                own[t, y] += p
                if t:
                    expect[int(across[at + t]), path[t - 1], y] += p
        if n:
            want[at : at + n] = own / total
            pair += expect / total
            z += np.log(total)
        at += n
    assert np.allclose(post, want) and np.isclose(logz, z) and np.allclose(s_in, pair[0]) and np.allclose(s_out, pair[1])


def test_found(spark):
    data = corpus()
    data += [(900, SENTENCES["pt"][0] + " " + SENTENCES["en"][1], "pt"), (901, SENTENCES["fr"][0], "de"), (902, SENTENCES["it"][0], None), (903, SENTENCES["es"][0] + " Der kurze Titel", "spanish"), (904, "", "pt"), (905, None, None), (906, "só isto", None), (None, SENTENCES["it"][0], None), (902, SENTENCES["it"][0], None)]
    assert rows(L.found(frame(spark, data))) == [(900, "en"), (900, "pt"), (901, "fr"), (902, "it")]


def test_segments_and_documents(spark):
    data = corpus()
    mixed = SENTENCES["de"][0] + "\n" + SENTENCES["pt"][0] + " " + SENTENCES["pt"][1]
    df = frame(spark, [*data, (900, mixed, None), (901, "12 34", "pt")])
    seg = L.segments(df).filter("doc_id = 900").orderBy("segment").collect()
    assert [(r.lang, mixed[r.start : r.end].strip()) for r in seg] == [("de", SENTENCES["de"][0]), ("pt", SENTENCES["pt"][0] + " " + SENTENCES["pt"][1])]
    assert all(0.5 < r.confidence <= 1 for r in seg)
    docs = {r.doc_id: r for r in L.document_languages(df).collect()}
    assert docs[901].lang is None and docs[901].confidence == 0
    assert np.mean([docs[i].lang == lang for i, _, lang in data]) == 1


def test_empty_and_long(spark):
    df = frame(spark, [])
    assert L.found(df).count() == 0 and L.segments(df).count() == 0
    long = " ".join(SENTENCES["en"] * 600)
    assert rows(L.found(frame(spark, [*corpus(5), (900, long, "pt")]))) == [(900, "en")]
