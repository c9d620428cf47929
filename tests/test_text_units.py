from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import boilerplate as B
from corpusloom.operators import content as C
from corpusloom.operators import dedup
from tests.conftest import rows

PAGES = "id long, domain_id long, same_as long, recursion_level int, status string, text_md5 string, text string, clean string"


def test_normalized(spark):
    cases = {"a\r\nb\rc": "a\nb\nc", "  x \t y ": "x y", "\n\n a\n\n\n\n\nb \n\n": "a\n\n\nb", "é\u0007\u0085": "é", " z z": "z z", "": "", "\x0b": ""}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "text string")
    assert {r.text: r.n for r in df.select("text", tx.normalized(F.col("text")).alias("n")).collect()} == cases | {None: None}


def test_hosts(spark):
    cases = {"HTTPS://A.B/x": "a.b", "//u@c.d:80": "c.d", "e.f./p?q#r": "e.f", "": None, None: None, "http://x.wikipedia.org": "x.wikipedia.org"}
    df = spark.createDataFrame([(k,) for k in cases], "url string").withColumn("h", tx.host(F.col("url")))
    assert {r.url: r.h for r in df.collect()} == cases
    names = spark.createDataFrame([("wikipedia.org",), ("pt.wikipedia.org",), ("notwikipedia.org",), (None,)], "h string")
    assert rows(names.select(tx.is_wiki(F.col("h")).alias("w"))) == [(False,), (False,), (True,), (True,)]


def test_cut_merges_touching_spans():
    assert B.cut("abcdefgh", [(1, 3), (3, 4), (2, 3), (6, 7)]) == ("aefh", 4)
    assert B.edge(2) == 3 and B.edge(3) == 1 and B.edge(100) == 10


def pages(spark, texts, **kw):
    return spark.createDataFrame([(i, kw.get("domain", 1), kw.get("same", {}).get(i), 0, "done", None, t, "clash") for i, t in texts], PAGES)


def test_exact_groups_nulls_repeats(spark):
    df = pages(spark, [(1, "a  b"), (2, "a b"), (3, "a b"), (3, "a b"), (3, None), (4, ""), (5, None), (None, "a b")], same={2: 3, 3: 404})
    f = dedup.page_features(df).cache()
    assert rows(f, "page_id") == [(1,), (2,), (3,)]
    assert rows(dedup.groups(f, "normalized_sha256"), "pages", "representative") == [(3, 1)]
    assert rows(dedup.mark_representatives(f, "normalized_sha256"), "page_id", "is_representative") == [(1, True), (2, False), (3, False)]
    assert rows(dedup.same_as_audit(df, f)) == [(2, 1, 1, 1, 1, 1)]
    assert dedup.page_features(df.limit(0)).count() == 0


def test_boilerplate_rounds(spark):
    head = "This paragraph stands on every page of the site and is longer than eighty characters, surely."
    df = pages(spark, [(i, f"{head}\n\nOwn text number {i} with its own words {i * 37}.") for i in range(6)])
    docs = B.clean_pages(df)
    found = B.candidates(B.text_units(docs), docs)
    assert [(r.kind, r.document_frequency, r.threshold) for r in found.collect()] == [("paragraph", 6, 5)]
    assert all(r.text.startswith("Own text") and r.removed == len(head) for r in B.clean(docs, found).collect())
    assert B.two_rounds(df).count() == 6 and B.two_rounds(df.limit(0)).count() == 0
    assert B.cross_domain(B.text_units(docs)).count() == 0


def test_moving_ratio_against_brute_force():
    import random

    random.seed(5)
    for n in (0, 4, 5, 6, 40):
        w = [random.choice("abcd") for _ in range(n)]
        want = sum(len(set(w[i : i + 5])) / 5 for i in range(n - 4)) / (n - 4) if n >= 5 else None
        got = C.moving_ratio(w, 5)
        assert got == want or abs(got - want) < 1e-12


def test_profile_signals(spark):
    text = "Hello!!!! mail me@x.org or www.site.org now.\n\nThe same line stands here twice.\n\nThe same line stands here twice.\n\ncafÃ©"
    df = spark.createDataFrame([(1, text, 7), (2, "", 7), (3, None, 7)], "doc_id long, text string, words long")
    out = {r.doc_id: r for r in C.profile(df).collect()}
    assert set(out) == {1, 2}
    assert (out[1].emails, out[1].urls, out[1].punctuation_runs, out[1].mojibake_markers, out[1].repeated_sentence_words, out[1].repeated_paragraph_words) == (1, 1, 1, 1, 6, 6)
    assert out[2].words == 0 and out[2].ttr == 0 and not out[2].any_signal
    assert unicodedata.normalize("NFC", C.MARKERS[14]) == "Â "


def test_fixed_histogram_edges(spark):
    df = spark.createDataFrame([(1,), (2,), (101,), (102,), (9999,), (10000,), (None,)], "characters long")
    assert rows(C.fixed_histogram(df, "characters"), "bin", "documents") == [(-1, 1), (0, 2), (1, 1), (100, 1), (99, 1)]
    assert C.fixed_histogram(df.limit(0), "characters").count() == 0


def test_interface_lines_and_pairs(spark):
    docs = spark.createDataFrame([(1, 1, "Editar\nCorpo de texto\nEsta página foi editada pela última vez às 10:00"), (2, 2, "Editar"), (3, None, "Editar"), (4, 1, "editar código da escola")], "page_id long, domain_id long, text string")
    canon = spark.createDataFrame([(1, True), (2, False)], "id long, is_wiki boolean")
    assert rows(B.interface_lines(docs, canon), "line", "rule") == [("editar", "literal:editar"), ("esta página foi editada pela última vez às 10:00", "pattern:0")]
    two = spark.createDataFrame([(1, 1, "Top one\n Next  two\n\nbody\nmore body\nlast"), (2, 1, ""), (3, 1, "single")], "page_id long, domain_id long, text string")
    assert rows(B.short_pairs(two), "page_id", "pair") == [(1, "more body last"), (1, "top one next two")]
    assert B.short_pair_candidates(two, min_documents=1).count() == 2 and B.short_pair_candidates(two.limit(0)).count() == 0


def residual_docs(spark):
    data = []
    for i in range(24):
        body = [f"Corpo do texto número {chr(97 + i)} com palavras próprias", f"segunda linha {chr(97 + i)} do corpo", f"terceira {chr(97 + i)} linha do corpo", f"quarta {chr(97 + i)} linha", f"quinta {chr(97 + i)} linha"]
        data.append((i, 1, "\n".join(["Editar", "Menu da página", *body, "Fim da página", "x 1", "y 2"])))
    data += [(100, 2, "Editar\nMenu da página\ncorpo\ncorpo dois\nfim"), (101, None, "Editar\nMenu da página"), (102, 1, "")]
    return spark.createDataFrame(data, "page_id long, domain_id long, text string")


def test_second_round_by_kind_and_exceptions(spark):
    docs = residual_docs(spark)
    wiki = spark.createDataFrame([(1,)], "domain_id long")
    found = B.residual_candidates(B.residual_units(docs, wiki), docs).cache()
    kinds = {(r.domain_id, r.kind, r.unit) for r in found.collect()}
    assert kinds == {(1, "mediawiki", "editar"), (1, "short_line", "menu da página"), (1, "short_line", "fim da página"), (1, "short_pair", "editar menu da página"), (1, "short_pair", "fim da página x 1"), (1, "short_pair", "x 1 y 2")}
    out = {r.page_id: r for r in B.clean_residual(docs, found).collect()}
    first = out[0]
    assert first.text.split("\n")[0].startswith("Corpo do texto") and first.text.endswith("quinta a linha")
    assert (first.mediawiki_characters, first.short_line_characters) == (6, len("Menu da página") + len("Fim da página"))
    assert first.short_pair_characters == len("x 1") + len("y 2") + 3 and first.removed_lines == 5
    assert out[100].text.startswith("Editar") and out[101].removed_lines == 0 and out[102].text == ""
    no = spark.createDataFrame([(1, "mediawiki", "editar"), (1, "short_pair", "x 1 y 2"), (1, "short_pair", "editar menu da página"), (1, "short_pair", "fim da página x 1")], "domain_id long, kind string, unit string")
    kept = B.approved_residuals(found, no)
    assert {(r.kind, r.unit) for r in kept.collect()} == {("short_line", "menu da página"), ("short_line", "fim da página")}
    again = {r.page_id: r for r in B.clean_residual(docs, kept).collect()}
    assert again[0].text.startswith("Editar\n") and again[0].text.endswith("x 1\ny 2") and again[0].mediawiki_characters == 0
    assert B.clean_residual(docs.limit(0), found).count() == 0 and B.clean_residual(docs, found.limit(0)).filter("removed_lines > 0").count() == 0
