from __future__ import annotations

import csv
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.pipeline import Config, LoomError, Pipeline, ReviewRequired, SourceChanged
from corpusloom.sources import sinks, tables
from corpusloom.streaming import incremental
from tests.conftest import rows

HEAD = "This paragraph stands on every page of the site and is longer than eighty characters, surely."


@pytest.fixture()
def sources(tmp_path):
    lines = ["\t".join(tables.PAGE_FIELDS)]
    for i in range(1, 13):
        text = f"{HEAD}\n\nOwn text of page number {chr(96 + i)} with its words." if i < 12 else "zz"
        lines.append("\t".join([str(i), "1", "NULL", "", "u", "", "", "", "200", "t", "1", "done", "0", zstandard.compress(text.encode()).hex() if i < 12 else "zz", "", "\\N", "", "c", "u"]))
    lines += ["too\tfew", "\t".join(["x", "1", "", "", "u", "", "", "", "abc", "t", "1", "done", "0", "", "", "", "", "c", "u"])]
    (tmp_path / "pages.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "domain.tsv").write_text("1\thttp://a.b\t\\N\tNULL\t0\t5\t\tc\t2024\n2\tc.d\t\t1\tx\t\t\tc\t2024\n")
    return tmp_path


def test_scan_counts_errors(spark, sources):
    pages = tables.read_pages(spark, str(sources / "pages.tsv")).cache()
    assert rows(tables.error_counters(pages)) == [("invalid_hex", 1), ("invalid_id", 1), ("invalid_status_code", 1), ("wrong_column_count", 1)]
    assert pages.filter("text IS NOT NULL").count() == 11 and pages.filter("id = 1").first().text.startswith(HEAD)
    doms = tables.read_domains(spark, str(sources / "domain.tsv"))
    assert rows(tables.error_counters(doms)) == [("invalid_recursion_level", 1), ("missing_request_count", 1)]
    with pytest.raises(ValueError):
        tables.has_header(spark, str(sources / "domain.tsv"), tables.DOMAIN_FIELDS, "present")


def test_run_gate_resume_and_guard(spark, sources):
    config = Config(pages=str(sources / "pages.tsv"), domains=str(sources / "domain.tsv"), output=str(sources / "out"), review_rows=100, min_lower=0.2)
    pipe = Pipeline(spark, config)
    with pytest.raises(ReviewRequired) as gate:
        pipe.run()
    with open(str(gate.value), newline="") as file:
        sheet = list(csv.DictReader(file))
    assert len(sheet) == 1
    with open(str(sources / "out/review/candidates-filled.csv"), "w", newline="") as file:
        out = csv.DictWriter(file, sheet[0].keys())
        out.writeheader()
        out.writerows(r | {"label": "yes"} for r in sheet)
    assert pipe.run()["violations"] == {"df_at_most_tf": 0, "cleaning_shrinks": 0}
    summary = json.loads((sources / "out/public/summary.json").read_text())
    assert (summary["pages"], summary["unique"]) == (11, 11)
    assert HEAD not in "".join(p.read_text() for p in (sources / "out/public").iterdir())
    assert pipe.near_duplicates()["documents"] == 0
    with (sources / "pages.tsv").open("a") as file:
        file.write("more\n")
    with pytest.raises(SourceChanged):
        pipe.run()
    with pytest.raises(LoomError):
        Config(pages="$NOT_SET_ANYWHERE/x", domains="d", output="o")


def test_latex_escapes(spark, tmp_path):
    df = spark.createDataFrame([("a_b & 5%", 1), (None, 2)], "x string, n long")
    _, tex = sinks.write_table(df, str(tmp_path), "t")
    assert r"a\_b \& 5\%" in open(tex).read() and "{lr}" in open(tex).read()


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A b", "2025-01-01 00:00:00"), (2, "A  b", "2025-01-01 01:00:00"), (3, "c", "2025-01-02 00:00:00")], "id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"))
    incremental.run_available(incremental.first_copies(stream, "at"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    terms = incremental.windowed_terms(incremental.read_stream(spark, str(tmp_path / "in")), "at")
    query = terms.writeStream.format("memory").queryName("terms").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.sql("SELECT term, sum(tf) AS n FROM terms GROUP BY term")) == [("a", 2), ("b", 2), ("c", 1)]
