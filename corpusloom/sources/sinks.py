"""Small outputs of reports: CSV and LaTeX tables, JSON, checksums, review sheets; all of aggregates."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a published table may have; it is a report, not an export.
MAX_ROWS = 100_000
_LATEX = str.maketrans({"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#"})


def _rows(df: DataFrame) -> list[tuple]:
    got = [tuple(r) for r in df.limit(MAX_ROWS + 1).collect()]
    if len(got) > MAX_ROWS:
        raise ValueError(f"a published table has at most {MAX_ROWS} rows")
    return got


def _replace(path: Path, text: str) -> None:
    """Write beside the target and rename, so that a reader never sees half a file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with part.open("w", encoding="utf-8", newline="") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    part.replace(path)


def write_table(df: DataFrame, folder: str, name: str) -> list[str]:
    """``name.csv`` and ``name.tex``; the first column is left-aligned in LaTeX, the others right."""
    import io

    rows, buffer = _rows(df), io.StringIO()
    out = csv.writer(buffer)
    out.writerow(df.columns)
    out.writerows(["" if v is None else v for v in r] for r in rows)
    cell = lambda v: "" if v is None else str(v).translate(_LATEX)
    body = " \\\\\n".join(" & ".join(map(cell, r)) for r in [tuple(df.columns), *rows])
    tex = f"\\begin{{tabular}}{{l{'r' * (len(df.columns) - 1)}}}\n{body} \\\\\n\\end{{tabular}}\n"
    paths = [Path(folder, f"{name}.csv"), Path(folder, f"{name}.tex")]
    _replace(paths[0], buffer.getvalue())
    _replace(paths[1], tex)
    return [str(p) for p in paths]


def write_json(value: object, path: str) -> None:
    _replace(Path(path), json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def checksum(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_checksums(folder: str) -> str:
    """``SHA256SUMS`` over all published files of a folder."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file() and p.name != "SHA256SUMS")
    target = Path(folder, "SHA256SUMS")
    _replace(target, "".join(f"{checksum(str(p))}  {p.relative_to(folder)}\n" for p in files))
    return str(target)


def export_review(sample: DataFrame, path: str, key: str, *columns: str) -> str:
    """A sheet of a sample for human judgement, with a stable id and an empty ``label``."""
    rows = sample.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 20).alias("sample_id"), key, *columns, F.lit("").alias("label"))
    return write_table(rows.orderBy("sample_id"), str(Path(path).parent), Path(path).stem)[0]


def import_review(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("yes", "no", "unsure")) -> DataFrame:
    """``(sample_id, label)`` of a filled sheet; an unknown label is an error."""
    with open(path, encoding="utf-8", newline="") as file:
        rows = [(r["sample_id"], r["label"].strip().lower()) for r in csv.DictReader(file)]
    if bad := sorted({label for _, label in rows} - set(allowed)):
        raise ValueError(f"labels that are not allowed: {bad}")
    return spark.createDataFrame(rows, "sample_id string, label string")
