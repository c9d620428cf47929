"""Tab-separated page and domain files: header detection, typed rows, error classes.

Unlike a delivery, these files have no quoting: a tab always parts fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrow import map_batches
from corpusloom.sources.delivery import FIELDS as PAGE_FIELDS
from corpusloom.sources.delivery import INTS, LONGS, decode_text

#: The columns of a domain file in order.
DOMAIN_FIELDS = ("id", "url", "url_md5", "parent_domain_id", "recursion_level", "request_count", "last_request_at", "created_at", "updated_at")
MAX_LINE = 128 * 1024 * 1024


def has_header(spark: SparkSession, path: str, fields: tuple[str, ...], mode: str = "auto") -> bool:
    """Whether the file begins with its column names; ``mode`` is auto, present or absent."""
    if mode not in ("auto", "present", "absent"):
        raise ValueError(f"unknown header mode {mode!r}")
    first = spark.read.text(path).limit(1).collect()
    same = bool(first) and first[0].value.rstrip("\r").split("\t") == list(fields)
    if mode == "present" and not same:
        raise ValueError(f"{path} does not begin with the expected columns")
    return same and mode != "absent"


def scan(spark: SparkSession, path: str, fields: tuple[str, ...], mode: str = "auto", max_line: int = MAX_LINE) -> DataFrame:
    """``(<fields as strings>, error)``: one row per line; the header is left out.

    ``error`` is ``line_too_large`` or ``wrong_column_count``, and the fields are null then; empty
    fields, ``NULL`` and ``\\N`` are null.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\\r$", "").alias("line"))
    if has_header(spark, path, fields, mode):
        lines = lines.filter(F.col("line") != "\t".join(fields))
    parts = F.split("line", "\t", -1)
    error = F.when(F.octet_length("line") > max_line, "line_too_large").when(F.size(parts) != len(fields), "wrong_column_count")
    rows = lines.select(parts.alias("p"), error.alias("error"))
    return rows.select(*[_null(F.when(F.col("error").isNull(), F.col("p")[i])).alias(c) for i, c in enumerate(fields)], "error")


def _null(c: Column) -> Column:
    return F.when(~c.isin("", "NULL", "\\N"), c)


def _number(name: str, kind: str) -> tuple[Column, Column]:
    """Value of an integer column, and whether it is there but cannot be read."""
    value = F.when(F.col(name).rlike("^-?[0-9]+$"), F.expr(f"try_cast({name} AS {kind})"))
    return value, F.col(name).isNotNull() & value.isNull()


def read_pages(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """Pages with typed columns, decoded text and ``errors``: all classes that apply to a line.

    Fields that cannot be read are null; lines without structure keep their error only.
    """
    raw = scan(spark, path, PAGE_FIELDS, mode)
    checks = {c: _number(c, "bigint" if c in ("id", *LONGS) else "int") for c in ("id", *LONGS, *INTS)}
    wrong = F.concat(F.array("error"), *[F.array(F.when(bad, f"invalid_{c}")) for c, (_, bad) in checks.items()])
    typed = raw.select(*[(checks[c][0] if c in checks else F.col(c)).alias(c) for c in PAGE_FIELDS], F.array_compact(wrong).alias("errors"))

    def step(batch):
        import pyarrow as pa

        at = batch.schema.names.index("text")
        texts, reasons = [], []
        for x in batch.column(at).to_pylist():
            text, reason = (None, None) if x is None else decode_text(x) if len(x) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in x) else (None, "invalid_hex")
            texts.append(text)
            reasons.append(reason)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(reasons, pa.string())], names=[*batch.schema.names, "text_error"])

    ddl = ", ".join(f"{n} {t}" for n, t in typed.dtypes) + ", text_error string"
    out = map_batches(typed, ddl, step)
    return out.withColumn("errors", F.array_compact(F.concat("errors", F.array("text_error")))).drop("text_error")


def read_domains(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """Domains with typed columns and ``errors``."""
    raw = scan(spark, path, DOMAIN_FIELDS, mode)
    checks = {c: _number(c, k) for c, k in (("id", "bigint"), ("parent_domain_id", "bigint"), ("recursion_level", "int"), ("request_count", "bigint"))}
    wrong = F.concat(F.array("error"), *[F.array(F.when(bad, f"invalid_{c}")) for c, (_, bad) in checks.items()], F.array(F.when(F.col("error").isNull() & F.col("request_count").isNull(), "missing_request_count")))
    return raw.select(*[(checks[c][0] if c in checks else F.col(c)).alias(c) for c in DOMAIN_FIELDS], F.array_compact(wrong).alias("errors"))


def error_counters(rows: DataFrame) -> DataFrame:
    """``(error, lines)`` over the ``errors`` of a scan."""
    return rows.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("lines"))
