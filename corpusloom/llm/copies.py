"""Duplicates hidden by formatting differences: one record per canonical text, with its copies."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import map_batches
from corpusloom.session import materialize

_NOT_ALNUM = re.compile(r"[\W_]+")
_FIELD_BREAK = re.compile(r"[\n\r|;\x0b\x0c\x85  ]+")
_FIELD = re.compile(r"\s*[^\W\d_][^:.!?]*:\s*[^:]*\Z")
_LABEL = re.compile(r"\s+([^\W\d_]+\s*:)")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
#: A key held by more rows than this is hot: it is aggregated in two levels.
HOT_ROWS = 20_000
SALTS = 64


def canonical(text: str) -> str:
    """Letters and digits of ``text`` in order, after NFC and case folding; '' if it has none.

    Where the whole text is ``label: value`` fields parted by line ends, ``|`` or ``;`` the fields
    are sorted, so that their order does not matter.  Where a line end became a blank, the last word before a
    colon is taken for the label of a new field.
    """
    text = unicodedata.normalize("NFC", text).casefold()
    if ":" in text:
        fields = [f for piece in _FIELD_BREAK.split(text) for f in _parted(piece) if _NOT_ALNUM.sub("", f)]
        if _all_fields(fields):
            return "\x1f".join(sorted(_NOT_ALNUM.sub("", f) for f in _joined(fields)))
    return _NOT_ALNUM.sub("", text)


def _parted(piece: str) -> list[str]:
    """A piece with several colons and no sentence in it, parted before the last word before each further colon."""
    if piece.count(":") < 2 or _SENTENCE.search(piece):
        return [piece]
    return _LABEL.sub(r"\n\1", piece).split("\n")


def _joined(fields: list[str]) -> list[str]:
    """Fields with their continuation lines: a piece without a colon belongs to the field before it."""
    out: list[str] = []
    for f in fields:
        if ":" in f or not out:
            out.append(f)
        else:
            out[-1] += f
    return out


def _all_fields(fields: list[str]) -> bool:
    joined = _joined(fields)
    return len(joined) >= 2 and all(_FIELD.match(f) for f in joined)


def canonical_keys(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, hi, lo)``: the 128-bit key of each record's canonical text, once per id.

    Rows with a null id or null text, and texts without letter or digit, have no key.  The text
    itself is never shuffled, only its key.
    """

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {"id": [], "hi": [], "lo": []}
        for i, t in zip(ids, texts):
            if key := canonical(t):
                n = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
                out["id"].append(i)
                out["hi"].append((n >> 64) - (1 << 63))
                out["lo"].append((n & (1 << 64) - 1) - (1 << 63))
        return out

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return map_batches(src, "id long, hi long, lo long", step).distinct()


def format_copies(df: DataFrame, id_col: str = "id", text_col: str = "text", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``(id, kept_id, copies)`` for each record whose canonical text stands on more than one id.

    ``kept_id`` is the smallest id of the group and ``copies`` its number of records.  Keys with more
    than ``hot_rows`` records are found exactly from map-side combined counts (there are at most
    rows / hot_rows of them); they are salted and aggregated in two levels, while every other group
    is bounded by ``hot_rows`` and needs one shuffle only.  Repeated rows of an id count once; an
    empty input gives no rows.
    """
    keys = materialize(canonical_keys(df, id_col, text_col), "format-keys")
    cold, heads = _groups(keys, hot_rows, salts)
    each = cold.filter(F.size("ids") > 1).select(F.explode("ids").alias("id"), "kept_id", F.size("ids").cast("long").alias("copies"))
    return each.unionByName(keys.join(heads, ["hi", "lo"]).select("id", "kept_id", "copies"))


def _groups(keys: DataFrame, hot_rows: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """``(hi, lo, kept_id, ids)`` of all keys that are not hot, and ``(hi, lo, kept_id, copies)`` of the hot ones.

    The table of hot keys grows with rows / hot_rows; it is left to the planner, which sends it to all
    executors while it is small and splits the skewed partitions of a shuffled join beyond.
    """
    hot = materialize(keys.groupBy("hi", "lo").count().filter(F.col("count") > hot_rows).select("hi", "lo"), "format-hot")
    cold = keys.join(hot, ["hi", "lo"], "left_anti").groupBy("hi", "lo").agg(F.min("id").alias("kept_id"), F.collect_list("id").alias("ids"))
    salted = keys.join(hot, ["hi", "lo"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    first = salted.groupBy("hi", "lo", "salt").agg(F.min("id").alias("m"), F.count("*").alias("n"))
    heads = first.groupBy("hi", "lo").agg(F.min("m").alias("kept_id"), F.sum("n").alias("copies"))
    return cold, materialize(heads, "format-heads")


def copy_groups(df: DataFrame, **kw) -> DataFrame:
    """``(kept_id, copies)``: one row per group of two or more records."""
    return format_copies(df, **kw).filter("id = kept_id").select("kept_id", "copies")


def found(df: DataFrame, **kw) -> DataFrame:
    """``(kept_id, copy_id)``: one row for each record that a smaller id already holds."""
    return format_copies(df, **kw).filter("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))


def collapsed(df: DataFrame, id_col: str = "id", text_col: str = "text", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``(id, copies)``: every record with a key that stays after collapsing, singles included; hot keys as in ``format_copies``."""
    cold, heads = _groups(materialize(canonical_keys(df, id_col, text_col), "format-keys"), hot_rows, salts)
    return cold.select(F.col("kept_id").alias("id"), F.size("ids").cast("long").alias("copies")).unionByName(heads.select(F.col("kept_id").alias("id"), "copies"))
