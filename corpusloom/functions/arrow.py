"""Arrow batch plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points that one step of a vectorised function works on; a longer text is a step of its own.
CHUNK_CHARS = 2_000_000


def map_batches(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch | None]) -> DataFrame:
    """Apply ``step`` to each Arrow batch of ``df``; a dict of columns is turned into a batch of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from corpusloom.session import ship

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = step(batch)
            if out is None:
                continue
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def map_partition(df: DataFrame, schema: str, step: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Apply ``step`` to all rows of each partition of ``df`` at once; partitions must be of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from corpusloom.session import ship

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from step(pa.Table.from_batches(held).combine_chunks()).cast(target).to_batches(max_chunksize=10_000)

    return df.mapInArrow(run, schema)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` code points each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
