"""Small helpers that the training-data operators share.

Text conventions: a null text counts as the empty text; white space is the six
characters space, \\t, \\n, \\v, \\f and \\r; only A-Z are lower-cased. Python's
``bytes.split()`` and ``bytes.lower()`` follow exactly these rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, table

__all__ = ["SPACE", "SPACE_CLASS", "WORD_CLASS", "arrow_map", "column", "cut", "in_order", "parts", "remainder", "slices", "table", "texts"]

SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: A slice of a batch that one Python step holds at once: rows and, roughly, bytes of text.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remainder(col: str | Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that stay small in memory, whatever the batch holds."""
    start = 0
    while start < batch.num_rows:
        part = batch.slice(start, rows)
        n = part.num_rows
        while n > 1 and part.get_total_buffer_size() and part.nbytes > SLICE_BYTES:
            n = max(1, n // 2)
            part = batch.slice(start, n)
        yield part
        start += n


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow over small slices: ``step`` gets a slice and returns columns by name, in the schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := step(part)) is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def in_order(df: DataFrame, *by: str | Column) -> DataFrame:
    """The rows dealt by ranges of ``by`` and sorted within each, with ``part`` (the range) and ``index`` (0, 1, ... over all rows).

    No task holds more than a range; of each range one number, its size, goes to the driver.
    ``by`` must tell the rows apart for the index to be the same in every run.
    """
    rows = cut(df.repartitionByRange(parts(df), *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("__id", 33).cast("int")).withColumn("__id", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before, offsets = 0, []
    for part, n in sorted(rows.groupBy("part").agg(F.count(F.lit(1))).collect()):
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "part int, __start long")
    return rows.join(F.broadcast(starts), "part").withColumn("index", F.col("__start") + F.col("__id")).drop("__id", "__start")
