"""What the text operators share: walking Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text handled at a time in a Python worker; one longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Split record batches so that ``column`` (binary or string) stays near PIECE_BYTES."""
    for batch in batches:
        at, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        for row, size in enumerate(lengths):
            if held and held + size > PIECE_BYTES:
                yield batch.slice(at, row - at)
                at, held = row, 0
            held += size
        if at < len(lengths):
            yield batch.slice(at)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 of a text, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that a column has, whatever its case."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def one_row(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Of the rows that share ``keys`` the one whose ``columns`` come first as JSON (columns of any type, maps too); only those are kept."""
    inner, text = free_names([*columns, *keys], "row", "json")
    packed = rows.select(*(F.col(f"`{k}`") for k in keys), F.struct(*(F.col(f"`{c}`") for c in columns)).alias(inner))
    packed = packed.withColumn(text, F.to_json(F.struct(inner), {"ignoreNullFields": "false"}))
    return packed.groupBy(*(f"`{k}`" for k in keys)).agg(F.min_by(inner, text).alias(inner)).select(*(F.col(inner).getField(c).alias(c) for c in columns))
