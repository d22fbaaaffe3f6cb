"""What the operators of this subpackage share: reading tables, Arrow text columns, bounded memos."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIMMED = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null is the empty text."""
    return [value or "" for value in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a batch; null is the empty text."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def rows(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    """A batch from lists, in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, (columns[f.name] for f in schema), strict=True)], schema=schema
    )


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened until none of them is one of ``columns``."""
    taken, tail = {column.lower() for column in columns}, ""
    while taken & {(name + tail).lower() for name in names}:
        tail += "_"
    return [name + tail for name in names]


class Memo(dict):
    """Results by key, worked out once; emptied when ``limit`` entries are held, so that memory is bounded.

    Keys longer than ``longest`` are worked out every time.
    """

    def __init__(self, work: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.work, self.limit, self.longest = work, limit, longest

    def __missing__(self, key):
        value = self.work(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def word_count(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hex_number(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 of a text as a number; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def crc_sql(number: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the decimal digits of a number: shift and xor bit by bit, as it has no such function."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: {bit})"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({number}::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, b: {byte}), 4294967295)"
