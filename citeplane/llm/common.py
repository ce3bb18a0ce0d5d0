"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeplane.scratch import materialize

__all__ = ["BROADCAST_BYTES", "Memo", "fits", "materialize", "pick", "slices", "table", "text_of", "texts"]

#: Largest thing, in bytes, that an operator of this package ships to every executor.
BROADCAST_BYTES = 64 << 20
#: Bytes that one generation of a worker's memo holds.
MEMO_BYTES = 16 << 20


class Memo(dict):
    """What ``make`` gives for a key, remembered in two generations: a full younger one becomes the older one, which goes.

    What is used stays, at most twice ``limit`` bytes are held, and no result depends on it. ``size`` is the bytes of a
    value; a large entry is made again each time.
    """

    def __init__(self, make: Callable, size: Callable = getsizeof, limit: int = MEMO_BYTES):
        self.make, self.size, self.limit, self.older, self.held = make, size, limit, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        n = getsizeof(key) + self.size(value) + 100
        if n > self.limit >> 8:
            return value
        self.held += n
        if self.held > self.limit:
            self.older, self.held = dict(self), n
            self.clear()
        self[key] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fits(df: DataFrame, columns: list[str], limit: int = BROADCAST_BYTES) -> tuple[bool, int]:
    """Whether the given string columns of ``df`` take at most ``limit`` bytes, and how many they take."""
    total = df.select(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) + 32 for c in columns[1:]), F.coalesce(F.octet_length(columns[0]), F.lit(0)) + 32))).first()[0] or 0
    return total <= limit, total


def slices(batch, column: int, most: int = 4 << 20):
    """``batch`` in slices of about ``most`` bytes of one string column (at least a row each)."""
    import pyarrow.compute as pc

    sizes, start, held = pc.binary_length(batch.column(column)).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, found by their exact names: others that differ from them in case only do no harm."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names))


def texts(df: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """The named columns and ``__text``, the text with null as the empty text."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names), text_of(f"c{df.columns.index(text_col)}").alias("__text"))
