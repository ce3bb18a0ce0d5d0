"""Repeated windows of tokens, from sparse positions: what suffix-array dedup and line dedup share.

A window is ``size`` tokens in a row. Of the ``size - gram + 1`` grams in a window, the one of least hash (the first of
equals) is its minimiser, so equal windows have their minimiser at the same place. A run of windows with one minimiser
is one row: its gram's hash ``h``, the hash ``c`` of all it spans, and its place. Then, only by joins and aggregations on
keys, which split and pre-aggregate hot ones:

1. rows whose ``h`` no other place has are gone: no window of theirs can repeat;
2. where all rows of an ``h`` are equal in ``c``, all their windows repeat;
3. else equal rows (``h``, ``c``) repeat, and of each class one row is extended to both sides: its windows' own hashes
   meet those of the other classes of ``h``, so that every repeated window, and with it every maximal match, is found.

Work is linear in the tokens, whatever the size of a group: no pairs are made. Hashes that are compared have 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_P = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INV = tuple(pow(p, -1, 1 << 64) for p in _P)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any stretch of tokens, from running sums modulo 2^64."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.n = n
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(tokens ^ np.uint64(p)) * _powers(p, n), dtype=np.uint64)]) for p in _P]
        self.back = [_powers(i, n + 1) for i in _INV]

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[end] - s[start]) * self.back[which][start] + (end - start).astype(np.uint64))


def minimisers(tokens: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """h, c, minimiser, first and last start of each run of windows that share a minimiser."""
    n = len(tokens)
    if n < size:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = Hashes(tokens)
    at = np.arange(n - gram + 1)
    grams = hashes.of(0, at, at + gram)
    m = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1).argmin(axis=1) + np.arange(n - size + 1)
    edges = np.flatnonzero(np.diff(m)) + 1
    first, last = np.concatenate([[0], edges]), np.concatenate([edges - 1, [len(m) - 1]])
    m = m[first]
    c = _mix(hashes.of(1, first, last + size) + ((m - first) << 8 | (last - first)).astype(np.uint64))
    return grams[m], c, m, first, last


def place(m: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimiser, how far the first window begins before it, and how many windows follow that one."""
    return m << 12 | (m - first) << 6 | (last - first)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


Tokens = Callable[[str], np.ndarray]


def _rows(texts: DataFrame, tokens: Tokens, size: int, gram: int) -> DataFrame:
    """(h, c, pos, k, th) of ``texts`` (k, th, __text)."""
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("h", "c", "pos")] + texts.drop("__text").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                got = [minimisers(tokens(t.as_py()), size, gram) for t in part.column(2)]
                owner = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
                h, c, m, first, last = (np.concatenate([g[i] for g in got]) for i in range(5)) if got else minimisers(np.zeros(0, np.uint64), size, gram)
                keys = part.select([0, 1]).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(c), pa.array(place(m, first, last)), keys.column(0), keys.column(1)], names=[f.name for f in schema.fields])

    return texts.mapInArrow(run, schema)


def _windows(texts: DataFrame, tokens: Tokens, size: int) -> DataFrame:
    """(h, wh, start, k, th): every window of the runs listed in ``runs`` of ``texts`` (k, th, __text, runs)."""
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("h", "wh", "start")] + texts.drop("__text", "runs").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                made = []
                for i, (text, runs) in enumerate(zip(part.column(2), part.column(3))):
                    flat = runs.values
                    h, pos = (flat.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                    first, count = (pos >> 12) - (pos >> 6 & 63), (pos & 63) + 1
                    total = int(count.sum())
                    start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
                    hashes = Hashes(tokens(text.as_py()))
                    made.append((np.repeat(h, count), hashes.of(1, start, start + size), start, np.full(total, i)))
                if not made:
                    continue
                h, wh, start, owner = (np.concatenate([x[j] for x in made]) for j in range(4))
                keys = part.select([0, 1]).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(h), _signed(wh), pa.array(start), keys.column(0), keys.column(1)], names=[f.name for f in schema.fields])

    return texts.mapInArrow(run, schema)


def repeated(docs: DataFrame, tokens: Tokens, size: int, gram: int, key: str = "doc_id", text_col: str = "text", later: bool = False) -> DataFrame:
    """(k, th, start, end): stretches of tokens that repeated windows cover; they may overlap.

    ``k`` is the document's key and ``th`` the hash of its text: rows equal in both are one document. With ``later``,
    a window's first place, by k, th and position, is left out.
    """
    if not 0 <= size - gram < 64:
        raise ValueError("size - gram must be from 0 to 63")
    texts = common.texts(docs, [key], text_col).toDF("k", "__text").select("k", F.xxhash64("__text").alias("th"), "__text")
    loc: Callable[[str], Column] = lambda p: F.struct("k", "th", F.col(p).alias("p")) if later else F.xxhash64("k", "th", p)
    ends = lambda p: (F.min(loc(p)).alias("lo"), F.max(loc(p)).alias("hi"))
    rows = common.materialize(_rows(texts, tokens, size, gram))
    # What is aggregated is written before it meets its rows again: a join of two plain exchanges is one whose hot keys can
    # be split, while one that took over the partitions of the aggregation would leave a hot key to one task.
    grams = rows.groupBy("h").agg(*ends("pos"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("lo <> hi").select("h", "lo", F.expr("c0 = c1").alias("even"))
    found = common.materialize(rows.join(common.materialize(grams), "h"))
    begin = F.expr("shiftright(pos, 12) - (shiftright(pos, 6) & 63)")
    spans = lambda df: df.select("k", "th", begin.alias("start"), (begin + F.expr("(pos & 63)") + size).alias("end"))
    even = found.where("even").where(loc("pos") != F.col("lo")) if later else found.where("even")
    mixed = found.where("not even").drop("lo", "even")
    classes = mixed.groupBy("h", "c").agg(*ends("pos"))
    mixed = common.materialize(mixed.join(common.materialize(classes), ["h", "c"]))
    several = mixed.where("lo <> hi")
    several = several.where(loc("pos") != F.col("lo")) if later else several
    heads = mixed.where(loc("pos") == F.col("lo")).groupBy("k", "th").agg(F.collect_set(F.struct("h", "pos")).alias("runs"))
    heads = heads.select(F.col("k").alias("hk"), F.col("th").alias("hth"), "runs")
    wide = texts.join(heads, (F.col("th") == F.col("hth")) & F.col("k").eqNullSafe(F.col("hk"))).select("k", "th", "__text", "runs")
    wide = common.materialize(_windows(wide, tokens, size))
    shared = wide.groupBy("h", "wh").agg(*ends("start")).where("lo <> hi").select("h", "wh", "lo")
    single = wide.join(common.materialize(shared), ["h", "wh"])
    single = single.where(loc("start") != F.col("lo")) if later else single
    return spans(even).unionByName(spans(several)).unionByName(single.select("k", "th", "start", (F.col("start") + size).alias("end")))


def merged(spans: DataFrame) -> DataFrame:
    """(k, th, spans): for each document its stretches in order, those that touch joined; array of start and end."""
    lists = spans.groupBy("k", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("x"))
    schema = T.StructType([*lists.drop("x").schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                start, end = (x.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                reach = np.maximum.accumulate(end)
                new = np.concatenate([[True], start[1:] > reach[:-1]])
                out.append([{"start": int(s), "end": int(e)} for s, e in zip(start[new], np.concatenate([reach[:-1][new[1:]], reach[-1:]]))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kind)], names=[f.name for f in schema.fields])

    return lists.mapInArrow(run, schema)
