"""Operator 2, benchmark decontamination over suffix arrays of the training texts.

Each slice of the documents is a shard: its words become ids in the benchmark's vocabulary, its suffixes that can hold
a window at all (as many known words as the shortest window has) are sorted by their first ``WINDOW`` words, and every
benchmark suffix is binary-searched in that array, which yields all places of its window; overlapping places join to
the longest verbatim matches. A shard never leaves its task, so nothing is shuffled and no document meets another.

A benchmark of up to ``BLOCK_BYTES`` is sent to the tasks whole. A larger one is taken in blocks of that size: a pass over
the texts for each, run and written before the next begins, so that one block is held at a time whatever their number;
the matches, by hashes of the texts that have some, are joined to the documents at the end.

``decontaminate`` drops the documents that op2 calls contaminated, ``without_affected`` all with a match.

Defined results: a null text has no words; a document without words is clean; a benchmark row without words has no
window; repeated benchmark rows count once by item_id; a row without an item_id marks words but is not listed;
repeated documents are judged each; empty tables give no rows or clean documents.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
#: Bytes of benchmark text sent to the tasks at once.
BLOCK_BYTES = 4 << 20
_KEEP = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_KEEP).split()


class Windows:
    """The distinct windows of benchmark items, as ids of words: arrays of some 200 bytes a window."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.window, rows, owner = window, [], []
        for item, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=">i4")
            if len(ids):
                ids = np.pad(ids, (0, max(0, window - len(ids))))
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                owner.append(np.full(len(rows[-1]), item))
        low = np.concatenate(rows).astype(">i4") if rows else np.zeros((0, window), ">i4")
        self.low, of = np.unique(np.frombuffer(low.tobytes(), dtype=f"S{4 * window}"), return_inverse=True)
        high = np.frombuffer(self.low.astype(f"S{4 * window}").tobytes(), dtype=">i4").reshape(-1, window).copy()
        self.sizes = (high > 0).sum(axis=1)
        self.shortest = int(self.sizes.min()) if len(high) else 0
        high[high == 0] = -1
        self.high = np.frombuffer(high.tobytes(), dtype=f"S{4 * window}")
        # Items by window: those of window w are owners[begins[w]:begins[w + 1]].
        pairs = np.unique(np.column_stack([of, np.concatenate(owner)]), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.names = [item for item, _ in items]
        self.owners, self.begins = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(high) + 1))

    def items_of(self, w: int) -> set[str]:
        return {self.names[i] for i in self.owners[self.begins[w] : self.begins[w + 1]]} - {None}

    def search(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(window, its starts) for each window that occurs in ``ids``; 0 is a word no item has, or a border."""
        if not len(self.low) or len(ids) < self.shortest:
            return []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        starts = np.flatnonzero(known[self.shortest :] - known[: -self.shortest] == self.shortest)
        if not len(starts):
            return []
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)]).astype(">i4")
        suffixes = np.lib.stride_tricks.sliding_window_view(padded, self.window)[starts]
        keys = np.frombuffer(suffixes.tobytes(), dtype=f"S{4 * self.window}")
        order = np.argsort(keys, kind="stable")
        array, keys = starts[order], keys[order]
        first, last = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        return [(int(w), array[first[w] : last[w]]) for w in np.flatnonzero(last > first)]


def _match(windows: Windows, docs: list[list[bytes]]) -> Iterator[tuple[list[int], list[str]]]:
    """For each document its matches, as start and end by turns, and the items that have them."""
    get, sizes = windows.vocabulary.get, np.array([len(d) + 1 for d in docs], dtype=np.int64)
    flat = np.fromiter(map(get, chain.from_iterable((*d, b"") for d in docs), repeat(0)), dtype=np.int32, count=int(sizes.sum()))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    change = np.zeros(len(flat) + 1, dtype=np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for w, at in windows.search(flat):
        np.add.at(change, at, 1)
        np.add.at(change, at + windows.sizes[w], -1)
        for d in np.unique(np.searchsorted(begins, at, "right") - 1):
            items[int(d)].update(windows.items_of(w))
    hit = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(hit))
    owner = np.searchsorted(begins, edges[::2], "right") - 1
    spans: dict[int, list[int]] = defaultdict(list)
    for d, s, e in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
        spans[d] += [s - int(begins[d]), e - int(begins[d])]
    for d in range(len(docs)):
        yield spans.get(d, []), sorted(items.get(d, ()))


def _joined(flat: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2])):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _pass(rows: DataFrame, block: list[tuple[str | None, str]], window: int, hits: bool) -> DataFrame:
    """``rows``, the last column of which is the text, with n_words, spans and items in its stead; with ``hits`` only those with a match."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value, window)
        for batch in batches:
            for part in common.slices(batch, batch.num_columns - 1):
                split = [words_of(t.as_py()) for t in part.column(part.num_columns - 1)]
                found = list(_match(windows, split))
                made = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, split), pa.int64()), pa.array([s for s, _ in found], pa.list_(pa.int32())), pa.array([i for _, i in found], pa.list_(pa.string()))], names=schema.names)
                yield made.filter(pa.array([bool(s) for s, _ in found], pa.bool_())) if hits else made

    return rows.mapInArrow(run, schema)


def _union(rows: DataFrame) -> DataFrame:
    """``rows`` with the lists of spans and of items that blocks have found, the last two columns, joined and sorted."""
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = ([list(chain.from_iterable(x or ())) for x in batch.column(batch.num_columns - i).to_pylist()] for i in (2, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(map(_joined, spans), pa.list_(pa.int32())), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and n_words, spans (start and end of each longest match, by turns, in words), items."""
    names = docs.columns
    bench = common.pick(benchmark, list(dict.fromkeys([item_id, item_text]))).select(F.col(item_id).cast("string").alias("i"), common.text_of(item_text).alias("t")).where("t <> ''").distinct()
    _, size = common.fits(bench, ["i", "t"], block_bytes)
    blocks = max(1, math.ceil(size / block_bytes))
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = common.text_of(f"c{names.index(text_col)}").alias("__t")
    of = lambda b: [tuple(r) for r in bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
    if blocks == 1:
        return _pass(plain.select("*", text), of(0), window, False).toDF(*names, "n_words", "spans", "items")
    # One pass for each block, run and written before the next begins; texts that are equal have one result.
    bench = common.materialize(bench)
    keys = [F.xxhash64(F.lit(i), text).alias(f"__r{i}") for i in range(2)]
    hits = None
    for b in range(blocks):
        one = common.materialize(_pass(plain.select(*keys, text), of(b), window, True).groupBy("__r0", "__r1").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        hits = one if hits is None else hits.unionByName(one)
    hits = common.materialize(hits.groupBy(F.col("__r0").alias("__k0"), F.col("__r1").alias("__k1")).agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")))
    rows = _pass(plain.select("*", *keys, text), [], window, False).drop("spans", "items")
    found = rows.join(hits, (F.col("__r0") == F.col("__k0")) & (F.col("__r1") == F.col("__k1")), "left")
    return _union(found.select(*plain.columns, "n_words", "spans", "items")).toDF(*names, "n_words", "spans", "items")


def _judged(found: DataFrame, n: int) -> DataFrame:
    """``found`` with its columns by position, then n_words, spans, items, n_hit and contaminated."""
    plain = found.toDF(*(f"c{i}" for i in range(n)), "n_words", "spans", "items")
    ends = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return plain.withColumn("n_hit", ends).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents of which matches cover a twentieth of the words or more."""
    names = docs.columns
    return _judged(matches(docs, benchmark, **options), len(names)).where("not contaminated").select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def without_affected(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold any window of an item, however long they are."""
    names = docs.columns
    found = matches(docs, benchmark, **options).toDF(*(f"c{i}" for i in range(len(names))), "n_words", "spans", "items")
    return found.where("size(spans) = 0").drop("n_words", "spans", "items").toDF(*names)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = _judged(matches(common.pick(docs, ["doc_id", "text"]), bench), 2)
    items = F.array_join("items", ",")
    return found.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated", "spans")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_decontamination(spark, sf_dir).drop("spans")


OP2_SQL = r"""
with d as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as p from b where len(w) > 0)),
k as (select distinct k from bw),
dw as (select r, p, k, array_to_string(w[p:p + k - 1], ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, k where len(w) >= k)),
m as (select dw.r, dw.p, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
h as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from (select distinct r, p, k from m)) group by r),
i as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as s from (select distinct r, item_id from m where item_id is not null) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items, sha256(coalesce(i.s, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
from d left join h on d.r = h.r left join i on d.r = i.r
"""

QUERIES = {"op2_decontamination": op2_query}
SQL = {"op2_decontamination": OP2_SQL}
