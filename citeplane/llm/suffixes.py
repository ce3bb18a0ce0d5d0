"""Operator 1, dedup by a sparse suffix array: passages of ``PASSAGE`` words or more that stand at several places.

1. Suffixes are retained at minimisers: of the grams of ``GRAM`` words in a window of ``PASSAGE`` words, the one of least
   hash. Equal windows have theirs at the same place, so each repeated window is seen from suffixes that share a gram.
   Windows in a row with one minimiser are one suffix, with the context that they span.
2. All suffixes are sorted over range partitions by (hash of the first gram, hash of the context, place). The place ends
   every tie, so a hot prefix, or a passage with a third of all places, is split among partitions like anything else.
   One pass compares neighbours: those of equal context repeat as they are and are reported at once, place by place;
   of each context one suffix goes on if a neighbour shares its gram. A partition's first and last contexts are settled
   with those of the next partitions, two rows for each task.
3. Matches are extended. Suffixes that share a gram are sorted twice by their words, rightwards and leftwards, and the
   longest common prefixes of neighbours cut both orders into classes for each split of the window: a window repeats
   exactly if two suffixes are in one class on both sides. More than ``GROUP`` contexts of one gram don't fit one task;
   their windows meet by their own hashes instead, which gives the same result for a group of any size.

Words are what white space separates, compared by 64-bit hashes. Defined results: a null or short text has no passage;
rows that repeat a document with the same text are one document, and so are rows without a doc_id that share a text; a
null doc_id is a document like others; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .repeats import Hashes, merged, minimisers

PASSAGE = 50
GRAM = 16
#: Different contexts of one gram up to which a task extends them together.
GROUP = 4000
#: Kinds of rows of the sorted pass: a place whose whole context repeats, a context to be extended, one at a partition's end.
PLACE, INNER, END = 0, 1, 2


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def retained(texts: DataFrame, passage: int, gram: int) -> DataFrame:
    """(h, c, m, first, last, k, th) of ``texts`` (k, th, __text): a row for each retained suffix."""
    schema = T.StructType(_fields("h", "c", "m", "first", "last") + texts.drop("__text").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                got = [minimisers(word_hashes(t.as_py()), passage, gram) for t in part.column(2)]
                columns = [np.concatenate([g[i] for g in got]).view(np.int64) for i in range(5)]
                owner = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), pa.int64())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *part.select([0, 1]).take(owner).columns], names=[f.name for f in schema.fields])

    return texts.mapInArrow(run, schema)


def neighbours(suffixes: DataFrame) -> DataFrame:
    """(kind, shared, several) and the columns of ``suffixes``: what the sorted suffixes say of each other."""
    order = suffixes.withColumn("x", F.xxhash64("k", F.col("k").isNull(), "th")).repartitionByRange("h", "c", "x", "m").sortWithinPartitions("h", "c", "x", "m")
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("shared", T.BooleanType()), T.StructField("several", T.BooleanType()), *suffixes.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        # The context that is open at the end of a batch: its first suffix, whether it has another, and what came before it.
        held: pa.RecordBatch | None = None
        key = place = None
        several = first = before = False

        def made(kind: np.ndarray, shared: np.ndarray, more: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shared, pa.bool_()), pa.array(more, pa.bool_()), *rows.columns], names=names)

        def one(kind: int, shared: bool, more: bool) -> pa.RecordBatch:
            return made(np.array([kind]), np.array([shared]), np.array([more]), held)

        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, m, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 7))
            batch = batch.select(list(range(7)))
            same = np.empty(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            same[0] = key == (h[0], c[0])
            twice = np.empty(len(h), bool)  # a row of a repeated document
            twice[1:] = same[1:] & (x[1:] == x[:-1]) & (m[1:] == m[:-1])
            twice[0] = same[0] and place == (x[0], m[0])
            place = x[-1], m[-1]
            if twice.any():
                keep = np.flatnonzero(~twice)
                if not len(keep):
                    continue
                h, c, same, batch = h[keep], c[keep], same[keep], batch.take(pa.array(keep))
            n = len(h)
            starts = np.flatnonzero(~same)
            lead = int(starts[0]) if len(starts) else n
            if lead:  # more of the open context
                if not several:
                    yield one(PLACE, False, True)
                several = True
                yield made(np.zeros(lead, int), np.zeros(lead, bool), np.ones(lead, bool), batch.slice(0, lead))
            if not len(starts):
                continue
            follows = h[starts] == np.concatenate([[key[0] if key else 0], h[starts[:-1]]])
            follows[0] &= key is not None
            if held is not None:
                shared = bool(before or follows[0])
                if first or shared:
                    yield one(END if first else INNER, shared, several)
            sizes = np.diff(np.append(starts, n))
            # Contexts that begin and end in this batch, then the places of those and of the last one that repeat.
            shared = follows[:-1] | follows[1:]
            kind = np.where((held is None) & (np.arange(len(starts) - 1) == 0), END, INNER)
            out = np.flatnonzero(shared | (kind == END))
            if len(out):
                yield made(kind[out], shared[out], sizes[:-1][out] > 1, batch.take(pa.array(starts[:-1][out])))
            places = lead + np.flatnonzero(np.repeat(sizes > 1, sizes))
            if len(places):
                yield made(np.zeros(len(places), int), np.zeros(len(places), bool), np.ones(len(places), bool), batch.take(pa.array(places)))
            first = held is None and len(starts) == 1
            before, several = bool(follows[-1]), bool(sizes[-1] > 1)
            held, key = batch.slice(int(starts[-1]), 1), (h[-1], c[-1])
        if held is not None:
            yield one(END, before, several)

    return order.mapInArrow(run, schema)


def settled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places whose context repeats, and contexts to be extended, once the ends of partitions are compared with each other."""
    suffix = found.columns[3:]
    # Two rows at most for each task of the sorted pass.
    ends = found.where(f"kind = {END}")
    grams = ends.groupBy("h").agg((F.max("shared") | (F.min("c") != F.max("c"))).alias("g_shared")).withColumnRenamed("h", "gh")
    contexts = ends.groupBy("h", "c").agg((F.max("several") | (F.count("*") > 1)).alias("c_several"), F.min(F.struct(*suffix)).alias("head"))
    # An end with a single place, of a context that goes on elsewhere, hasn't been reported yet.
    late = ends.where("not several").join(contexts.where("c_several").select(F.col("h").alias("ch"), F.col("c").alias("cc")), (F.col("h") == F.col("ch")) & (F.col("c") == F.col("cc"))).select(*suffix)
    places = found.where(f"kind = {PLACE}").select(*suffix).unionByName(late)
    more = contexts.join(grams.where("g_shared"), F.col("h") == F.col("gh")).select("c_several", "head.*").withColumnRenamed("c_several", "several")
    heads = found.where(f"kind = {INNER}").select("several", *suffix).unionByName(more.select("several", *suffix))
    return places, heads


def in_context(texts: DataFrame, heads: DataFrame, passage: int) -> DataFrame:
    """``heads`` with ``words``, the hashes of the words they span as bytes."""
    own = ["h", "several", "big", "m", "first", "last"]
    by_text = heads.groupBy("k", "th").agg(F.collect_list(F.struct(*own)).alias("s")).select(F.col("k").alias("hk"), F.col("th").alias("hth"), "s")
    wide = texts.join(by_text, (F.col("th") == F.col("hth")) & F.col("k").eqNullSafe(F.col("hk"))).select("k", "th", "__text", "s")
    schema = T.StructType([*heads.select(*own, "k", "th").schema.fields, T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                flat, sizes = part.column(3).flatten(), [len(x) for x in part.column(3)]
                first, last = (flat.field(j).to_pylist() for j in (4, 5))
                words, at = [], 0
                for text, n in zip(part.column(2), sizes):
                    data = word_hashes(text.as_py()).astype(">u8").tobytes()
                    words += [data[8 * a : 8 * (b + passage)] for a, b in zip(first[at : at + n], last[at : at + n])]
                    at += n
                keys = part.select([0, 1]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([*(flat.field(j) for j in range(6)), *keys.columns, pa.array(words, pa.binary())], names=[f.name for f in schema.fields])

    return wide.mapInArrow(run, schema)


def _common(rows: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``rows`` under ``head``, and of each how many words it shares with the one before it there."""
    data = np.concatenate([head[:, None], rows], axis=1).astype(">u8")
    order = np.argsort(np.frombuffer(data.tobytes(), dtype=f"S{8 * data.shape[1]}"), kind="stable")
    data = data[order]
    differ = data[1:] != data[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), data.shape[1]) - 1
    return order, np.concatenate([[-1], lcp])


def extended(h: np.ndarray, m: np.ndarray, first: np.ndarray, last: np.ndarray, words: list[bytes], passage: int, gram: int) -> np.ndarray:
    """[suffix, a]: whether the window that begins ``a`` words before the suffix stands at another one as well."""
    reach = passage - gram
    left, right = np.zeros((len(h), reach), np.uint64), np.zeros((len(h), passage), np.uint64)
    for i, w in enumerate(words):
        row, at = np.frombuffer(w, dtype=">u8"), int(m[i] - first[i])
        left[i, :at] = row[:at][::-1]
        right[i, : min(passage, len(row) - at)] = row[at : at + passage]
    (lo, lcp), (ro, rcp) = _common(left, h.view(np.uint64)), _common(right, h.view(np.uint64))
    near, far = m - last, m - first
    out = np.zeros((len(h), reach + 1), bool)
    of_left, of_right = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for a in range(reach + 1):
        of_left[lo], of_right[ro] = np.cumsum(lcp < a), np.cumsum(rcp < passage - a)
        own = np.flatnonzero((near <= a) & (a <= far))
        if len(own) > 1:
            _, back, n = np.unique(of_left[own] * (len(h) + 1) + of_right[own], return_inverse=True, return_counts=True)
            out[own[n[back] > 1], a] = True
    return out


def _stretches(hit: np.ndarray, m: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each stretch of windows in a row that ``hit`` marks."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, m[row] - (b - 1), m[row] - a + passage


def extend(contexts: DataFrame, passage: int, gram: int, group: int = GROUP) -> DataFrame:
    """(k, th, start, end) of the repeated windows of suffixes that don't repeat as they are; a gram's are in one task."""
    schema = T.StructType([*contexts.select("k", "th").schema.fields, *_fields("start", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            h, m, first, last = (rows.column(i).to_numpy() for i in (0, 3, 4, 5))
            hit = extended(h, m, first, last, rows.column(8).to_pylist(), passage, gram)
            hit[rows.column(1).to_numpy()] = False  # these are reported as they are
            row, start, end = _stretches(hit, m, passage)
            keys = rows.select([6, 7]).take(pa.array(row)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in keys.columns), pa.array(start), pa.array(end)], names=[f.name for f in schema.fields])

        held: pa.Table | None = None
        before = None
        for batch in batches:
            # Repeated rows of a document give a suffix repeatedly; it is one.
            marks = np.column_stack([batch.column(i).to_numpy() for i in (0, 3, 9)])
            new = np.ones(len(marks), bool)
            new[1:] = (marks[1:] != marks[:-1]).any(axis=1)
            if len(marks):
                new[0] = before is None or bool((marks[0] != before).any())
                before = marks[-1]
            more = pa.Table.from_batches([batch]).filter(pa.array(new))
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows < group:
                continue
            h = held.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last gram may go on
            for a, b in _chunks(h[:cut], group):
                yield done(held.slice(a, b - a))
            held = held.slice(cut)
        if held is not None and held.num_rows:
            for a, b in _chunks(held.column(0).to_numpy(), group):
                yield done(held.slice(a, b - a))

    return contexts.withColumn("x", F.xxhash64("k", F.col("k").isNull(), "th")).repartition("h").sortWithinPartitions("h", "x", "m").mapInArrow(run, schema)


def _chunks(h: np.ndarray, group: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole grams with about ``group`` rows."""
    ends = np.append(np.flatnonzero(np.diff(h)) + 1, len(h))
    at = 0
    for end, after in zip(ends.tolist(), [*ends[1:].tolist(), None]):
        if after is None or after - at > group:
            if end > at:
                yield at, end
            at = end


def _windows(contexts: DataFrame, passage: int) -> DataFrame:
    """(h, wh, place, several, k, th, start): every window of ``contexts``."""
    schema = T.StructType([*_fields("h", "wh", "start"), *contexts.select("several", "k", "th").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 8):
                h, several, first, last = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
                made = []
                for a, b, w in zip(first.tolist(), last.tolist(), part.column(8).to_pylist()):
                    at = np.arange(b - a + 1)
                    made.append(Hashes(np.frombuffer(w, dtype=">u8").astype(np.uint64)).of(1, at, at + passage).view(np.int64))
                count = last - first + 1
                owner = np.repeat(np.arange(len(h)), count)
                start = np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist())]) if made else first
                rows = part.select([1, 6, 7]).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(h[owner]), pa.array(np.concatenate(made) if made else h), pa.array(start), *rows.columns], names=[f.name for f in schema.fields])

    return contexts.mapInArrow(run, schema)


def extend_large(contexts: DataFrame, passage: int) -> DataFrame:
    """The same for grams of any number of contexts: their windows meet by key, pre-aggregated."""
    rows = common.materialize(_windows(contexts, passage))
    place = F.xxhash64("k", F.col("k").isNull(), "th", "start")
    # Written before it meets its rows again, so that the join can split a hot key.
    shared = common.materialize(rows.groupBy("h", "wh").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h", "wh"))
    return rows.where("not several").join(shared, ["h", "wh"]).select("k", "th", "start", (F.col("start") + passage).alias("end"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k, th, spans) of the documents with passages that stand elsewhere too; th is the hash of the text."""
    texts = common.texts(docs, [key], text_col).toDF("k", "__text").select("k", F.xxhash64("__text").alias("th"), "__text")
    suffixes = common.materialize(retained(texts, passage, gram))
    places, heads = settled(common.materialize(neighbours(suffixes)))
    heads = common.materialize(heads)
    big = common.materialize(heads.groupBy("h").count().where(F.col("count") > group).select(F.col("h").alias("bh")))
    heads = heads.join(big, F.col("h") == F.col("bh"), "left").withColumn("big", F.col("bh").isNotNull()).drop("bh")
    contexts, large = in_context(texts, heads, passage), not big.isEmpty()
    if large:  # else one pass reads them, and they aren't written
        contexts = common.materialize(contexts)
    spans = places.select("k", "th", F.col("first").alias("start"), (F.col("last") + passage).alias("end"))
    spans = spans.unionByName(extend(contexts.where("not big"), passage, gram, group))
    if large:
        spans = spans.unionByName(extend_large(contexts.where("big"), passage))
    return merged(spans)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each maximal stretch of repeated passages, in words from the start (the end is excluded)."""
    found = repeated_passages(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"))


SQL_TEXT = rf"""
with d as (select distinct doc_id, text from documents),
w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
g as (select r, doc_id, p, md5(array_to_string(w[p + 1:p + {PASSAGE}], ' ')) as g from (select r, doc_id, w, unnest(range(0, len(w) - {PASSAGE - 1})) as p from w where len(w) >= {PASSAGE})),
x as (select r, doc_id, p from g where g in (select g from g group by g having count(*) > 1)),
y as (select *, case when p - {PASSAGE} > lag(p) over (partition by r order by p) or lag(p) over (partition by r order by p) is null then 1 else 0 end as new from x),
z as (select *, sum(new) over (partition by r order by p) as n from y)
select doc_id, min(p)::bigint as start_word, (max(p) + {PASSAGE})::bigint as end_word from z group by r, doc_id, n
"""

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL = {"op1_suffix_dedup": SQL_TEXT}
