"""Operator 9, SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of radius + 1 bits; the mask of a non-zero vector v holds the bits whose
vector has an odd inner product with v (Pagh, "CoveringLSH"). Up to ``radius`` differing bits span a space that some v
is orthogonal to, and v's mask holds none of them, so each pair within the radius agrees under at least one of the
2^(radius+1) - 1 masks: nothing is missed, with certainty.

Plan: fingerprints in one pass over the text; equal ones become one row; each row goes to 15 tables; a bucket is
compared inside one task and gives links that connect what is within the radius, fewer than its members. A bucket of
more than ``SMALL`` members, found by counting, is keyed again by the masks of the bits it doesn't agree on yet, which
halves them: after three levels at most a few bits are free, so the number of different members is bounded and no
case is left out. Components come from star contraction.

Defined results: a null or blank text has the fingerprint zero and is linked like any other; repeated rows and equal
texts share a fingerprint and thus a component; a null doc_id is returned as it is and never names a component unless
all of its documents have none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Members up to which a bucket is compared in one go; beyond, it is keyed again.
SMALL = 2000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``fp``, the 64-bit fingerprint as a signed long."""
    rows = common.texts(docs, id_cols, text_col)
    schema = T.StructType([*rows.drop("__text").schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, batch.num_columns - 1):
                got = np.array([fingerprint(t.as_py()) for t in part.column(part.num_columns - 1)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got.view(np.int64), pa.int64())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the set bits of ``free``: any ``radius`` of them are missed by one mask at least."""
    bits = [i for i in range(64) if free >> i & 1]
    spans = [i % (2 ** (radius + 1) - 1) + 1 for i in range(len(bits))]
    return [sum(1 << b for b, m in zip(bits, spans) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _levels(radius: int) -> list[dict[int, list[tuple[int, int]]]]:
    """By level, from the id of the mask above to (id, mask) below it; a mask holds all bits of those above."""
    every, out, above = (1 << 64) - 1, [], {0: 0}
    for _ in range(3):
        level, n, made = {}, 0, {}
        for k, held in above.items():
            level[k] = []
            for m in covering_masks(every & ~held, radius):
                level[k].append((n, held | m))
                made[n] = held | m
                n += 1
        out.append(level)
        above = made
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, level: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(fp, table, key): a row for each mask of the level below the row's own ``above``."""
    masks = F.create_map(*(x for k, v in level.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(n).alias("n"), F.lit(_signed(m)).alias("m")) for n, m in v))))) if len(level) > 1 else F.array(*(F.struct(F.lit(n).alias("n"), F.lit(_signed(m)).alias("m")) for n, m in level[0]))
    masks = masks[F.col("above")] if len(level) > 1 else masks
    return rows.select("fp", F.explode(masks).alias("x")).select("fp", F.col("x.n").alias("table"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))


def _linked(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect all of a bucket that is connected within the radius: a forest."""
    n = len(fps)
    left = np.arange(n)
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            for i in left[near]:
                yield int(fps[at]), int(fps[i])
            front = np.concatenate([front, left[near]])
            left = left[~near]


def _compare(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) inside the buckets of ``keyed``, streamed in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def close(parts: list[np.ndarray]) -> list[tuple[int, int]]:
            fps = np.unique(np.concatenate(parts)) if parts else np.array([], np.uint64)
            return list(_linked(fps, radius)) if len(fps) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, t, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
            out: list[tuple[int, int]] = []
            if last != (t[0], k[0]):
                out += close(held)
                held = []
            several = np.flatnonzero(ends - starts > 1)
            final = len(starts) - 1
            if final == 0:
                held.append(fp)
            else:
                out += close([*held, fp[: ends[0]]])
                for g in several:
                    if 0 < g < final:
                        out += close([fp[starts[g] : ends[g]]])
                held = [fp[starts[final] :]]
            last = t[-1], k[-1]
            if out:
                got = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])
        out = close(held)
        if out:
            got = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return keyed.sortWithinPartitions("table", "key").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Links (a, b) between different values of ``fp`` that connect what is within ``radius`` bits."""
    levels = _levels(radius)
    rows = fps.select("fp").where("fp is not null").distinct().withColumn("above", F.lit(0))
    found = None
    for depth, level in enumerate(levels):
        keyed = _keyed(rows, level)
        if depth < len(levels) - 1:
            keyed = common.materialize(keyed)
            # Counts are pre-aggregated, and few buckets are large: at most rows / small of them.
            large = common.materialize(keyed.groupBy("table", "key").count().where(F.col("count") > small).select("table", "key"))
            if large.isEmpty():
                rows = None
            else:
                rows = keyed.join(large, ["table", "key"], "left_semi").select("fp", F.col("table").alias("above"))
                keyed = keyed.join(large, ["table", "key"], "left_anti").select("fp", "table", "key")
        made = _compare(keyed.repartition("table", "key"), radius)
        found = made if found is None else found.unionByName(made)
        if depth < len(levels) - 1 and rows is None:
            break
    return found


def near_duplicates(docs: DataFrame, id_cols: list[str], key: str = "doc_id", text_col: str = "text", radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """``id_cols``, ``fp`` and ``component_id``: the least ``key`` among the documents that links reach."""
    prints = common.materialize(fingerprints(docs, id_cols, text_col))
    nodes = components(links(prints, radius, small))
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    rooted = common.materialize(least.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Written before it meets its fingerprints again, so that the join can split a large component.
    name = common.materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(name, "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("__fp")).select(*id_cols, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that with the least ``key``; of several rows with it, one.

    Where a group has no row with a key, one of its rows without stays. Groups are told apart by their fingerprints, so
    rows without a key, or different texts with one key, stay once for each group they are in.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(key)}"
    # A row is known by 128 bits of all it holds; nulls leave a hash as it is, so they are told apart by a flag.
    held = [x for f in plain.schema.fields if not isinstance(f.dataType, T.MapType) for x in (F.col(f.name), F.col(f.name).isNull())]
    plain = plain.select("*", *(F.xxhash64(F.lit(i), *held).alias(f"__r{i}") for i in range(2)))
    prints = common.materialize(fingerprints(plain, [at, "__r0", "__r1"], f"c{names.index(text_col)}"))
    nodes = components(links(prints))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col(at).isNull(), at, "__r0", "__r1")).alias("first"))
    rooted = first.join(nodes, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__r0").alias("__k0"), F.col("first.__r1").alias("__k1"))
    # Only rows that are equal in all are ranked together, each task's own before they are dealt; the join takes them as dealt.
    same = Window.partitionBy("__r0", "__r1").orderBy("__r0")
    rows = plain.withColumn("__rank", F.row_number().over(same)).where("__rank = 1")
    return rows.join(kept, (F.col("__r0") == F.col("__k0")) & (F.col("__r1") == F.col("__k1")), "left_semi").drop("__rank", "__r0", "__r1").toDF(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = near_duplicates(docs, ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
SQL: dict[str, str] = {}
