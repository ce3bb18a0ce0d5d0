"""Operator 6, line dedup by winnowing: runs of ``RUN`` lines or more that stood earlier are deleted.

The fingerprints are the least line hashes of each window of ``RUN`` lines, which every run of that length holds at the
same place (winnowing's guarantee); places meet by fingerprint, matches are extended to both sides (see repeats.py), and
a line goes if a window that covers it stands at an earlier place: by doc_id, then by position.

Shorter runs of ``LONG`` words or more (split at ASCII white space) go too, as a passage that is one line is a passage:
they meet by the hash of the whole run, and runs of fewer words are left out before anything moves.

Lines count without the white space at their ends; blank lines are no part of a run, and those between two deleted
lines go with them. Defined results: a null text stays null and counts as empty; a document may lose all its lines and
then stays with an empty text; rows that repeat a document with the same text are one document (rows without a doc_id too, if they share a text), of which each row loses
the same lines; a null doc_id comes first in the order; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .repeats import Hashes, merged, repeated

RUN = 3
#: Words from which a run of fewer lines than ``RUN`` is long enough to go as well.
LONG = 50


def line_hashes(text: str) -> np.ndarray:
    import xxhash

    lines = [x for line in text.split("\n") if (x := line.strip())]
    return np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in lines), dtype=np.uint64, count=len(lines))


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines in ``spans`` (numbers of lines that aren't blank), how many lines it had, how many went."""
    at, gone, kept, last_gone, waiting, k = 0, 0, [], False, [], 0
    for line in text.split("\n"):
        if not line.strip():
            (waiting if last_gone else kept).append(line)
            continue
        while k < len(spans) and at >= spans[k][1]:
            k += 1
        if k < len(spans) and spans[k][0] <= at:
            gone, last_gone, waiting = gone + 1, True, []
        else:
            kept += [*waiting, line]
            last_gone, waiting = False, []
        at += 1
    kept += waiting
    return ("\n".join(kept) if gone else text), at, gone


def long_runs(text: str, run: int, long: int) -> tuple[np.ndarray, ...]:
    """h, c, start and end of each run of fewer than ``run`` lines that holds ``long`` words."""
    words = [n for line in text.split("\n") if line.strip() for n in (len(line.encode().split()),)]
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    start = [np.flatnonzero(upto[size:] - upto[:-size] >= long) for size in range(1, min(run, len(upto)))] if upto[-1] >= long else []
    if not start:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    end = np.concatenate([x + size for size, x in enumerate(start, 1)])
    start = np.concatenate(start)
    hashes = Hashes(line_hashes(text))
    return hashes.of(0, start, end), hashes.of(1, start, end), start, end


def repeated_long(docs: DataFrame, run: int, long: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, th, start, end): runs as ``long_runs`` finds them that stood earlier, as ``repeated`` gives them."""
    texts = common.texts(docs, [key], text_col).toDF("k", "__text").select("k", F.xxhash64("__text").alias("th"), "__text")
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("h", "c", "start", "end")] + texts.drop("__text").schema.fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 2):
                got = [long_runs(t.as_py(), run, long) for t in part.column(2)]
                keys = part.select([0, 1]).take(pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), pa.int64()))
                columns = [pa.array(np.concatenate([g[i] for g in got]).view(np.int64), pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, *keys.columns], names=[f.name for f in schema.fields])

    rows = common.materialize(texts.mapInArrow(find, schema))
    place = F.struct("k", "th", "start")
    # Written before it meets its rows again, so that the join can split a hot key (see repeats.py).
    first = common.materialize(rows.groupBy("h", "c").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h", "c", "lo"))
    return rows.join(first, ["h", "c"]).where(place != F.col("lo")).select("k", "th", "start", "end")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text", run: int = RUN, long: int | None = LONG) -> DataFrame:
    """All columns of ``docs``, the text without later repeated runs, then n_lines and n_deleted; ``long`` null: runs of ``run`` lines only."""
    names = docs.columns
    spans = repeated(docs, line_hashes, run, 1, key, text_col, later=True)
    if long is not None:
        spans = spans.unionByName(repeated_long(docs, run, long, key, text_col))
    found = merged(spans).toDF("__k", "__th", "__spans")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    k, t = f"c{names.index(key)}", f"c{names.index(text_col)}"
    rows = plain.withColumn("th", F.xxhash64(common.text_of(t))).join(found, (F.col("th") == F.col("__th")) & F.col(k).eqNullSafe(F.col("__k")), "left")
    rows = rows.select(*(c for c in plain.columns if c != t), F.col(t).alias("__text"), F.col("__spans"))
    schema = T.StructType([*rows.drop("__text", "__spans").schema.fields, T.StructField(t, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            for part in common.slices(batch, n - 2):
                made = []
                for text, spans in zip(part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist()):
                    got = without(text or "", [(s["start"], s["end"]) for s in spans or ()])
                    made.append((None, 0, 0) if text is None else got)
                yield pa.RecordBatch.from_arrays([*part.columns[: n - 2], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(cut, schema).select(*plain.columns, "n_lines", "n_deleted").toDF(*names, "n_lines", "n_deleted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.pick(common.table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(common.text_of("text"), 256).alias("text_sha256"))


_WINDOWS = " union all ".join(
    f"select r, doc_id, text, p, {n} as size, md5(string_agg(md5(x), '') over (partition by r order by p rows between current row and {n - 1} following)) as g, count(*) over (partition by r order by p rows between current row and {n - 1} following) as n, sum(k) over (partition by r order by p rows between current row and {n - 1} following) as k from lw"
    for n in range(1, RUN + 1)
)
SQL_TEXT = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
a as (select r, doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as q from d),
l as (select *, row_number() over (partition by r order by q) - 1 as p from (select *, trim(line, E' \t\n\r\x0b\x0c') as x from a) where x <> ''),
lw as (select *, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) as k from l),
w as ({_WINDOWS}),
f as (select *, first_value(struct_pack(d := doc_id, t := md5(text), p := p)) over (partition by size, g order by doc_id nulls first, md5(text), p) as first from w where n = size and (size = {RUN} or k >= {LONG})),
c as (select distinct r, unnest(range(p, p + size)) as p from f where first is distinct from struct_pack(d := doc_id, t := md5(text), p := p)),
s as (select a.r, a.q, a.line, l.p, c.p is not null as gone from a left join l on a.r = l.r and a.q = l.q left join c on l.r = c.r and l.p = c.p),
b as (select *, last_value(case when p is not null then gone end ignore nulls) over (partition by r order by q rows between unbounded preceding and current row) as before, first_value(case when p is not null then gone end ignore nulls) over (partition by r order by q rows between current row and unbounded following) as after from s),
k as (select r, coalesce(string_agg(line, chr(10) order by q) filter (not case when p is null then coalesce(before, false) and coalesce(after, false) else gone end), '') as text, count(p) as n_lines, count(*) filter (gone) as n_deleted from b group by r)
select d.doc_id, k.n_lines::bigint as n_lines, k.n_deleted::bigint as n_deleted, sha256(k.text) as text_sha256 from d join k using (r)
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {"op6_line_dedup": SQL_TEXT}
