"""Operator 5, quality rules with adaptive thresholds.

Measures of a document are taken in one pass over its text. Of the documents that the base rules keep, for each language and source a mergeable quantile sketch
of each rate is kept: a histogram of integer buckets whose width is at most 1/64 of their value, so sketches merge by
adding counts and a quantile is right within 1.6 %. They are aggregations by (lang, source, measure, bucket), which are
pre-aggregated by task, so a hot source moves some hundred rows for each task and not its documents. A group's sketch is blended with
its language's, scaled to ``PRIOR`` documents: the fewer documents a group has, the more its language decides, and no
count switches from one to the other. Fences stand at a quantile of the blended sketch, ``spread`` times the distance to
another quantile away, with ``slack`` added, as rates that are mostly zero have no distance; for the length of words
there is one on each side. A group's fence is no further from its median than its language's is from the language's, so
that a source's own level counts, but one half full of junk can't lift its fence. Documents meet thresholds in a join that can split a hot source.

Defined results: a null or blank text has no words and fails the base rules; a null lang or source is a group of its
own; repeated rows are measured and judged each; texts are measured whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5


@dataclass(frozen=True)
class Fence:
    """At quantile ``at``, ``spread`` times the distance from ``of`` further out, and ``slack`` thousandths more."""

    at: int
    of: int
    spread: int
    slack: int


#: Upper and lower fences by rate.
UPPER = {"symbols": Fence(75, 25, 3, 100), "dup_lines": Fence(99, 50, 1, 50), "repeats": Fence(99, 50, 1, 20), "word_length": Fence(75, 25, 3, 250)}
LOWER = {"word_length": Fence(25, 75, 3, 250)}
#: Documents that a group's language counts as in its sketch.
PRIOR = 100
QUANTILES = tuple(sorted({50, *(q for f in (*UPPER.values(), *LOWER.values()) for q in (f.at, f.of))}))
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def measures_of(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the number of lines with a word."""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    repeat = 0
    if n >= WINDOW:
        # Words as numbers, windows as rows of them that are told apart by sorting: some 60 bytes a word, however long the text.
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=">u4", count=n)
        if len(number) < n:
            rows = np.frombuffer(np.lib.stride_tricks.sliding_window_view(ids, WINDOW).tobytes(), dtype=f"S{4 * WINDOW}")
            order = np.argsort(rows, kind="stable")
            same = rows[order][1:] == rows[order][:-1]
            found = np.zeros(len(rows) + WINDOW, dtype=np.int64)
            at = order[np.append(same, False) | np.concatenate([[False], same])]
            np.add.at(found, at, 1)
            np.add.at(found, at + WINDOW, -1)
            repeat = int((np.cumsum(found) > 0).sum())
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat, len(lines)


def measured(docs: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """The named columns, the five measures, and n_lines, all long."""
    rows = common.texts(docs, names, text_col)
    added = [*MEASURES, "n_lines"]
    schema = T.StructType([*rows.drop("__text").schema.fields, *(T.StructField(m, T.LongType()) for m in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, batch.num_columns - 1):
                got = [measures_of(t.as_py()) for t in part.column(part.num_columns - 1)]
                columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


#: In thousandths, as SQL of integers, so that every engine gets the same buckets.
RATES = {
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
}
#: Bucket of a rate v: itself below 64; else its 7 leading bits, by their binary exponent.
BUCKET = "if(v < 64, v, 64 * (length(bin(v)) - 7) + shiftright(v, length(bin(v)) - 7))"
#: The least value of a bucket.
LOWEST = "if(bucket < 128, bucket, shiftleft(64 + bucket % 64, cast(bucket div 64 - 1 as int)))"


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, bucket, n): mergeable by adding n."""
    pairs = F.array(*(F.struct(F.lit(k).alias("rate"), F.expr(v).alias("v")) for k, v in RATES.items()))
    return rows.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.rate", "x.v").withColumn("bucket", F.expr(BUCKET)).groupBy(*keys, "rate", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], which: tuple[int, ...] = QUANTILES) -> DataFrame:
    """(keys, rate, q<N> for each of ``which``): the lower ends of the buckets that hold them. A group has some hundred buckets."""
    held = sketch.groupBy(*keys, "rate").agg(F.sum("n").cast("decimal(38,0)").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", F.col("n").cast("decimal(30,0)").alias("n")))).alias("b"))
    walk = lambda share: F.expr(f"aggregate(b, named_struct('upto', cast(0 as decimal(38,0)), 'at', cast(null as bigint)), (a, x) -> named_struct('upto', cast(a.upto + x.n as decimal(38,0)), 'at', coalesce(a.at, if((a.upto + x.n) * 100 >= total * {share}, x.bucket, null)))).at")
    for q in which:
        held = held.withColumn("bucket", walk(q)).withColumn(f"q{q}", F.expr(LOWEST)).drop("bucket")
    return held.drop("b", "total")


def blended(own: DataFrame, wide: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of groups with their language's added as ``PRIOR`` documents, all scaled by the language's number: whole numbers."""
    total = lambda df, keys: df.groupBy(*keys, "rate").agg(F.sum("n").cast("decimal(18,0)").alias("total"))
    first = group[0]
    of_wide = common.materialize(total(wide, group[:1]).select(F.col(first).alias("__g"), F.col("rate").alias("__r"), F.col("total").alias("__total")))
    same = F.col(first).eqNullSafe(F.col("__g")) & (F.col("rate") == F.col("__r"))
    mine = own.join(of_wide, same).select(*group, "rate", "bucket", (F.col("n") * F.col("__total")).cast("decimal(30,0)").alias("n"))
    groups = common.materialize(own.select(*group, "rate").distinct())
    theirs = groups.join(wide.select(F.col(first).alias("__g"), F.col("rate").alias("__r"), "bucket", "n"), same).select(*group, "rate", "bucket", (F.lit(PRIOR) * F.col("n")).cast("decimal(30,0)").alias("n"))
    return mine.unionByName(theirs).groupBy(*group, "rate", "bucket").agg(F.sum("n").cast("decimal(30,0)").alias("n"))


def fences(of: DataFrame, keys: list[str], middle: str, upper: str, lower: str) -> DataFrame:
    """(keys, rate, and the median and fences by these names) from quantiles; null where a rate has no such fence."""

    def one(which: dict[str, Fence], sign: str):
        out = F.lit(None).cast("long")
        for rate, f in which.items():
            out = F.when(F.col("rate") == rate, F.expr(f"q{f.at} + {f.spread} * (q{f.at} - q{f.of}) {sign} {f.slack}")).otherwise(out)
        return out

    return of.select(*keys, "rate", F.col("q50").alias(middle), one(UPPER, "+").alias(upper), one(LOWER, "-").alias(lower))


def thresholds(rows: DataFrame, group: list[str] = ["lang", "source"]) -> DataFrame:  # noqa: B006
    """``group`` and, for each rate, most_<rate> and least_<rate>."""
    fine = common.materialize(sketches(rows, group))
    coarse = common.materialize(fine.groupBy(group[0], "rate", "bucket").agg(F.sum("n").alias("n")))
    own = fences(quantiles(blended(fine, coarse, group), group), group, "m", "u", "l")
    wide = fences(quantiles(coarse, group[:1]), group[:1], "wm", "wu", "wl").withColumnsRenamed({group[0]: "__g", "rate": "__r"})
    both = own.join(wide, F.col(group[0]).eqNullSafe(F.col("__g")) & (F.col("rate") == F.col("__r")))
    both = both.select(*group, "rate", F.least("u", F.expr("m + wu - wm")).alias("most"), F.greatest("l", F.expr("m + wl - wm")).alias("least"))
    return both.groupBy(*group).agg(*(F.max(F.when(F.col("rate") == k, F.col(m))).alias(f"{m}_{k}") for k in RATES for m in ("most", "least")))


def judged(docs: DataFrame, names: list[str], group: list[str] = ["lang", "source"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """``names``, the measures, base_failed and kept."""
    both = list(dict.fromkeys([*names, *group]))
    rows = common.materialize(measured(docs, both, text_col))
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    limits = thresholds(rows.where(~base), group)
    limits = limits.toDF(*(f"__{c}" for c in limits.columns))
    same = None
    for g in group:
        on = rows[g].eqNullSafe(limits[f"__{g}"])
        same = on if same is None else same & on
    fits = None
    for k, v in RATES.items():
        one = F.expr(f"({v}) <= __most_{k}" + (f" and ({v}) >= __least_{k}" if k in LOWER else ""))
        fits = one if fits is None else fits & one
    return rows.join(limits, same, "left").select(*names, *MEASURES, base.alias("base_failed"), (~base & F.coalesce(fits, F.lit(False))).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"), ["doc_id"])


_SPACE = r"[\x20\x09-\x0D]"
SQL_TEXT = rf"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, p, array_to_string(w[p:p + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as p from w where len(w) >= 5)),
x as (select r, count(distinct q) as n from (select r, unnest(range(p, p + 5)) as q from (select r, p, count(*) over (partition by r, g) as k from g) where k > 1) group by r),
m as materialized (select doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(x.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines from w left join x using (r)),
v as (select lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) as rate, unnest([1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1), 1000 * word_chars // greatest(n_words, 1)]) as v from m where not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)),
b as materialized (select lang, source, rate, case when v < 64 then v else (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) end as low, count(*)::hugeint as n from v group by all),
lb as materialized (select lang, rate, low, sum(n)::hugeint as n from b group by all),
lt as (select lang, rate, sum(n)::hugeint as total from lb group by all),
gr as (select distinct lang, source, rate from b),
c as (select lang, null as source, true as wide, rate, low, n from lb
 union all select lang, source, false, rate, low, sum(n)::hugeint from (select b.lang, b.source, b.rate, b.low, b.n * lt.total as n from b join lt on b.lang is not distinct from lt.lang and b.rate = lt.rate
  union all select gr.lang, gr.source, gr.rate, lb.low, {PRIOR} * lb.n from gr join lb on gr.lang is not distinct from lb.lang and gr.rate = lb.rate) group by all),
s as (select *, sum(n) over (partition by lang, source, wide, rate order by low) as upto, sum(n) over (partition by lang, source, wide, rate) as total from c),
q as (select lang, source, wide, rate, {", ".join(f"min(low) filter (upto * 100 >= total * {n}) as q{n}" for n in QUANTILES)} from s group by all),
e as (select lang, source, wide, rate, q50 as m, case rate {" ".join(f"when '{k}' then q{f.at} + {f.spread} * (q{f.at} - q{f.of}) + {f.slack}" for k, f in UPPER.items())} end as u, case rate {" ".join(f"when '{k}' then q{f.at} + {f.spread} * (q{f.at} - q{f.of}) - {f.slack}" for k, f in LOWER.items())} end as l from q),
f as (select o.lang, o.source, o.rate, least(o.u, o.m + a.u - a.m) as u, greatest(o.l, o.m + a.l - a.m) as l from e o join e a on o.lang is not distinct from a.lang and o.rate = a.rate and a.wide and not o.wide),
p as (select lang, source, {", ".join(f"max(u) filter (rate = '{k}') as u_{k}, max(l) filter (rate = '{k}') as l_{k}" for k in UPPER)} from f group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce(1000 * n_symbols // greatest(n_words, 1) <= u_symbols and 1000 * n_dup_lines // greatest(n_lines, 1) <= u_dup_lines and 1000 * n_repeat_words // greatest(n_words, 1) <= u_repeats and 1000 * word_chars // greatest(n_words, 1) between l_word_length and u_word_length, false) as kept
from m left join p on m.lang is not distinct from p.lang and m.source is not distinct from p.source
"""

QUERIES = {"op5_quality": op5_quality}
SQL = {"op5_quality": SQL_TEXT}
