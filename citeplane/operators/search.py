"""Corpus-wide search: which documents hold which quotes, word for word after white space is collapsed.

A quote of three words or more that a document holds has its inner words there as whole words, so some of them in a row
are equal on both sides: an equi-join on such a gram, of up to ``GRAM`` words, finds candidates and the containment test
decides. Of a quote's inner grams one is taken, of least hash. Quotes of less than ``SENT_BYTES`` are sent to all tasks,
so that documents' grams are filtered where they arise and only candidates move; beyond that the grams meet in a join,
which can split a hot one. Quotes of one or two words have no inner word: those are tested against
each document, a checked number of bytes at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeplane.scratch import materialize

GRAM = 4
#: Bytes of short quotes, and of those with grams, that are sent to every task at once.
BLOCK_BYTES, SENT_BYTES = 8 << 20, 32 << 20


def _nested(docs: DataFrame, quotes: DataFrame, doc_id: str, quote_id: str) -> DataFrame | None:
    """Containment by loops over blocks of quotes, each block of a checked size; null where there is no quote."""
    size = quotes.agg(F.sum(F.octet_length("quote") + 64)).first()[0] or 0
    blocks, out = math.ceil(size / BLOCK_BYTES), None
    for b in range(blocks):
        block = F.broadcast(quotes.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == b))
        one = docs.join(block, F.contains("body", "quote")).select(doc_id, quote_id)
        out = one if out is None else out.unionByName(one)
    return out


def _grams(words: str, n: int) -> Column:
    """Hashes of ``n`` words in a row; none of a text with fewer."""
    return F.expr(f"if(size({words}) < {n}, array(), transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64({n}, slice({words}, i, {n}))))")


def containment(docs: DataFrame, quotes: DataFrame, doc_id: str = "doc_id", quote_id: str = "item_id", blocked: bool = True, gram: int = GRAM, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(doc_id, quote_id) for each document (doc_id, body) that holds a quote (quote_id, quote), both normalized."""
    docs, quotes = docs.select(doc_id, "body"), quotes.where("quote <> ''").select(quote_id, "quote")
    none = docs.join(quotes.limit(0), F.lit(True)).select(doc_id, quote_id).limit(0)
    if not blocked:
        return _nested(docs, quotes, doc_id, quote_id) or none
    split = quotes.withColumn("w", F.split("quote", " "))
    inner = split.where(F.size("w") >= 3).withColumn("w", F.slice("w", 2, F.size("w") - 2)).withColumn("n", F.least(F.size("w"), F.lit(gram)))
    of_size = F.array_min(_grams("w", 1))
    for n in range(2, gram + 1):
        of_size = F.when(F.col("n") == n, F.array_min(_grams("w", n))).otherwise(of_size)
    keyed = materialize(inner.select(quote_id, "quote", "n", of_size.alias("g")))
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]  # at most ``gram`` rows
    found = None
    if sizes:
        held = F.array_distinct(F.concat(*(_grams("w", n) for n in sizes)))
        each = docs.withColumn("w", F.split("body", " ")).select(F.col(doc_id).alias("__d"), F.explode(held).alias("g"))
        few = keyed.agg(F.sum(F.octet_length("quote") + 64)).first()[0] <= sent_bytes
        met = each.join(F.broadcast(keyed) if few else keyed, "g").select("__d", quote_id, "quote").distinct()
        found = docs.join(met, F.col(doc_id).eqNullSafe(F.col("__d"))).where(F.contains("body", "quote")).select(doc_id, quote_id)
    short = _nested(docs, split.where(F.size("w") < 3).drop("w"), doc_id, quote_id)
    parts = [x for x in (found, short) if x is not None]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else none

