"""Extraction: what each distinct target of each document holds, with a document parsed once for many targets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeplane.operators import content
from citeplane.operators.outline import squeeze
from citeplane.scratch import materialize

#: Targets of one document that one row carries; a document with more is parsed once for each lot of them.
LOT = 256
KEYS = ("doc_key", "format", "locator", "anchor")


def lots(targets: DataFrame) -> DataFrame:
    """(doc_key, url, targets): distinct targets by document, in lots of about ``LOT``."""
    each = targets.groupBy(*KEYS).agg(F.min("url").alias("url"))
    # Both are written before they meet: a document of many targets is split, and its lots are dealt out.
    each = materialize(each)
    size = materialize(each.groupBy("doc_key").agg(F.count("*").alias("__n")).withColumnRenamed("doc_key", "__k"))
    each = each.join(size, F.col("doc_key") == F.col("__k")).withColumn("__lot", F.pmod(F.xxhash64("format", "locator", "anchor"), F.ceil(F.col("__n") / LOT)))
    return each.groupBy("doc_key", "__lot").agg(F.collect_list(F.struct("format", "locator", "anchor", "url")).alias("targets")).drop("__lot")


def extract(targets: DataFrame, documents: DataFrame, formats: tuple[content.Format, ...] = ()) -> DataFrame:
    """Outcomes (doc_key, format, locator, anchor, text, status, reason) of ``targets`` (with url) in ``documents``
    (doc_key, body, miss): ``miss`` is a status and ``miss_reason`` a reason where the document isn't to be had.
    Where documents have a ``stamp``, outcomes have it, so that texts needn't meet their documents once more."""
    stamp = ("stamp",) if "stamp" in documents.columns else ()
    names = (*KEYS, "text", "status", "reason", *stamp)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    wanted = lots(targets)
    rows = wanted.join(documents.withColumnRenamed("doc_key", "__d"), F.col("doc_key") == F.col("__d"), "left").select("doc_key", "body", "miss", "miss_reason", "targets", *stamp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, body, miss, why, listed, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                doc = content.Document(body, formats) if body else None  # one tree at a time: the one before it is let go
                for t in listed:
                    if miss:
                        got = content.Outcome("", miss, why or "")
                    else:
                        got = content.load(doc, t["url"], t["format"], t["locator"], t["anchor"])
                    out.append((key, t["format"], t["locator"], t["anchor"], squeeze(got.text), got.status, got.reason, *rest))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(len(names))], names=[*names])

    return rows.mapInArrow(run, schema)


def stamped(documents: DataFrame) -> DataFrame:
    """``documents`` with ``stamp``, which is another as soon as the body or the reason for having none is another."""
    return documents.withColumn("stamp", F.sha2(F.concat_ws("\0", F.coalesce("body", F.lit("")), F.coalesce("miss", F.lit("")), F.coalesce("miss_reason", F.lit(""))), 256))


def extract_new(targets: DataFrame, documents: DataFrame, known: DataFrame | None, formats: tuple[content.Format, ...] = ()) -> DataFrame:
    """Outcomes as ``extract`` gives them, with ``stamp``; those that ``known``, outcomes of a run before, has for the
    same target and the same document are taken from there, and only the rest is parsed."""
    documents = materialize(stamped(documents))
    if known is not None:
        stamps = documents.groupBy(F.col("doc_key").alias("__d")).agg(F.min("stamp").alias("stamp"))
        each = materialize(targets.groupBy(*KEYS).agg(F.min("url").alias("url")).join(materialize(stamps), F.col("doc_key") == F.col("__d"), "left").drop("__d"))
        had = known.select(*(F.col(k).alias(f"__{k}") for k in KEYS), "text", "status", "reason", F.col("stamp").alias("__s")).dropDuplicates([f"__{k}" for k in KEYS])
        same = (F.col("doc_key") == F.col("__doc_key")) & (F.col("stamp") == F.col("__s"))
        for k in KEYS[1:]:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        kept = each.join(had, same).select(*KEYS, "text", "status", "reason", "stamp")
        targets = each.join(had, same, "left_anti").select(*KEYS, "url")
        # Only documents that something new is asked of are read again.
        documents = documents.join(targets.select(F.col("doc_key").alias("__k")).distinct(), F.col("doc_key") == F.col("__k"), "left_semi")
    got = extract(targets, documents, formats)
    return got if known is None else got.unionByName(kept)
