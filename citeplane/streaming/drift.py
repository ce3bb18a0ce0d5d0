"""Re-verification as documents change: a stream of fetched versions, and the citations of each that changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeplane.functions import urls
from citeplane.operators.verify import Citations, Options, Report, World, check
from citeplane.scratch import scope


def versions(fetched: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream (url, body, ts) without repeats of a version: one row for each document and body within the delay."""
    rows = fetched.withColumn("doc_url", urls.document_url(F.col("url"))).withColumn("body_hash", F.sha2(F.coalesce("body", F.lit("")), 256))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_url", "body_hash"])


def changes(seen: DataFrame) -> DataFrame:
    """(doc_url, body_hash, previous, n): each version that differs from the one before it, with how many came so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        for batch in batches:
            for h in batch.sort_values("ts")["body_hash"]:
                if h != last:
                    out.append((key[0], h, last, n + 1))
                    last, n = h, n + 1
        state.update((last, n))
        yield pd.DataFrame(out, columns=["doc_url", "body_hash", "previous", "n"])

    rows = seen.select("doc_url", "body_hash", "ts").groupBy("doc_url")
    return rows.applyInPandasWithState(step, "doc_url string, body_hash string, previous string, n long", "last string, n long", "append", "NoTimeout")


def reverify(fetched: DataFrame, citations: Citations, sink: Callable[[Report, int], None], checkpoint: str, options: Options = Options(), delay: str = "1 hour"):  # noqa: B008
    """Starts a query that checks, in each micro-batch, the citations of the documents in it, and hands on the report, to be used there and then."""

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc_url").agg(F.max_by("body", "ts").alias("body")).select(F.col("doc_url").alias("url"), "body").persist()
        named = citations.sources.join(latest.select(F.col("url").alias("__u")), urls.document_url(F.col("url")) == F.col("__u"), "left_semi")
        touched = Citations(citations.sources, citations.fragments.join(named.select("source_id"), "source_id", "left_semi"), None, citations.cite_sites)
        with scope():  # what a batch has written goes when its report is used, however long the stream runs
            sink(check(touched, World(latest), options), number)
        latest.unpersist()

    return versions(fetched, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
