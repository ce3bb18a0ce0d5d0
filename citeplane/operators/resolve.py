"""Resolution: from citations to the document and the target in it that each one names.

Joins on keys throughout; a document that many citations name stays many rows until the join that fetches its text, which
can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeplane.connectors import DEFAULT, Registry
from citeplane.functions import formats, text, urls
from citeplane.scratch import materialize

#: A source without a URL has that of the nearest of so many ancestors.
ANCESTORS = 3


def source_urls(sources: DataFrame) -> DataFrame:
    """``sources`` with ``resolved_url``: its own URL or the nearest ancestor's; part_of holds the parent's source_id."""
    up = sources.groupBy("source_id").agg(F.min_by("url", F.coalesce("label", F.lit(""))).alias("u"), F.min_by("part_of", F.coalesce("label", F.lit(""))).alias("p"))
    # Written before children meet their parents, so that the joins are of plain exchanges and can split a parent of many.
    up = materialize(up)
    out = sources.withColumn("resolved_url", text.blank_to_null(F.col("url"))).withColumn("__p", F.col("part_of"))
    for _ in range(ANCESTORS):
        step = up.select(F.col("source_id").alias("__id"), text.blank_to_null(F.col("u")).alias("__u"), F.col("p").alias("__next"))
        # A source with a URL walks no further: its key is null and meets nothing.
        out = out.withColumn("__p", F.when(F.col("resolved_url").isNull(), F.col("__p"))).join(step, F.col("__p") == F.col("__id"), "left")
        out = out.withColumn("resolved_url", F.coalesce("resolved_url", "__u")).withColumn("__p", F.col("__next")).drop("__id", "__u", "__next")
    return out.drop("__p")


def targeting(section: Column, css: Column, lines: Column, kind: Column) -> tuple[Column, Column]:
    """(format, locator): a section before a selector before lines; empty counts as absent."""
    section = text.blank_to_null(section)
    locator = F.coalesce(section, text.blank_to_null(css), text.blank_to_null(lines))
    return F.when(section.isNotNull(), "section").otherwise(F.coalesce(formats.normalize_mime(kind), F.lit(""))), locator


def _route(rows: DataFrame, found: Column, miss: Column, fetcher: bool, crawlers: tuple[str, ...] | None, registry: Registry) -> DataFrame:
    """Adds who serves the URL: the repository that claims it, or the fetcher, with the reason where that stands in."""
    # Inside a lambda the many patterns are evaluated once a row and stay out of the generated code.
    claim = F.transform(F.array("url"), lambda u: F.struct(registry.claimed_by(u).alias("claim"), registry.key_of(u).alias("key")))[0]
    rows = rows.withColumn("__c", claim).withColumn("__claim", F.col("__c.claim")).withColumn("key", F.col("__c.key")).drop("__c").withColumn("anchor", F.coalesce(urls.url_anchor(F.col("url")), F.lit("")))
    reason = F.when(F.col("__claim").isNotNull() & F.col("key").isNull(), "this URL yields no key for it")
    if crawlers is not None:
        reason = reason.when(F.col("__claim").isNotNull() & ~F.col("__claim").isin(*crawlers), "it has no crawler and the document is not cached")
    rows = rows.withColumn("fallback_reason", reason)
    repo = F.when(found & F.col("fallback_reason").isNull(), F.col("__claim"))
    rows = rows.withColumn("repo", repo)
    status = F.when(~found, miss).when(F.col("repo").isNotNull() | F.lit(fetcher), "resolved").otherwise("no_module")
    rows = rows.withColumn("status", status).withColumn("kind", F.when(F.col("status") != "resolved", "none").when(F.col("repo").isNotNull(), "repo").otherwise("fetcher"))
    rows = rows.withColumn("fallback_from", F.when((F.col("kind") == "fetcher") & F.col("fallback_reason").isNotNull(), F.col("__claim")))
    rows = rows.withColumn("key", F.when(F.col("kind") == "repo", F.col("key"))).withColumn("fallback_reason", F.when(F.col("fallback_from").isNotNull(), F.col("fallback_reason")))
    return rows.withColumn("doc_key", F.when(F.col("kind") != "none", urls.document_key(F.col("url"), F.col("repo"), F.col("key"), F.col("location")))).drop("__claim")


RESOLVED = ("urn", "label", "source", "url", "location", "snippet", "status", "kind", "repo", "key", "format", "locator", "anchor", "fallback_from", "fallback_reason", "doc_key")


def chain(fragments: DataFrame, sources: DataFrame, fetcher: bool = True, crawlers: tuple[str, ...] | None = None, registry: Registry = DEFAULT) -> DataFrame:
    """Fragments with the source, the URL and the target that they name."""
    known = source_urls(sources).select(F.col("source_id").alias("__sid"), F.col("label").alias("source"), F.col("type").alias("__type"), F.col("resolved_url").alias("url"))
    rows = fragments.join(materialize(known), F.col("source_id") == F.col("__sid"), "left")
    kind, locator = targeting(F.col("section"), F.col("selector"), F.col("lines"), F.col("__type"))
    rows = rows.withColumn("format", kind).withColumn("locator", locator).withColumn("location", F.coalesce("location", F.lit("")))
    rows = _route(rows, F.col("url").isNotNull(), F.when(F.col("__sid").isNull(), "no_source").otherwise("no_url"), fetcher, crawlers, registry)
    return rows.select(*RESOLVED)


def direct(terms: DataFrame, fetcher: bool = True, crawlers: tuple[str, ...] | None = None, registry: Registry = DEFAULT) -> DataFrame:
    """Terms, which name their URL themselves."""
    kind, locator = targeting(F.col("section"), F.col("selector"), F.col("lines"), F.col("type"))
    rows = terms.withColumn("url", text.blank_to_null(F.col("url"))).withColumn("source", F.lit("")).withColumn("format", kind).withColumn("locator", locator).withColumn("location", F.coalesce("location", F.lit("")))
    return _route(rows, F.col("url").isNotNull(), F.lit("no_url"), fetcher, crawlers, registry).select(*RESOLVED)
