"""Repositories: which of a repository's files a citation's location names, and the text that counts there.

Files are rows (repo, key, name, title, number, body). A location is matched against names and titles first, without
bodies; the body joins afterwards, once for each distinct (repo, key, location).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeplane import fixed
from citeplane.connectors import DEFAULT, Registry
from citeplane.functions import text
from citeplane.scratch import materialize
from citeplane.sources import payloads


def _titled(location: Column, title: Column) -> Column:
    want, have = F.lower(F.trim(location)), F.lower(F.coalesce(title, F.lit("")))
    return (want != "") & (have != "") & (F.contains(have, want) | F.contains(want, have))


def choose(targets: DataFrame, files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """(repo, key, location, name) for the distinct targets (repo, key, location) that have a file; whole books apart."""
    each = targets.select("repo", "key", "location").distinct()
    # A plain chapter number, the usual location in a large book, meets its chapter by key; the rest meet all of theirs.
    number = F.when(F.col("repo") == "gutenberg", F.regexp_extract("location", rf"(?s)\A\s*{fixed.CHAPTER_NUMBER}\s*\z", 1).try_cast("int"))
    numbered = each.withColumn("number", number).where("number is not null")
    by_number = materialize(numbered.join(files.select("repo", "key", "number", "name"), ["repo", "key", "number"]).groupBy("repo", "key", "location").agg(F.min("name").alias("name")))
    each = each.join(by_number, ["repo", "key", "location"], "left_anti")
    rows = each.join(files.select("repo", "key", "name", "title", "number"), ["repo", "key"]).withColumn("__titled", _titled(F.col("location"), F.col("title")))
    count = rows.where("__titled").groupBy("repo", "key", "location").agg(F.count("*").alias("__m"))
    rows = rows.join(count, ["repo", "key", "location"], "left")
    only = F.when(F.col("__titled"), F.col("__m"))
    rank = registry.rank_of(F.col("repo"), F.col("location"), F.col("name"), F.col("title"), F.col("number"), only)
    best = rows.withColumn("__rank", rank).where("__rank >= 0").groupBy("repo", "key", "location")
    return best.agg(F.min_by("name", F.struct("__rank", F.coalesce("number", F.lit(0)), "name")).alias("name")).unionByName(by_number)


def books(files: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """(repo, key, body): the chapters of each book in order; none if a chapter lacks its text."""
    chapters = files.where(F.col("repo").isin(*registry.books)).groupBy("repo", "key")
    return chapters.agg(F.sort_array(F.collect_list(F.struct("number", text.strip_leading_headers(F.col("body")).alias("t")))).alias("c"), F.count("*").alias("n"), F.count("body").alias("m")).where("n = m").select("repo", "key", F.array_join(F.transform("c", lambda x: x["t"]), "\n\n").alias("body"))


def documents(targets: DataFrame, files: DataFrame, crawls: DataFrame, crawl: bool = True, registry: Registry = DEFAULT) -> DataFrame:
    """(doc_key, body, miss, miss_reason) of the repository targets (doc_key, repo, key, location)."""
    each = targets.select("doc_key", "repo", "key", "location").distinct()
    chosen = choose(each, files, registry).join(files.select("repo", "key", "name", F.col("body").alias("__body")), ["repo", "key", "name"])
    whole = each.where(F.col("repo").isin(*registry.books) & (F.trim("location") == "")).select("repo", "key", "location").distinct().join(books(files, registry), ["repo", "key"]).select("repo", "key", "location", F.col("body").alias("__body"))
    found = chosen.select("repo", "key", "location", "__body").unionByName(whole)
    cached = files.select("repo", "key").distinct().withColumn("__cached", F.lit(True))
    outcome = crawls.withColumn("__r", F.row_number().over(Window.partitionBy("repo", "key").orderBy("status", "reason"))).where("__r = 1").select("repo", "key", F.col("status").alias("__status"), F.col("reason").alias("__reason"))
    rows = each.join(found, ["repo", "key", "location"], "left").join(cached, ["repo", "key"], "left").join(outcome, ["repo", "key"], "left")
    at = F.col("location")
    body = registry.text_of(F.col("repo"), F.col("__body"), at)
    name = F.concat(F.col("repo"), F.lit(": "), F.col("key"))
    bad = F.col("__status").isin("not_found", "unavailable") & F.col("__cached").isNull()
    miss = F.when(bad, F.col("__status")).when(F.col("__body").isNull(), "no_file").when(F.col("__body") == "", "empty")
    off = F.lit(" is not cached, and crawling is off") if not crawl else F.lit(" is not cached")
    reason = F.when(bad, F.concat(name, F.lit(" "), F.coalesce("__reason", F.col("__status")))).when(F.col("__body").isNull() & F.col("__cached").isNotNull(), F.concat(name, F.lit(' holds nothing for location "'), at, F.lit('"'))).when(F.col("__body").isNull(), F.concat(name, off)).when(F.col("__body") == "", F.concat(name, F.lit(" is cached but empty")))
    return payloads.rendered(rows.select("doc_key", "repo", "location", body.alias("body"), miss.alias("miss"), reason.alias("miss_reason")), registry.rendered)
