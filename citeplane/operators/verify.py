"""Verification: from citations and documents to verdicts, findings and checks, as one plan.

Every fragment counts in each chain check, whatever became of it. Only failures are explained, and they are filtered out
before that stage, so the rest never pays for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeplane import schemas
from citeplane.connectors import DEFAULT, Registry
from citeplane.functions import text, urls
from citeplane.operators import content, extract, locate, repositories, resolve
from citeplane.scratch import materialize
from citeplane.session import dealt

CACHE, CONTENT, SNIPPET = "Fragments: cache resolution", "Fragments: content extraction", "Fragments: snippet verified"
TERMS, URLS, REPOS, SUPERSEDED, SHAPE = "Terms", "Source URLs", "Repo documents", "Document supersession", "Citations shape"
ORDER = (CACHE, CONTENT, SNIPPET, TERMS, URLS, REPOS, SUPERSEDED, SHAPE)
NOT_FOUND = "snippet not found in extracted content"


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


@dataclass
class Citations:
    sources: DataFrame
    fragments: DataFrame
    terms: DataFrame | None = None
    cite_sites: DataFrame | None = None


@dataclass
class World:
    """What is known of the outside. No row means that nothing is known, which is never taken as a good sign."""

    documents: DataFrame
    fetches: DataFrame | None = None
    files: DataFrame | None = None
    crawls: DataFrame | None = None
    supersessions: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    strict_redirects: bool = False
    strict_repos: bool = False
    strict_supersession: bool = False
    crawl: bool = True
    fetcher: bool = True
    crawlers: tuple[str, ...] | None = None
    #: Repositories that claim URLs, and formats asked before those that come along.
    registry: Registry = DEFAULT
    formats: tuple[content.Format, ...] = ()
    #: Further checks by name: each gets the citations, the world and the resolved targets, and returns rows with ok and,
    #: for those that failed, severity, source, label, url, urn and reason; columns that it leaves out are empty.
    custom: tuple[tuple[str, Callable[[Citations, World, DataFrame], DataFrame]], ...] = ()


@dataclass
class Report:
    checks: DataFrame
    findings: DataFrame
    verdicts: DataFrame
    resolved: DataFrame = field(repr=False, default=None)
    #: What each target held, with its document's stamp: ``known`` of the next run.
    outcomes: DataFrame = field(repr=False, default=None)


def outcomes(resolved: DataFrame, world: World, options: Options, known: DataFrame | None = None) -> DataFrame:
    """(doc_key, format, locator, anchor, text, status, reason, stamp) of every distinct target."""
    spark = resolved.sparkSession
    found = resolved.where("status = 'resolved'")
    fetched = world.documents.groupBy(urls.document_url(F.col("url")).alias("__u")).agg(F.min("body").alias("body"))
    pages = fetched.select(F.concat(F.lit("url:"), F.col("__u")).alias("doc_key"), "body", F.lit(None).cast("string").alias("miss"), F.lit(None).cast("string").alias("miss_reason"))
    files = world.files if world.files is not None else _none(spark, schemas.REPO_FILES)
    crawls = world.crawls if world.crawls is not None else _none(spark, schemas.CRAWLS)
    held = repositories.documents(found.where("kind = 'repo'"), files, crawls, options.crawl, options.registry)
    return extract.extract_new(found.select(*extract.KEYS, "url"), pages.unionByName(held), known, options.formats)


def _failed(check: str, ord_: str, reason: Column, severity: str = "failure", item: Column | None = None, source: Column | None = None, urn: Column | None = None) -> list[Column]:
    named = F.coalesce(text.blank_to_null(F.col("source")), F.lit("(no source)")) if source is None else source
    label = F.coalesce(text.blank_to_null(F.col("label")), text.local_name(F.col("urn"))) if item is None else item
    url = F.coalesce("url", F.lit(""))
    return [F.lit(check).alias("check"), F.lit(severity).alias("severity"), named.alias("source"), label.alias("label"), url.alias("url"), (F.col("urn") if urn is None else urn).alias("urn"), reason.alias("reason"), F.col(ord_).alias("ord")]


def chain_verdicts(resolved: DataFrame, got: DataFrame) -> DataFrame:
    """``resolved`` with the reason of failure in each chain check (null: passed), quote, text and its target's status."""
    got = got.select(*(F.col(k).alias(f"__{k}") for k in extract.KEYS), "text", F.col("status").alias("outcome"), F.col("reason").alias("why"))
    same = F.col("doc_key") == F.col("__doc_key")
    for k in extract.KEYS[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = resolved.join(got, same, "left").drop(*(f"__{k}" for k in extract.KEYS))
    place = F.concat(F.lit('"'), "location", F.lit('" -> '))
    ok, n = F.col("status") == "resolved", F.length("text")
    empty = F.when(F.col("outcome") != "ok", F.col("why")).otherwise(F.concat(F.lit("empty extraction ("), n.cast("string"), F.lit(" chars)")))
    rows = rows.withColumn("quote", text.quote_of(F.col("snippet")))
    size = F.length("quote").cast("string")
    short = F.concat(F.lit("snippet is too short to be evidence ("), size, F.lit(f" chars without its ellipsis, white space collapsed; {text.MIN_EVIDENCE} is the least)"))
    return rows.select(
        "*",
        F.when(~ok, F.concat(place, "status")).alias("fail_cache"),
        F.when(~ok, F.concat(place, F.lit("no cache"))).when(n < text.MIN_EVIDENCE, F.concat(place, empty)).alias("fail_content"),
        F.when(text.normalize_ws(F.coalesce("snippet", F.lit(""))) == "", "no snippet: the fragment quotes nothing, and nothing can be verified")
        .when(F.length("quote") < text.MIN_EVIDENCE, short)
        .when(~ok, "cache not resolved for verification")
        .when(F.col("outcome") != "ok", F.coalesce(text.blank_to_null(F.col("why")), F.lit("source unavailable")))
        .when(~F.contains(F.col("text"), F.col("quote")), NOT_FOUND)
        .alias("fail_snippet"),
    )


def _for_hints(judged: DataFrame, fail: str) -> DataFrame:
    """``judged`` with texts only where a hint is looked for in them: the others aren't written and read again."""
    return judged.withColumn("text", F.when(F.col(fail) == NOT_FOUND, F.col("text")))


def _explained(failures: DataFrame) -> DataFrame:
    """(check, urn, hint) of the failures whose quote wasn't found."""
    return locate.diagnose(dealt(failures.select("check", "urn", "quote", "text", "where")), ["check", "urn"])


def _first(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of the rows with equal keys the first one by ord."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "ord").alias("x"), F.min("ord").alias("ord")).select(*keys, "x.*", "ord")


def redirect_check(resolved: DataFrame, fetches: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(rows of the check with ok, findings): fetched URLs as written, first of each."""
    rows = _first(resolved.where("kind = 'fetcher' and url is not null"), ["url"], ["source", "label", "urn"])
    known = fetches.groupBy(F.col("url").alias("__u")).agg(F.min(F.struct("final_url", "chain")).alias("f"))
    rows = rows.join(known, urls.document_url(F.col("url")) == F.col("__u"), "left")
    hops = F.array_join(F.transform("f.chain", lambda h: F.concat_ws(" ", h["status"].cast("string"), h["url"])), " -> ")
    moved = F.concat(F.lit("moved: "), hops, F.lit(" -> "), F.col("f.final_url"), F.lit(". What was verified is the destination, not this URL; update it."))
    reason = F.when(F.col("f").isNull(), "destination not recorded; refresh to learn whether this URL answers for itself").when(F.size("f.chain") > 0, moved)
    # Counted and listed: written once, so that URLs meet their fetches once.
    rows = materialize(rows.withColumn("reason", reason).select("url", "source", "label", "urn", "ord", "reason"))
    severity = "failure" if strict else "warning"
    found = rows.where("reason is not null").select(*_failed(URLS, "ord", F.col("reason"), severity, F.col("url"), F.coalesce(text.blank_to_null(F.col("source")), F.lit("source")), F.lit("")))
    return rows.select(F.col("reason").isNull().alias("ok")), found


def repo_check(resolved: DataFrame, crawls: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """First citation of each crawled document, and of each URL that the fetcher stood in for."""
    rows = _first(resolved.where("kind = 'repo'"), ["repo", "key"], ["source", "label", "urn", "url"])
    known = crawls.groupBy(F.col("repo").alias("__r"), F.col("key").alias("__k")).agg(F.min(F.struct("status", "reason")).alias("c"))
    rows = rows.join(known, (F.col("repo") == F.col("__r")) & (F.col("key") == F.col("__k")))
    why = F.coalesce(F.concat(F.lit(": "), text.blank_to_null(F.col("c.reason"))), F.lit(""))
    gone = F.concat("repo", F.lit(" has no such document: "), "key", F.lit(". What this cites has moved or is gone, even if its URL still leads somewhere."))
    lost = F.concat("repo", F.lit(" could not fetch "), "key", why, F.lit(". Nobody knows whether the document exists."))
    rows = rows.withColumn("reason", F.when(F.col("c.status") == "not_found", gone).when(F.col("c.status") != "ok", lost))
    rows = rows.withColumn("hard", F.lit(True)).withColumn("source", F.coalesce(text.blank_to_null(F.col("source")), F.col("repo")))
    stood = _first(resolved.where("fallback_from is not null"), ["url"], ["source", "label", "urn", "fallback_from", "fallback_reason"])
    told = F.concat("fallback_from", F.lit(" claims this URL but "), "fallback_reason", F.lit(". What was verified is the fetched page, not what "), "fallback_from", F.lit(" holds."))
    stood = stood.withColumn("reason", told).withColumn("hard", F.lit(False)).withColumn("source", F.coalesce(text.blank_to_null(F.col("source")), F.lit("source"))).withColumn("key", F.col("url"))
    both = rows.select("source", "label", "urn", "url", "key", "reason", "hard", "ord").unionByName(stood.select("source", "label", "urn", "url", "key", "reason", "hard", "ord"))
    severity = F.when(F.col("hard") | F.lit(strict), "failure").otherwise("warning")
    found = both.where("reason is not null").select(*_failed(REPOS, "ord", F.col("reason"), "x", F.coalesce("url", "key"), F.col("source"), F.lit("")), severity.alias("s")).withColumn("severity", F.col("s")).drop("s")
    return both.select(F.col("reason").isNull().alias("ok")), found


def supersession_check(resolved: DataFrame, supersessions: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    rows = _first(resolved.where("kind = 'repo'"), ["repo", "key"], ["source", "label", "urn", "url"])
    known = supersessions.groupBy(F.col("repo").alias("__r"), F.col("key").alias("__k")).agg(F.min(F.struct("status", "superseded_by", "reason")).alias("p"))
    rows = rows.join(known, (F.col("repo") == F.col("__r")) & (F.col("key") == F.col("__k")))
    by = F.when(F.size(F.coalesce("p.superseded_by", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" by "), F.array_join("p.superseded_by", ", "))).otherwise(", with no replacement named")
    why = F.coalesce(F.concat(F.lit(": "), text.blank_to_null(F.col("p.reason"))), F.lit(""))
    old = F.concat("repo", F.lit(" says "), "key", F.lit(" has been superseded"), by, F.lit(". The quote stands there still, in a document that is not in force."))
    unknown = F.concat("repo", F.lit(" could not tell whether "), "key", F.lit(" is still in force"), why)
    rows = rows.withColumn("reason", F.when(F.col("p.status") == "superseded", old).when(F.col("p.status") != "current", unknown))
    found = rows.where("reason is not null").select(*_failed(SUPERSEDED, "ord", F.col("reason"), "failure" if strict else "warning", F.coalesce("url", "key"), F.coalesce(text.blank_to_null(F.col("source")), F.col("repo")), F.lit("")))
    return rows.select(F.col("reason").isNull().alias("ok")), found


def _ordered(rows: DataFrame, offset: int) -> DataFrame:
    """With ord, by which fragments come before terms, each by urn; nothing is numbered, so nothing is sorted as a whole."""
    return rows.withColumn("ord", F.concat(F.lit(str(offset)), "urn"))


def custom_check(name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ok, findings) of a check that a user has added."""
    given = lambda c, kind="string", default=None: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in rows.columns else F.lit(default).cast(kind)
    columns = [F.lit(name).alias("check"), given("severity", default="failure").alias("severity"), given("source", default="(no source)").alias("source"), given("label", default="").alias("label"), given("url", default="").alias("url"), given("urn", default="").alias("urn"), given("reason", default="failed").alias("reason"), given("urn", default="").alias("ord")]
    return rows.select(F.coalesce("ok", F.lit(False)).alias("ok")), rows.where(~F.coalesce("ok", F.lit(False))).select(*columns)


def check(citations: Citations, world: World, options: Options = Options(), known: DataFrame | None = None) -> Report:  # noqa: B008
    """The full verification. Targets and verdicts are made and written at once; the report's frames are made as read.

    ``known`` are the outcomes of a run before: targets in documents that haven't changed since aren't parsed again.
    """
    spark = citations.fragments.sparkSession
    resolved = _ordered(resolve.chain(citations.fragments, citations.sources, options.fetcher, options.crawlers, options.registry), 0)
    terms = _ordered(resolve.direct(citations.terms if citations.terms is not None else _none(spark, schemas.TERMS), options.fetcher, options.crawlers, options.registry), 1)
    # Read by five checks: written once, so that neither the work nor the plan is repeated.
    every = materialize(resolved.unionByName(terms))
    resolved, terms = (every.where(F.col("ord").startswith(k)) for k in "01")
    got = materialize(outcomes(every, world, options, known))
    judged = materialize(_for_hints(chain_verdicts(resolved, got), "fail_snippet"))
    where = F.when(F.col("kind") == "fetcher", F.coalesce("locator", F.lit(""))).otherwise("")
    findings = [judged.where(f"{c} is not null").select(*_failed(name, "ord", F.col(c)), "quote", "text", where.alias("where")) for c, name in (("fail_cache", CACHE), ("fail_content", CONTENT), ("fail_snippet", SNIPPET))]
    of_terms = chain_verdicts(terms, got)
    place = F.concat(F.lit('"'), "location", F.lit('" -> '))
    n = F.length("text")
    unheld = (F.col("quote") != "") & (n >= text.MIN_EVIDENCE) & ~F.contains(F.col("text"), F.col("quote"))
    why = F.when(F.col("outcome") != "ok", F.col("why")).otherwise(F.concat(F.lit("empty extraction ("), n.cast("string"), F.lit(" chars)")))
    of_terms = of_terms.withColumn("fail", F.when(F.col("status") != "resolved", F.concat(place, "status")).when(unheld, NOT_FOUND).when(n < text.MIN_DIRECT, F.concat(place, why)))
    of_terms = materialize(_for_hints(of_terms, "fail"))
    findings.append(of_terms.where("fail is not null").select(*_failed(TERMS, "ord", F.col("fail")), "quote", "text", F.lit("").alias("where")))
    failed = findings[0]
    for f in findings[1:]:
        failed = failed.unionByName(f)
    hints = _explained(failed.where(F.col("reason") == NOT_FOUND)).select(F.col("check").alias("__c"), F.col("urn").alias("__n"), "hint")
    hints = materialize(hints)
    failed = failed.drop("quote", "text", "where").join(hints, (F.col("check") == F.col("__c")) & (F.col("urn") == F.col("__n")), "left").drop("__c", "__n")
    runs = [
        (URLS, redirect_check(every, world.fetches, options.strict_redirects)) if world.fetches is not None else None,
        (REPOS, repo_check(every, world.crawls if world.crawls is not None else _none(spark, schemas.CRAWLS), options.strict_repos)),
        (SUPERSEDED, supersession_check(every, world.supersessions if world.supersessions is not None else _none(spark, schemas.SUPERSESSIONS), options.strict_supersession)),
    ]
    runs += [(name, custom_check(name, materialize(f(citations, world, every)))) for name, f in options.custom]
    counted = None
    for name, rows in ((CACHE, judged.select(F.col("fail_cache").isNull().alias("ok"))), (CONTENT, judged.select(F.col("fail_content").isNull().alias("ok"))), (SNIPPET, judged.select(F.col("fail_snippet").isNull().alias("ok"))), (TERMS, of_terms.select(F.col("fail").isNull().alias("ok"))), *((n, r[0]) for n, r in filter(None, runs))):
        one = rows.agg(F.count_if("ok").alias("ok"), F.count("*").alias("total")).select(F.lit(name).alias("name"), "ok", "total")
        counted = one if counted is None else counted.unionByName(one)
    for _, (_, f) in filter(None, runs):
        failed = failed.unionByName(f.withColumn("hint", F.lit(None).cast(schemas.HINT)))
    sites = citations.cite_sites if citations.cite_sites is not None else _none(spark, schemas.CITE_SITES)
    failed = materialize(with_cite_sites(failed, sites))
    verdicts = judged.select("urn", F.when(F.col("fail_snippet").isNull(), "verified").otherwise("failed").alias("status"), "ord")
    return Report(roll_up(counted, failed, tuple(n for n, _ in options.custom)), failed, verdicts, every, got)


def with_cite_sites(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """``findings`` with cited_by, by file and line; those without a urn have none."""
    place = F.struct("file", F.coalesce("line", F.lit(0)).alias("n"), "line")
    listed = sites.where("file is not null").groupBy(F.col("urn").alias("__n")).agg(F.sort_array(F.collect_list(place)).alias("x"))
    listed = listed.select("__n", F.transform("x", lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"))).alias("cited_by"))
    none = F.array().cast("array<struct<file:string,line:int>>")
    return findings.join(listed, (F.col("urn") == F.col("__n")) & (F.col("urn") != ""), "left").drop("__n").withColumn("cited_by", F.coalesce("cited_by", none))


def roll_up(counted: DataFrame, findings: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """Checks (name, status, ok, total, failures, warnings, structural, ord); those of a run only where they count something."""
    bad = findings.groupBy(F.col("check").alias("__c")).agg(F.count_if(F.col("severity") == "failure").alias("failures"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = counted.where(~F.col("name").isin(URLS, REPOS, SUPERSEDED) | (F.col("total") > 0)).join(bad, F.col("name") == F.col("__c"), "left").fillna(0, ["failures", "warnings"])
    return rows.select("name", verdict(F.col("total"), F.col("failures"), F.col("warnings")).alias("status"), "ok", "total", "failures", "warnings", (F.col("name") == SHAPE).alias("structural"), (F.array_position(F.lit([*ORDER, *custom]), F.col("name")) - 1).cast("int").alias("ord"))


def verdict(total: Column, failures: Column, warnings: Column) -> Column:
    return F.when(total == 0, "----").when(failures > 0, "FAIL").when(warnings > 0, "WARN").otherwise("PASS")


def summary(checks: DataFrame) -> DataFrame:
    """One row: pass, fail, warn, verified, nothing_verified, failed. A run that verifies nothing has failed."""
    nothing = ~F.coalesce(F.bool_or((F.col("total") > 0) & ~F.col("structural")), F.lit(False))
    rows = checks.agg(*(F.count_if(F.col("status") == s.upper()).alias(s) for s in ("pass", "fail", "warn")), F.coalesce(F.sum("ok"), F.lit(0)).alias("verified"), nothing.alias("nothing_verified"))
    return rows.withColumn("failed", (F.col("fail") > 0) | F.col("nothing_verified"))
