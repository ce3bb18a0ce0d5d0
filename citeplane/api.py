"""The library's front: check, locate, validate and emit over a session and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeplane.operators import constraints, locate as _locate, verify
from citeplane.operators.verify import Citations, Options, Report, World
from citeplane.session import ship
from citeplane.sources import rdf, sources_file


def load(spark: SparkSession, path: str) -> Citations:
    """Citations of a YAML file, or of Turtle: a file's or a folder's."""
    if path.endswith((".yaml", ".yml")):
        return sources_file.load(spark, path).citations(spark)
    triples, errors = rdf.load_triples(ship(spark), path)
    if bad := errors.first():
        raise rdf.TurtleError(f"{bad['file']}: {bad['error']}")
    return rdf.citations_of(triples)


def check(spark: SparkSession, citations: Citations, world: World, options: Options = Options(), validate_shapes: bool = False, known: DataFrame | None = None) -> Report:  # noqa: B008
    """The checks of a run; with ``validate_shapes`` the shape of the citations is one of them."""
    report = verify.check(citations, world, options, known)
    if not validate_shapes:
        return report
    held = constraints.conforms(rdf.citation_triples(citations))
    row = spark.createDataFrame([(verify.SHAPE, "WARN" if held is None else "PASS" if held else "FAIL", int(held is True), 1, int(held is False), int(held is None), True, len(verify.ORDER) - 1)], "name string, status string, ok long, total long, failures long, warnings long, structural boolean, ord int")
    return Report(report.checks.unionByName(row), report.findings, report.verdicts, report.resolved, report.outcomes)


def locate(spark: SparkSession, pairs: DataFrame, id_cols: list[str], **options) -> DataFrame:
    ship(spark)
    return _locate.locate(pairs, id_cols, **options)


def emit(citations: Citations, name: str) -> DataFrame:
    return rdf.serialize(rdf.citation_triples(citations), name)


def default_identifiers(triples: DataFrame) -> DataFrame:
    """Subjects under the namespace that files share, which collide across files: give such files a base."""
    return triples.where(triples["s"].startswith(sources_file.NAMESPACE)).select("s").distinct()


def body_of(spark: SparkSession, url: str, documents: DataFrame, files: DataFrame | None = None, crawls: DataFrame | None = None, options: Options = Options(), location: str = "") -> str | None:  # noqa: B008
    """The text of one document: a repository's, where one claims the URL and has it, else the fetched page."""
    from citeplane import schemas
    from citeplane.operators import repositories, resolve

    term = [("urn:x", "x", url, None, location, None, None, None, None)]
    found = resolve.direct(spark.createDataFrame(term, schemas.TERMS), registry=options.registry)
    if files is not None:
        none = spark.createDataFrame([], schemas.CRAWLS)
        held = repositories.documents(found.where("kind = 'repo'"), files, crawls if crawls is not None else none, options.crawl, options.registry)
        if (row := held.where("miss is null").first()) is not None:
            return row["body"]
    row = documents.where(documents["url"] == url.partition("#")[0]).first()
    return None if row is None else row["body"] or ""


def moved_to(url: str, fetches: DataFrame | None) -> str | None:
    """Where a URL leads, if a fetch was redirected."""
    row = None if fetches is None else fetches.where(fetches["url"] == url.partition("#")[0]).first()
    return row["final_url"] if row is not None and row["chain"] else None


def texts(spark: SparkSession, wanted: DataFrame, documents: DataFrame, most: int | None = 5000, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(url, format, locator, text, status, reason) of ``wanted`` (url, format, locator), cut to ``most`` characters with a mark."""
    from citeplane.functions import text, urls
    from citeplane.operators import extract
    from pyspark.sql import functions as F

    ship(spark)
    key = lambda c: F.concat(F.lit("url:"), urls.document_url(F.col(c)))
    none = F.lit(None).cast("string")
    targets = wanted.select(key("url").alias("doc_key"), F.coalesce("format", F.lit("")).alias("format"), "locator", F.coalesce(urls.url_anchor(F.col("url")), F.lit("")).alias("anchor"), "url")
    held = documents.select(key("url").alias("doc_key"), "body", none.alias("miss"), none.alias("miss_reason")).dropDuplicates(["doc_key"])
    got = extract.extract(targets, held, options.formats)
    return got.select(F.substring("doc_key", 5, 1 << 30).alias("url"), "format", "locator", text.truncate(F.col("text"), most).alias("text"), "status", "reason")
