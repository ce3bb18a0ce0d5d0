"""Shapes of citation triples as queries: each constraint is an aggregation, a semi join or a filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeplane.scratch import materialize
from citeplane.sources.rdf import CP, DCTERMS, OA, PROV, RDF, RDFS, SCHEMA, XSD


@dataclass(frozen=True)
class Shape:
    """On the nodes of a class (or, without one, the subjects of the path): how many values, and of what kind."""

    name: str
    target: str | None
    path: str
    least: int = 0
    most: int | None = None
    of_class: str | None = None
    pattern: str | None = None
    datatype: str | None = None
    among: tuple[str, ...] = ()
    at_least: int | None = None
    text: bool = False


def _one(target: str, path: str, name: str, **more) -> Shape:
    return Shape(name, target, path, 1, 1, **more)


SHAPES = (
    Shape("Source", CP + "Source", RDFS + "label", 1, text=True),
    Shape("Source", CP + "Source", DCTERMS + "isPartOf", of_class=CP + "Source"),
    Shape("Fragment", CP + "Fragment", RDFS + "label", 1, text=True),
    _one(CP + "Fragment", OA + "hasTarget", "Fragment"),
    Shape("Fragment", CP + "Fragment", CP + "sourceLines", 0, 1, pattern=r"\A[0-9]+(?:-[0-9]+)?\z"),
    Shape("Fragment", CP + "Fragment", CP + "sourceLocation", 0, 1),
    _one(OA + "SpecificResource", OA + "hasSource", "AnnotationTarget", of_class=CP + "Source"),
    _one(OA + "TextQuoteSelector", OA + "exact", "TextQuote", text=True),
    _one(OA + "CssSelector", RDF + "value", "Css"),
    _one(CP + "SectionSelector", RDF + "value", "Section"),
    _one(CP + "CiteSite", CP + "citingFile", "CiteSite", datatype=XSD + "string"),
    Shape("CiteSite", CP + "CiteSite", CP + "citingLine", 0, 1, datatype=XSD + "integer", at_least=1),
    _one(CP + "Term", SCHEMA + "url", "Term"),
    Shape("Term", CP + "Term", RDFS + "label", 1, text=True),
    Shape("Activity", CP + "VerificationActivity", PROV + "startedAtTime", 1, datatype=XSD + "dateTime"),
    Shape("Activity", CP + "VerificationActivity", PROV + "endedAtTime", 0, 1, datatype=XSD + "dateTime"),
    Shape("Status", None, CP + "verificationStatus", 0, 1, among=("verified", "failed", "pending")),
    _one(CP + "VerificationResult", CP + "verificationStatus", "Result"),
    _one(CP + "VerificationResult", PROV + "wasGeneratedBy", "Result", of_class=CP + "VerificationActivity"),
    _one(CP + "VerificationResult", PROV + "wasDerivedFrom", "Result", of_class=CP + "Fragment"),
)


def violations(triples: DataFrame, shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """(shape, node, path, problem) of every broken constraint."""
    # Every shape reads the triples: they are written once, and each query's plan begins there.
    triples = materialize(triples.select("s", "p", "o", "o_kind", "datatype", "lang").distinct())
    kinds = triples.where(F.col("p") == RDF + "type").select(F.col("s").alias("n"), F.col("o").alias("k"))
    out = None
    for x in shapes:
        values = triples.where(F.col("p") == x.path)
        nodes = kinds.where(F.col("k") == x.target).select("n").distinct() if x.target else values.select(F.col("s").alias("n")).distinct()
        held = nodes.join(values, F.col("n") == F.col("s"), "left")
        if x.of_class:
            known = kinds.where(F.col("k") == x.of_class).select(F.col("n").alias("__o")).distinct().withColumn("__ok", F.lit(True))
            held = held.join(known, F.col("o") == F.col("__o"), "left")
        own = F.coalesce("datatype", F.when(F.col("o_kind") == "literal", F.when(F.col("lang").isNotNull(), RDF + "langString").otherwise(XSD + "string")))
        bad = [("a value is of the wrong class", F.col("__ok").isNull())] if x.of_class else []
        if x.pattern:
            bad.append(("a value doesn't fit the pattern", ~F.col("o").rlike(x.pattern)))
        if x.datatype:
            bad.append(("a value is of the wrong type", ~own.eqNullSafe(F.lit(x.datatype))))
        if x.text:
            bad.append(("a value is no text", ~F.coalesce(own.isin(XSD + "string", RDF + "langString"), F.lit(False))))
        if x.among:
            bad.append(("a value is none of those allowed", ~F.col("o").isin(*x.among)))
        if x.at_least is not None:
            bad.append(("a value is too small", F.coalesce(F.col("o").try_cast("bigint") < x.at_least, F.lit(True))))
        some = F.col("s").isNotNull()
        sums = held.groupBy("n").agg(F.count("s").alias("c"), *(F.bool_or(some & test).alias(f"b{i}") for i, (_, test) in enumerate(bad)))
        problems = [F.when(F.col("c") < x.least, "too few values")] + ([F.when(F.col("c") > x.most, "too many values")] if x.most is not None else []) + [F.when(F.col(f"b{i}"), why) for i, (why, _) in enumerate(bad)]
        one = sums.select(F.lit(x.name).alias("shape"), F.col("n").alias("node"), F.lit(x.path).alias("path"), F.explode(F.array_compact(F.array(*problems))).alias("problem"))
        out = one if out is None else out.unionByName(one)
    # A source needs a URL or a parent to have it from.
    located = triples.where(F.col("p").isin(SCHEMA + "url", DCTERMS + "isPartOf")).select(F.col("s").alias("__s")).distinct()
    lost = kinds.where(F.col("k") == CP + "Source").select("n").distinct().join(located, F.col("n") == F.col("__s"), "left_anti")
    out = out.unionByName(lost.select(F.lit("Source").alias("shape"), F.col("n").alias("node"), F.lit(SCHEMA + "url").alias("path"), F.lit("neither a URL nor a parent").alias("problem")))
    targets = triples.where(F.col("p") == OA + "hasSelector").join(kinds.where(F.col("k").isin(OA + "TextQuoteSelector", OA + "CssSelector", CP + "SectionSelector")), F.col("o") == F.col("n"))
    twice = targets.groupBy("s", "k").agg(F.countDistinct("o").alias("c")).where("c > 1")
    return out.unionByName(twice.select(F.lit("AnnotationTarget").alias("shape"), F.col("s").alias("node"), F.lit(OA + "hasSelector").alias("path"), F.lit("several selectors of one kind").alias("problem")))


def conforms(triples: DataFrame) -> bool | None:
    """True, False, or null where there is nothing to judge."""
    return None if triples.isEmpty() else violations(triples).isEmpty()
