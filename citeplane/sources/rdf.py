"""Triples: a Turtle subset read by file, N-Triples and Turtle written, and citations from triples.

The subset: prefixes and base (both spellings), ``a``, lists of predicates and objects, blank nodes by label and in
brackets, collections, short and long strings with language or datatype, numbers and booleans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeplane import schemas
from citeplane.fixed import BIBO, DCTERMS, OA, PROV, RDF, RDFS, SCHEMA, SERIALIZATIONS, XSD
from citeplane.functions import text as tx
from citeplane.operators.verify import Citations

CP = "urn:citeplane:vocabulary#"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "oa": OA, "prov": PROV, "dcterms": DCTERMS, "schema": SCHEMA, "bibo": BIBO, "cp": CP}


def empty(spark: SparkSession) -> tuple[DataFrame, dict[str, str]]:
    """No triples, and the prefixes that this package's graphs are written with."""
    return spark.createDataFrame([], schemas.TRIPLES), dict(PREFIXES)


class TurtleError(ValueError):
    """Text outside the subset."""


_LEX = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*\'\'\')
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<dir>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)
    |(?P<num>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<bool>(?:true|false)\b(?![\w:-]))
    |(?P<bnode>_:[\w](?:[\w.-]*[\w-])?)|(?P<name>(?:[A-Za-z][\w.-]*)?:(?:(?:[\w:%-]|\\.|\.(?=[\w:%-])))*)|(?P<a>a(?=[\s<\[]))|(?P<mark>[\[\]();,.])''',
    re.X,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.S)


class _Reader:
    def __init__(self, source: str, scope: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TurtleError(f"not understood: {source[at : at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.fresh, self.scope = 0, 0, scope
        self.prefixes, self.base = {}, ""
        self.out: list[tuple] = []

    def look(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        kind, text = self.look()
        if kind == "end" or mark is not None and text != mark:
            raise TurtleError(f"{mark or 'more'} expected, not {text or 'the end'!r}")
        self.at += 1
        return kind, text

    def blank(self) -> tuple:
        self.fresh += 1
        return f"_:{self.scope}b{self.fresh}", "bnode", None, None

    def term(self) -> tuple:
        kind, text = self.take()
        if kind == "iri":
            iri = _unescape(text[1:-1])
            return (iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri), "iri", None, None
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "a":
            return RDF + "type", "iri", None, None
        if kind == "bnode":
            return f"_:{self.scope}{text[2:]}", "bnode", None, None
        if kind in ("str", "long"):
            n = 3 if kind == "long" else 1
            value, lang, datatype = _unescape(text[n:-n]), None, None
            if self.look()[0] == "lang":
                lang = self.take()[1][1:].lower()
            elif self.look()[0] == "dt":
                self.take()
                datatype = self.term()[0]
            return value, "literal", None if datatype == XSD + "string" else datatype, lang
        if kind == "num":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if kind == "bool":
            return text, "literal", XSD + "boolean", None
        if text == "[":
            node = self.blank()
            if self.look()[1] != "]":
                self.predicates(node[0])
            self.take("]")
            return node
        if text == "(":
            nodes = []
            while self.look()[1] != ")":
                nodes.append(self.term())
            self.take(")")
            head = (RDF + "nil", "iri", None, None)
            for x in reversed(nodes):
                cell = self.blank()
                self.out += [(cell[0], RDF + "first", *x), (cell[0], RDF + "rest", *head)]
                head = cell
            return head
        raise TurtleError(f"no term: {text!r}")

    def predicates(self, subject: str) -> None:
        while True:
            p = self.term()[0]
            while True:
                self.out.append((subject, p, *self.term()))
                if self.look()[1] != ",":
                    break
                self.take()
            while self.look()[1] == ";":
                self.take()
            if self.look()[1] in (".", "]", ""):
                return

    def read(self) -> list[tuple]:
        while self.look()[0] != "end":
            kind, text = self.look()
            if kind == "dir":
                self.take()
                word = text.lstrip("@").lower()
                name = self.take()[1][:-1] if word == "prefix" else ""
                iri = self.term()[0]
                if word == "prefix":
                    self.prefixes[name] = iri
                else:
                    self.base = iri
                if text.startswith("@"):
                    self.take(".")
                continue
            subject = self.term()[0]
            if not (text == "[" and self.look()[1] == "."):
                self.predicates(subject)
            self.take(".")
        return self.out


def parse_turtle(source: str, scope: str = "") -> list[tuple]:
    """Distinct triples (s, p, o, o_kind, datatype, lang); blank nodes get names within the scope."""
    return list(dict.fromkeys(_Reader(source, scope).read()))


def role(name: Column) -> Column:
    """semantic, shapes, inferred or data, by a file's name."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.ttl\z", "")
    out = F.when(stem.endswith("-semantic") | (stem == "semantic"), "semantic")
    for r in ("shapes", "inferred"):
        out = out.when(stem.rlike(rf"(?:\A|[-._]){r}\z"), r)
    return out.otherwise("data")


def load_triples(spark: SparkSession, folder: str, roles: tuple[str, ...] = ("data", "semantic")) -> tuple[DataFrame, DataFrame]:
    """(triples with their role, errors by file) of all ``*.ttl`` under a folder; a file is one row and one parse."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ttl").text(folder, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("file")).withColumn("role", role(F.col("file"))).where(F.col("role").isin(*roles))
    names = [x.split()[0] for x in schemas.TRIPLES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows: list[tuple] = []
            for text, file, kind in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [(*t, file, kind, None) for t in parse_turtle(text or "", hashlib.sha256(file.encode()).hexdigest()[:8])]
                except TurtleError as e:
                    rows.append((None,) * 6 + (file, kind, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(9)], names=[*names, "file", "role", "error"])

    rows = files.mapInArrow(run, schemas.TRIPLES + ", file string, role string, error string")
    return rows.where("error is null").select(*names, "role").distinct(), rows.where("error is not null").select("file", "error")


def _quoted(c: Column) -> Column:
    for sign, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(sign), F.lit(to))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _node(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def n_triples(triples: DataFrame) -> DataFrame:
    """A column ``value`` of lines, in order: write it with ``.write.text``."""
    tail = F.coalesce(F.concat(F.lit("@"), "lang"), F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.lit(""))
    o = F.when(F.col("o_kind") == "literal", F.concat(_quoted(F.col("o")), tail)).otherwise(_node(F.col("o")))
    return triples.select(F.concat_ws(" ", _node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value")).distinct().orderBy("value")


def turtle(triples: DataFrame) -> DataFrame:
    """A column ``value`` of one block for each subject, in order, each complete in itself."""
    lines = n_triples(triples).select(F.regexp_extract("value", r"\A(\S+) ", 1).alias("s"), F.regexp_replace(F.regexp_replace("value", r"\A\S+ ", ""), r" \.\z", "").alias("po"))
    shown = F.regexp_replace("po", re.escape(f"<{RDF}type>").replace("\\-", "-"), "a")
    return lines.groupBy("s").agg(F.sort_array(F.collect_list(shown)).alias("x")).select("s", F.concat("s", F.lit(" "), F.array_join("x", " ;\n    "), F.lit(" .")).alias("value")).orderBy("s").select("value")


class UnknownFormat(ValueError):
    """A serialization that isn't offered."""


def serialize(triples: DataFrame, name: str) -> DataFrame:
    """A column ``value`` of lines or blocks in the named format."""
    kind = SERIALIZATIONS.get(name.lower())
    if kind is None:
        raise UnknownFormat(f"unknown format {name!r}; known: {', '.join(sorted(SERIALIZATIONS))}")
    if kind in ("nt", "turtle"):
        return (n_triples if kind == "nt" else turtle)(triples)
    if kind == "jsonld":
        value = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("datatype").alias("@type"), F.col("lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
        by = triples.distinct().select("s", "p", value.alias("v")).groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("v"))
        pair = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("p").alias("k"))), r'\A\{"k":|\}\z', ""), F.lit(":["), "v", F.lit("]"))
        whole = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("s").alias("@id"))), r"\}\z", ","), F.array_join(F.sort_array(F.collect_list(pair)), ","), F.lit("}"))
        return by.groupBy("s").agg(whole.alias("value")).orderBy("s").select("value")
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    local = F.regexp_extract("p", r"([A-Za-z_][\w.-]*)\z", 1)
    space = F.expr("substring(p, 1, length(p) - length(regexp_extract(p, '([A-Za-z_][\\\\w.-]*)$', 1)))")
    refers = lambda c, about, ref: F.when(c.startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), F.substring(c, 3, 1 << 30), F.lit('"'))).otherwise(F.concat(F.lit(f" {ref if about is None else about}=\""), xml(c), F.lit('"')))
    attrs = F.coalesce(F.concat(F.lit(' xml:lang="'), "lang", F.lit('"')), F.concat(F.lit(' rdf:datatype="'), xml(F.col("datatype")), F.lit('"')), F.lit(""))
    body = F.when(F.col("o_kind") == "literal", F.concat(attrs, F.lit(">"), xml(F.col("o")), F.lit("</x:"), local, F.lit(">"))).otherwise(F.concat(refers(F.col("o"), None, "rdf:resource"), F.lit("/>")))
    item = F.concat(F.lit("  <x:"), local, F.lit(' xmlns:x="'), xml(space), F.lit('"'), body)
    by = triples.distinct().select("s", item.alias("v")).groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("v")), "\n").alias("v"))
    return by.orderBy("s").select(F.concat(F.lit("<rdf:Description"), refers(F.col("s"), "rdf:about", ""), F.lit(">\n"), "v", F.lit("\n</rdf:Description>")).alias("value"))


def citation_triples(c: Citations) -> DataFrame:
    """Sources, fragments and cite sites as triples; blank nodes are named after what they belong to."""
    lit = lambda df, s, p, o, dt=None: df.where(F.col(o).isNotNull()).select(s.alias("s"), F.lit(p).alias("p"), F.col(o).cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(dt).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    ref = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.when(o.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")).where("o is not null")
    sid, urn = F.col("source_id"), F.col("urn")
    anon = lambda what: F.concat(F.lit("_:"), tx.slug(urn), F.lit("_" + what))
    out = [ref(c.sources, sid, RDF + "type", F.lit(CP + "Source")), lit(c.sources, sid, RDFS + "label", "label"), ref(c.sources, sid, DCTERMS + "isPartOf", F.col("part_of"))]
    out += [lit(c.sources, sid, p, k) for k, p in (("url", SCHEMA + "url"), ("type", DCTERMS + "format"), ("language", DCTERMS + "language"), ("title", DCTERMS + "title"), ("date", DCTERMS + "issued"), ("license", DCTERMS + "license"), ("isbn", BIBO + "isbn"), ("doi", BIBO + "doi"), ("publisher", DCTERMS + "publisher"), ("edition", CP + "edition"))]
    f, target = c.fragments, anon("target")
    out += [ref(f, urn, RDF + "type", F.lit(CP + "Fragment")), lit(f, urn, RDFS + "label", "label"), ref(f, urn, OA + "motivatedBy", F.lit(OA + "identifying")), ref(f, urn, OA + "hasTarget", target), ref(f, target, RDF + "type", F.lit(OA + "SpecificResource")), ref(f, target, OA + "hasSource", sid)]
    out += [lit(f, urn, p, k) for k, p in (("lines", CP + "sourceLines"), ("location", CP + "sourceLocation"), ("page_start", BIBO + "pageStart"), ("page_end", BIBO + "pageEnd"))]
    for column, what, kind, value in (("snippet", "quote", OA + "TextQuoteSelector", OA + "exact"), ("selector", "css", OA + "CssSelector", RDF + "value"), ("section", "section", CP + "SectionSelector", RDF + "value")):
        some, node = f.where(F.col(column).isNotNull()), anon(what)
        out += [ref(some, target, OA + "hasSelector", node), ref(some, node, RDF + "type", F.lit(kind)), lit(some, node, value, column)]
    if c.cite_sites is not None:
        site = F.concat(F.lit("_:"), tx.slug(urn), F.lit("_cite_"), F.substring(F.sha2(F.concat_ws(":", "file", "line"), 256), 1, 8))
        out += [ref(c.cite_sites, site, RDF + "type", F.lit(CP + "CiteSite")), lit(c.cite_sites, site, CP + "citingFile", "file"), lit(c.cite_sites, site, CP + "citingLine", "line", XSD + "integer"), ref(c.cite_sites, site, PROV + "wasDerivedFrom", urn), ref(c.cite_sites, urn, CP + "citedBy", site)]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.distinct()


def citations_of(triples: DataFrame) -> Citations:
    """Citations from triples, as joins and pivots by subject; of several values the least counts."""

    def values(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
        return df.where(F.col("p").isin(*wanted.values())).groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(k) for k, p in wanted.items()))

    def of_class(name: str) -> DataFrame:
        return triples.where((F.col("p") == RDF + "type") & (F.col("o") == name)).select("s").distinct()

    props = {"label": RDFS + "label", "url": SCHEMA + "url", "type": DCTERMS + "format", "part_of": DCTERMS + "isPartOf", "language": DCTERMS + "language", "title": DCTERMS + "title", "date": DCTERMS + "issued", "license": DCTERMS + "license", "isbn": BIBO + "isbn", "doi": BIBO + "doi", "publisher": DCTERMS + "publisher", "edition": CP + "edition"}
    sources = of_class(CP + "Source").join(values(triples, props), "s", "left").withColumnRenamed("s", "source_id")
    kinds = triples.where(F.col("p") == RDF + "type").select(F.col("s").alias("sel"), F.col("o").alias("kind"))
    links = lambda p, a, b: triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    picked = links(OA + "hasTarget", "urn", "t").join(links(OA + "hasSelector", "t", "sel"), "t").join(kinds, "sel").join(values(triples, {"exact": OA + "exact", "value": RDF + "value"}).withColumnRenamed("s", "sel"), "sel")
    by = lambda kind, c: F.min(F.when((F.col("kind") == kind) & (F.col(c) != ""), F.col(c)))
    selectors = picked.groupBy("urn").agg(by(OA + "TextQuoteSelector", "exact").alias("snippet"), by(OA + "CssSelector", "value").alias("selector"), by(CP + "SectionSelector", "value").alias("section"))
    sourced = links(OA + "hasTarget", "urn", "t").join(links(OA + "hasSource", "t", "source_id"), "t").groupBy("urn").agg(F.min("source_id").alias("source_id"))
    more = {"label": RDFS + "label", "lines": CP + "sourceLines", "location": CP + "sourceLocation", "page_start": BIBO + "pageStart", "page_end": BIBO + "pageEnd", "url": SCHEMA + "url", "type": DCTERMS + "format"}
    plain = values(triples, more).withColumnRenamed("s", "urn")

    def cited(kind: str) -> DataFrame:
        return of_class(kind).withColumnRenamed("s", "urn").join(plain, "urn", "left").join(selectors, "urn", "left").join(sourced, "urn", "left")

    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    sites = links(CP + "citedBy", "urn", "n").join(values(triples, {"file": CP + "citingFile", "line": CP + "citingLine"}).withColumnRenamed("s", "n"), "n").select("urn", "file", F.col("line").try_cast("int").alias("line"))
    return Citations(sources.select(*names(schemas.SOURCES)), cited(CP + "Fragment").select(*names(schemas.FRAGMENTS)), cited(CP + "Term").select(*names(schemas.TERMS)), sites)


def provenance(verdicts: DataFrame, started: str, ended: str) -> DataFrame:
    """Triples of one verification activity and a result for each verdict (urn, status)."""
    spark = verdicts.sparkSession
    activity, node = "_:activity", F.concat(F.lit("_:result_"), tx.slug(F.col("urn")))
    fixed = spark.createDataFrame([(activity, RDF + "type", CP + "VerificationActivity", "iri", None, None), (activity, PROV + "startedAtTime", started, "literal", XSD + "dateTime", None), (activity, PROV + "endedAtTime", ended, "literal", XSD + "dateTime", None)], schemas.TRIPLES)
    row = lambda s, p, o, kind: verdicts.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    for x in (row(F.lit(activity), PROV + "used", F.col("urn"), "iri"), row(node, RDF + "type", F.lit(CP + "VerificationResult"), "iri"), row(node, CP + "verificationStatus", F.col("status"), "literal"), row(node, PROV + "wasGeneratedBy", F.lit(activity), "bnode"), row(node, PROV + "wasDerivedFrom", F.col("urn"), "iri")):
        fixed = fixed.unionByName(x)
    return fixed.distinct()


def described(triples: DataFrame, citations: Citations) -> DataFrame:
    """Triples that make verdicts readable alone: of each fragment with its blank nodes, its source, and two ancestors."""
    nodes = citations.fragments.select(F.col("urn").alias("n"), "source_id").distinct()
    parents = citations.sources.select(F.col("source_id").alias("c"), F.col("part_of").alias("up"))
    reach = nodes.select("n").unionByName(nodes.select(F.col("source_id").alias("n")))
    step = nodes.select(F.col("source_id").alias("n")).distinct()
    for _ in range(2):
        step = step.join(parents, F.col("n") == F.col("c")).select(F.col("up").alias("n")).where("n is not null").distinct()
        reach = reach.unionByName(step)
    front = reach.where("n is not null").distinct()
    out = triples.join(front, F.col("s") == F.col("n"), "left_semi")
    for _ in range(2):
        blank = out.where("o_kind = 'bnode'").select(F.col("o").alias("n")).distinct()
        out = out.unionByName(triples.join(blank, F.col("s") == F.col("n"), "left_semi")).distinct()
    return out
