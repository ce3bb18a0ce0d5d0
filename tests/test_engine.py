"""Plans: functions, sources, triples, constraints, verification, streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from citeplane import api, report, schemas
from citeplane.functions import text, urls
from citeplane.operators import constraints, repositories, search, verify
from citeplane.sources import payloads, rdf, sources_file
from citeplane.sources.sources_file import Refused

BODY = "<html><body><h1>Book</h1><h2>Part 1</h2><p>It was the best of times, it was the worst of times.</p><h2>Part 2</h2><p>Call me Ishmael and nothing else at all.</p></body></html>"
DATA = {
    "base": "https://example.org/c",
    "patterns": [{"match": "Book (?P<n>\\d+)", "source": {"url": "https://b.org/{n}"}}],
    "sources": [
        {"label": "Book 7", "type": "html", "fragments": [
            {"label": "times", "section": "Part 1", "snippet": "it was the worst of times", "cited_by": [{"file": "b.md", "line": 9}, {"file": "a.md"}]},
            {"label": "wrong part", "section": "Part 2", "snippet": "it was the worst of times"},
            {"label": "no part", "section": "Part 3", "snippet": "it was the worst of times"},
            {"label": "short", "snippet": "too short"},
            {"label": "css", "selector": "h2:nth-of-type(2) + p", "snippet": "Call me ISHMAEL and nothing else"},
        ]},
        {"label": "Chapter", "part_of": "Book 7", "url": "https://b.org/gone"},
        {"label": "RFC 9110", "fragments": [{"label": "x", "snippet": "the semantics of HTTP are stateless", "section": "§ 3"}]},
    ],
}


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("a  b\x1c\tc\n", "a b c"), (" x\u0085", "x"), ("", "")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_ws(F.col("c")), c=raw) == want == " ".join(raw.split())


def test_text_functions(spark):
    assert one(spark, text.quote_of(F.col("c")), c=" a  b ... ") == "a b"
    assert one(spark, text.truncate(F.col("c"), 3), c="abcdef") == "abc\n... [3 more chars]"
    assert one(spark, text.slug(F.col("c")), c=" Ünder — Line! ") == "ünder_line" == sources_file.slug(" Ünder — Line! ")
    assert one(spark, text.ascii_slug(F.col("c")), c="The (Big) One") == "the_big_one"
    assert one(spark, text.anchor_slug(F.col("c")), c="7.2 Terms, Defined") == "72-terms-defined"
    assert one(spark, text.line_range(F.col("c"), F.lit("0-2")), c="a\nb\nc") == "a\nb"
    assert one(spark, text.line_range(F.col("c"), F.lit("x")), c="a") == ""
    assert one(spark, text.repository_text(F.col("c"), F.lit("lines:2-2")), c="a\nb") == "b"
    assert one(spark, text.repository_text(F.col("c"), F.lit("x")), c="a" * 5000) == ""
    assert one(spark, text.strip_leading_headers(F.col("c")), c="# a\n# b\n\n\nx\n# y") == "x\n# y"
    assert one(spark, text.typographic_kind(F.col("c"), F.lit("die Strasse hier")), c="die STRAßE hier") == "differs only in case"


@pytest.mark.parametrize(
    ("url", "repo", "key"),
    [
        ("https://archive.org/details/item1/page/2", "archive", "item1"), ("https://www.gutenberg.org/ebooks/2701#x", "gutenberg", "2701"), ("https://developer.mozilla.org/en-US/docs/Web/CSS/::before?x", "mdn", "en-us/web/css/_doublecolon_before"),
        ("https://developer.mozilla.org/en-US/docs/../x", "mdn", None), ("https://developer.mozilla.org/fr/docs/x", None, None), ("https://www.rfc-editor.org/rfc/rfc9110.html#section-3", "rfc", "rfc9110"), ("https://datatracker.ietf.org/doc/html/draft-A.b-03", "rfc", "draft-a.b-03"),
        ("https://en.wikisource.org/wiki/On_the%20Origin?x", "wikisource", "On_the Origin"), ("https://en.wiktionary.org/wiki/a+b", "wiktionary", "a+b"), ("https://example.org/#https://archive.org/details/x", None, None),
    ],
)
def test_claims(spark, url, repo, key):
    assert (one(spark, urls.claimed_by(F.col("u")), u=url), one(spark, urls.repository_key(F.col("u")), u=url)) == (repo, key)


def test_families_are_claimed(spark):
    for name, repo in (("RFC 1", "rfc"), ("MDN Web/X", "mdn"), ("Gutenberg 5", "gutenberg"), ("Wikisource A_b", "wikisource"), ("Wiktionary w", "wiktionary"), ("Archive z", "archive")):
        url = sources_file.complete({"label": name}, sources_file.patterns_of(None, "x"))["url"]
        assert one(spark, urls.minted_url(F.col("n")), n=name) == url and one(spark, urls.claimed_by(F.col("u")), u=url) == repo


@pytest.mark.parametrize(
    "change",
    [
        {"sources": None, "x": 1}, {"base": "relative"}, {"base": "https://a#b#"}, {"sources": [{"url": "u"}]}, {"sources": [{"label": "a"}]}, {"sources": [{"label": "a", "url": "u", "part_of": "b"}]}, {"sources": [{"label": "a", "url": "u", "colour": 1}]},
        {"sources": [{"label": "a", "url": ["u"]}]}, {"sources": [{"label": "A!", "url": "u"}, {"label": "a", "url": "v"}]}, {"sources": [{"label": "a", "url": "u", "fragments": [{"label": "f", "lines": "1-2"}]}]},
        {"sources": [{"label": "a", "url": "u", "fragments": [{"label": "f", "snippet": "x", "cited_by": {"file": "f"}}]}]}, {"sources": [{"label": "a", "url": "u", "fragments": [{"label": "f", "snippet": "x", "cited_by": [{"file": "f", "line": True}]}]}]},
        {"patterns": [{"match": "("}]}, {"patterns": [{"match": "a", "source": {"url": "{x}"}}]}, {"patterns": {"match": "a"}},
    ],
)
def test_refusals(change):
    with pytest.raises(Refused):
        sources_file.parse({**DATA, **change})


def test_parsed_rows():
    got = sources_file.parse(DATA)
    assert got.sources[0][:4] == ("https://example.org/c#source_book_7", "Book 7", "https://b.org/7", "text/html") and got.sources[1][4] == got.sources[0][0]
    assert got.fragments[0][0] == "https://example.org/c#fragment_book_7_times" and ("https://example.org/c#fragment_book_7_times", "a.md", None) in got.cite_sites
    assert got.resolve("RFC 9110")["url"].endswith("rfc9110.html") and got.resolve("nothing") is None
    more = sources_file.add_fragment(DATA, "RFC 1", {"label": "n", "snippet": "q"})
    assert more["sources"][-1]["label"] == "RFC 1" and len(sources_file.add_fragment(DATA, "other", {"label": "n", "snippet": "q"}, "https://b.org/7")["sources"]) == 3


@pytest.fixture(scope="module")
def run(spark):
    rfc = "<html><body><h1>HTTP</h1><h2>3. Concepts</h2><p>We say that the semantics of HTTP are stateless.<span class='pilcrow'>¶</span></p></body></html>"
    world = verify.World(
        spark.createDataFrame([("https://b.org/7", BODY)], schemas.DOCUMENTS),
        spark.createDataFrame([("https://b.org/7", "https://b.org/8", [(301, "https://b.org/7")])], schemas.FETCHES),
        spark.createDataFrame([("rfc", "rfc9110", "rfc9110", None, None, rfc)], schemas.REPO_FILES),
        spark.createDataFrame([("rfc", "rfc9110", "ok", "")], schemas.CRAWLS),
        spark.createDataFrame([("rfc", "rfc9110", "superseded", ["rfc9999"], "")], schemas.SUPERSESSIONS),
    )
    return api.check(spark, sources_file.parse(DATA).citations(spark), world, validate_shapes=True)


def test_verification_end_to_end(run):
    checks = {c["name"]: (c["status"], c["ok"], c["total"]) for c in run.checks.collect()}
    assert checks == {
        verify.CACHE: ("PASS", 6, 6), verify.CONTENT: ("FAIL", 5, 6), verify.SNIPPET: ("FAIL", 2, 6), verify.TERMS: ("----", 0, 0),
        verify.URLS: ("WARN", 0, 1), verify.REPOS: ("PASS", 1, 1), verify.SUPERSEDED: ("WARN", 0, 1), verify.SHAPE: ("PASS", 1, 1),
    }
    found = {(f["check"], f["label"]): f for f in run.findings.collect()}
    assert found[verify.SNIPPET, "css"]["hint"]["kind"] == "differs only in case" and found[verify.SNIPPET, "css"]["hint"]["where"].startswith("h2")
    assert "Part 3" in found[verify.SNIPPET, "no part"]["reason"] and "short" in found[verify.SNIPPET, "short"]["reason"]
    assert found[verify.SNIPPET, "wrong part"]["reason"] == verify.NOT_FOUND
    assert "rfc9999" in found[verify.SUPERSEDED, "https://www.rfc-editor.org/rfc/rfc9110.html"]["reason"]


def test_reports(run):
    out = report.as_json(run)
    assert out["summary"] == {"pass": 3, "fail": 2, "warn": 2, "verified": 15, "nothing_verified": False, "failed": True}
    assert json.loads(json.dumps(out)) == out
    shown = report.as_text(run)
    assert "[FAIL] Fragments: snippet verified" in shown and "EXIT CODE: 1" in shown and "source says:" in shown
    assert report.json_rows(run).count() == run.findings.count()


def test_nothing_verified_is_a_failure(spark):
    none = verify.Citations(spark.createDataFrame([], schemas.SOURCES), spark.createDataFrame([], schemas.FRAGMENTS))
    got = verify.check(none, verify.World(spark.createDataFrame([], schemas.DOCUMENTS)))
    s = verify.summary(got.checks).first()
    assert s["nothing_verified"] and s["failed"] and s["fail"] == 0


def test_statuses_without_documents(spark):
    cited = sources_file.parse(DATA).citations(spark)
    frags = cited.fragments.unionByName(spark.createDataFrame([("urn:lost", "nowhere", "l", "a quote that is long enough", *[None] * 6)], schemas.FRAGMENTS))
    got = verify.check(verify.Citations(cited.sources, frags), verify.World(spark.createDataFrame([], schemas.DOCUMENTS)))
    by = {r["urn"]: r for r in got.resolved.collect()}
    assert by["urn:lost"]["status"] == "no_source" and {v["status"] for v in got.verdicts.collect()} == {"failed"}


def test_triples_round_trip(spark):
    cited = sources_file.parse(DATA).citations(spark)
    triples = rdf.citation_triples(cited)
    back = rdf.citations_of(triples)
    assert sorted(map(tuple, back.fragments.collect()), key=str) == sorted(map(tuple, cited.fragments.collect()), key=str)
    assert sorted(map(tuple, back.sources.collect()), key=str) == sorted(map(tuple, cited.sources.collect()), key=str)
    want = {tuple(r) for r in triples.collect()}
    for name in ("nt", "turtle"):
        text_ = "\n".join(r["value"] for r in rdf.serialize(triples, name).collect())
        assert len(rdf.parse_turtle(text_)) == len(want)
    assert {tuple(r) for r in spark.createDataFrame(rdf.parse_turtle("\n".join(r["value"] for r in rdf.n_triples(triples).collect())), schemas.TRIPLES).collect()} == want
    for r in rdf.serialize(triples, "json-ld").collect():
        assert "@id" in json.loads(r["value"])
    assert rdf.serialize(triples, "xml").count() == triples.select("s").distinct().count()
    with pytest.raises(rdf.UnknownFormat):
        rdf.serialize(triples, "n3?")
    assert constraints.conforms(triples) is True and constraints.conforms(triples.limit(0)) is None
    lost = rdf.described(triples, cited)
    assert lost.count() > 0 and api.default_identifiers(triples).count() == 0
    prov = rdf.provenance(spark.createDataFrame([("urn:a", "verified")], "urn string, status string"), "2026-01-01T00:00:00Z", "2026-01-01T00:00:01Z")
    assert prov.count() == 8


def test_turtle_subset(spark, tmp_path):
    t = '@prefix e: <http://e/> . PREFIX f: <http://f/>\n e:a a e:T ; e:p "x"@EN , """long "q" text""" , 1, 2.5, true ; e:q [ e:r ( 1 2 ) ] . # end\n_:b f:y <rel> .'
    got = rdf.parse_turtle("@base <http://base/> . " + t)
    assert ("http://e/a", "http://e/p", "x", "literal", None, "en") in got and ("_:b", "http://f/y", "http://base/rel", "iri", None, None) in got and len(got) == 13
    with pytest.raises(rdf.TurtleError):
        rdf.parse_turtle("e:a e:b e:c .")
    (tmp_path / "sub").mkdir()
    for name, body in (("a.ttl", t), ("sub/b-shapes.ttl", t), ("c.ttl", "broken {"), ("d-semantic.ttl", "@prefix e: <http://e/> . e:z e:p e:o .")):
        (tmp_path / name).write_text(body)
    triples, errors = rdf.load_triples(spark, str(tmp_path))
    assert errors.count() == 1 and triples.where("role = 'semantic'").count() == 1 and triples.where("role = 'data'").count() == 13


def test_constraints_find_each_fault(spark):
    cp, oa = rdf.CP, rdf.OA
    rows = [("s", rdf.RDF + "type", cp + "Source", "iri", None, None), ("f", rdf.RDF + "type", cp + "Fragment", "iri", None, None), ("f", rdf.RDFS + "label", "l", "literal", None, None), ("f", cp + "sourceLines", "x-y", "literal", None, None), ("f", oa + "hasTarget", "t", "bnode", None, None), ("f", oa + "hasTarget", "u", "bnode", None, None), ("c", rdf.RDF + "type", cp + "CiteSite", "iri", None, None), ("c", cp + "citingFile", "f", "literal", None, None), ("c", cp + "citingLine", "0", "literal", rdf.XSD + "integer", None), ("r", cp + "verificationStatus", "maybe", "literal", None, None)]
    got = {(r["node"], r["problem"]) for r in constraints.violations(spark.createDataFrame(rows, schemas.TRIPLES)).collect()}
    assert got == {("s", "too few values"), ("s", "neither a URL nor a parent"), ("f", "a value doesn't fit the pattern"), ("f", "too many values"), ("c", "a value is too small"), ("r", "a value is none of those allowed")}


def test_mdn():
    page = '---\ntitle: "Origin"\n---\n\nThe **`Origin`** {{Glossary("Request header", "request _header_")}} is {{domxref("Window/name")}}, {{unknown("x")}} and {{deprecated_inline}}.\n\n## See\n\n> [!NOTE]\n> Look at [this](/x) ![i](y.png) `{{keep}}` &amp; <b>x</b>.\n'
    out = payloads.mdn(page)
    assert out.startswith("# Origin\n") and "The Origin request header is name, ⟨macro⟩ and Deprecated." in out
    assert "Note:\nLook at this   {{keep}} &  x ." in out and payloads.mdn(page, "See").startswith("Note:")


def test_rfc():
    old = '<html><body><div id="content"><pre>\nNet Group\n\n                A Title of It\n\nAbstract\n\n   Words.\n<span class="h2"><a href="#section-1" id="section-1" class="selflink">1</a>.  Intro </span>\n   Text with a well-\n   known word.\n\nDoe  [Page 1]\n<span class="grey">RFC</span>\n   More.\n</pre></div></body></html>'
    from citeplane.operators.content import Document

    doc = Document(payloads.rfc(old))
    assert doc.title() == "A Title of It" and doc.heading_with_id("section-1") == "1. Intro"
    assert doc.extract("section", "§ 1") == "Text with a well-known word.\n\nMore."
    assert payloads.rfc("<p>x</p>") == "<p>x</p>" and "¶" not in payloads.rfc("<body><h1>a</h1><p>x<a class='pilcrow'>¶</a></p></body>")


def test_gutenberg(spark):
    page = "<h2>Book I</h2><p>" + "Sing, goddess. " * 8 + "</p><h2>Book II</h2><p>short</p><p>" + "Of arms and the man. " * 6 + "</p><div id='pg-footer'><h2>End</h2><p>" + "licence " * 20 + "</p></div>"
    assert [(n, t) for n, t, _ in payloads.chapters(page)] == [(1, "Book I"), (2, "Book II")]
    files = payloads.gutenberg_files(spark.createDataFrame([("5", page)], "key string, html string"))
    wanted = [("Aen. II", "5_ch002"), ("Metamorphoses I", "5_ch001"), ("chapter:1", "5_ch001"), ("book ii", None), ("a book ii b", None), ("nothing", None)]
    targets = spark.createDataFrame([("gutenberg", "5", w) for w, _ in wanted], "repo string, key string, location string")
    got = {r["location"]: r["name"] for r in repositories.choose(targets, files).collect()}
    assert got == {w: n for w, n in wanted if n}
    assert repositories.books(files).first()["body"].count("\n\n") == 1


@pytest.mark.parametrize(("location", "title"), [("Gen 3:1-6", "Genesis"), ("1 Thess 2:1-3", "First Thessalonians"), ("Song 1:2-4", "The Song of Solomon"), ("3 John 1:1-2", "Third Epistle of John"), ("Xyz 1:1-2", None)])
def test_bible(spark, location, title):
    titles = ["Genesis", "First Thessalonians", "The Song of Solomon", "Third Epistle of John"]
    files = spark.createDataFrame([("gutenberg", "10", t, t, i, "1:1 a\n1:2 b\n3:4 c") for i, t in enumerate(titles)], schemas.REPO_FILES)
    found = repositories.choose(spark.createDataFrame([("gutenberg", "10", location)], "repo string, key string, location string"), files).first()
    assert (found and found["name"]) == title


def test_wiki(spark):
    names = ["main", "Chapter_1", "Chapter_2", "Notes"]
    files = spark.createDataFrame([("wikisource", "B", n, None, None, n) for n in names], schemas.REPO_FILES)
    wanted = {"section:Notes": "Notes", "section:notes": "Notes", "section:zzz": None, "Chapter_2": "Chapter_2", "x: chapter 2": "Chapter_2", "qqq": "main", "": "Chapter_1"}
    targets = spark.createDataFrame([("wikisource", "B", w) for w in wanted], "repo string, key string, location string")
    assert {r["location"]: r["name"] for r in repositories.choose(targets, files).collect()} == {k: v for k, v in wanted.items() if v}
    entry = payloads.wiktionary_file("w", "==English==\n\n===Etymology===\nFrom {{der|en|la|tr=x|a word}} [[old|Old]] ''w'' {{x|en}}.\n\n===Noun===\nA thing.\n")
    assert payloads.wiktionary(entry, "English/Noun") == "A thing." and payloads.wiktionary(entry, "etymology") == "From la (a word) Old w {{x|en}}."
    assert payloads.wiktionary("x" * 6000, "other") == ""


@pytest.mark.parametrize("blocked", [True, False])
def test_search(spark, blocked):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone two three four five sixy"), (3, "")], "doc_id int, body string")
    quotes = spark.createDataFrame([(1, "one two three four five six"), (2, "two"), (3, ""), (4, "seven eight")], "item_id int, quote string")
    assert sorted(map(tuple, search.containment(docs, quotes, blocked=blocked).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_streaming(spark, tmp_path):
    from citeplane.streaming import drift

    source = str(tmp_path / "in")
    rows = [("https://b.org/7", BODY, 1), ("https://b.org/7#a", BODY, 2), ("https://b.org/7", BODY.replace("worst", "best"), 3)]
    spark.createDataFrame(rows, "url string, body string, n int").select("url", "body", F.timestamp_seconds("n").alias("ts")).write.parquet(source)
    stream = spark.readStream.schema("url string, body string, ts timestamp").parquet(source)
    got = []
    q = drift.reverify(stream, sources_file.parse(DATA).citations(spark), lambda r, n: got.append({v["urn"]: v["status"] for v in r.verdicts.collect()}), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert len(got) == 1 and set(got[0].values()) == {"failed"} and len(got[0]) == 5
    query = drift.changes(drift.versions(stream)).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["n"] for r in spark.table("changed").orderBy("n").collect()] == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    import yaml

    from citeplane.__main__ import main

    docs, path = str(tmp_path / "docs"), tmp_path / "s.yaml"
    spark.createDataFrame([("https://b.org/7", BODY)], schemas.DOCUMENTS).write.parquet(docs)
    path.write_text(yaml.safe_dump(DATA))
    assert main(["check", str(path), "--documents", docs, "--json"]) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["failed"]
    assert main(["validate", str(path)]) == 0 and main(["emit", str(path), "--format", "nt"]) == 0
    assert main(["locate", "https://b.org/7", "Call me Ishmael and nothing", "--documents", docs]) == 0
    assert "Part 2" in capsys.readouterr().out
    assert main(["locate", "https://b.org/7", "Call me Ishmael or nothing else at", "--documents", docs]) == 1
    assert main(["add", str(path), "--name", "Book 7", "https://b.org/7", "Call me Ishmael and nothing", "--documents", docs]) == 0
    assert len(yaml.safe_load(path.read_text())["sources"][0]["fragments"]) == 6
