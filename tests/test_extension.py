"""What users add: repositories, formats, checks, configuration, fetching, and runs that take up where the last ended."""

from __future__ import annotations

import json
import re
import shutil

import pytest
from pyspark.sql import functions as F

from citeplane import api, config, report, schemas
from citeplane.connectors import DEFAULT, Connector
from citeplane.functions import text
from citeplane.operators import content, extract, verify
from citeplane.operators.outline import of_markdown
from citeplane.sources import fetch, rdf, sources_file

from .test_engine import BODY, DATA, one


def standard(key):
    return [f"https://standards.example/raw/{key}.txt"]


def one_file(key, bodies):
    return [("main", None, None, b) for b in bodies]


def shouted(body, location):
    return body.upper()


SEVENTH = Connector("standards", r"standards\.example/doc/(\d+)", rank=lambda location, name, title, number, alike: F.when(name == "main", 1), text=text.repository_text, render=shouted, mint=((r"^Standard (?P<n>\d+)$", "https://standards.example/doc/{n}"),), pages=standard, files=one_file)
REGISTRY = DEFAULT.with_connector(SEVENTH)


class Scripted:
    """Answers by address, in turn; the last one stays."""

    def __init__(self, answers, calls=None):
        self.answers, self.calls, self.given = answers, calls if calls is not None else [], {}

    def get(self, url):
        self.calls.append(url)
        listed = self.answers.get(url, [fetch.Answer(404)])
        at = self.given[url] = min(self.given.get(url, -1) + 1, len(listed) - 1)
        if isinstance(listed[at], Exception):
            raise listed[at]
        return listed[at]


def page(url, body):
    return {url: [fetch.Answer(200, {"content-type": "text/plain; charset=latin-1"}, body.encode("latin-1"))]}


def test_a_seventh_repository(spark):
    assert one(spark, REGISTRY.claimed_by(F.col("u")), u="https://standards.example/doc/12#a") == "standards"
    assert one(spark, REGISTRY.key_of(F.col("u")), u="https://standards.example/doc/12#a") == "12"
    assert one(spark, REGISTRY.minted_url(F.col("n")), n="Standard 12") == "https://standards.example/doc/12"
    assert one(spark, DEFAULT.claimed_by(F.col("u")), u="https://standards.example/doc/12") is None
    assert [c.name for c in REGISTRY.without("rfc")] == ["archive", "gutenberg", "wikisource", "wiktionary", "mdn", "standards"]
    for bad in (lambda: REGISTRY.with_connector(SEVENTH), lambda: Connector("x", "no group")):
        with pytest.raises(ValueError):
            bad()
    none = [None] * 8
    sources = spark.createDataFrame([("s", "Standard", "https://standards.example/doc/12", None, None, *none), ("t", "Gone", "https://standards.example/doc/13", None, None, *none)], schemas.SOURCES)
    fragments = spark.createDataFrame([("urn:1", "s", "f", "THE VALUE IS THIRTY DEGREES", None, None, None, None, None, None), ("urn:2", "t", "g", "the value is thirty degrees", None, None, None, None, None, None)], schemas.FRAGMENTS)
    targets = spark.createDataFrame([("standards", "12"), ("standards", "13"), ("standards", "12")], "repo string, key string")
    answers = page("https://standards.example/raw/12.txt", "In short, the value is thirty degrees at most.")
    files, crawls = fetch.crawl(targets, lambda: Scripted(answers), fetch.Policy(interval=0), REGISTRY)
    assert sorted(map(tuple, crawls.collect())) == [("standards", "12", "ok", ""), ("standards", "13", "not_found", "status 404")] and files.count() == 1
    world = verify.World(spark.createDataFrame([], schemas.DOCUMENTS), None, files, crawls)
    got = api.check(spark, verify.Citations(sources, fragments), world, verify.Options(registry=REGISTRY))
    assert {r["urn"]: r["status"] for r in got.verdicts.collect()} == {"urn:1": "verified", "urn:2": "failed"}
    assert {r["name"]: r["status"] for r in got.checks.collect()}[verify.REPOS] == "FAIL"
    assert api.body_of(spark, "https://standards.example/doc/12", world.documents, files, crawls, verify.Options(registry=REGISTRY)).startswith("IN SHORT")


def test_a_format_of_ones_own(spark):
    ini = content.Format("ini", "text/x-ini", lambda b: b.startswith("["), title=lambda b: b[1 : b.index("]")], sections=lambda b: of_markdown(re.sub(r"(?m)^\[(.+)\]$", r"# \1\n", b)), extract=lambda b, key: dict(x.split("=", 1) for x in b.split("\n") if "=" in x).get(key, ""), locate=lambda b, q: next(((x.split("=")[0], x) for x in b.split("\n") if q in x), None))
    body = "[colours]\nsky=a long word for blue\n[sizes]\nbig=a long word for huge\n"
    doc = content.Document(body, (ini,))
    assert doc.kind == "ini" and doc.title() == "colours" and doc.extract("text/x-ini", "sky") == "a long word for blue"
    assert doc.extract("section", "sizes") == "big=a long word for huge" and doc.locate("word for huge") == ("ini", "big", "big=a long word for huge")
    assert content.Document(body).kind == "plain-text" and content.Document("# x", (ini,)).kind == "markdown" and doc.extract("text/plain", "2-2").startswith("sky=")
    targets = spark.createDataFrame([("d", "", "big", "", "u")], "doc_key string, format string, locator string, anchor string, url string")
    docs = spark.createDataFrame([("d", body, None, None)], "doc_key string, body string, miss string, miss_reason string")
    assert extract.extract(targets, docs, (ini,)).first()["text"] == "a long word for huge"


def cited(spark):
    return sources_file.parse(DATA).citations(spark)


def test_checks_of_ones_own(spark):
    def licensed(citations, world, resolved):
        return citations.sources.select((F.col("label") == "Book 7").alias("ok"), "label", F.col("url"), F.lit("no license is given").alias("reason"))

    world = verify.World(spark.createDataFrame([("https://b.org/7", BODY)], schemas.DOCUMENTS))
    got = api.check(spark, cited(spark), world, verify.Options(custom=(("Licences", licensed),)))
    last = got.checks.orderBy(F.desc("ord")).first()
    assert (last["name"], last["status"], last["ok"], last["total"], last["failures"]) == ("Licences", "FAIL", 1, 3, 2)
    assert got.findings.where("check = 'Licences'").select("label", "reason", "severity", "source").distinct().count() == 2
    assert "no license is given" in report.as_text(got) and [c["name"] for c in report.as_json(got)["checks"]][-1] == "Licences"


def test_only_what_is_new_is_parsed(spark):
    docs = [("https://b.org/7", BODY)]
    world = lambda d: verify.World(spark.createDataFrame(d, schemas.DOCUMENTS))
    first = api.check(spark, cited(spark), world(docs))
    # Outcomes that say something else than the document does are taken as they are, so they weren't made again.
    marked = first.outcomes.withColumn("text", F.concat("text", F.lit(" (known)")))
    again = api.check(spark, cited(spark), world(docs), known=marked)
    assert again.outcomes.where("text like '% (known)'").count() == first.outcomes.where("text is not null").count() > 0
    changed = api.check(spark, cited(spark), world([(docs[0][0], BODY.replace("worst", "best"))]), known=marked)
    held = changed.outcomes.where("text like '% (known)'")
    assert held.where("doc_key = 'url:https://b.org/7'").count() == 0 and {r["status"] for r in changed.verdicts.collect()} == {"failed"}


def test_asking_again_and_pacing():
    now, slept = [0.0], []
    pace = fetch.Pace(2.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    policy = fetch.Policy(interval=2.0, tries=3, pause=1.0, longest=50, hops=2)
    ask = lambda answers, url="https://h/a": fetch.ask(Scripted(answers), url, pace, policy, lambda: 0.0)
    got = ask({"https://h/a": [fetch.Answer(503, {"retry-after": "9"}), OSError("reset"), fetch.Answer(200, {}, "né".encode())]})
    assert (got["body"], got["status"], got["chain"]) == ("né", 200, []) and slept == [9.0, 2.0]
    assert ask({"https://h/a": [OSError("down")]})["status"] is None and ask({"https://h/a": [OSError("down")]})["reason"] == "down"
    for status, tries in ((404, 1), (403, 1), (410, 1), (400, 1), (429, 3), (500, 3)):
        client = Scripted({"https://h/a": [fetch.Answer(status)]})
        assert fetch.ask(client, "https://h/a", pace, policy)["body"] is None and len(client.calls) == tries
    hop = lambda to, status=301: [fetch.Answer(status, {"location": to})]
    got = ask({"https://h/a": hop("/b"), "https://h/b": hop("https://i/c", 302), **page("https://i/c", "x")})
    assert (got["final_url"], [c["url"] for c in got["chain"]], got["body"]) == ("https://i/c", ["https://h/a", "https://h/b"], "x")
    assert ask({"https://h/a": hop("/a")})["reason"] == "too many redirects"
    assert fetch.ask(Scripted(page("https://h/a", "xyz")), "https://h/a", pace, fetch.Policy(most_bytes=2))["reason"] == "more than 2 bytes"
    pace.penalize("z", 5)
    pace.penalize("z", 3)
    assert pace.after["z"] == now[0] + 5
    assert fetch.retry_after("7", 0) == 7 and fetch.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 10) == 50 and fetch.retry_after("soon", 0) is None and fetch.retry_after(None, 0) is None
    with pytest.raises(OSError):
        fetch.HttpClient().get("file:///etc/passwd")


def test_a_table_of_fetches(spark, tmp_path):
    path, asked = str(tmp_path / "fetches"), tmp_path / "asked"
    asked.mkdir()

    class Counting(Scripted):
        def get(self, url):
            (asked / str(len(list(asked.iterdir())))).write_text(url)
            return super().get(url)

    answers = page("https://b.org/7", BODY) | {"https://b.org/old": [fetch.Answer(301, {"location": "/7"})]}
    wanted = spark.createDataFrame([("https://b.org/7#x",), ("https://b.org/7",), ("https://b.org/old",), ("https://b.org/none",), (None,), ("",)], "url string")
    go = lambda **k: {r["url"]: r for r in fetch.refresh(wanted.coalesce(1), path, lambda: Counting(answers), fetch.Policy(interval=0), **k).collect()}
    got = go()
    assert set(got) == {"https://b.org/7", "https://b.org/old", "https://b.org/none"} and got["https://b.org/none"]["status"] == 404 and got["https://b.org/none"]["body"] is None
    assert got["https://b.org/old"]["final_url"] == "https://b.org/7" and got["https://b.org/old"]["chain"][0]["status"] == 301
    n = len(list(asked.iterdir()))
    go()
    assert len(list(asked.iterdir())) == n + 1  # only what couldn't be had is asked for again
    go(force=True)
    assert len(list(asked.iterdir())) == 2 * n + 1
    documents, fetches = fetch.world_tables(fetch.held(spark, path))
    checked = api.check(spark, cited(spark), verify.World(documents, fetches))
    assert {r["status"] for r in checked.verdicts.collect()} == {"verified", "failed"}
    assert api.moved_to("https://b.org/old#x", fetches) == "https://b.org/7" and api.moved_to("https://b.org/7", fetches) is None
    shutil.rmtree(path)
    assert fetch.held(spark, path).count() == 0


def test_configuration(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("""
[check]
strict_repos = true
[fetch]
interval = 2
tries = 7
[claims]
rfc = ''
mdn = 'mdn\\.example/(\\w+)'
[repositories.standards]
claim = 'standards\\.example/doc/(\\d+)'
page = 'https://standards.example/raw/{key}.txt'
names = { '^Standard (?P<n>\\d+)$' = 'https://standards.example/doc/{n}' }
""")
    got = config.load(str(path))
    assert got.options.strict_repos and not got.options.strict_redirects and (got.policy.interval, got.policy.tries) == (2.0, 7)
    assert [c.name for c in got.options.registry] == ["standards", "archive", "gutenberg", "wikisource", "wiktionary", "mdn"]
    assert got.options.registry["mdn"].claim.startswith("mdn") and got.options.registry["standards"].pages("3") == ["https://standards.example/raw/3.txt"]
    assert config.load(None).options == verify.Options()
    for bad in ({"x": {}}, {"check": {"crawls": True}}, {"check": {"crawl": 1}}, {"fetch": {"tries": 1.5}}, {"claims": {"no": "(x)"}}, {"claims": {"rfc": "("}}, {"repositories": {"a": {}}}, {"repositories": {"a": {"claim": "x"}}}, {"repositories": {"rfc": {"claim": "(x)"}}}):
        with pytest.raises((config.BadConfiguration, ValueError)):
            config.parse(bad)


def test_texts_and_located_blocks(spark):
    docs = spark.createDataFrame([("https://b.org/7", BODY), ("https://b.org/8", "x" * 9000)], schemas.DOCUMENTS)
    wanted = spark.createDataFrame([("https://b.org/7", "section", "Part 2"), ("https://b.org/8", None, None), ("https://b.org/9", None, None)], "url string, format string, locator string")
    got = {r["url"]: r for r in api.texts(spark, wanted, docs).collect()}
    assert got["https://b.org/7"]["text"] == "Call me Ishmael and nothing else at all." and got["https://b.org/8"]["text"].endswith("[4000 more chars]") and got["https://b.org/9"]["status"] == "unavailable"
    none, prefixes = rdf.empty(spark)
    assert none.count() == 0 and prefixes["oa"] == rdf.OA
    for kind, locator in (("section", "Part 2"), ("plain-text", "1-2"), ("html", 'p[title="a"]'), ("plain-text", None)):
        block = report.located_turtle({"format": kind, "locator": locator}, "https://b.org/7", 'a "label"', 'Call me "Ishmael"\nnow')
        triples = spark.createDataFrame(rdf.parse_turtle(block), schemas.TRIPLES)
        back = rdf.citations_of(triples).fragments.first()
        assert (back["snippet"], back["label"], back[{"section": "section", "html": "selector", "plain-text": "lines"}[kind]]) == ('Call me "Ishmael"\nnow', 'a "label"', locator)
    assert json.loads(json.dumps(prefixes))
