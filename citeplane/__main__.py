"""Command line: check, validate, locate, add, emit and fetch. Documents come from a Parquet table (url, body)."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    from citeplane.session import ship

    return ship(SparkSession.builder.appName("citeplane").getOrCreate())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("citeplane", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check")
    check.add_argument("path")
    check.add_argument("--documents", required=True)
    for table in ("fetches", "files", "crawls", "supersessions", "known", "config"):
        check.add_argument(f"--{table}")
    for flag in ("strict-redirects", "strict-repos", "strict-supersession", "no-crawl", "json", "summary", "shapes"):
        check.add_argument(f"--{flag}", action="store_true")
    commands.add_parser("validate").add_argument("path")
    emit = commands.add_parser("emit")
    emit.add_argument("path")
    emit.add_argument("--format", default="turtle")
    emit.add_argument("--output")
    for name in ("locate", "add"):
        c = commands.add_parser(name)
        if name == "add":
            c.add_argument("path")
            c.add_argument("--name", required=True)
            c.add_argument("--label")
        else:
            c.add_argument("--format", choices=("yaml", "turtle"), default="yaml")
        c.add_argument("url")
        c.add_argument("snippet")
        for table in ("fetches", "files", "crawls", "config"):
            c.add_argument(f"--{table}")
        c.add_argument("--documents", required=True)
    fetch = commands.add_parser("fetch", help="ask for the documents that are not in a table yet, and add them to it")
    fetch.add_argument("path")
    fetch.add_argument("table")
    fetch.add_argument("--force", action="store_true")
    fetch.add_argument("--config")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from citeplane import api, config, report
    from citeplane.operators import constraints
    from citeplane.operators.verify import World, summary
    from citeplane.sources import rdf, sources_file

    spark = _session()
    settings = config.load(getattr(a, "config", None))
    table = lambda p: spark.read.parquet(p) if p else None
    if a.command == "check":
        world = World(table(a.documents), table(a.fetches), table(a.files), table(a.crawls), table(a.supersessions))
        given = {k: v for k, v in (("strict_redirects", a.strict_redirects), ("strict_repos", a.strict_repos), ("strict_supersession", a.strict_supersession)) if v} | ({"crawl": False} if a.no_crawl else {})
        got = api.check(spark, api.load(spark, a.path), world, replace(settings.options, **given), a.shapes, table(a.known))
        if a.json:
            return int(report.write_json(got, sys.stdout))
        for line in report.text_lines(got, a.summary):
            print(line)
        return int(summary(got.checks).first()["failed"])
    if a.command == "fetch":
        from citeplane.operators import resolve
        from citeplane.sources import fetch

        cited = resolve.chain(*(lambda c: (c.fragments, c.sources))(api.load(spark, a.path)), registry=settings.options.registry)
        got = fetch.refresh(cited.where("kind = 'fetcher'").select("url"), a.table, policy=settings.policy, force=a.force)
        lost = got.where("body is null").count()
        print(f"{got.count() - lost} documents, {lost} that could not be had")
        return int(lost > 0)
    if a.command == "validate":
        triples = rdf.citation_triples(api.load(spark, a.path)) if a.path.endswith((".yaml", ".yml")) else rdf.load_triples(spark, a.path)[0]
        if triples.isEmpty():
            print("nothing to validate", file=sys.stderr)
            return 1
        bad = 0
        for r in constraints.violations(triples).orderBy("shape", "node", "path", "problem").toLocalIterator():
            print(f"{r['shape']}: {r['node']} {r['path']}: {r['problem']}")
            bad = 1
        return bad
    if a.command == "emit":
        triples = rdf.citation_triples(api.load(spark, a.path))
        if triples.isEmpty():
            print("nothing to emit", file=sys.stderr)
            return 1
        out = "\n".join(r["value"] for r in rdf.serialize(triples, a.format).toLocalIterator())
        Path(a.output).write_text(out + "\n", encoding="utf-8") if a.output else print(out)
        if not api.default_identifiers(triples).isEmpty():
            print("identifiers are of the shared default namespace; a base in the file makes them your own", file=sys.stderr)
        return 0
    body = api.body_of(spark, a.url, table(a.documents), table(a.files), table(a.crawls), settings.options)
    if body is None:
        print(f"no document of {a.url}", file=sys.stderr)
        return 1
    if moved := api.moved_to(a.url, table(a.fetches)):
        print(f"{a.url} leads to {moved}: what is located is that document; cite it by its own URL", file=sys.stderr)
    from citeplane.operators import content, diagnosis, locate

    found = locate.find(content.Document(body, settings.options.formats), a.snippet)
    if found["found_by"] == "none":
        if h := found["hint"]:
            print("\n".join(diagnosis.render(diagnosis.Finding(**{k: v for k, v in h.items() if k != "percent"}))))
        return 1
    label = (a.command == "add" and a.label) or " ".join(a.snippet.split()[:5]) + ("..." if len(a.snippet.split()) > 5 else "")
    if found["ambiguous"]:
        print(f"the quote stands in {found['ambiguous']} sections", file=sys.stderr)
    if a.command == "locate":
        print((report.located_turtle if a.format == "turtle" else report.located_yaml)(found, a.url, label, a.snippet), end="")
        return 0
    import yaml

    key = {"section": "section", "html": "selector", "plain-text": "lines"}.get(found["format"]) if found["locator"] else None
    path = Path(a.path)
    data = sources_file.add_fragment(yaml.safe_load(path.read_text(encoding="utf-8")), a.name, {"label": label, "snippet": a.snippet} | ({key: found["locator"]} if key else {}), a.url)
    path.write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
