"""Reports of a verification run. Frames can be written as they are; these render a run for a reader.

Findings are ordered in the cluster and come to the driver one partition at a time, so a report of any size can be
written; only ``as_json`` and ``as_text``, which return one value, hold all of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from io import StringIO
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from citeplane.operators import diagnosis
from citeplane.operators.verify import Report, summary
from citeplane.scratch import materialize

WIDTH = 70
SEVERITIES = ("failure", "warning")


def json_rows(report: Report) -> DataFrame:
    """One JSON line for each finding, for runs of any size: write it with ``.write.text``."""
    return report.findings.select(F.to_json(F.struct("check", "severity", "source", "label", "url", "urn", "reason", "hint", "cited_by")).alias("value"))


def _findings(report: Report, by_group: bool) -> Iterator[Row]:
    """Findings by check and severity; with ``by_group`` the largest groups of a source and URL first, which ``group`` counts."""
    rows = report.findings.join(F.broadcast(report.checks.select(F.col("name").alias("__n"), F.col("ord").alias("__o"))), F.col("check") == F.col("__n"))
    keys = ["__o", "severity"]
    if by_group:
        group = ["check", "severity", "source", "url"]
        # A group with many findings is counted first, and then meets its rows in a join that can split it.
        size = materialize(report.findings.groupBy(*group).agg(F.count("*").alias("group")))
        rows = rows.join(size.toDF(*(f"__{c}" for c in group), "group"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group])
        keys += [F.desc("group"), "source", "url"]
    yield from rows.orderBy(*keys, "ord", "url").drop("__o", "__n").toLocalIterator()


def _record(r: Row) -> dict:
    out = {k: r[k] for k in ("source", "label", "url", "urn", "reason")}
    if r["hint"] is not None:
        out["hint"] = r["hint"].asDict(True)
    if r["cited_by"]:
        out["cited_by"] = [s.asDict() for s in r["cited_by"]]
    return out


def write_json(report: Report, out: TextIO) -> bool:
    """Writes the report as one JSON value, finding by finding; whether the run has failed."""
    rows = _findings(report, False)
    row = next(rows, None)
    out.write('{"checks": [')
    for i, c in enumerate(report.checks.orderBy("ord").collect()):
        head = {"name": c["name"], "status": c["status"], "ok": c["ok"], "total": c["total"]}
        out.write(("," if i else "") + "\n" + json.dumps(head, ensure_ascii=False)[:-1])
        for severity in SEVERITIES:
            out.write(f', "{severity}s": [')
            first = True
            while row is not None and (row["check"], row["severity"]) == (c["name"], severity):
                out.write(("" if first else ",") + "\n  " + json.dumps(_record(row), ensure_ascii=False))
                first, row = False, next(rows, None)
            out.write("]")
        out.write("}")
    s = summary(report.checks).first().asDict()
    out.write('\n], "summary": ' + json.dumps(s) + "}\n")
    return bool(s["failed"])


def as_json(report: Report) -> dict:
    out = StringIO()
    write_json(report, out)
    return json.loads(out.getvalue())


def _shown(r: Row) -> Iterator[str]:
    """Lines of one finding."""
    yield f"           {r['label']}: {r['reason']}"
    if h := r["hint"]:
        yield from ("             " + x for x in diagnosis.render(diagnosis.Finding(h["source_text"], h["ratio"], h["kind"] or "", h["where"] or "", h["extra"], h["missing"])))
    yield from ("             cited by " + (s["file"] if s["line"] is None else f"{s['file']}:{s['line']}") for s in r["cited_by"])


def text_rows(report: Report) -> DataFrame:
    """(value) the checks, groups and findings of the rendered report in its order, made in the cluster: write it with ``.write.text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = ["\n".join(_shown(r)) for r in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shown, pa.string())], names=[*batch.schema.names[:-1], "value"])

    group = ["check", "severity", "source", "url"]
    rows = report.findings
    first = F.min_by("label", F.struct("ord", "url"))
    size = materialize(rows.groupBy(*group).agg(F.count("*").alias("group"), first.alias("label")))
    rows = rows.join(size.select(*(F.col(c).alias(f"__{c}") for c in group), "group"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group])
    keys = ["check", "severity", "group", "source", "url"]
    found = rows.select(*keys, F.lit(1).alias("place"), "ord", F.struct("label", "reason", "hint", "cited_by").alias("x"))
    found = found.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[:-1]) + ", value string")
    where = F.when((F.col("url") != "") & ~F.col("label").eqNullSafe(F.col("url")), F.concat(F.lit(" ("), "url", F.lit(")"))).otherwise("")
    heads = size.select(*keys, F.lit(0).alias("place"), F.lit("").alias("ord"), F.concat(F.lit("         "), "source", where, F.lit(" ("), F.col("group").cast("string"), F.lit(")")).alias("value"))
    checks = report.checks.select("name", F.col("ord").alias("__o"), F.concat(F.lit("\n  ["), "status", F.lit("] "), F.rpad("name", 40, "."), F.lit(" "), F.col("ok").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("value"))
    below = heads.unionByName(found).join(F.broadcast(checks.select("name", "__o")), F.col("check") == F.col("name")).drop("name")
    tops = checks.select("__o", *(F.lit(None).cast(below.schema[c].dataType).alias(c) for c in [*keys, "place", "ord"]), "value")
    return tops.unionByName(below.select(*tops.columns)).orderBy("__o", F.asc_nulls_first("severity"), F.desc("group"), "source", "url", "place", "ord").select("value")


def text_lines(report: Report, brief: bool = False, title: str = "Citation verification") -> Iterator[str]:
    rule = "=" * WIDTH
    yield from (rule, f"  {title}", rule)
    rows = iter(()) if brief else _findings(report, True)
    row = next(rows, None)
    for c in report.checks.orderBy("ord").collect():
        yield f"\n  [{c['status']}] {c['name']:.<40s} {c['ok']}/{c['total']}"
        group = None
        while row is not None and row["check"] == c["name"]:
            if group != (own := (row["severity"], row["source"], row["url"])):
                group = own
                where = f" ({row['url']})" if row["url"] and row["label"] != row["url"] else ""
                yield f"         {row['source']}{where} ({row['group']})"
            yield from _shown(row)
            row = next(rows, None)
    s = summary(report.checks).first()
    yield from (f"\n  {rule}", f"  Summary: {s['pass']} PASS, {s['fail']} FAIL, {s['warn']} WARN")
    if s["nothing_verified"]:
        yield "  NOTHING WAS VERIFIED: there are no fragments and no terms."
    why = "nothing was verified" if s["nothing_verified"] else "failures present" if s["failed"] else "warnings are not fatal" if s["warn"] else "all checks passed"
    yield from (f"  EXIT CODE: {int(s['failed'])} ({why})", f"  {rule}")


def as_text(report: Report, brief: bool = False, title: str = "Citation verification") -> str:
    return "\n".join(text_lines(report, brief, title))


def located_yaml(found: dict, url: str, label: str, quote: str) -> str:
    """A fragment for a sources file, from what ``locate`` found."""
    import yaml

    key = {"section": "section", "html": "selector", "plain-text": "lines"}.get(found["format"]) if found["locator"] else None
    fragment = {"label": label, "snippet": quote} | ({key: found["locator"]} if key else {})
    return yaml.safe_dump({"url": url, "fragments": [fragment]}, sort_keys=False, allow_unicode=True)


def located_turtle(found: dict, url: str, label: str, quote: str) -> str:
    """The same as Turtle: a source, its fragment and the target that was found."""
    from citeplane.sources import rdf, sources_file

    text = lambda x: json.dumps(x, ensure_ascii=False)  # noqa: E731  Turtle's strings have JSON's escapes
    kind = {"section": "cp:SectionSelector", "html": "oa:CssSelector"}.get(found["format"]) if found["locator"] else None
    source, fragment = (f"<{sources_file.NAMESPACE}{k}_{sources_file.slug(x)}>" for k, x in (("source", url), ("fragment", f"{url} {label}")))
    selectors = [f"[ a oa:TextQuoteSelector ; oa:exact {text(quote)} ]"] + ([f"[ a {kind} ; rdf:value {text(found['locator'])} ]"] if kind else [])
    lines = f" ;\n    cp:sourceLines {text(found['locator'])}" if found["format"] == "plain-text" and found["locator"] else ""
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in rdf.PREFIXES.items() if k in ("rdf", "rdfs", "oa", "schema", "cp"))
    return (
        f"{head}\n{source} a cp:Source ;\n    rdfs:label {text(url)} ;\n    schema:url {text(url)} .\n\n"
        f"{fragment} a cp:Fragment ;\n    rdfs:label {text(label)} ;\n    oa:motivatedBy oa:identifying{lines} ;\n"
        f"    oa:hasTarget [ a oa:SpecificResource ; oa:hasSource {source} ; oa:hasSelector {' , '.join(selectors)} ] .\n"
    )
