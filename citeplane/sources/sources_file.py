"""The sources file: a small control input of sources with their fragments, checked in full before anything runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import SparkSession

from citeplane import fixed, schemas
from citeplane.operators.verify import Citations

NAMESPACE = "urn:citeplane:"


class Refused(ValueError):
    """The file says something that can't be meant."""


def _text(value: object, what: str) -> str:
    if isinstance(value, bool | int | float | str):
        return str(value)
    raise Refused(f"{what} must be one piece of text; a {type(value).__name__} could never match a source")


def _known(entry: dict, allowed: frozenset[str], what: str) -> None:
    if unknown := sorted(set(map(str, entry)) - allowed):
        raise Refused(f"{what}: unknown key(s) {', '.join(unknown)}; known: {', '.join(sorted(allowed))}")


def slug(label: str) -> str:
    return re.sub(r"\W+", "_", label.lower().strip()).strip("_")


@dataclass(frozen=True)
class Pattern:
    """A family of names, and the source that a name of it stands for."""

    match: re.Pattern[str]
    template: dict[str, str]

    def mint(self, name: str) -> dict[str, str] | None:
        m = self.match.match(name)
        filled = m and {k: v or "" for k, v in m.groupdict().items()}
        return m and {k: t.format(**filled) for k, t in self.template.items()}


def _shipped() -> list[Pattern]:
    return [Pattern(re.compile(p), {"url": u}) for p, u in fixed.FAMILIES]


def patterns_of(declared: object, origin: str) -> list[Pattern]:
    """Declared patterns in order; the shipped ones come after them."""
    if declared is None:
        return _shipped()
    if not isinstance(declared, list):
        raise Refused(f"{origin}: patterns must be a list of match and source, not a {type(declared).__name__}")
    made = []
    for i, entry in enumerate(declared, 1):
        what = f"{origin}: patterns[{i}]"
        if not isinstance(entry, dict):
            raise Refused(f"{what} must be a mapping of match and source")
        _known(entry, frozenset(("match", "source")), what)
        source = entry.get("source")
        if "match" not in entry or not isinstance(source, dict) or not source.get("url"):
            raise Refused(f"{what} needs a match, and a source with a url")
        _known(source, fixed.SOURCE_KEYS - {"label", "fragments"}, f"{what}: source")
        try:
            text = str(entry["match"])
            match = re.compile(text)
        except re.error as e:
            raise Refused(f"{what}: bad regular expression: {e}") from None
        template = {k: _text(v, f"{what}: source.{k}") for k, v in source.items()}
        for k, t in template.items():
            try:
                used = [re.split(r"[.\[]", name)[0] for _, name, _, _ in Formatter().parse(t) if name is not None]
            except ValueError as e:
                raise Refused(f"{what}: source.{k} is no template: {e}") from None
            if lost := [u for u in used if u not in match.groupindex]:
                raise Refused(f"{what}: source.{k} uses {lost[0]}, which the match doesn't capture")
        made.append(Pattern(match, template))
    return [*made, *_shipped()]


def complete(entry: dict, patterns: list[Pattern]) -> dict | None:
    """The entry with its url; a pattern gives what it lacks, never what it has."""
    if entry.get("url"):
        return dict(entry)
    minted = next((m for p in patterns if (m := p.mint(str(entry.get("label", "")))) is not None), None)
    return None if minted is None else {**minted, **entry}


@dataclass
class Parsed:
    base: str = ""
    sources: list[tuple] = field(default_factory=list)
    fragments: list[tuple] = field(default_factory=list)
    cite_sites: list[tuple] = field(default_factory=list)
    patterns: list[Pattern] = field(default_factory=list)
    entries: dict[str, dict] = field(default_factory=dict)

    def citations(self, spark: SparkSession) -> Citations:
        return Citations(spark.createDataFrame(self.sources, schemas.SOURCES), spark.createDataFrame(self.fragments, schemas.FRAGMENTS), None, spark.createDataFrame(self.cite_sites, schemas.CITE_SITES))

    def resolve(self, name: str) -> dict | None:
        """The source that a name stands for: an entry, else what a pattern mints."""
        return self.entries.get(name) or complete({"label": name}, self.patterns)


def _base(value: object, origin: str) -> str:
    if value is None:
        return ""
    base = _text(value, f"{origin}: base").strip()
    if not re.match(r"https?://|urn:", base):
        raise Refused(f"{origin}: base must be an absolute IRI of yours, not {base!r}")
    if "#" in base.rstrip("#"):
        raise Refused(f"{origin}: base must not have a fragment already: {base!r}")
    return base


def parse(data: object, origin="<data>") -> Parsed:
    """Rows of a sources file, or a refusal."""
    if not isinstance(data, dict) or "sources" not in data:
        raise Refused(f"{origin}: a list of sources must be at the top")
    _known(data, fixed.TOP_KEYS, origin)
    out = Parsed(_base(data.get("base"), origin), patterns=patterns_of(data.get("patterns"), origin))
    head = out.base + ("" if out.base[-1] in "/:#" else "#") if out.base else NAMESPACE
    minted: dict[str, str] = {}

    def mint(kind: str, key: str, what: str) -> str:
        urn = f"{head}{kind}_{slug(key)}"
        if urn in minted:
            raise Refused(f"{what} appears twice" if minted[urn] == what else f"{minted[urn]} and {what} would both be {urn}; give them labels that differ in letters or digits")
        minted[urn] = what
        return urn

    ids: dict[str, str] = {}
    for entry in data["sources"] or ():
        if not isinstance(entry, dict) or not entry.get("label"):
            raise Refused(f"{origin}: each source needs a label")
        label = _text(entry["label"], "label")
        ids[label] = mint("source", label, f"source {label!r}")
    for raw in data["sources"] or ():
        label = _text(raw["label"], "label")
        what = f"source {label!r}"
        _known(raw, fixed.SOURCE_KEYS, what)
        entry = complete(raw, out.patterns)
        if entry is None:
            raise Refused(f"{what} has no url, and no pattern mints one from its label ({origin})")
        out.entries[label] = entry
        values = {k: _text(entry[k], f"{what}: {k}") for k in fixed.SOURCE_FIELDS if entry.get(k) is not None}
        if "type" in values:
            values["type"] = fixed.MIME.get(values["type"], values["type"])
        parent = entry.get("part_of")
        if parent is not None and _text(parent, f"{what}: part_of") not in ids:
            raise Refused(f"{what}: part_of names {parent!r}, which no source here is")
        out.sources.append((ids[label], label, values.get("url"), values.get("type"), ids[str(parent)] if parent is not None else None, *(values.get(k) for k in fixed.SOURCE_FIELDS[2:])))
        for frag in raw.get("fragments") or ():
            if not isinstance(frag, dict) or not frag.get("label"):
                raise Refused(f"each fragment of {what} needs a label")
            name = _text(frag["label"], "label")
            here = f"fragment {name!r} of {what}"
            _known(frag, fixed.FRAGMENT_KEYS, here)
            if all(frag.get(k) is None for k in ("snippet", "selector", "section")):
                raise Refused(f"{here} has no snippet, selector or section: it points at nothing and verifies nothing ({origin})")
            urn = mint("fragment", f"{label} {name}", here)
            cell = lambda k, frag=frag, here=here: None if frag.get(k) is None else _text(frag[k], f"{here}: {k}")
            out.fragments.append((urn, ids[label], name, *map(cell, ("snippet", "selector", "section", *fixed.FRAGMENT_FIELDS))))
            out.cite_sites += [(urn, *site) for site in _sites(frag.get("cited_by"), here)]
    return out


def _sites(listed: object, what: str) -> list[tuple[str, int | None]]:
    if listed is None:
        return []
    if not isinstance(listed, list):
        raise Refused(f"{what}: cited_by must be a list of places, even of one")
    out = []
    for i, site in enumerate(listed, 1):
        at = f"{what}: cited_by[{i}]"
        if not isinstance(site, dict):
            raise Refused(f"{at} must be a mapping with a file")
        _known(site, frozenset(("file", "line")), at)
        if not site.get("file"):
            raise Refused(f"{at} must name its file")
        line = site.get("line")
        if line is not None and (isinstance(line, bool) or not isinstance(line, int)):
            raise Refused(f"{at}: line must be a whole number")
        out.append((_text(site["file"], f"{at}: file"), line))
    return out


def load(spark: SparkSession, path: str) -> Parsed:
    """A YAML file from any place that Spark reads."""
    import yaml

    body = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return parse(yaml.safe_load(body), path)


def add_fragment(data: dict, name: str, fragment: dict, url: str | None = None) -> dict:
    """The data of a sources file with a fragment more: in the entry of that label or url, or in a new one."""
    if not isinstance(data, dict) or not isinstance(data.get("sources"), list):
        raise Refused("this is no sources file")
    entries = [dict(e) for e in data["sources"]]
    patterns = patterns_of(data.get("patterns"), "<data>")
    at = next((e for e in entries if e.get("label") == name), None) or next((e for e in entries if url and (complete(e, patterns) or {}).get("url") == url), None)
    if at is None:
        at = {"label": name} | ({"url": url} if url else {})
        if complete(at, patterns) is None:
            raise Refused(f"{name!r} is no entry, and no pattern mints its url; give one")
        entries.append(at)
    at["fragments"] = [*(at.get("fragments") or ()), fragment]
    made = {**data, "sources": entries}
    parse(made)
    return made
