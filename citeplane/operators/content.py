"""Formats of documents: detection, text, title, extraction of a target, and location of a quote."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from citeplane import fixed
from citeplane.operators import markup, outline
from citeplane.operators.outline import NoSuchSection, Section, squeeze

HTML, MARKDOWN, WIKITEXT, PLAIN = "html", "markdown", "wikitext", "plain-text"
_OPENING, _COMMENTS = re.compile(fixed.HTML_OPENING_TAG), re.compile(fixed.LEADING_COMMENTS)
_LINES = re.compile(r"(\d+)-(\d+)")


def looks_like_html(body: str) -> bool:
    head = body[:1000].lstrip().lower()
    after = head[m.end() :] if (m := _COMMENTS.match(head)) else head
    return head.startswith(("<html", "<!doctype")) or bool(_OPENING.match(after)) or "<body" in head or "<head" in head


def detect(body: str) -> str:
    if looks_like_html(body):
        return HTML
    if re.search(fixed.MARKDOWN_SIGN, body):
        return MARKDOWN
    if re.search(fixed.WIKITEXT_SIGN, body) or any(x in body[:2000] for x in ("[[", "{{")):
        return WIKITEXT
    return PLAIN


def named(name: str | None) -> str | None:
    """A format by its own name or its media type."""
    return name if name in fixed.MIME else next((k for k, v in fixed.MIME.items() if v == name), None)


@dataclass(frozen=True)
class Format:
    """A format that a user adds: those before it in order are asked first, and the four that come along last.

    ``claims`` says whether a body is of it. The others take the body: its text, its title, its sections (null: it has
    none), what a locator names (empty: nothing) and the locator of a quote with the text that was matched.
    """

    name: str
    mime: str
    claims: Callable[[str], bool]
    text: Callable[[str], str] = str
    title: Callable[[str], str] = lambda body: ""
    sections: Callable[[str], Section | None] = lambda body: None
    extract: Callable[[str, str], str] = lambda body, locator: ""
    locate: Callable[[str, str], tuple[str, str] | None] = lambda body, quote: None


class Document:
    """A body with what is parsed of it once: one per document, for all its targets."""

    def __init__(self, body: str, formats: tuple[Format, ...] = ()):
        self.body = body
        self.formats = {f.name: f for f in formats}
        self._kind: str | None = None
        self._tree: markup.Element | None = None
        self._outlines: dict[str, Section] = {}

    @property
    def kind(self) -> str:
        if self._kind is None:
            self._kind = next((f.name for f in self.formats.values() if f.claims(self.body)), None) or detect(self.body)
        return self._kind

    def named(self, name: str | None) -> str | None:
        """A format by its own name or its media type, if just one has that."""
        if name in self.formats:
            return name
        own = [f.name for f in self.formats.values() if f.mime == name]
        shipped = named(name)
        return (own[0] if len(own) == 1 and shipped is None else None) if own else shipped

    @property
    def tree(self) -> markup.Element:
        if self._tree is None:
            self._tree = markup.parse(self.body)
        return self._tree

    def sections(self, kind: str | None = None) -> Section | None:
        """Null for plain text, which has none."""
        kind = kind or self.kind
        if kind == PLAIN:
            return None
        if kind in self.formats:
            return self.formats[kind].sections(self.body)
        if kind not in self._outlines:
            self._outlines[kind] = outline.of_html(self.tree) if kind == HTML else outline.of_markdown(self.body) if kind == MARKDOWN else outline.of_wikitext(self.body)
        return self._outlines[kind]

    def text(self, kind: str | None = None) -> str:
        if (kind or self.kind) in self.formats:
            return self.formats[kind or self.kind].text(self.body)
        return markup.text_of(markup.content(self.tree)) if (kind or self.kind) == HTML else self.body

    def title(self, kind: str | None = None) -> str:
        kind = kind or self.kind
        if kind in self.formats:
            return self.formats[kind].title(self.body)
        if kind == PLAIN:
            return ""
        if kind == HTML:
            tag = self.tree.find("title")
            return squeeze("".join(_strings(tag))) if tag else ""
        if kind == MARKDOWN and (m := re.match(r"---[ \t\r]*\n(.*?)\n---\s*$", self.body, re.S | re.M)) and (t := re.search(r"(?m)^title:\s*(\S.*?)\s*$", m[1])):
            return squeeze(t[1]).strip("\"'")
        return next((s.title for s in self.sections(kind).parts), "")

    def heading_with_id(self, anchor: str) -> str | None:
        if self.kind != HTML:
            return None
        e = next((e for e in markup.content(self.tree).walk() if e.attrs.get("id") == anchor), None)
        return squeeze(markup.text_of(e)) if e is not None and e.tag in fixed.HEADING_TAGS else None

    def anchor_target(self, anchor: str) -> str | None:
        root = self.sections()
        return None if root is None else outline.of_anchor(root, anchor, self.heading_with_id(anchor))

    def _section(self, selector: str, kind: str) -> str:
        root = self.sections(kind)
        if root is None:
            raise NoSuchSection(f'"{selector}" needs sections, and {kind} has none; give a line range')
        return outline.follow(root, selector)

    def _by(self, kind: str, locator: str) -> str:
        if kind in self.formats:
            return self.formats[kind].extract(self.body, locator)
        if kind == HTML:
            return "\n\n".join(markup.text_of(e) for e in markup.select(self.tree, locator))
        if kind == PLAIN:
            return lines(self.body, locator)
        try:
            return self._section(locator, kind)
        except NoSuchSection:
            return ""

    def extract(self, kind: str | None, locator: str | None, strict: bool = True) -> str:
        """What a target names. ``kind`` is a format, a media type, or ``section``. Strict: nothing found is an error."""
        if kind == "section":
            return self._section(locator or "", self.kind)
        fmt = self.named(kind) or self.kind
        if not locator:
            return self.text(fmt)
        if _LINES.fullmatch(locator.strip()):
            return lines(self.body, locator)
        text = self._by(fmt, locator)
        if strict and not text and fmt != PLAIN:
            self._section(locator, fmt)
        return text

    def locate(self, quote: str, kind: str | None = None) -> tuple[str, str, str] | None:
        """(format, locator, matched text) of a quote."""
        fmt, quote = self.named(kind) or self.kind, squeeze(quote)
        if fmt in self.formats:
            found = self.formats[fmt].locate(self.body, quote)
            return (fmt, *found) if found else None
        if fmt == PLAIN:
            return locate_lines(self.body, quote)
        if fmt != HTML:
            found = outline.proven(self.sections(fmt), quote)
            return ("section", found, quote) if found else None
        held = [(e, t) for e in self.tree.walk() if e.tag in fixed.LOCATED_TAGS and quote in (t := squeeze(markup.text_of(e)))]
        for e, t in sorted(held, key=lambda x: -sum(1 for _ in x[0].ancestors())):
            selector = markup.path_to(e)
            try:
                found = markup.select(self.tree, selector)
            except markup.UnsupportedSelector:
                continue
            if quote in squeeze("\n\n".join(map(markup.text_of, found))):
                return HTML, selector, t
        return None

    def locate_section(self, quote: str) -> str | None:
        root = self.sections()
        return None if root is None else outline.proven(root, quote)


def _strings(e: markup.Element):
    for kid in e.kids:
        if isinstance(kid, str):
            yield kid
        else:
            yield from _strings(kid)


def lines(body: str, locator: str) -> str:
    """Lines N to M, counted from 1, both included."""
    m = _LINES.match(locator.strip())
    return "\n".join(body.split("\n")[max(0, int(m[1]) - 1) : int(m[2])]) if m else ""


def locate_lines(body: str, quote: str) -> tuple[str, str, str] | None:
    quote = squeeze(quote)
    rows = [(n, t) for n, line in enumerate(body.split("\n"), 1) if (t := squeeze(line))]
    at = " ".join(t for _, t in rows).find(quote) if quote else -1
    if at < 0:
        return None
    first = last = passed = 0
    for n, t in rows:
        if not first and passed + len(t) > at:
            first = n
        if passed < at + len(quote):
            last = n
        passed += len(t) + 1
    return PLAIN, f"{first}-{last}", squeeze(lines(body, f"{first}-{last}"))


@dataclass(frozen=True)
class Outcome:
    text: str
    status: str = "ok"
    reason: str = ""


def load(doc: Document | None, url: str, kind: str | None, locator: str | None, anchor: str) -> Outcome:
    """The outcome of one target: an anchor names the target where nothing else does; a miss never widens it."""
    if doc is None or not doc.body:
        return Outcome("", "unavailable", f"could not fetch {url}")
    if not locator and anchor and (found := doc.anchor_target(anchor)):
        kind, locator = "section", found
    try:
        return Outcome(doc.extract(kind, locator))
    except NoSuchSection as e:
        return Outcome("", "no_section", str(e))
    except markup.UnsupportedSelector as e:
        return Outcome("", "no_section", str(e))
