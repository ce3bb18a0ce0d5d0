"""Repository connectors: what claims a URL, how its key and files are read, and what it can be asked.

A connector is a value; a ``Registry`` is an ordered list of them, handed to a run by ``Options.registry``. The six that
come along are made of the same parts as one that a user adds. All but ``render`` are Column expressions, so that
claiming, routing and choosing files stay inside the plan; ``render`` and the pages that ``crawl`` asks for run in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import partial
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeplane import fixed
from citeplane.functions import text, urls
from citeplane.sources import payloads

#: Rank of a file for a location: (location, name, title, number, how many titles are like it) -> number, null: not it.
Rank = Callable[[Column, Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class Connector:
    """``claim`` is searched in the URL without its anchor and its first group is the raw key; a null ``key`` yields none.

    ``pages`` gives the addresses that a crawl of a key asks for, and ``files`` makes files (name, title, number, body) of
    their bodies. ``mint`` are families of names with the URL that each stands for. ``text`` is what of a body counts at a
    location, ``render`` turns the payload into text, and ``whole`` says that an empty location is all files in a row.
    """

    name: str
    claim: str
    key: Callable[[Column], Column] | None = None
    rank: Rank | None = None
    text: Callable[[Column, Column], Column] | None = None
    render: Callable[[str, str], str] | None = None
    whole: bool = False
    mint: tuple[tuple[str, str], ...] = ()
    pages: Callable[[str], Iterable[str]] | None = None
    files: Callable[[str, list[str]], Iterable[tuple[str, str | None, int | None, str]]] | None = None
    supersedes: bool = False

    def __post_init__(self):
        if re.compile(self.claim).groups < 1:
            raise ValueError(f"the claim of {self.name} captures no key")

    @property
    def crawls(self) -> bool:
        return self.pages is not None


class Registry:
    """Connectors in order: the first whose claim is found in a URL owns it."""

    def __init__(self, connectors: Iterable[Connector]):
        self.connectors = tuple(connectors)
        names = [c.name for c in self.connectors]
        if len(set(names)) < len(names):
            raise ValueError(f"a connector's name is taken: {sorted(n for n in set(names) if names.count(n) > 1)}")

    def __iter__(self):
        return iter(self.connectors)

    def __getitem__(self, name: str) -> Connector:
        return next(c for c in self.connectors if c.name == name)

    def with_connector(self, connector: Connector, first: bool = False) -> Registry:
        """A registry with one more, before the others or behind them."""
        return Registry((connector, *self.connectors) if first else (*self.connectors, connector))

    def without(self, *names: str) -> Registry:
        return Registry(c for c in self.connectors if c.name not in names)

    def _by(self, subject: Column, value: Callable[[Connector], Column | None], test: Callable[[Connector], Column]) -> Column:
        out = None
        for c in self.connectors:
            if (v := value(c)) is not None:
                out = F.when(test(c), v) if out is None else out.when(test(c), v)
        return F.lit(None).cast("string") if out is None else out

    def claimed_by(self, url: Column) -> Column:
        url = urls.document_url(url)
        return self._by(url, lambda c: F.lit(c.name), lambda c: url.rlike(c.claim))

    def key_of(self, url: Column) -> Column:
        """The key of the claimed document; null where the URL yields none."""
        url = urls.document_url(url)
        raw = lambda c: text.blank_to_null(F.regexp_extract(url, c.claim, 1))
        return self._by(url, lambda c: c.key(raw(c)) if c.key else raw(c), lambda c: url.rlike(c.claim))

    def minted_url(self, name: Column) -> Column:
        """The URL of the first family that the name belongs to; null where it belongs to none."""
        return urls.minted_url(name, tuple(f for c in self.connectors for f in c.mint))

    def rank_of(self, repo: Column, *args: Column) -> Column:
        """The rank of a file, by its repository; those without a rule have one file for every location."""
        return F.coalesce(self._by(repo, lambda c: F.coalesce(c.rank(*args), F.lit(-1)) if c.rank else F.lit(0), lambda c: repo == c.name), F.lit(0))

    def text_of(self, repo: Column, body: Column, location: Column) -> Column:
        return F.coalesce(self._by(repo, lambda c: F.coalesce(c.text(body, location), F.lit("")) if c.text else None, lambda c: (repo == c.name) & body.isNotNull()), body)

    @property
    def rendered(self) -> dict[str, Callable[[str, str], str]]:
        return {c.name: c.render for c in self.connectors if c.render}

    @property
    def crawlers(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.connectors if c.crawls)

    @property
    def books(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.connectors if c.whole)


# Which file a location names


def gutenberg_rank(location: Column, name: Column, title: Column, number: Column, alike: Column) -> Column:
    """By book of the Bible, by book of a classic, by chapter number, by a title that only one chapter has."""
    title = F.lower(F.coalesce(title, F.lit("")))
    books = F.create_map(*(F.lit(x) for kv in fixed.BIBLE_BOOKS.items() for x in kv))
    book = books[F.lower(F.trim(F.regexp_extract(location, fixed.BIBLE_REFERENCE, 1)))]
    classic = F.regexp_extract(location, fixed.CLASSICAL_REFERENCE, 2)
    in_title = (classic != "") & F.regexp_like(title, F.concat(F.lit(r"(?i)\bbook\s+"), F.lower(classic), F.lit(r"\b")))
    chapter = F.regexp_extract(location, fixed.CHAPTER_NUMBER, 1).try_cast("int")
    return F.when(F.trim(location) != "", F.when(F.contains(title, book), 1).when(in_title, 2).when(number == chapter, 3).when(alike == 1, 4))


def wikisource_rank(location: Column, name: Column, title: Column, number: Column, alike: Column) -> Column:
    """Exact name, then likeness to what follows a colon, then likeness to all of it, then the main page."""
    section = F.trim(F.regexp_extract(location, r"(?s)\Asection:(.+)", 1))
    low, main = F.lower(name), name == "main"
    like = lambda s: ~main & (F.contains(low, s) | F.contains(s, low))
    after = text.file_slug(F.trim(F.regexp_replace(location, r"(?s)\A[^:]*:", "")))
    named = F.when(name == section, 1).when(low == F.lower(section), 2)
    return F.when(section != "", named).when(name == location, 1).when(F.contains(location, F.lit(":")) & like(after), 2).when(like(text.file_slug(location)), 3).when(main, 4)


def verses(body: Column, location: Column) -> Column:
    """The verses, or the lines, that a location names in a chapter; all of it where it names none."""
    chapter, first, last = (F.regexp_extract(location, fixed.BIBLE_VERSES, i).try_cast("int") for i in (1, 2, 3))
    of = lambda x, i: F.regexp_extract(x, fixed.BIBLE_VERSE_LINE, i).try_cast("int")
    kept = F.filter(F.split(body, "\n"), lambda x: (of(x, 1) == chapter) & of(x, 2).between(first, last))
    lines = F.regexp_extract(location, r"lines:(\d+-\d+)", 1)
    return F.when(chapter.isNotNull(), F.array_join(kept, "\n")).when(lines != "", text.line_range(body, lines)).otherwise(body)


# The pages that a crawl asks for, and the files that their bodies make


def _one_file(name: str, key: str, bodies: list[str]):
    return [(name, None, None, bodies[0])] if bodies else []


def _chapters(key: str, bodies: list[str]):
    return [(f"{key}_ch{n:03d}", title, n, body) for page in bodies for n, title, body in payloads.chapters(page)]


def _entry(key: str, bodies: list[str]):
    return [("main", None, None, payloads.wiktionary_file(key, body)) for body in bodies]


#: Public addresses that a crawl of a key asks for.
PAYLOADS = {
    "archive": "https://archive.org/download/{key}/{key}_djvu.txt",
    "gutenberg": "https://www.gutenberg.org/cache/epub/{key}/pg{key}-images.html",
    "mdn": "https://raw.githubusercontent.com/mdn/content/main/files/{key}/index.md",
    "rfc": "https://www.rfc-editor.org/rfc/{key}.html",
    "wikisource": "https://en.wikisource.org/w/index.php?title={key}&action=raw",
    "wiktionary": "https://en.wiktionary.org/w/index.php?title={key}&action=raw",
}
_CLAIMS, _KEYS = dict(fixed.CLAIMS), {
    "mdn": urls.mdn_key,
    "rfc": lambda raw: F.when(F.lower(raw).rlike(fixed.RFC_SAFE_KEY), F.lower(raw)),
    "wikisource": urls.decoded_key,
    "wiktionary": urls.decoded_key,
}
_RANKS = {"gutenberg": gutenberg_rank, "wikisource": wikisource_rank}
_TEXTS = {"gutenberg": verses, "archive": text.repository_text, "wikisource": text.repository_text}
_FILES = {"gutenberg": _chapters, "wiktionary": _entry}


def _pages(template: str, key: str) -> list[str]:
    return [template.format(key=quote(key, safe="/"))]


def _shipped(name: str) -> Connector:
    template = PAYLOADS.get(name)
    return Connector(
        name, _CLAIMS[name], _KEYS.get(name), _RANKS.get(name), _TEXTS.get(name), payloads.RENDERED.get(name), name == "gutenberg",
        tuple(f for f in fixed.FAMILIES if re.search(_CLAIMS[name], re.sub(r"\{\w+\}", "1", f[1]))),
        partial(_pages, template) if template else None, _FILES.get(name, partial(_one_file, "main")), name in urls.SUPERSESSION,
    )


DEFAULT = Registry(map(_shipped, _CLAIMS))


def with_claim(registry: Registry, name: str, claim: str) -> Registry:
    """The registry with another claim for one of its connectors, as a configuration may say."""
    return Registry(replace(c, claim=claim) if c.name == name else c for c in registry)
