"""Configuration: a TOML file that sets a run's options, the pace of fetching, and further repositories, without code.

    [check]
    strict_redirects = true

    [fetch]
    interval = 2.0

    [claims]                       # other patterns for repositories that come along; "" takes one out
    rfc = 'rfc-editor\\.org/rfc/(rfc\\d+)'

    [repositories.standards]       # one more, of a file for each key
    claim = 'standards\\.example/doc/(\\d+)'
    page = 'https://standards.example/raw/{key}.txt'
    names = { '^Standard (?P<n>\\d+)$' = 'https://standards.example/doc/{n}' }

What a file leaves out has its default; an unknown name is refused, so that a typing error can't pass for a setting.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from functools import partial

from citeplane.connectors import DEFAULT, Connector, Registry, with_claim
from citeplane.functions import text
from citeplane.operators.verify import Options
from citeplane.sources.fetch import Policy

#: Options that a file can set; the others hold code.
SETTABLE = frozenset({"strict_redirects", "strict_repos", "strict_supersession", "crawl", "fetcher"})


class BadConfiguration(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    options: Options = field(default_factory=Options)
    policy: Policy = field(default_factory=Policy)


def _known(given: Iterable[str], allowed: Iterable[str], what: str) -> None:
    if unknown := sorted(set(given) - set(allowed)):
        raise BadConfiguration(f"{what} has no {', '.join(unknown)}; it has {', '.join(sorted(allowed))}")


def _page(template: str, key: str) -> list[str]:
    return [template.format(key=key)]


def _whole(key: str, bodies: list[str]) -> list[tuple]:
    return [("main", None, None, body) for body in bodies]


def _connector(name: str, given: dict) -> Connector:
    _known(given, ("claim", "page", "names"), f"repository {name}")
    if "claim" not in given:
        raise BadConfiguration(f"repository {name} has no claim")
    page = given.get("page")
    try:
        return Connector(name, given["claim"], text=text.repository_text, mint=tuple(given.get("names", {}).items()), pages=partial(_page, page) if page else None, files=_whole)
    except (re.error, ValueError) as e:
        raise BadConfiguration(f"repository {name}: {e}") from e


def parse(data: dict) -> Config:
    _known(data, ("check", "fetch", "claims", "repositories"), "a configuration")
    check, fetch = data.get("check", {}), data.get("fetch", {})
    _known(check, SETTABLE, "[check]")
    if bad := sorted(k for k, v in check.items() if not isinstance(v, bool)):
        raise BadConfiguration(f"[check] wants true or false for {', '.join(bad)}")
    policy = Policy()
    _known(fetch, (f.name for f in fields(Policy)), "[fetch]")
    for k, v in fetch.items():
        wanted = type(getattr(policy, k))
        if isinstance(v, bool) or not isinstance(v, (int, float) if wanted is float else wanted):
            raise BadConfiguration(f"[fetch] wants {wanted.__name__} for {k}")
    registry: Registry = DEFAULT
    claims = data.get("claims", {})
    _known(claims, (c.name for c in DEFAULT), "[claims]")
    for name, claim in claims.items():
        try:
            registry = with_claim(registry, name, claim) if claim else registry.without(name)
        except (re.error, ValueError) as e:
            raise BadConfiguration(f"claim of {name}: {e}") from e
    for name, given in data.get("repositories", {}).items():
        registry = registry.with_connector(_connector(name, given), first=True)
    return Config(replace(Options(), registry=registry, **check), replace(policy, **{k: type(getattr(policy, k))(v) for k, v in fetch.items()}))


def load(path: str | None) -> Config:
    """The configuration of a file; the defaults where none is given."""
    if path is None:
        return Config()
    with open(path, "rb") as f:
        return parse(tomllib.load(f))
