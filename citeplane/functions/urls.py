"""URLs, document keys, keys of repositories and names that mint URLs, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeplane import fixed
from citeplane.functions.text import blank_to_null

SUPERSESSION = ("rfc",)


def document_url(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def url_anchor(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("#")), F.regexp_replace(url, r"(?s)\A[^#]*#", "")).otherwise("")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(document_url(url), 256), 1, 16)


def mdn_key(slug: Column) -> Column:
    """The folder of a page, from its address."""
    slug = F.regexp_replace(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), r"\A/+|/+\z", "")
    for sign, word in fixed.MDN_FOLDERS:
        slug = F.replace(slug, F.lit(sign), F.lit(word))
    key = F.concat(F.lit("en-us/"), F.lower(slug))
    return F.when((slug != "") & ~key.rlike(r"(?:\A|/)\.{0,2}(?:/|\z)"), key)


def decoded_key(raw: Column) -> Column:
    return F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def claimed_by(url: Column) -> Column:
    """The repository, of those that come along, that claims a URL; null where none does."""
    from citeplane.connectors import DEFAULT

    return DEFAULT.claimed_by(url)


def repository_key(url: Column) -> Column:
    from citeplane.connectors import DEFAULT

    return DEFAULT.key_of(url)


def minted_url(name: Column, families=fixed.FAMILIES) -> Column:
    """The URL of the first family that the name belongs to; null where it belongs to none."""
    out = None
    for pattern, url in families:
        pattern, (head, tail) = pattern.replace("(?P<", "(?<"), re.split(r"\{\w+\}", url)  # as Java spells groups
        made = F.concat(F.lit(head), F.regexp_extract(name, pattern, 1), F.lit(tail))
        out = F.when(name.rlike(pattern), made) if out is None else out.when(name.rlike(pattern), made)
    return out


def document_key(url: Column, repo: Column, key: Column, location: Column) -> Column:
    return F.when(repo.isNull(), F.concat(F.lit("url:"), document_url(url))).otherwise(F.concat_ws(":", F.lit("repo"), repo, key, F.coalesce(location, F.lit(""))))
