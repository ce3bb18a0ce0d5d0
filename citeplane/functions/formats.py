"""Detection of a body's format as a Column expression, with the same verdicts as the per-document code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeplane import fixed


def normalize_mime(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in fixed.MIME.items() for x in kv))
    return F.coalesce(names[c], c)


def looks_like_html(body: Column) -> Column:
    head = F.lower(F.regexp_replace(F.substring(body, 1, 1000), r"(?U)\A[\s\x{1c}-\x{1f}]+", ""))
    after = F.regexp_replace(head, fixed.LEADING_COMMENTS, "")
    return head.startswith("<html") | head.startswith("<!doctype") | after.rlike("^" + fixed.HTML_OPENING_TAG) | F.contains(head, F.lit("<body")) | F.contains(head, F.lit("<head"))


def detect_format(body: Column) -> Column:
    start = F.substring(body, 1, 2000)
    wiki = body.rlike(fixed.WIKITEXT_SIGN) | F.contains(start, F.lit("[[")) | F.contains(start, F.lit("{{"))
    return F.when(looks_like_html(body), "html").when(body.rlike(fixed.MARKDOWN_SIGN), "markdown").when(wiki, "wikitext").otherwise("plain-text")
