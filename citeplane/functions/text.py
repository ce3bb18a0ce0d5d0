"""Text functions as Column expressions: all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeplane import fixed

#: Fewest characters of a quote, once normalized, that count as evidence, and of a term's page.
MIN_EVIDENCE = 20
MIN_DIRECT = 3
#: Characters below which a repository's file is taken whole, whatever the location says.
SMALL_FILE = 5000
#: Java's \s with (?U) lacks U+001C to U+001F, which Python's has.
_WHITE = r"(?U)[\s\x{1c}-\x{1f}]+"


def normalize_ws(c: Column) -> Column:
    """Runs of Unicode white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, _WHITE, " "))


def drop_ellipsis(c: Column) -> Column:
    """Without one final ellipsis, of a text that is normalized already."""
    return F.trim(F.regexp_replace(c, r"(\.\.\.|…)\z", ""))


def quote_of(c: Column) -> Column:
    return drop_ellipsis(normalize_ws(F.coalesce(c, F.lit(""))))


def truncate(c: Column, most: int | None) -> Column:
    """The first characters and how many are left out; null takes all."""
    if most is None:
        return c
    rest = (F.length(c) - most).cast("string")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n... ["), rest, F.lit(" more chars]"))).otherwise(c)


def strip_headers(c: Column) -> Column:
    """Without blank lines and lines that begin with a number sign."""
    return F.trim(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.startswith("#") & (normalize_ws(x) != "")), "\n"))


def strip_leading_headers(c: Column) -> Column:
    """Without the number-sign lines a file begins with and the blank ones behind them."""
    return F.regexp_replace(c, r"\A(?:#[^\n]*\n?)*(?:[ \t\r]*\n)*", "")


def local_name(c: Column) -> Column:
    return F.substring_index(c, "#", -1)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def slug(c: Column) -> Column:
    """Lower case; runs of other than letters and digits of any script become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(?U)\W+", "_"), r"\A_+|_+\z", "")


def ascii_slug(c: Column, most: int = 50) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_+|_+\z", ""), 1, most), r"_+\z", "")


def file_slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def urn(label: Column, kind: str, base: str = "") -> Column:
    head = base + ("" if base[-1] in "/:#" else "#") if base else "urn:citeplane:"
    return F.concat(F.lit(f"{head}{kind}_"), slug(label))


def anchor_slug(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(normalize_ws(c)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), r"\A-+|-+\z", "")


def auto_label(c: Column) -> Column:
    """The first five words, and dots where there are more."""
    words = F.split(normalize_ws(c), " ")
    return F.concat(F.array_join(F.slice(words, 1, 5), " "), F.when(F.size(words) > 5, "...").otherwise(""))


def lines(body: Column, first: Column, last: Column) -> Column:
    """Lines from ``first`` to ``last``, counted from 1, both included."""
    at = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(F.split(body, "\n"), at, F.greatest(last - at + 1, F.lit(0))), "\n")


def line_range(body: Column, locator: Column) -> Column:
    """Lines of a locator N-M; empty where it is none."""
    number = lambda i: F.regexp_extract(F.trim(locator), r"\A(\d+)-(\d+)", i).try_cast("int")
    return F.coalesce(lines(body, number(1), number(2)), F.lit(""))


def repository_text(body: Column, location: Column) -> Column:
    """Lines of ``lines:N-M``; all of a small file or where no location is given; else nothing."""
    ranged = F.regexp_extract(location, r"lines:(\d+-\d+)", 1)
    return F.when(ranged != "", line_range(body, ranged)).when((F.trim(location) == "") | (F.length(body) < SMALL_FILE), body).otherwise("")


def roman_to_int(c: Column) -> Column:
    """Greedy and in any case, so that forms like IIII count; null where it is no numeral."""
    text = F.upper(F.trim(c))
    groups = "".join(f"({s}*)" if len(s) == 1 else f"((?:{s})*)" for _, s in fixed.ROMAN)
    total = reduce(lambda a, b: a + b, ((F.length(F.regexp_extract(text, rf"\A{groups}\z", i)) / len(s)).cast("int") * worth for i, (worth, s) in enumerate(fixed.ROMAN, 1)))
    return F.when((text != "") & text.rlike(rf"\A{groups}\z"), total)


def int_to_roman(c: Column) -> Column:
    out, rest = F.lit(""), c
    for worth, sign in fixed.ROMAN:
        out, rest = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / worth).cast("int"))), rest % worth
    return out


def trailing_number(c: Column) -> Column:
    found = F.regexp_extract(F.trim(c), fixed.TRAILING_NUMBER, 1)
    return F.coalesce(found.try_cast("int"), roman_to_int(blank_to_null(found)))


def designator(title: Column) -> Column:
    """The number a title begins with, or a capital followed by a dot, perhaps behind Appendix or Annex; else null."""
    return blank_to_null(F.regexp_extract(F.trim(title), fixed.DESIGNATOR, 1))


#: Folding of case. (The optimizer makes lower(upper(w)) lower(w), so the letters that only folding changes are named.)
_FOLD = lambda w: F.replace(F.translate(F.lower(w), "ſς", "sσ"), F.lit("ß"), F.lit("ss"))
_PUNCTUATION = r"[!-/:-@\[-`{-~]+"
_STRIP = lambda c, of: F.regexp_replace(c, rf"\A{of}|{of}\z", "")
FOLDS = (
    (fixed.CASE, _FOLD),
    (fixed.INLINE_MARKUP, lambda w: _STRIP(w, "[`*]+")),
    (fixed.PUNCTUATION, lambda w: _STRIP(w, _PUNCTUATION)),
    (fixed.CASE_PUNCTUATION_OR_MARKUP, lambda w: _STRIP(_STRIP(_FOLD(w), "[`*]+"), _PUNCTUATION)),
)


def typographic_kind(quote: Column, source: Column) -> Column:
    """The first fold under which the quote's words stand in the source's in a row; null where none, or as they are."""
    text = lambda c, fold=None: F.concat(F.lit(" "), F.array_join(F.transform(F.split(c, " "), fold) if fold else F.split(c, " "), " "), F.lit(" "))
    kind = F.when(F.contains(text(source), text(quote)), F.lit(None).cast("string"))
    for name, fold in FOLDS:
        kind = kind.when(F.contains(text(source, fold), text(quote, fold)), name)
    return F.when(quote != "", kind)
