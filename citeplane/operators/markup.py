"""A lenient HTML tree on the standard library, its text, and a subset of CSS selectors over it.

Rules of leniency: void elements close themselves; an end tag closes up to the nearest open element of its name and is
ignored if none is open; nothing is implied or repaired. Comments and declarations count as text, as they do for
callers that read every string of a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from citeplane import fixed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def walk(self) -> Iterator[Element]:
        """Descendants in document order."""
        todo = [iter(self.kids)]
        while todo:
            for kid in todo[-1]:
                if isinstance(kid, Element):
                    yield kid
                    todo.append(iter(kid.kids))
                    break
            else:
                todo.pop()

    def ancestors(self) -> Iterator[Element]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def find(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(made)
        if tag not in VOID:
            self.at = made
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            closed, self.at = self.at, self.at.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data):
        self.at.kids.append(data)

    handle_comment = handle_data

    def handle_decl(self, decl):
        self.at.kids.append(re.sub(r"(?i)^doctype\s+", "", decl))

    def unknown_decl(self, data):
        self.at.kids.append(data)

    def handle_pi(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def content(root: Element) -> Element:
    return root.find("body") or root


def text_of(node: Element) -> str:
    """Strings under a node, a line feed behind each block, nothing from silent elements."""
    out: list[str] = []
    todo: list = [iter(node.kids)]
    ends: list[str] = [""]
    while todo:
        for kid in todo[-1]:
            if isinstance(kid, str):
                out.append(kid)
            elif kid.tag not in fixed.NON_CONTENT_TAGS:
                todo.append(iter(kid.kids))
                ends.append("\n" if kid.tag in fixed.BLOCK_TAGS else "")
                break
        else:
            todo.pop()
            out.append(ends.pop())
    return "".join(out)


class UnsupportedSelector(ValueError):
    """A selector outside the subset."""


_TOKEN = re.compile(
    r"""(?P<comb>\s*[>+~]\s*|\s+)|(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>(?:[\w-]|\\.)+)|\.(?P<cls>(?:[\w-]|\\.)+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:(?P<edge>first-child|last-child|first-of-type|last-of-type|only-child|only-of-type|empty|root)\b
    |:(?P<fn>not|is|where|has|nth-child|nth-last-child|nth-of-type|nth-last-of-type)\(""",
    re.X,
)
_STEP = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<one>[+-]?\d+))\s*\Z", re.I)


def _step(text: str) -> tuple[int, int]:
    """(a, b) of the positions a * n + b, n from 0."""
    m = _STEP.match(text)
    if m is None:
        raise UnsupportedSelector(f"no position: {text!r}")
    if m["word"]:
        return 2, int(m["word"].lower() == "odd")
    if m["one"]:
        return 0, int(m["one"])
    return int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"]), int((m["sign"] or "+") + (m["b"] or "0"))


def _split(text: str, sign: str = ",") -> list[str]:
    """Parts of a list, whose sign doesn't count in quotes, brackets and parentheses; with ``)`` up to the one that closes."""
    out, depth, quote, begin, at = [], 0, "", 0, 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == sign and not depth:
            out.append(text[begin:at])
            begin = at + 1
            if sign == ")":
                return out
        else:
            depth += (c in "([") - (c in ")]")
        at += 1
    return [*out, text[begin:]] if sign == "," else []


def _compound(e: Element, tests: list[tuple], scope: Element | None = None) -> bool:
    for kind, *v in tests:
        if kind == "tag":
            ok = v[0] == "*" or e.tag == v[0]
        elif kind == "id":
            ok = e.attrs.get("id") == v[0]
        elif kind == "cls":
            ok = v[0] in e.attrs.get("class", "").split()
        elif kind == "attr":
            name, op, want = v
            have = e.attrs.get(name)
            if have is None or op is None:
                ok = have is not None
            else:
                ok = {"=": have == want, "~=": want in have.split(), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have, "|=": have == want or have.startswith(want + "-")}[op]
        elif kind == "scope":
            ok = e is scope
        elif kind == "empty":
            ok = not any(k for k in e.kids)
        elif kind == "root":
            ok = e.parent is None or not e.parent.tag
        elif kind in ("is", "not"):
            ok = any(_fits(e, c, len(c) - 1) for c in v[0]) == (kind == "is")
        elif kind == "has":
            ok = any(_fits(x, c, len(c) - 1, e) for c in v[0] for x in _around(e, c[1][0]))
        else:
            typed, a, b, back = v
            like = [s for s in (e.parent.elements() if e.parent else [e]) if not typed or s.tag == e.tag]
            place = next(i for i, s in enumerate(like) if s is e) + 1
            if kind == "only":
                ok = len(like) == 1
            else:
                off = (len(like) + 1 - place if back else place) - b
                ok = off == 0 if a == 0 else off % a == 0 and off // a >= 0
        if not ok:
            return False
    return True


def _around(e: Element, how: str) -> Iterator[Element]:
    """Elements that a relative selector of ``e`` may end at: below it, or below it and its later siblings."""
    yield from e.walk()
    if how in "+~" and e.parent is not None:
        beside = e.parent.elements()
        for s in beside[next(i for i, x in enumerate(beside) if x is e) + 1 :]:
            yield s
            yield from s.walk()


def _relative(selector: str) -> list[tuple[str, list[tuple]]]:
    m = re.match(r"\s*([>+~])?\s*", selector)
    chain = _compile(selector[m.end() :])
    return [("", [("scope",)]), (m[1] or " ", chain[0][1]), *chain[1:]]


def _compile(selector: str) -> list[tuple[str, list[tuple]]]:
    """Compounds with the combinator before each."""
    chain: list[tuple[str, list[tuple]]] = [("", [])]
    at, text = 0, selector.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or not m.end() > at:
            raise UnsupportedSelector(f"not supported in a selector: {text[at:]!r}")
        at, tests = m.end(), chain[-1][1]
        plain = lambda s: re.sub(r"\\(.)", r"\1", s)
        if m["comb"]:
            if not tests:
                raise UnsupportedSelector(f"a combinator stands alone in {text!r}")
            chain.append((m["comb"].strip() or " ", []))
        elif m["tag"]:
            tests.append(("tag", m["tag"].lower()))
        elif m["id"]:
            tests.append(("id", plain(m["id"])))
        elif m["cls"]:
            tests.append(("cls", plain(m["cls"])))
        elif m["attr"]:
            tests.append(("attr", m["attr"].lower(), m["op"], next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")))
        elif m["fn"]:
            found = _split(text[at:], ")")
            if not found:
                raise UnsupportedSelector(f"a parenthesis stays open in {text!r}")
            at += len(found[0]) + 1
            if m["fn"].startswith("nth"):
                tests.append(("nth", m["fn"].endswith("type"), *_step(found[0]), "last" in m["fn"]))
            else:
                tests.append(("is" if m["fn"] == "where" else m["fn"], [(_relative if m["fn"] == "has" else _compile)(x) for x in _split(found[0])]))
        else:
            edge = m["edge"]
            typed = edge.endswith("type")
            tests.append((edge,) if edge in ("empty", "root") else ("only", typed, 0, 1, False) if edge.startswith("only") else ("nth", typed, 0, 1, edge.startswith("last")))
    if not chain[-1][1]:
        raise UnsupportedSelector(f"an incomplete selector: {text!r}")
    return chain


def _fits(e: Element, chain: list[tuple[str, list[tuple]]], last: int, scope: Element | None = None) -> bool:
    if not e.tag or not _compound(e, chain[last][1], scope):
        return False
    if last == 0:
        return True
    how = chain[last][0]
    if how == ">":
        return e.parent is not None and _fits(e.parent, chain, last - 1, scope)
    if how == " ":
        return any(_fits(a, chain, last - 1, scope) for a in e.ancestors())
    before = e.parent.elements() if e.parent else []
    before = before[: next((i for i, s in enumerate(before) if s is e), 0)]
    return any(_fits(s, chain, last - 1, scope) for s in (before[-1:] if how == "+" else before))


def select(root: Element, selector: str) -> list[Element]:
    """Elements that the selector list fits, in document order."""
    chains = [_compile(s) for s in _split(selector)]
    return [e for e in root.walk() if any(_fits(e, c, len(c) - 1) for c in chains)]


def path_to(e: Element) -> str:
    """A selector of child steps down to ``e``, from the nearest element with an id, itself included."""
    steps: list[str] = []
    while e is not None and e.tag:
        if e.attrs.get("id"):
            steps.append("#" + e.attrs["id"])
            break
        same = [s for s in e.parent.elements() if s.tag == e.tag] if e.parent else [e]
        place = next(i for i, s in enumerate(same) if s is e) + 1
        steps.append(f"{e.tag}:nth-of-type({place})" if len(same) > 1 else e.tag)
        e = e.parent
    return " > ".join(steps[::-1])
