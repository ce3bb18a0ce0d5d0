"""Names, tags, patterns and tables that right results depend on. Each is stated as it is, once."""

from __future__ import annotations

# Formats and HTML

MIME = {"html": "text/html", "markdown": "text/markdown", "wikitext": "text/x-wikitext", "plain-text": "text/plain"}
NON_CONTENT_TAGS = frozenset({"script", "style", "head", "noscript", "template"})
HEADING_TAGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
BLOCK_TAGS = frozenset({
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
})
SECTION_CONTENT_TAGS = frozenset({"p", "pre", "li", "blockquote", "dd", "dt", "td", "th", "figcaption"})
LOCATED_TAGS = frozenset({"p", "li", "td", "th", "blockquote", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "span", "div", "pre", "code"})
HTML_OPENING_TAG = r"<(?:!doctype|html|head|body|pre|script|iframe|h[1-6]|div|font|table|a|style|title|b|br|p)[\s>/]"
LEADING_COMMENTS = r"^(?:<!--(?s:.*?)-->\s*)+"
MARKDOWN_SIGN = r"(?m)^#{1,6}\s"
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+?)(?:\s+#+)?\s*$"
WIKITEXT_SIGN = r"(?m)^={2,6}[^=]"
WIKITEXT_HEADING = r"^(={2,6})\s*(.+?)\s*=+\s*$"
TRUNCATION_MARKER = r"\n?\.\.\. \[\d+ more chars\]\s*$"

# sections

ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
PARAGRAPH = r"(?i)^(?:paragraph|para)\s+(\d+)$"
TRAILING_NUMBER = r"(\d+|[IVXLCDM]+)\s*$"
DESIGNATOR = r"^(?:(?:Appendix|Annex)\s+)?(\d+(?:\.\d+)*|[A-Z](?:\.\d+)*(?=\.))"
SECTION_ANCHOR = r"(?i)^(?:section|sec|appendix|app)-(\d+(?:\.\d+)*|[A-Z](?:\.\d+)*)$"

# How a quote differs from its source

CASE = "differs only in case"
INLINE_MARKUP = "differs only in inline markup (backticks, emphasis)"
PUNCTUATION = "differs only in punctuation"
CASE_PUNCTUATION_OR_MARKUP = "differs only in case, punctuation or markup"

# Keys of a sources file

SOURCE_FIELDS = ("url", "type", "language", "title", "date", "license", "isbn", "doi", "publisher", "edition")
FRAGMENT_FIELDS = ("lines", "location", "page_start", "page_end")
SOURCE_KEYS = frozenset({*SOURCE_FIELDS, "label", "part_of", "fragments"})
FRAGMENT_KEYS = frozenset({*FRAGMENT_FIELDS, "label", "snippet", "selector", "section", "cited_by"})
TOP_KEYS = frozenset({"sources", "patterns", "base"})

# Namespaces and names of serializations

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OA = "http://www.w3.org/ns/oa#"
PROV = "http://www.w3.org/ns/prov#"
DCTERMS = "http://purl.org/dc/terms/"
SCHEMA = "https://schema.org/"
BIBO = "http://purl.org/ontology/bibo/"
SERIALIZATIONS = {"turtle": "turtle", "ttl": "turtle", "nt": "nt", "n-triples": "nt", "ntriples": "nt", "json-ld": "jsonld", "jsonld": "jsonld", "xml": "xml", "rdf-xml": "xml"}

# Repositories, the patterns that claim a URL, and names that stand for URLs

CLAIMS = (
    ("archive", r"archive\.org/details/(.+?)(?:/|$|\?|#)"),
    ("gutenberg", r"gutenberg\.org/ebooks/(\d+)"),
    ("wikisource", r"wikisource\.org/wiki/(.+?)(?:\?|#|$)"),
    ("wiktionary", r"wiktionary\.org/wiki/(.+?)(?:\?|#|$)"),
    ("mdn", r"developer\.mozilla\.org/(?i:en-US)/docs/([^#?\s]+)"),
    ("rfc", r"(?:rfc-editor\.org/rfc|datatracker\.ietf\.org/doc/html|ietf\.org/archive/id)/((?:rfc|bcp|std)\d+|draft-[a-zA-Z0-9][a-zA-Z0-9.\-]*?)(?:\.[a-z]+)?(?:$|[/?#])"),
)
FAMILIES = (
    (r"^Archive (?P<item>[^/?#\s]+)$", "https://archive.org/details/{item}"),
    (r"^Gutenberg (?P<id>\d+)$", "https://www.gutenberg.org/ebooks/{id}"),
    (r"^Wikisource (?P<page>.+)$", "https://en.wikisource.org/wiki/{page}"),
    (r"^Wiktionary (?P<word>.+)$", "https://en.wiktionary.org/wiki/{word}"),
    (r"^MDN (?P<page>.+)$", "https://developer.mozilla.org/en-US/docs/{page}"),
    (r"^RFC (?P<n>\d+)$", "https://www.rfc-editor.org/rfc/rfc{n}.html"),
)

# RFC

RFC_SAFE_KEY = r"^(?:rfc|bcp|std)\d+$|^draft-[a-z0-9][a-z0-9.\-]*$"
RFC_KEY = r"^rfc\d+$"
RFC_CONTAINERS = "div.rfcmarkup, div.rfchtml, #content"
RFC_FURNITURE_CLASSES = frozenset({"grey", "noprint", "pilcrow"})
RFC_PAGE_FOOTER = r"(?m)^.*\[Page \d+\]\s*$"
RFC_PARAGRAPH_BREAK = r"\n[ \t]*\n"
RFC_WRAPPED_HYPHEN = r"(?<=[A-Za-z0-9])-\n[ \t]*(?=[A-Za-z0-9])"
RFC_TITLE_ENDS = r"^(Abstract|Status of [Tt]his Memo)\b"
RFC_DOCUMENT_URI = r"^/api/v\d+/doc/document/([^/]+)/?$"

# MDN

MDN_FOLDERS = (("*", "_star_"), ("::", "_doublecolon_"), (":", "_colon_"), ("?", "_question_"))
MDN_MACRO_MARK = "⟨macro⟩"
MDN_TEXT_MACROS = frozenset({"glossary", "httpheader", "httpstatus", "httpmethod", "httpstatuscode", "domxref", "jsxref", "cssxref", "svgattr", "svgelement", "webextapiref"})
MDN_PATH_MACROS = frozenset({"domxref", "jsxref", "cssxref"})
MDN_BADGE_MACROS = {
    "optional_inline": "Optional", "deprecated_inline": "Deprecated", "experimental_inline": "Experimental", "non-standard_inline": "Non-standard",
    "readonlyinline": "Read only", "securecontext_inline": "Secure context",
}
MDN_FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"
MDN_TITLE = r"(?m)^title:\s*(.+?)\s*$"
MDN_FENCE = r"(?ms)^([ \t]*)(`{3,}|~{3,})[^\n]*\n(.*?)^[ \t]*\2[ \t]*$"
MDN_INLINE_CODE = r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)"
MDN_HTML_TAG = r"</?[A-Za-z][^<>]*>"
MDN_MACRO = r"(?s)\{\{\s*([\w.\-]+)\s*(?:\(\s*(.*?)\s*\))?\s*\}\}"
MDN_MACRO_DEBRIS = r"(?s)\{\{.*?\}\}"
MDN_ARGUMENT = r'"([^"]*)"|\'([^\']*)\'|([^,\s][^,]*)'
MDN_IMAGE = r"!\[[^\]]*\]\((?:[^()]|\([^()]*\))*\)"
MDN_LINK = r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:[^()]|\([^()]*\))*\)"
MDN_CALLOUT = r"(?m)^>\s*\[!(\w+)\][ \t]*$"
MDN_QUOTE_MARK = r"(?m)^>[ \t]?"
MDN_BOLD = r"(?s)\*\*(.+?)\*\*"
MDN_STAR_ITALIC = r"(?<![\w*])\*(?!\s)([^*\n]+?)(?<![\s*])\*(?![\w*])"
MDN_UNDERSCORE_ITALIC = r"(?<![\w_])_([^_\n]+)_(?![\w_])"

# Wiktionary

WIKI_TEMPLATE = r"\{\{[^}]+\}\}"
WIKI_TEMPLATE_OPTIONS = ("tr=", "sc=", "pos=")
WIKI_LINK = r"\[\[([^|\]]+\|)?([^\]]+)\]\]"
WIKI_QUOTES = r"'{2,}"

# Gutenberg

GUTENBERG_FRAME = r"pg-(header|footer)"
CHAPTER_NUMBER = r"(?i)^chapter:(\d+)"
CLASSICAL_REFERENCE = r"(?i)^(Aen|Od|Theog|Met|Metamorphoses|Homeric Hymn)[.\s]+([IVXLCDM\d]+)"
BIBLE_REFERENCE = r"^(\d?\s*[a-zA-Z]+)"
BIBLE_VERSES = r"^(?:\d\s+)?[A-Za-z]+\s+(\d+):(\d+)[-\u2013](\d+)"
BIBLE_VERSE_LINE = r"^(\d+):(\d+)\s"
BIBLE_BOOKS = {
    "gen": "genesis", "ex": "exodus", "lev": "leviticus", "num": "numbers", "deut": "deuteronomy", "josh": "joshua", "judg": "judges", "ruth": "ruth",
    "1 sam": "samuel", "2 sam": "samuel", "1 kgs": "kings", "2 kgs": "kings", "1 chr": "chronicles", "2 chr": "chronicles",
    "esth": "esther", "job": "job", "ps": "psalms", "prov": "proverbs", "eccl": "ecclesiastes", "song": "song of solomon", "isa": "isaiah", "jer": "jeremiah",
    "lam": "lamentations", "ezek": "ezekiel", "dan": "daniel", "hos": "hosea", "joel": "joel", "amos": "amos", "obad": "obadiah", "jonah": "jonah", "mic": "micah",
    "nah": "nahum", "hab": "habakkuk", "zeph": "zephaniah", "hag": "haggai", "zech": "zechariah", "mal": "malachi",
    "matt": "matthew", "mark": "mark", "luke": "luke", "john": "john", "acts": "acts", "rom": "romans", "1 cor": "corinthians", "2 cor": "corinthians",
    "gal": "galatians", "eph": "ephesians", "phil": "philippians", "col": "colossians", "1 thess": "thessalonians", "2 thess": "thessalonians",
    "1 tim": "timothy", "2 tim": "timothy", "titus": "titus", "phlm": "philemon", "heb": "hebrews", "jas": "james", "1 pet": "peter", "2 pet": "peter",
    "1 john": "john", "2 john": "john", "3 john": "john", "jude": "jude", "rev": "revelation",
}
