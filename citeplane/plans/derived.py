"""Registered queries whose inputs are made of the tables' own values: documents, payloads, files and answers by rule.

Their SQL states what each rule leads to, so that parsing, targeting, location, diagnosis, repositories, reports and
what users add are compared with another engine as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeplane import api, config, report, schemas
from citeplane.connectors import DEFAULT, Connector
from citeplane.functions import text
from citeplane.operators import constraints, content, extract, locate, repositories, verify
from citeplane.scratch import materialize, root
from citeplane.sources import fetch, payloads, rdf, sources_file

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _part(spark, sf_dir: str) -> DataFrame:
    """Parts with ``k``, the key as text, and two sentences of plain words."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_partkey").cast("string").alias("k"), F.concat(F.lit("Thing "), F.col("p_partkey").cast("string"), F.lit(" is of brand "), "p_brand").alias("a"), F.concat("p_type", F.lit(" is the type of thing "), F.col("p_partkey").cast("string")).alias("b"))


_PART = "p as (select p_partkey, p_partkey::varchar as k, 'Thing ' || p_partkey || ' is of brand ' || p_brand as a, p_type || ' is the type of thing ' || p_partkey as b from part)"
_NULL = lambda kind="string": F.lit(None).cast(kind)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _case(by: Column, *values: Column | str | None) -> Column:
    out = None
    for i, v in enumerate(values):
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(by == i, v) if out is None else out.when(by == i, v)
    return out


def _extracted(rows: DataFrame, formats: tuple[content.Format, ...] = ()) -> DataFrame:
    """(p_partkey, text, status) of ``rows`` (p_partkey, body, format, locator, anchor), each its own document."""
    key = F.col("p_partkey").cast("string")
    targets = rows.select(key.alias("doc_key"), "format", "locator", "anchor", F.concat(F.lit("https://x.org/"), key).alias("url"))
    docs = rows.select(key.alias("doc_key"), "body", _NULL().alias("miss"), _NULL().alias("miss_reason"))
    return extract.extract(targets, docs, formats).select(F.col("doc_key").cast("long").alias("p_partkey"), "text", "status")


# sections and formats


@_query(f"""with {_PART} select p_partkey, case p_partkey % 8 when 0 then a || '. ' || b || '. Third. ' || a || '.' when 1 then 'Third.' when 2 then a || '.' when 3 then '' when 4 then a || '.' when 5 then b || '. Third. ' || a || '.' when 6 then '' when 7 then b || '. Third. ' || a || '.' end as text,
 case when p_partkey % 8 in (3, 6) then 'no_section' else 'ok' end as status from p""")
def markdown_sections(spark, sf_dir):
    """Section selectors of each kind in Markdown: names, paths, paragraphs, designators, Roman numerals, misses."""
    p = _part(spark, sf_dir)
    a, b = F.concat("a", F.lit(".")), F.concat("b", F.lit("."))
    body = _text("---\ntitle: x\n---\n\n# Part ", F.col("k"), "\n\n", a, "\n\n## Sub IV ##\n\n", b, "\n\n\nThird.\n\n### 2.1 Deep\n\n", a, "\n")
    locator = _case(F.col("p_partkey") % 8, F.concat(F.lit("part  "), "k"), "sub 4, paragraph 2", F.concat(F.lit("Part "), "k", F.lit(", PARA 1")), "Nothing of it", "§ 2.1", "'Sub IV'", "§ 2", "Sub iv")
    return _extracted(p.select("p_partkey", body.alias("body"), F.lit("section").alias("format"), locator.alias("locator"), F.lit("").alias("anchor")))


@_query(f"""with {_PART} select p_partkey, case p_partkey % 4 when 0 then a || '. ' || b || '.' when 1 then b || '.' when 2 then '== Part ' || k || ' == ' || a || '. === Sub === ' || b || '.' when 3 then a || '.' end as text, 'ok' as status from p""")
def wikitext_sections(spark, sf_dir):
    p = _part(spark, sf_dir)
    body = _text("== Part ", F.col("k"), " ==\n", F.col("a"), ".\n\n=== Sub ===\n", F.col("b"), ".\n")
    by = F.col("p_partkey") % 4
    return _extracted(p.select("p_partkey", body.alias("body"), _case(by, "wikitext", "text/x-wikitext", "", "").alias("format"), _case(by, F.concat(F.lit("Part "), "k"), "Sub", None, "2-2").alias("locator"), F.lit("").alias("anchor")))


@_query(f"""with {_PART} select p_partkey, case p_partkey % 5 when 0 then '# H ' || a || ' ' || b when 1 then b when 2 then '# H ' || a || ' ' || b when 3 then a || ' ' || b when 4 then '' end as text, case p_partkey % 5 when 4 then 'unavailable' else 'ok' end as status from p""")
def named_formats(spark, sf_dir):
    """A format by its name, its media type, an unknown name, or the section's; a document without a body."""
    p = _part(spark, sf_dir)
    by = F.col("p_partkey") % 5
    body = F.when(by != 4, _text("# H\n", F.col("a"), "\n", F.col("b")))
    return _extracted(p.select("p_partkey", body.alias("body"), _case(by, "text/plain", "plain-text", "application/x", "markdown", "html").alias("format"), _case(by, None, "3-3", None, "H", "p").alias("locator"), F.lit("").alias("anchor")))


@_query(f"""with {_PART} select p_partkey, case p_partkey % 5 when 0 then a when 1 then b when 2 then b when 3 then 'Top ' || k || ' ' || a || ' 1.2. Sub title ' || b when 4 then a end as text, 'ok' as status from p""")
def anchored_targets(spark, sf_dir):
    """Anchors as targets: an id on a heading, a designator, a title's slug, one that nothing has, and one beside a selector."""
    p = _part(spark, sf_dir)
    by = F.col("p_partkey") % 5
    body = _text("<body><h1 id='top'>Top ", F.col("k"), "</h1><p class='x'>", F.col("a"), "</p><h2>1.2. Sub title</h2><p>", F.col("b"), "</p></body>")
    anchor = _case(by, "top", "section-1.2", "12-sub-title", "nowhere", "section-1.2")
    # The first section holds all below it, so its own paragraph is asked for through the anchor's section alone where it has none below.
    body = F.when(by == 0, _text("<body><h1 id='top'>Top ", F.col("k"), "</h1><p>", F.col("a"), "</p></body>")).otherwise(body)
    return _extracted(p.select("p_partkey", body.alias("body"), F.lit("").alias("format"), F.when(by == 4, "p.x").alias("locator"), anchor.alias("anchor")))


@_query(f"""with {_PART} select p_partkey, case p_partkey % 4 when 3 then null else 'markdown' end as kind, case p_partkey % 4 when 0 then 'Named ' || k when 1 then 'Front ' || k when 2 then '' else 'Wiki ' || k end as title from p where p_partkey % 4 < 3 union all select p_partkey, 'wikitext', 'Wiki ' || k from p where p_partkey % 4 = 3""")
def document_titles(spark, sf_dir):
    """Titles of Markdown, by heading and by front matter, and of wikitext."""
    import pyarrow as pa

    p = _part(spark, sf_dir)
    body = _case(F.col("p_partkey") % 4, F.concat(F.lit("x\n\n# Named "), "k", F.lit("\n\n# Other\n")), F.concat(F.lit('---\nid: 1\ntitle: "Front '), "k", F.lit('"\n---\n# H\n')), "#\tx\n####### no", F.concat(F.lit("a\n== Wiki "), "k", F.lit(" ==\nb\n")))

    def run(batches):
        from citeplane.operators.content import Document

        for batch in batches:
            docs = [Document(b) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.kind for d in docs]), pa.array([d.title() if d.title() != "x" else "" for d in docs])], names=["p_partkey", "kind", "title"])

    return p.select("p_partkey", body.alias("body")).mapInArrow(run, "p_partkey long, kind string, title string")


# location and diagnosis


@_query(f"""with {_PART} select p_partkey, case p_partkey % 6 when 3 then 'plain-text' when 4 then 'html' when 5 then null else 'section' end as format,
 case p_partkey % 6 when 0 then 'Sub' when 1 then 'Part ' || k when 2 then '§ 1.2' when 3 then '2-3' when 4 then '#m > p:nth-of-type(2)' end as locator, case p_partkey % 6 when 3 then 'format' when 4 then 'format' when 5 then 'none' else 'section' end as found_by, 0 as ambiguous from p""")
def located_quotes(spark, sf_dir):
    """Where a quote stands: the shortest section selector that leads back, lines, a CSS path from an id, or nowhere."""
    p = _part(spark, sf_dir)
    by = F.col("p_partkey") % 6
    head = _text("# Part ", F.col("k"), "\n\n", F.col("a"), "\n\n")
    body = _case(by, _text(head, "## Sub\n\n", F.col("b")), _text(head, "## Sub\n\n", F.col("b")), _text(head, "## 1.2 Named so\n\n", F.col("b")), _text("x\n", F.col("a"), " and \n", F.col("b"), "\ny"), _text("<div id='m'><p>x</p><p>", F.col("b"), "</p></div>"), _text(head))
    quote = _case(by, F.col("b"), F.col("a"), F.col("b"), _text(F.col("a"), " and ", F.col("b")), F.col("b"), "this stands nowhere at all in it")
    found = locate.locate(p.select("p_partkey", body.alias("body"), quote.alias("quote")), ["p_partkey"])
    return found.select("p_partkey", "format", "locator", "found_by", "ambiguous")


@_query(r"""with p as (select page_id, html, regexp_extract(html, '(?s)</h1>\s*<p>(?:<b>)?([^<&]{30,80})', 1) as quote, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as title from pages)
select page_id, case when quote = '' then 'none' when quote is null then 'none' else 'section' end as found_by, case when quote <> '' then case when contains(title, ',') then '''' || title || '''' else title end end as locator from p where quote = '' or not contains(title, '''')""")
def located_sections(spark, sf_dir):
    """The section selector of each page's first paragraph: its heading, quoted where it has a comma."""
    first = F.regexp_extract("html", r"(?s)</h1>\s*<p>(?:<b>)?([^<&]{30,80})", 1)
    title = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("body"), first.alias("quote"), title.alias("title")).where("quote = '' or not contains(title, \"'\")")
    return locate.locate(pages, ["page_id"]).select("page_id", "found_by", "locator")


_WORDS = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"


@_query(f"""with b as (select item_id, {_WORDS} as w from benchmark), c as (select *, len(w) as n from b), r as (select item_id, w, n, item_id % 3 as m from c)
select item_id, case m when 0 then array_to_string(w, ' ') when 1 then array_to_string(w, ' ') else array_to_string(w, ' ') end as source_text,
 round(case m when 0 then 2.0 * n / (2 * n + 1) when 1 then 1.0 else 2.0 * n / (2 * n + 1) end, 6) as ratio, case m when 1 then 'differs only in case' else '' end as kind, case m when 0 then 'indeed' when 1 then '' else 'quite' end as missing, '' as extra from r""")
def explained_quotes(spark, sf_dir):
    """Why a quote isn't found in its own text: a word more near its beginning, another case, a word more before its last."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = F.split(text.normalize_ws(F.col("text")), " ")
    quote = _case(F.col("item_id") % 3, F.array_join(F.array_insert(words, 2, F.lit("indeed")), " "), F.upper(F.array_join(words, " ")), F.array_join(F.array_insert(words, -2, F.lit("quite")), " "))
    found = locate.diagnose(rows.select("item_id", quote.alias("quote"), "text", F.lit("").alias("where")), ["item_id"])
    return found.select("item_id", "hint.source_text", F.round("hint.ratio", 6).alias("ratio"), "hint.kind", F.array_join("hint.missing", " ").alias("missing"), F.array_join("hint.extra", " ").alias("extra"))


# repositories


@_query(f"""with {_PART} select p_partkey, 'Thing: ' || k || ' Note: ' || a || ' is code ' || k || ' & more Thing ⟨macro⟩.' as text from p""")
def mdn_text(spark, sf_dir):
    """Pages with macros, code, callouts, links and entities as prose."""
    p = _part(spark, sf_dir)
    body = _text('---\ntitle: "Thing: ', F.col("k"), '"\n---\n\n> [!NOTE]\n> ', F.col("a"), " is **code `", F.col("k"), '`** &amp; _more_ {{domxref("Window/Thing")}} {{none("x")}}.\n')
    return _rendered(p, "mdn", body).select("p_partkey", text.normalize_ws(F.regexp_replace("body", "# Thing", "Thing")).alias("text"))


def _rendered(p: DataFrame, repo: str, body: Column, location: Column | None = None) -> DataFrame:
    rows = p.select(F.col("k").alias("doc_key"), F.lit(repo).alias("repo"), (F.lit("") if location is None else location).alias("location"), body.alias("body"), _NULL().alias("miss"), _NULL().alias("miss_reason"))
    return payloads.rendered(rows).select(F.col("doc_key").cast("long").alias("p_partkey"), "body")


@_query(f"""with {_PART} select p_partkey, '<html><head><title>On thing ' || k || '</title></head><body><pre>Net group</pre><pre>      On thing ' || k || '</pre><pre>Abstract</pre><h2 id="section-1">1. ' || a || ' and on</h2><pre>' || chr(10) || '  ' || b || ' well-known</pre></body></html>' as body from p""")
def rfc_text(spark, sf_dir):
    """Preformatted pages: headings hoisted and joined, footers and furniture gone, the title from the first page."""
    p = _part(spark, sf_dir)
    body = _text("<html><body><pre>Net group\n\n      On thing ", F.col("k"), "\n\nAbstract\n\n<hr><span class='grey'>RFC</span>", "<span class='h2'><a class='selflink' id='section-1' href='#section-1'>1</a>. ", F.col("a"), "</span><span class='h2'>and on</span>\n  ", F.col("b"), " well-\n  known\n\nX [Page 2]\n</pre></body></html>")
    return _rendered(p, "rfc", body)


@_query(f"""with {_PART} select p_partkey, case p_partkey % 3 when 0 then a || ' from stem (a gloss)' when 1 then b when 2 then a end as text from p""")
def wiktionary_text(spark, sf_dir):
    """A section of a language, the etymology, and lines of an entry."""
    p = _part(spark, sf_dir)
    by = F.col("p_partkey") % 3
    body = F.when(by == 2, _text("x\n", F.col("a"), "\ny")).otherwise(_text("# w\n## English\n## English/Etymology\n", F.col("a"), " from stem (a gloss)\n## English/Noun\n", F.col("b"), "\n## French\n"))
    return _rendered(p, "wiktionary", body, _case(by, "etymology", "english/noun", "lines:2-2")).select("p_partkey", F.col("body").alias("text"))


@_query(f"""with {_PART} select p_partkey, n, case n when 1 then 'Preamble' when 2 then 'Book I' else 'Book II' end as title, case n when 1 then 'Before it all ' || a || ' and so on' || chr(10) || chr(10) || 'and ' || b || ' or the like' when 2 then a || ' and ' || b else b || ' and ' || a end as body from p, (values (1), (2), (3)) x(n)""")
def gutenberg_chapters(spark, sf_dir):
    """Chapters of a page: what stands before the first heading, short paragraphs and chapters left out."""
    p = _part(spark, sf_dir)
    html = _text("<p>Before it all ", F.col("a"), " and so on</p><blockquote>and ", F.col("b"), " or the like</blockquote><h2>Book I</h2><p>", F.col("a"), " and ", F.col("b"), "</p><h4>Empty</h4><p>too short</p><h3>Book II</h3><p>", F.col("b"), " and ", F.col("a"), "</p><p>tiny</p><div id='pg-footer'><h2>End</h2><p>", F.col("a"), F.col("b"), F.col("a"), "</p></div>")
    files = payloads.gutenberg_files(p.select(F.col("k").alias("key"), html.alias("html")))
    return files.select(F.col("key").cast("long").alias("p_partkey"), F.col("number").cast("int").alias("n"), "title", "body")


@_query(f"""with {_PART} select p_partkey, case p_partkey % 4 when 0 then a || chr(10) || b when 1 then b when 2 then a || chr(10) || b when 3 then '' end as text, a || chr(10) || b as bare from p""")
def repository_text(spark, sf_dir):
    """What counts of a file at a location: all, lines, a small file whole, nothing of a large one; and without its header."""
    p = _part(spark, sf_dir)
    by = F.col("p_partkey") % 4
    body = _text(F.col("a"), "\n", F.col("b"))
    long = F.when(by == 3, F.repeat(body, 500)).otherwise(body)
    headed = F.concat(F.lit("# x: y\n# z\n\n  \n"), body)
    return p.select("p_partkey", text.repository_text(long, _case(by, "", "lines:2-2", "elsewhere", "elsewhere")).alias("text"), text.strip_leading_headers(headed).alias("bare"))


@_query(f"""with {_PART} select p_partkey, case p_partkey % 6 when 0 then 'Chapter_1' when 1 then 'Notes' when 2 then 'Chapter_2' when 3 then 'main' when 4 then 'Chapter_1' when 5 then null end as name from p where p_partkey % 6 < 5""")
def subpage_choice(spark, sf_dir):
    """The subpage that a location names: exactly, in part, by a section's name, or the main page; an empty one has the first."""
    p = _part(spark, sf_dir)
    names = F.explode(F.array(*map(F.lit, ("main", "Chapter_1", "Chapter_2", "Notes"))))
    files = p.select(F.lit("wikisource").alias("repo"), F.col("k").alias("key"), names.alias("name"), _NULL().alias("title"), _NULL("int").alias("number"), F.lit("x").alias("body"))
    targets = p.select(F.lit("wikisource").alias("repo"), F.col("k").alias("key"), _case(F.col("p_partkey") % 6, "Chapter_1", "section:notes", "x: chapter 2", "quite else", "", "section:none").alias("location"))
    return repositories.choose(targets, files).select(F.col("key").cast("long").alias("p_partkey"), "name")


@_query(f"""with {_PART} select p_partkey, case p_partkey % 5 when 0 then 'ok' when 1 then 'not_found' when 2 then 'unavailable' when 3 then 'no_file' when 4 then 'empty' end as status, case p_partkey % 5 when 0 then a end as text from p""")
def repository_documents(spark, sf_dir):
    """What becomes of a repository's document: there, not there, not to be had, not cached, empty."""
    p = _part(spark, sf_dir)
    by = F.col("p_partkey") % 5
    targets = p.select(F.col("k").alias("doc_key"), F.lit("archive").alias("repo"), F.col("k").alias("key"), F.lit("").alias("location"))
    files = p.where(by.isin(0, 4)).select(F.lit("archive").alias("repo"), F.col("k").alias("key"), F.lit("f").alias("name"), _NULL().alias("title"), _NULL("int").alias("number"), F.when(by == 0, F.col("a")).otherwise("").alias("body"))
    crawls = p.where(by.isin(1, 2)).select(F.lit("archive").alias("repo"), F.col("k").alias("key"), F.when(by == 1, "not_found").otherwise("unavailable").alias("status"), F.lit("503").alias("reason"))
    found = repositories.documents(targets, files, crawls)
    return found.select(F.col("doc_key").cast("long").alias("p_partkey"), F.coalesce("miss", F.lit("ok")).alias("status"), F.when(F.col("miss").isNull(), F.col("body")).alias("text"))


# runs and reports


def _terms_run(spark, sf_dir) -> verify.Report:
    """Terms of parts: every fifth one has no page, every third one quotes what its page doesn't say."""
    p = _part(spark, sf_dir)
    url = F.concat(F.lit("https://t.org/"), "k")
    quote = F.when(F.col("p_partkey") % 3 == 0, "this is said by no page of them").when(F.col("p_partkey") % 3 == 1, F.col("a"))
    terms = p.select(F.concat(F.lit("urn:t:"), "k").alias("urn"), F.concat(F.lit("term "), "k").alias("label"), url.alias("url"), F.lit("plain-text").alias("type"), *(_NULL().alias(c) for c in ("location", "lines", "section", "selector")), quote.alias("snippet"))
    docs = p.where("p_partkey % 5 <> 0").select(url.alias("url"), F.when(F.col("p_partkey") % 7 == 0, "ok").otherwise(F.concat("a", F.lit("\n"), "b")).alias("body"))
    none = [spark.createDataFrame([], x) for x in (schemas.SOURCES, schemas.FRAGMENTS)]
    return api.check(spark, verify.Citations(*none, terms), verify.World(docs))


_TERMS = "t as (select p_partkey, case when p_partkey % 5 = 0 then 'unavailable' when p_partkey % 7 = 0 then 'empty' when p_partkey % 3 = 0 then 'not found' end as why from part)"


@_query(f"with {_TERMS} select 'term ' || p_partkey as label, why from t where why is not null")
def term_findings(spark, sf_dir):
    """Terms, which name their pages themselves: what is missing, too short to compare, or not said there."""
    r = F.col("reason")
    why = F.when(F.contains(r, F.lit("could not fetch")), "unavailable").when(r == verify.NOT_FOUND, "not found").otherwise("empty")
    return _terms_run(spark, sf_dir).findings.where(F.col("check") == verify.TERMS).select("label", why.alias("why"))


@_query(f"with {_TERMS} select 'Terms' as \"check\", 'failure' as severity, why, count(*)::bigint as n from t where why is not null group by why")
def json_findings(spark, sf_dir):
    """Findings as JSON lines, read back and counted."""
    rows = report.json_rows(_terms_run(spark, sf_dir)).select(F.from_json("value", "check string, severity string, reason string").alias("x")).select("x.*")
    why = F.when(F.contains(F.col("reason"), F.lit("could not fetch")), "unavailable").when(F.col("reason") == verify.NOT_FOUND, "not found").otherwise("empty")
    return rows.groupBy("check", "severity", why.alias("why")).agg(F.count("*").alias("n"))


@_query(f"with {_TERMS}, c as (select count(*) as n, count(why) as bad from t) select 'Terms' as name, bad, n - bad as ok from c where bad > 0")
def text_report(spark, sf_dir):
    """The failures and the ratio that the rendered report shows of a check."""
    # Rendered and written in order in the cluster; only the counts are taken from it.
    lines = materialize(report.text_rows(_terms_run(spark, sf_dir)))
    head = lambda i: F.max(F.regexp_extract("value", r"\] Terms\.* (\d+)/(\d+)\z", i)).try_cast("long")
    rows = lines.agg(F.count_if(F.contains(F.col("value"), F.lit("           term "))).alias("bad"), head(1).alias("ok"), head(2).alias("total"))
    return rows.where("total > 0").select(F.lit("Terms").alias("name"), "bad", "ok")


@_query("""with d as (select doc_id, doc_id % 4 = 0 as odd from documents) select p, count(*)::bigint as n from (select unnest(['type', 'status', 'about']) as p from d) group by p""")
def provenance_triples(spark, sf_dir):
    """Triples of a run's verdicts, by predicate, without the run's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("urn:f:"), F.col("doc_id").cast("string")).alias("urn"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("verified").alias("status"))
    rows = rdf.provenance(docs, "2026-01-01T00:00:00Z", "2026-01-01T00:00:01Z").where("s like '_:result%'")
    name = F.when(F.col("p") == rdf.RDF + "type", "type").when(F.col("p").endswith("verificationStatus"), "status").when(F.col("o").startswith("urn:f:"), "about")
    return rows.select(name.alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("n"))


# sources files, triples, users' own


def _yaml(spark, sf_dir) -> sources_file.Parsed:
    """A sources file of nations: control input, of some dozens of entries at any scale."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").limit(100).collect()
    entries = [{"label": "World", "url": "https://w.org/"}]
    for r in rows:
        k = r["n_nationkey"]
        entry = {"label": f"RFC {k + 1}"} if k % 3 == 0 else {"label": f"Land {k}"} if k % 3 == 1 else {"label": r["n_name"], "url": f"https://w.org/{k}", "part_of": "World", "type": "html"}
        entries.append(entry | {"fragments": [{"label": f"f {k}", "snippet": f"A land by the name of {r['n_name']}", "lines": f"{k}-{k + 1}", "cited_by": [{"file": "b.md", "line": k + 1}, {"file": "a.md"}]}]})
    return sources_file.parse({"base": "https://e.org/c", "patterns": [{"match": r"Land (?P<n>\d+)", "source": {"url": "https://l.org/{n}", "language": "en"}}], "sources": entries})


_FILE = """select case n_nationkey % 3 when 0 then 'RFC ' || (n_nationkey + 1) when 1 then 'Land ' || n_nationkey else n_name end as source, case n_nationkey % 3 when 0 then 'https://www.rfc-editor.org/rfc/rfc' || (n_nationkey + 1) || '.html' when 1 then 'https://l.org/' || n_nationkey else 'https://w.org/' || n_nationkey end as url,
 case n_nationkey % 3 when 1 then 'en' end as language, case n_nationkey % 3 when 2 then 'World' end as parent, 'A land by the name of ' || n_name as snippet, n_nationkey || '-' || (n_nationkey + 1) as lines, ['a.md', 'b.md:' || (n_nationkey + 1)] as cited_by from nation"""


@_query(f"select source, url, language, parent, snippet, lines, array_to_string(cited_by, ',') as cited_by from ({_FILE})")
def sources_of_file(spark, sf_dir):
    """A sources file as rows: URLs given or minted by patterns, parents by label, fragments and the places that cite them."""
    c = _yaml(spark, sf_dir).citations(spark)
    up = c.sources.select(F.col("source_id").alias("__p"), F.col("label").alias("parent"))
    rows = c.fragments.select("urn", "source_id", "snippet", "lines").join(c.sources.select("source_id", F.col("label").alias("source"), "url", "language", "part_of"), "source_id").join(up, F.col("part_of") == F.col("__p"), "left")
    found = verify.with_cite_sites(rows, c.cite_sites)
    return found.select("source", "url", "language", "parent", "snippet", "lines", F.array_join(F.transform("cited_by", lambda s: F.concat_ws(":", s["file"], s["line"].cast("string"))), ",").alias("cited_by"))


@_query("""with f as (select unnest(['data', 'semantic']) as role) select role, 'Source' as kind, (select count(*) + 1 from nation)::bigint as n from f union all select role, 'Fragment', (select count(*) from nation)::bigint from f union all select 'error', 'file', 1""")
def turtle_folder(spark, sf_dir):
    """A folder of Turtle files, read by role: inferred ones left out, a broken one reported and the rest kept."""
    import uuid

    triples = materialize(rdf.citation_triples(_yaml(spark, sf_dir).citations(spark)))
    folder = f"{root(spark)}/citeplane-{uuid.uuid4().hex}-ttl"
    jvm = spark.sparkContext._jvm
    body = "\n".join(r["value"] for r in rdf.serialize(triples, "turtle").collect())
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content_ in (("a.ttl", body), ("sub/a-semantic.ttl", body), ("a-inferred.ttl", body), ("a-shapes.ttl", body), ("bad.ttl", "broken {")):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
        out.write(bytearray(content_.encode()))
        out.close()
    found, errors = rdf.load_triples(spark, folder)
    kinds = materialize(found.where(F.col("p") == rdf.RDF + "type").select("role", "s", F.regexp_extract("o", r"(Source|Fragment)\z", 1).alias("kind")).where("kind <> ''").distinct().groupBy("role", "kind").agg(F.count("*").alias("n")))
    lost = materialize(errors.agg(F.count("*").alias("n")).select(F.lit("error").alias("role"), F.lit("file").alias("kind"), "n"))
    fs.delete(where, True)
    return kinds.unionByName(lost)


@_query("select 'urn:citeplane:' || what || '_' || lower(n_name) as s from (select replace(replace(n_name, ' ', '_'), '-', '_') as n_name from nation), (values ('source')) x(what) order by s")
def default_identifiers(spark, sf_dir):
    """Subjects under the namespace that files share: a file without a base has them."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").limit(100).collect()
    parsed = sources_file.parse({"sources": [{"label": r["n_name"], "url": f"https://w.org/{r['n_nationkey']}"} for r in rows]})
    return api.default_identifiers(rdf.citation_triples(parsed.citations(spark)))


@_query("select n_nationkey, case n_nationkey % 6 when 0 then 'sources' when 1 then 'unknown' when 2 then 'label' when 3 then 'nothing' when 4 then 'twice' when 5 then 'base' end as why from nation")
def refused_files(spark, sf_dir):
    """Why a sources file is refused, for files of six faults."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").limit(100).collect()
    faults = ({}, {"sources": [{"label": "a", "url": "u", "colour": "x"}]}, {"sources": [{"url": "u"}]}, {"sources": [{"label": "a", "url": "u", "fragments": [{"label": "f"}]}]}, {"sources": [{"label": "a", "url": "u"}, {"label": "a", "url": "v"}]}, {"base": "nowhere", "sources": []})
    signs = (("list of sources", "sources"), ("colour", "unknown"), ("needs a label", "label"), ("verifies nothing", "nothing"), ("twice", "twice"), ("base must", "base"))
    out = []
    for r in rows:
        try:
            sources_file.parse(faults[r["n_nationkey"] % 6])
        except sources_file.Refused as e:
            out.append((r["n_nationkey"], next((w for sign, w in signs if sign in str(e)), str(e))))
    return spark.createDataFrame(out, f"n_nationkey {dict(spark.read.parquet(f'{sf_dir}/nation.parquet').dtypes)['n_nationkey']}, why string")


@_query("""select 'Fragment' as node, problem, count(*)::bigint as n from (select case n_nationkey % 3 when 0 then 'a value doesn''t fit the pattern' when 1 then 'too many values' end as problem from nation) where problem is not null group by problem""")
def broken_shapes(spark, sf_dir):
    """Constraints that made-up fragments break: lines that are none, and two targets."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("urn:f:"), F.col("n_nationkey").cast("string")).alias("s"), (F.col("n_nationkey") % 3).alias("m"))
    facts = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")) for p, o, kind in ((rdf.RDF + "type", F.lit(rdf.CP + "Fragment"), "iri"), (rdf.RDFS + "label", F.lit("l"), "literal"), (rdf.CP + "sourceLines", F.when(F.col("m") == 0, "x-y").otherwise("1-2"), "literal"), (rdf.OA + "hasTarget", F.concat(F.lit("_:t"), "s"), "bnode"), (rdf.OA + "hasTarget", F.when(F.col("m") == 1, F.concat(F.lit("_:u"), "s")), "bnode"))))
    triples = rows.select("s", F.explode(facts).alias("x")).select("s", "x.*", _NULL().alias("datatype"), _NULL().alias("lang")).where("o is not null")
    bad = constraints.violations(triples).where("s like 'urn:f:%'" if "s" in constraints.violations(triples).columns else "node like 'urn:f:%'")
    return bad.select("node", "problem").distinct().groupBy("problem").agg(F.count("*").alias("n")).select(F.lit("Fragment").alias("node"), "problem", "n")


class _Echo:
    """A client without a network: an address answers with its own name, twice with a delay first, or is gone."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def get(self, url: str) -> fetch.Answer:
        n = self.asked[url] = self.asked.get(url, 0) + 1
        size = len(url)
        if size % 7 == 0:
            return fetch.Answer(404)
        if size % 5 == 0 and "?moved" not in url:
            return fetch.Answer(302, {"location": url.split("?")[0] + "?moved"})
        return fetch.Answer(503, {"retry-after": "0"}) if n < 2 and size % 3 == 0 else fetch.Answer(200, {}, f"page of {url}".encode())


@_query("""with u as (select distinct split_part(url, '#', 1) as url from pages where url is not null and split_part(url, '#', 1) <> ''), f as (select url, length(url) as n, split_part(url, '?', 1) || '?moved' as moved from u),
g as (select url, n % 7 = 0 as gone, n % 5 = 0 and n % 7 <> 0 and not contains(url, '?moved') as hops, moved, length(moved) as m from f)
select url, case when gone then 404 when hops and m % 7 = 0 then 404 else 200 end as status, case when hops then moved else url end as final_url, case when hops then 1 else 0 end as hops, case when gone or hops and m % 7 = 0 then null else 'page of ' || case when hops then moved else url end end as body from g""")
def fetched_documents(spark, sf_dir):
    """The documents that pages name, asked for over a client: once each, with another try and redirects followed."""
    wanted = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    got = fetch.fetch(fetch.missing(wanted, spark.createDataFrame([], fetch.FETCHED)), _Echo, fetch.Policy(interval=0, pause=0))
    return got.select("url", "status", "final_url", F.size("chain").alias("hops"), "body")


@_query(f"""with {_PART} select p_partkey, case when p_partkey % 3 = 0 then 'known' else a end as text from p""")
def incremental_outcomes(spark, sf_dir):
    """A run that takes what a run before has found where the document is the same: a third of them here."""
    p = _part(spark, sf_dir)
    targets = p.select(F.col("k").alias("doc_key"), F.lit("").alias("format"), _NULL().alias("locator"), F.lit("").alias("anchor"), F.lit("u").alias("url"))
    docs = p.select(F.col("k").alias("doc_key"), F.col("a").alias("body"), _NULL().alias("miss"), _NULL().alias("miss_reason"))
    stamps = extract.stamped(docs).select("doc_key", "stamp")
    old = p.select(F.col("k").alias("doc_key"), "p_partkey").join(stamps, "doc_key")
    known = old.select("doc_key", F.lit("").alias("format"), _NULL().alias("locator"), F.lit("").alias("anchor"), F.lit("known").alias("text"), F.lit("ok").alias("status"), F.lit("").alias("reason"), F.when(F.col("p_partkey") % 3 == 0, F.col("stamp")).otherwise("other").alias("stamp"))
    return extract.extract_new(targets, docs, known).select(F.col("doc_key").cast("long").alias("p_partkey"), "text")


@_query("select p_partkey, case p_partkey % 3 when 0 then 'parts' when 1 then 'rfc' end as repo, case p_partkey % 3 when 0 then 'k' || p_partkey when 1 then 'rfc' || p_partkey end as key, case p_partkey % 3 when 2 then 'https://parts.example/k' || p_partkey end as minted from part")
def own_repository(spark, sf_dir):
    """A repository that a user has added: its claim, its keys and the names that it mints, before those that come along."""
    registry = DEFAULT.with_connector(Connector("parts", r"parts\.example/(k\d+)", mint=((r"^Part (?P<k>\d+)$", "https://parts.example/k{k}"),)), first=True)
    p = _part(spark, sf_dir)
    by = F.col("p_partkey") % 3
    url = _case(by, F.concat(F.lit("https://parts.example/k"), "k"), F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), "k"), "https://example.org/")
    name = F.when(by == 2, F.concat(F.lit("Part "), "k")).otherwise("Nobody")
    return p.select("p_partkey", registry.claimed_by(url).alias("repo"), registry.key_of(url).alias("key"), registry.minted_url(name).alias("minted"))


@_query("select p_partkey, case p_partkey % 3 when 0 then 'shop' when 1 then 'mdn' end as repo from part")
def configured_repositories(spark, sf_dir):
    """Repositories as a configuration sets them: one more, one with another claim, one taken out."""
    made = config.parse({"claims": {"rfc": "", "mdn": r"docs\.example/(\w+)"}, "repositories": {"shop": {"claim": r"shop\.example/(\d+)"}}})
    url = _case(F.col("p_partkey") % 3, F.concat(F.lit("https://shop.example/"), "k"), F.concat(F.lit("https://docs.example/"), "k"), F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), "k"))
    return _part(spark, sf_dir).select("p_partkey", made.options.registry.claimed_by(url).alias("repo"))


def _claims_ini(body: str) -> bool:
    return body.startswith("[")


def _value(body: str, key: str) -> str:
    return dict(x.split("=", 1) for x in body.split("\n") if "=" in x).get(key, "")


@_query(f"""with {_PART} select p_partkey, case p_partkey % 2 when 0 then a else '[x] first=' || a || ' second=' || b end as text, 'ok' as status from p""")
def own_format(spark, sf_dir):
    """A format that a user has added, asked before those that come along: by detection with a locator, and by lines."""
    p = _part(spark, sf_dir)
    ini = content.Format("ini", "text/x-ini", _claims_ini, extract=_value)
    rows = p.select("p_partkey", _text("[x]\nfirst=", F.col("a"), "\nsecond=", F.col("b")).alias("body"), F.lit("").alias("format"), F.when(F.col("p_partkey") % 2 == 0, "first").alias("locator"), F.lit("").alias("anchor"))
    return _extracted(rows, (ini,))


@_query("""with c as (select count(*) as n, count(*) filter (p_partkey % 4 = 0) as bad from part) select 'Priced' as name, case when n = 0 then '----' when bad > 0 then 'FAIL' else 'PASS' end as status, (n - bad)::bigint as ok, n::bigint as total, bad::bigint as failures from c""")
def own_check(spark, sf_dir):
    """A check that a user has added, in the roll-up beside the others."""
    p = _part(spark, sf_dir)
    none = [spark.createDataFrame([], x) for x in (schemas.SOURCES, schemas.FRAGMENTS)]
    priced = lambda citations, world, resolved: p.select((F.col("p_partkey") % 4 != 0).alias("ok"), F.col("k").alias("label"), F.lit("no price").alias("reason"))
    got = verify.check(verify.Citations(*none), verify.World(spark.createDataFrame([], schemas.DOCUMENTS)), verify.Options(custom=(("Priced", priced),)))
    return got.checks.where("name = 'Priced'").select("name", "status", "ok", "total", "failures")


@_query(f"""with {_PART} select p_partkey, lower(replace(a, ' ', '_')) as file_name, trim(regexp_replace(lower(b), '[^a-z0-9]+', '-', 'g'), '-') as anchor, k as local from p""")
def slugs(spark, sf_dir):
    """Names of files, anchors of headings, and local names of identifiers."""
    p = _part(spark, sf_dir)
    return p.select("p_partkey", text.file_slug(F.col("a")).alias("file_name"), text.anchor_slug(F.col("b")).alias("anchor"), text.local_name(F.concat(F.lit("https://x.org/c#y#"), "k")).alias("local"))


@_query(f"""with {_PART} select p_partkey, left(a || ' ' || b, 40) || chr(10) || '... [' || (length(a || ' ' || b) - 40) || ' more chars]' as text, 'ok' as status from p""")
def cut_texts(spark, sf_dir):
    """Texts of documents at a glance: cut, with how much was left out."""
    p = _part(spark, sf_dir)
    url = F.concat(F.lit("https://x.org/"), "k")
    got = api.texts(spark, p.select(url.alias("url"), F.lit("plain-text").alias("format"), _NULL().alias("locator")), p.select(url.alias("url"), F.concat("a", F.lit("\n"), "b").alias("body")), 40)
    return got.select(F.expr("cast(substring(url, 15) as bigint)").alias("p_partkey"), "text", "status")
