"""Registered queries of the citation engine and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeplane import fixed, schemas
from citeplane.connectors import DEFAULT
from citeplane.functions import formats, text, urls
from citeplane.operators import constraints, extract, locate, repositories, resolve, search, verify
from citeplane.plans import derived
from citeplane.sources import payloads, rdf

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column) -> Column:
    return c.cast("long")


_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_QUOTE = r"trim(regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '(\.\.\.|…)$', ''))"

# search and gates

_HELD = rf"""
with d as materialized (select doc_id, {_NORM.format("text")} as body from documents),
q as materialized (select item_id, {_QUOTE.format("text")} as quote from benchmark),
h as (select item_id, count(*) as n from d join q on contains(body, quote) where length(quote) >= {text.MIN_EVIDENCE} group by item_id)
select q.item_id, coalesce(n, 0)::bigint as n_documents, coalesce(n, 0) > 0 as verified from q left join h using (item_id)
"""


def _verified(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.normalize_ws(F.col("text")).alias("body"))
    quotes = _table(spark, sf_dir, "benchmark").select("item_id", text.quote_of(F.col("text")).alias("quote"))
    found = search.containment(docs, quotes.where(F.length("quote") >= text.MIN_EVIDENCE), **how).groupBy("item_id").agg(F.count("*").alias("n"))
    return quotes.join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), F.expr("coalesce(n, 0) > 0").alias("verified"))


@_query(_HELD)
def snippet_verified(spark, sf_dir):
    """Every benchmark quote with how many documents hold it word for word; documents meet quotes by equal grams of words."""
    return _verified(spark, sf_dir)


@_query(_HELD)
def snippet_verified_blocked(spark, sf_dir):
    """The same as where quotes are too many to be sent: grams meet in a join."""
    return _verified(spark, sf_dir, sent_bytes=0)


@_query(_HELD)
def snippet_verified_nested(spark, sf_dir):
    """The same by a loop over quotes, blocks of a checked size of which are sent to all tasks."""
    return _verified(spark, sf_dir, blocked=False)


@_query(rf"""with q as (select conv_id, turn, {_QUOTE.format("coalesce(text, '')")} as quote from conversations)
select conv_id, turn, length(quote)::bigint as n_chars, case when quote = '' then 'none' when length(quote) < 20 then 'too short' else 'evidence' end as gate from q""")
def snippet_gate(spark, sf_dir):
    quote = _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.quote_of(F.col("text")).alias("quote"))
    return quote.select("conv_id", "turn", _long(F.length("quote")).alias("n_chars"), F.when(F.col("quote") == "", "none").when(F.length("quote") < text.MIN_EVIDENCE, "too short").otherwise("evidence").alias("gate"))


@_query(rf"select doc_id, length({_NORM.format('text')})::bigint as n_chars, length({_NORM.format('text')}) >= 20 as chain_ok, length({_NORM.format('text')}) >= 3 as direct_ok from documents")
def extraction_gate(spark, sf_dir):
    n = F.length(text.normalize_ws(F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", _long(n).alias("n_chars"), (n >= text.MIN_EVIDENCE).alias("chain_ok"), (n >= text.MIN_DIRECT).alias("direct_ok"))


# URLs and routing


@_query("select page_id, split_part(url, '#', 1) as doc_url, left(sha256(split_part(url, '#', 1)), 16) as cache_key, 'url:' || split_part(url, '#', 1) as doc_key from pages")
def document_key(spark, sf_dir):
    none = F.lit(None).cast("string")
    return _table(spark, sf_dir, "pages").select("page_id", urls.document_url(F.col("url")).alias("doc_url"), urls.cache_key(F.col("url")).alias("cache_key"), urls.document_key(F.col("url"), none, none, none).alias("doc_key"))


@_query("select split_part(url, '#', 2) as anchor, count(*)::bigint as n from pages group by 1")
def anchor_citations(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(urls.url_anchor(F.col("url")).alias("anchor")).agg(F.count("*").alias("n"))


@_query("select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, count(*)::bigint as pages, count(distinct split_part(url, '#', 1))::bigint as documents from pages group by 1")
def host_fanout(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(urls.document_url(F.col("url"))).alias("documents"))


_URLS = (
    "https://archive.org/details/item{k}?x=1", "https://www.gutenberg.org/ebooks/{k}.html", "https://developer.mozilla.org/en-us/docs/Web/CSS/:is_{k}#a", "https://www.rfc-editor.org/rfc/RFC{k}.txt",
    "https://www.rfc-editor.org/rfc/rfc{k}.html#section-1", "https://en.wikisource.org/wiki/Book_{k}%20Two", "https://en.wiktionary.org/wiki/w{k}#x", "https://example.com/{k}",
    "https://datatracker.ietf.org/doc/html/draft-Ab-c.d{k}/",
)


def _repo_urls(spark, sf_dir) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    made = None
    for i, u in enumerate(_URLS):
        a, b = u.split("{k}")
        test, value = F.col("p_partkey") % len(_URLS) == i, F.concat(F.lit(a), F.col("p_partkey").cast("string"), F.lit(b))
        made = F.when(test, value) if made is None else made.when(test, value)
    return part.select("p_partkey", made.alias("url"))


_REPO_URLS_SQL = "select p_partkey, case p_partkey % 9 " + " ".join(f"when {i} then '{u.split('{k}')[0]}' || p_partkey || '{u.split('{k}')[1]}'" for i, u in enumerate(_URLS)) + " end as url from part"


@_query(f"""with u as ({_REPO_URLS_SQL}) select p_partkey,
 case p_partkey % 9 when 0 then 'archive' when 1 then 'gutenberg' when 2 then 'mdn' when 4 then 'rfc' when 5 then 'wikisource' when 6 then 'wiktionary' when 8 then 'rfc' end as repo,
 case p_partkey % 9 when 0 then 'item' || p_partkey when 1 then '' || p_partkey when 2 then 'en-us/web/css/_colon_is_' || p_partkey when 4 then 'rfc' || p_partkey when 5 then 'Book_' || p_partkey || ' Two' when 6 then 'w' || p_partkey when 8 then 'draft-ab-c.d' || p_partkey end as repo_key from u""")
def repo_claim(spark, sf_dir):
    """Which repository claims a URL, and under which key."""
    return _repo_urls(spark, sf_dir).select("p_partkey", DEFAULT.claimed_by(F.col("url")).alias("repo"), DEFAULT.key_of(F.col("url")).alias("repo_key"))


@_query("""select p_partkey, case p_partkey % 7 when 0 then 'https://archive.org/details/' || p_partkey when 1 then 'https://www.gutenberg.org/ebooks/' || p_partkey when 2 then 'https://developer.mozilla.org/en-US/docs/' || p_partkey
 when 3 then 'https://www.rfc-editor.org/rfc/rfc' || p_partkey || '.html' when 4 then 'https://en.wikisource.org/wiki/' || p_partkey when 5 then 'https://en.wiktionary.org/wiki/' || p_partkey end as url from part""")
def pattern_mint(spark, sf_dir):
    """URLs that names mint: the first family of names decides."""
    heads = ("Archive ", "Gutenberg ", "MDN ", "RFC ", "Wikisource ", "Wiktionary ", "Nobody ")
    name = F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 7 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", DEFAULT.minted_url(name).alias("url"))


# text


@_query(r"""with b as (select 'page' as kind, page_id as id, html as body from pages union all select 'document', doc_id, text from documents),
h as (select *, lower(ltrim(left(body, 1000), E' \t\n\r\x0b\x0c')) as head from b)
select kind, id, case when starts_with(head, '<html') or starts_with(head, '<!doctype') or regexp_matches(regexp_replace(head, '^(<!--.*?-->\s*)+', '', 's'), '^OPENING') or contains(head, '<body') or contains(head, '<head') then 'html'
 when regexp_matches(body, '(?m)^#{1,6}\s') then 'markdown' when regexp_matches(body, '(?m)^={2,6}[^=]') or contains(left(body, 2000), '[[') or contains(left(body, 2000), '{{') then 'wikitext' else 'plain-text' end as format from h""".replace("OPENING", fixed.HTML_OPENING_TAG))
def detect_format(spark, sf_dir):
    both = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    both = both.unionByName(_table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return both.select("kind", "id", formats.detect_format(F.col("body")).alias("format"))


@_query("select doc_id, case when length(text) > 200 then left(text, 200) || chr(10) || '... [' || (length(text) - 200) || ' more chars]' else text end as shown from documents")
def truncate_marker(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("shown"))


@_query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as lines from documents")
def line_range(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.line_range(F.col("text"), F.lit("2-4")).alias("lines"))


@_query(rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
s as (select doc_id, n, {_NORM.format("line")} as x from l), t as (select *, sum(length(x) + 1) over (partition by doc_id order by n) - length(x) - 1 as pos0, row_number() over (partition by doc_id order by n) as k from s where x <> ''),
b as (select doc_id, string_agg(x, ' ' order by n) as body, trim(left(max(x) filter (k = 3), 60)) as quote from t group by doc_id), q as (select *, strpos(body, quote) - 1 as pos from b where length(quote) >= 20)
select q.doc_id, min(n) filter (pos0 + length(x) > pos) || '-' || max(n) filter (pos0 < pos + length(quote)) as lines from q join t using (doc_id) group by q.doc_id""")
def line_locate(spark, sf_dir):
    """The line range where the beginning of each document's third line with words stands first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    third = F.element_at(F.filter(F.transform(F.split("body", "\n"), text.normalize_ws), lambda x: x != ""), 3)
    rows = docs.where(F.size(F.filter(F.transform(F.split("body", "\n"), text.normalize_ws), lambda x: x != "")) >= 3).withColumn("quote", F.trim(F.substring(third, 1, 60))).where(F.length("quote") >= 20)
    return _lines(rows)


def _lines(rows: DataFrame) -> DataFrame:
    """Line ranges without Python: running lengths of the normalized lines against the quote's place."""
    split = F.filter(F.transform(F.split("body", "\n"), lambda x, i: F.struct((i + 1).alias("n"), text.normalize_ws(x).alias("x"))), lambda s: s["x"] != "")
    flat = rows.withColumn("s", split).withColumn("pos", F.instr(F.array_join(F.transform("s", lambda x: x["x"]), " "), F.col("quote")) - 1)
    walk = F.expr("aggregate(s, named_struct('at', 0, 'a', 0, 'b', 0), (m, x) -> named_struct('at', m.at + length(x.x) + 1, 'a', if(m.a = 0 and m.at + length(x.x) > pos, x.n, m.a), 'b', if(m.at < pos + length(quote), x.n, m.b)))")
    return flat.withColumn("w", walk).select("doc_id", F.concat_ws("-", F.col("w.a").cast("string"), F.col("w.b").cast("string")).alias("lines"))


_SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9_]+', '_', 'g'), '_')"


@_query(f"select p_partkey, 'urn:citeplane:source_' || {_SLUG.format('p_name')} as urn, 'https://x.org/c#fragment_' || {_SLUG.format("p_name || ' ' || p_brand")} as with_base from part")
def slug_urn(spark, sf_dir):
    both = F.concat_ws(" ", "p_name", "p_brand")
    return _table(spark, sf_dir, "part").select("p_partkey", text.urn(F.col("p_name"), "source").alias("urn"), text.urn(both, "fragment", "https://x.org/c").alias("with_base"))


@_query(f"select 'urn:citeplane:source_' || {_SLUG.format('p_type')} as urn, count(*)::bigint as n from part group by 1 having count(*) > 1")
def urn_collisions(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy(text.urn(F.col("p_type"), "source").alias("urn")).agg(F.count("*").alias("n")).where("n > 1")


@_query("""with r as (select p_partkey, p_size, ['', 'X', 'XX', 'XXX', 'XL', 'L'][p_size // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1] as roman from part)
select p_partkey, roman, p_size::int as number, p_size::int as trailing, case when p_partkey % 2 = 0 then p_size || '.' || p_size end as designator from r""")
def roman_ordinal(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_size", text.int_to_roman(F.col("p_size")).alias("roman"))
    size = F.col("p_size").cast("string")
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Appendix "), size, F.lit("."), size, F.lit(" on"))).otherwise(F.concat(F.lit("book "), size))
    return rows.select("p_partkey", "roman", text.roman_to_int(F.lower("roman")).alias("number"), text.trailing_number(F.concat(F.lit("Book "), "roman")).alias("trailing"), text.designator(title).alias("designator"))


@_query(rf"""select item_id, array_to_string(string_split({_NORM.format("text")}, ' ')[1:5], ' ') || case when len(string_split({_NORM.format("text")}, ' ')) > 5 then '...' else '' end as auto_label,
 trim(array_to_string(list_filter(string_split('# a' || chr(10) || text, chr(10)), lambda x: not starts_with(x, '#') and trim(x) <> ''), chr(10))) as stripped from benchmark""")
def text_labels(spark, sf_dir):
    body = F.concat(F.lit("# a\n"), "text")
    return _table(spark, sf_dir, "benchmark").select("item_id", text.auto_label(F.col("text")).alias("auto_label"), text.strip_headers(body).alias("stripped"))


@_query(rf"select item_id, 'differs only in case' as upper_kind, case when {_NORM.format('text')} = '' then null else 'differs only in inline markup (backticks, emphasis)' end as markup_kind from benchmark where {_NORM.format('text')} <> ''")
def typographic_kind(spark, sf_dir):
    """How a quote that is written otherwise differs from its source."""
    source = text.normalize_ws(F.col("text"))
    marked = F.array_join(F.transform(F.split(source, " "), lambda w: F.concat(F.lit("*"), w, F.lit("`"))), " ")
    rows = _table(spark, sf_dir, "benchmark").where(source != "")
    return rows.select("item_id", text.typographic_kind(F.upper(source), source).alias("upper_kind"), text.typographic_kind(marked, source).alias("markup_kind"))


# resolution


def _hierarchy(spark, sf_dir) -> DataFrame:
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    levels = [
        ("region", key("r", "r_regionkey"), none, F.concat(F.lit("https://example.org/"), "r_name")),
        ("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), F.when(F.col("n_nationkey") % 5 == 0, F.lit(""))),
        ("customer", key("c", "c_custkey"), key("n", "c_nationkey"), F.when(F.col("c_custkey") % 10 == 0, key("https://example.org/c/", "c_custkey"))),
        ("orders", key("o", "o_orderkey"), key("c", "o_custkey"), none),
        ("lineitem", F.concat_ws("-", key("l", "l_orderkey"), "l_linenumber"), key("o", "l_orderkey"), none),
    ]
    out = None
    for table, sid, up, url in levels:
        one = _table(spark, sf_dir, table).select(sid.alias("source_id"), sid.alias("label"), url.alias("url"), none.alias("type"), up.alias("part_of"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("""with c as materialized (select c_custkey, case when c_custkey % 10 = 0 then 'https://example.org/c/' || c_custkey end as url, case when n_nationkey % 5 = 0 then '' end as nation_url, 'https://example.org/' || r_name as region_url
  from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey),
o as materialized (select o_orderkey, c.url, nation_url, region_url from orders left join c on o_custkey = c_custkey)
select 'r' || r_regionkey as source_id, 'https://example.org/' || r_name as url from region union all select 'n' || n_nationkey, 'https://example.org/' || r_name from nation left join region on n_regionkey = r_regionkey
 union all select 'c' || c_custkey, coalesce(url, region_url) from c union all select 'o' || o_orderkey, coalesce(url, region_url) from o union all select 'l' || l_orderkey || '-' || l_linenumber, url from lineitem left join o on l_orderkey = o_orderkey""")
def part_of_url(spark, sf_dir):
    """A source's URL or its nearest ancestor's, at most three up: line items reach a customer or nation, no region."""
    return resolve.source_urls(_hierarchy(spark, sf_dir)).select("source_id", F.col("resolved_url").alias("url"))


def _page_sources(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    return _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_id"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("label"), F.when(F.col("page_id") % 11 != 0, F.col("url")).alias("url"), F.lit("html").alias("type"), none.alias("part_of"))


def _turn_fragments(spark, sf_dir) -> DataFrame:
    """Turns cite pages by a running number, some of which no page has."""
    none = F.lit(None).cast("string")
    rows, sources = _table(spark, sf_dir, "conversations"), max(_table(spark, sf_dir, "pages").count() + 9, 300)
    return rows.select(
        F.concat_ws(".", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("urn"), F.concat(F.lit("p"), ((F.col("conv_id") * 7 + F.col("turn")) % sources).cast("string")).alias("source_id"), F.col("role").alias("label"), F.col("text").alias("snippet"),
        none.alias("selector"), F.when(F.col("turn") % 4 == 3, "Part 1").alias("section"), F.when(F.col("turn") % 4 == 2, "1-3").alias("lines"), none.alias("location"),
    )


_CHAIN = """with s as (select 'p' || page_id as sid, page_id, case when page_id % 11 <> 0 then url end as url from pages),
f as (select 't.' || conv_id || '.' || turn as urn, 'p' || ((conv_id * 7 + turn) % (select greatest(count(*) + 9, 300) from pages)) as sid, role as label, turn, text from conversations)"""


@_query(_CHAIN + """ select f.urn, f.label, case when s.sid is null then 'no_source' when s.url is null then 'no_url' else 'resolved' end as status, s.url, 'Page ' || s.page_id as source,
 case when turn % 4 = 3 then 'section' when s.sid is null then '' else 'text/html' end as format, case when turn % 4 = 3 then 'Part 1' when turn % 4 = 2 then '1-3' end as locator, case when s.url is not null then 'url:' || split_part(s.url, '#', 1) end as doc_key from f left join s using (sid)""")
def chain_resolve(spark, sf_dir):
    rows = resolve.chain(_turn_fragments(spark, sf_dir), _page_sources(spark, sf_dir))
    return rows.select("urn", "label", "status", "url", "source", "format", "locator", "doc_key")


@_query("""select p.page_id, case when url = '' or url is null then 'no_url' else 'resolved' end as status, split_part(url, '#', 2) as anchor, case when page_id % 3 = 0 then 'section' else 'text/html' end as format,
 case when page_id % 3 = 0 then 'Intro' when page_id % 3 = 1 then 'p' end as locator from pages p""")
def direct_resolve(spark, sf_dir):
    none = F.lit(None).cast("string")
    terms = _table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("urn"), F.lit("x").alias("label"), "url", F.lit("html").alias("type"), none.alias("location"), F.lit("").alias("lines"), F.when(F.col("page_id") % 3 == 0, "Intro").alias("section"), F.when(F.col("page_id") % 3 == 1, "p").alias("selector"), none.alias("snippet"),
    )
    return resolve.direct(terms).select(F.col("urn").cast("long").alias("page_id"), "status", "anchor", "format", "locator")


# checks


def _run(spark, sf_dir) -> verify.Report:
    """Each document quotes its own beginning, every fourth one that of the document before it."""
    none = F.lit(None).cast("string")
    docs = _table(spark, sf_dir, "documents")
    url = lambda c: F.concat(F.lit("https://example.org/d/"), c.cast("string"))
    sources = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("label"), url(F.col("doc_id")).alias("url"), F.lit("plain-text").alias("type"), none.alias("part_of"))
    target = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    fragments = docs.select(F.concat(F.lit("urn:f:"), F.col("doc_id").cast("string")).alias("urn"), target.cast("string").alias("source_id"), F.lit("start").alias("label"), F.substring("text", 1, 60).alias("snippet"), none.alias("selector"), none.alias("section"), none.alias("lines"), none.alias("location"))
    sites = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("urn:f:"), F.col("doc_id").cast("string")).alias("urn"), F.lit("book.md").alias("file"), (F.col("doc_id") % 90 + 1).cast("int").alias("line"))
    fetches = docs.where("doc_id % 5 <> 0").select(url(F.col("doc_id")).alias("url"), url(F.col("doc_id") + 1).alias("final_url"), F.when(F.col("doc_id") % 7 == 0, F.array(F.struct(F.lit(301).alias("status"), url(F.col("doc_id")).alias("url")))).otherwise(F.array().cast("array<struct<status:int,url:string>>")).alias("chain"))
    return verify.check(verify.Citations(sources, fragments, None, sites), verify.World(docs.select(url(F.col("doc_id")).alias("url"), F.col("text").alias("body")), fetches))


_RUN = rf"""with d as materialized (select doc_id, {_NORM.format("text")} as body, trim(left(text, 60), E' \t\n\r\x0b\x0c') as raw, {_QUOTE.format("left(text, 60)")} as quote from documents),
r as materialized (select f.doc_id, f.raw, f.quote, s.doc_id as sid, s.body from d f left join d s on s.doc_id = case when f.doc_id % 4 = 0 then f.doc_id - 1 else f.doc_id end),
v as materialized (select *, sid is not null as c1, sid is not null and length(body) >= 20 as c2, raw <> '' and length(quote) >= 20 and sid is not null and body <> '' and contains(body, quote) as c3 from r)"""


@_query(_RUN + """, u as (select distinct sid from v where sid is not null), c as (
 select 'Fragments: cache resolution' as name, count(*) filter (c1) as ok, count(*) as total, count(*) filter (not c1) as failures, 0 as warnings from v union all
 select 'Fragments: content extraction', count(*) filter (c2), count(*), count(*) filter (not c2), 0 from v union all select 'Fragments: snippet verified', count(*) filter (c3), count(*), count(*) filter (not c3), 0 from v union all
 select 'Terms', 0, 0, 0, 0 union all select 'Source URLs', count(*) filter (sid % 5 <> 0 and sid % 7 <> 0), count(*), 0, count(*) filter (not (sid % 5 <> 0 and sid % 7 <> 0)) from u)
select name, case when total = 0 then '----' when failures > 0 then 'FAIL' when warnings > 0 then 'WARN' else 'PASS' end as status, ok::bigint as ok, total::bigint as total, failures::bigint as failures, warnings::bigint as warnings from c""")
def check_rollup(spark, sf_dir):
    """The whole verification of a citation of each document."""
    return _run(spark, sf_dir).checks.select("name", "status", "ok", "total", "failures", "warnings")


@_query(_RUN + " select 'urn:f:' || doc_id as urn, case when c3 then 'verified' else 'failed' end as status from v")
def provenance_status(spark, sf_dir):
    return _run(spark, sf_dir).verdicts.select("urn", "status")


@_query(_RUN + " select 'd' || sid as source, 'https://example.org/d/' || sid as url, case when sid % 5 = 0 then 'unknown' else 'moved' end as why from (select distinct sid from v where sid is not null) where sid % 5 = 0 or sid % 7 = 0")
def redirect_check(spark, sf_dir):
    found = _run(spark, sf_dir).findings.where(F.col("check") == verify.URLS)
    return found.select("source", "url", F.when(F.col("reason").startswith("moved"), "moved").otherwise("unknown").alias("why"))


@_query(_RUN + """ select 'urn:f:' || doc_id as urn, case when raw = '' then 'none' when length(quote) < 20 then 'short' when sid is null then 'unresolved' when body = '' then 'other' else 'not found' end as why,
 case when doc_id % 2 = 0 then 'book.md:' || (doc_id % 90 + 1) else '' end as cited_by from v where not c3""")
def snippet_findings(spark, sf_dir):
    found = _run(spark, sf_dir).findings.where(F.col("check") == verify.SNIPPET)
    r = F.col("reason")
    why = F.when(r.startswith("no snippet"), "none").when(r.startswith("snippet is too"), "short").when(r.startswith("cache not"), "unresolved").when(r == verify.NOT_FOUND, "not found").otherwise("other")
    return found.select("urn", why.alias("why"), F.array_join(F.transform("cited_by", lambda s: F.concat_ws(":", s["file"], s["line"].cast("string"))), ",").alias("cited_by"))


@_query(_RUN + """, c as (select count(*) filter (not c1) as a, count(*) filter (not c2) as b, count(*) filter (not c3) as c, count(*) filter (c1) + count(*) filter (c2) + count(*) filter (c3) as ok, count(*) as n from v),
u as (select count(*) filter (sid % 5 <> 0 and sid % 7 <> 0) as ok, count(*) as n from (select distinct sid from v where sid is not null))
select ((a = 0)::int + (b = 0)::int + (c = 0)::int + (u.ok = u.n)::int)::bigint as pass, ((a > 0)::int + (b > 0)::int + (c > 0)::int)::bigint as fail, (u.ok < u.n)::bigint as warn, (c.ok + u.ok)::bigint as verified, c.n + u.n = 0 as nothing_verified, a + b + c > 0 or c.n + u.n = 0 as failed from c, u""")
def report_summary(spark, sf_dir):
    return verify.summary(_run(spark, sf_dir).checks)


def _repo_run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved citations of repository URLs, crawl outcomes and supersessions, all derived from parts."""
    none = F.lit(None).cast("string")
    rows = _repo_urls(spark, sf_dir)
    terms = rows.select(F.col("p_partkey").cast("string").alias("urn"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("label"), "url", *(none.alias(c) for c in ("type", "location", "lines", "section", "selector", "snippet")))
    resolved = resolve.direct(terms).withColumn("ord", F.concat(F.lit("1"), "urn"))
    known = resolved.where("kind = 'repo'").withColumn("k", F.col("urn").cast("long"))
    crawls = known.where("k % 4 <> 0").select("repo", "key", F.when(F.col("k") % 4 == 1, "ok").when(F.col("k") % 4 == 2, "not_found").otherwise("unavailable").alias("status"), F.lit("503").alias("reason"))
    names = F.when(F.col("k") % 2 == 0, F.array(F.lit("rfc9"), F.lit("rfc10"))).otherwise(F.array().cast("array<string>"))
    later = known.where("repo = 'rfc' and k % 3 <> 0").select("repo", "key", F.when(F.col("k") % 3 == 1, "superseded").otherwise("current").alias("status"), names.alias("superseded_by"), F.lit("").alias("reason"))
    return resolved, crawls, later


_CASES = f"""with u as ({_REPO_URLS_SQL}), r as (select *, case when p_partkey % 9 in (3, 7) then null when p_partkey % 9 in (4, 8) then 'rfc' else 'other' end as repo from u)"""


@_query(_CASES + """ select 'part ' || p_partkey as label, url, case p_partkey % 4 when 2 then 'not_found' else 'unavailable' end as why, 'failure' as severity from r where repo is not null and p_partkey % 4 in (2, 3)""")
def repo_check(spark, sf_dir):
    resolved, crawls, _ = _repo_run(spark, sf_dir)
    _, found = verify.repo_check(resolved, crawls, False)
    named = resolved.select(F.col("url").alias("__u"), F.col("label").alias("name"))
    found = found.drop("label").join(named, F.col("url") == F.col("__u"))
    return found.select(F.col("name").alias("label"), "url", F.when(F.contains(F.col("reason"), F.lit("has no such")), "not_found").otherwise("unavailable").alias("why"), "severity")


@_query(_CASES + """ select url, case when p_partkey % 2 = 0 then 'named' else 'unnamed' end as successor, 'warning' as severity from r where repo = 'rfc' and p_partkey % 3 = 1""")
def supersession_check(spark, sf_dir):
    resolved, _, later = _repo_run(spark, sf_dir)
    _, found = verify.supersession_check(resolved, later, False)
    return found.select("url", F.when(F.contains(F.col("reason"), F.lit("by rfc9, rfc10")), "named").otherwise("unnamed").alias("successor"), "severity")


@_query("""select 'q' || item_id as urn, coalesce(string_agg(role || ':' || turn, ',' order by role, turn), '') as cited_by from benchmark left join conversations on conv_id % 97 = item_id group by item_id""")
def cite_sites(spark, sf_dir):
    none = F.lit(None).cast("string")
    found = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("urn"), none.alias("check"))
    sites = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("q"), (F.col("conv_id") % 97).cast("string")).alias("urn"), F.col("role").alias("file"), F.col("turn").cast("int").alias("line"))
    return verify.with_cite_sites(found, sites).select("urn", F.array_join(F.transform("cited_by", lambda s: F.concat_ws(":", s["file"], s["line"].cast("string"))), ",").alias("cited_by"))


# documents

_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')"


def _pages_extracted(spark, sf_dir, kind: str, locator: str | None) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    key = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    targets = pages.select(key.alias("doc_key"), F.lit(kind).alias("format"), F.lit(locator).cast("string").alias("locator"), F.lit("").alias("anchor"), "url")
    none = F.lit(None).cast("string")
    docs = pages.select(key.alias("doc_key"), F.col("html").alias("body"), none.alias("miss"), none.alias("miss_reason"))
    return extract.extract(targets, docs).select(F.expr("cast(substring(doc_key, 2) as bigint)").alias("page_id"), "text", "status")


@_query(rf"""select page_id, trim(regexp_replace({_ENTITIES.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '^.*?<body[^>]*>', '', 's'), '<!--(.*?)-->', '\1', 'gs'), '</(p|li|ul|nav|div|article|h1|footer)>|<br>', chr(10), 'g'), '<[^>]+>', '', 'g')")}, '\s+', ' ', 'g')) as text, 'ok' as status from pages""")
def html_text(spark, sf_dir):
    return _pages_extracted(spark, sf_dir, "html", None)


@_query(rf"""select page_id, trim(regexp_replace({_ENTITIES.format(r"regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")}, '\s+', ' ', 'g')) as text, 'ok' as status from pages""")
def css_extract(spark, sf_dir):
    return _pages_extracted(spark, sf_dir, "html", "article > h1")


@_query(rf"""select page_id, trim(regexp_replace({_ENTITIES.format(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) as title, 'html' as format, 1::bigint as n_sections from pages""")
def html_sections(spark, sf_dir):
    """Title, detected format and number of sections of each page, parsed once."""
    import pyarrow as pa

    def run(batches):
        from citeplane.operators.content import Document

        for batch in batches:
            docs = [Document(b or "") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.title() for d in docs]), pa.array([d.kind for d in docs]), pa.array([sum(1 for _ in d.sections().below()) if d.sections() else 0 for d in docs], pa.int64())], names=["page_id", "title", "format", "n_sections"])

    return _table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, title string, format string, n_sections long")


def _page_quotes(spark, sf_dir) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    first = F.regexp_extract("html", r"(?s)</h1>\s*<p>(?:<b>)?([^<&]{30,80})", 1)
    return pages.select("page_id", F.col("html").alias("body"), first.alias("quote"))


@_query(rf"""with p as (select page_id, regexp_extract(html, '(?s)</h1>\s*<p>(?:<b>)?([^<&]{{30,80}})', 1) as quote, trim(regexp_replace({_ENTITIES.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '\s+', ' ', 'g')) as title from pages)
select page_id, case when quote <> '' then 'section' end as format, case when quote <> '' then case when contains(title, ',') then chr(39) || title || chr(39) else title end end as locator, case when quote <> '' then 'section' else 'none' end as found_by, 0::bigint as ambiguous from p""")
def locate_selector(spark, sf_dir):
    """A target that leads back to the beginning of each page's first paragraph."""
    found = locate.locate(_page_quotes(spark, sf_dir), ["page_id"])
    return found.select("page_id", "format", "locator", "found_by", _long(F.col("ambiguous")).alias("ambiguous"))


@_query(rf"""with p as (select page_id, regexp_extract(html, '(?s)<li>(.*?)</li>', 1) as li, trim(regexp_replace({_ENTITIES.format("regexp_replace(regexp_extract(html, '(?s)<li>(.*?)</li>', 1), '<[^>]+>', '', 'g')")}, '\s+', ' ', 'g')) as text from pages)
select page_id, case when li = '' then 'no_section' else 'ok' end as status, length(text)::int as n_chars from p""")
def section_extract(spark, sf_dir):
    """The first paragraph of each page's first section, by a section selector."""
    return _pages_extracted(spark, sf_dir, "section", "paragraph 1").select("page_id", "status", F.length("text").alias("n_chars"))


@_query(rf"""with b as (select item_id, {_NORM.format("text")} as source, regexp_matches(text, '^\S+ ') as more, len(string_split({_NORM.format("text")}, ' ')) as n from benchmark)
select item_id, source as source_text, case when more then 2.0::double * n / (2 * n + 1) else 1.0 end as ratio, '' as kind, case when more then 'indeed' else '' end as missing, '' as extra from b""")
def closest_match(spark, sf_dir):
    """Why a benchmark quote with a word more isn't found in its own text."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text"), F.regexp_replace("text", r"\A(\S+) ", "$1 indeed ").alias("quote"), F.lit("").alias("where"))
    return locate.diagnose(rows, ["item_id"]).select("item_id", "hint.source_text", "hint.ratio", "hint.kind", F.array_join("hint.missing", " ").alias("missing"), F.array_join("hint.extra", " ").alias("extra"))


# repositories


@_query("select p_partkey, case p_partkey % 3 when 0 then 'b_djvu.txt' when 1 then 'a.txt' end as file from part")
def archive_files(spark, sf_dir):
    """The best full-text file of an item's metadata."""
    listed = F.when(F.col("p_partkey") % 3 == 0, '{"files": [{"name": "a.txt"}, {"name": "b_djvu.txt", "format": "DjVuTXT"}]}').when(F.col("p_partkey") % 3 == 1, '{"files": [{"name": "z.txt"}, {"name": "a.txt", "format": "Text"}]}').otherwise('{"files": [{"name": "x.pdf"}]}')
    return _table(spark, sf_dir, "part").select("p_partkey", payloads.archive_file(listed).alias("file"))


@_query("select p_partkey, case when p_partkey % 4 = 3 then null when p_partkey % 4 = 0 then 'superseded' when p_partkey % 4 = 1 then 'current' else 'unknown' end as status, case when p_partkey % 4 = 0 then least('rfc2', 'rfc' || p_partkey) || ',' || greatest('rfc2', 'rfc' || p_partkey) when p_partkey % 4 <> 3 then '' end as by from part where p_partkey > 2")
def supersession_payload(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    sent = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('{"objects": [{"source": "/api/v1/doc/document/rfc'), k, F.lit('/"}, {"source": "/api/v1/doc/document/rfc2/"}, {"source": "/x"}]}'))).when(F.col("p_partkey") % 4 == 1, '{"objects": []}').otherwise("[]")
    key = F.concat(F.when(F.col("p_partkey") % 4 == 3, "draft-").otherwise("rfc"), k)
    got = payloads.supersession(sent, key)
    return _table(spark, sf_dir, "part").where("p_partkey > 2").select("p_partkey", got["status"].alias("status"), F.array_join(F.sort_array(got["superseded_by"]), ",").alias("by"))


@_query("""with d as (select doc_id // 20 as book, doc_id % 20 + 1 as n, text from documents), b as (select book, sum(length(regexp_replace(text, '^(?:#[^\\n]*\\n?)*(?:[ \\t\\r]*\\n)*', ''))) + 2 * (count(*) - 1) as n_chars from d group by book)
select b.book, b.n_chars::bigint as n_chars, 'k2' as by_number, 'k' || (book % 20 + 1) as by_title from b where exists (select 1 from d where d.book = b.book and n = 2) and exists (select 1 from d where d.book = b.book and n = book % 20 + 1)""")
def book_chapters(spark, sf_dir):
    """Books of twenty documents each: the length of the whole, and the chapters that a number and a title name."""
    docs = _table(spark, sf_dir, "documents").withColumn("book", F.expr("doc_id div 20")).withColumn("n", F.expr("cast(doc_id % 20 + 1 as int)"))
    key = F.concat(F.lit("b"), F.col("book").cast("string"))
    title = F.concat(F.lit("On "), F.sha1(F.col("n").cast("string")))
    files = docs.select(F.lit("gutenberg").alias("repo"), key.alias("key"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("name"), title.alias("title"), F.col("n").alias("number"), F.concat(F.lit("# header\n\n"), "text").alias("body"))
    book = F.expr("cast(substring(key, 2) as bigint)").alias("book")
    whole = repositories.books(files).select(book, _long(F.length("body")).alias("n_chars"))
    titled = docs.select(F.lit("gutenberg").alias("repo"), key.alias("key"), F.concat(F.lit("on "), F.sha1((F.col("book") % 20 + 1).cast("string"))).alias("location"))
    wanted = files.select("repo", "key", F.lit("chapter:2").alias("location")).unionByName(titled).distinct()
    named = repositories.choose(wanted, files).groupBy(book).agg(F.max(F.when(F.col("location") == "chapter:2", F.col("name"))).alias("by_number"), F.max(F.when(F.col("location") != "chapter:2", F.col("name"))).alias("by_title"))
    return whole.join(named.where("by_number is not null and by_title is not null"), "book")


# triples


def _citations(spark, sf_dir) -> verify.Citations:
    none = F.lit(None).cast("string")
    wide = lambda df, schema: df.select(*(F.col(n) if n in df.columns else none.alias(n) for n in (x.split()[0] for x in schema.split(", "))))
    return verify.Citations(wide(_page_sources(spark, sf_dir), schemas.SOURCES), wide(_turn_fragments(spark, sf_dir), schemas.FRAGMENTS))


@_query("""with f as (select 't.' || conv_id || '.' || turn as urn, turn, text from conversations)
select 'https://schema.org/url' as p, count(*)::bigint as n from pages where page_id % 11 <> 0 union all select 'http://www.w3.org/ns/oa#exact', count(distinct urn) from f where text is not null union all select 'http://www.w3.org/ns/oa#hasTarget', count(distinct urn) from f""")
def emit_triples(spark, sf_dir):
    """Lines of N-Triples by predicate, for three predicates."""
    lines = rdf.n_triples(rdf.citation_triples(_citations(spark, sf_dir)))
    p = F.regexp_extract("value", r"\A\S+ <([^>]+)>", 1)
    return lines.groupBy(p.alias("p")).agg(F.count("*").alias("n")).where(F.col("p").isin(rdf.SCHEMA + "url", rdf.OA + "exact", rdf.OA + "hasTarget"))


@_query("""with f as (select distinct 'p' || ((conv_id * 7 + turn) % (select greatest(count(*) + 9, 300) from pages)) as sid, 't.' || conv_id || '.' || turn as urn from conversations), s as (select 'p' || page_id as sid, page_id from pages)
select 'AnnotationTarget' as shape, 'a value is of the wrong class' as problem, count(*)::bigint as n from f where sid not in (select sid from s) having count(*) > 0 union all select 'Source', 'neither a URL nor a parent', count(*) from s where page_id % 11 = 0""")
def constraint_report(spark, sf_dir):
    """Broken constraints of the citations as triples, counted."""
    return constraints.violations(rdf.citation_triples(_citations(spark, sf_dir))).groupBy("shape", "problem").agg(F.count("*").alias("n"))


@_query("""select 't.' || conv_id || '.' || turn as urn, 'p' || ((conv_id * 7 + turn) % (select greatest(count(*) + 9, 300) from pages)) as source_id, role as label, nullif(text, '') as snippet, case when turn % 4 = 3 then 'Part 1' end as section, case when turn % 4 = 2 then '1-3' end as lines from conversations""")
def triples_round_trip(spark, sf_dir):
    """Fragments as they come back from triples."""
    return rdf.citations_of(rdf.citation_triples(_citations(spark, sf_dir))).fragments.select("urn", "source_id", "label", "snippet", "section", "lines")


QUERIES |= derived.QUERIES
SQL |= derived.SQL
