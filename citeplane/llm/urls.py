"""Operator 10, URL filters: rules, and empirical-Bayes host reputation where no rule fits.

Labelled pages give each host its outcomes; the query takes a page as bad where ``labels.quality`` of the row whose
doc_id is its page_id is 0, as no other table labels pages. A host's registered domain is its public suffix and the label
before it. Public suffixes are the last label or, by rule, the last two where the last has two letters and the one before
it is in ``SECOND_LEVEL`` (co.uk, com.au); others of several labels can be given as ``suffixes``, a list of a checked
size. An IP address is its own domain and suffix. User names, ports and a final dot don't count. A host's beta prior has the mean of its registered domain, that of the
domain the mean of its suffix, that of the suffix the overall mean; the weight of each prior is estimated from how much
the children of one parent differ (analysis of variance, method of moments), so little data shrinks far and much data
stands for itself. A page is blocked if even the lower posterior bound of its host's share of bad pages is over
``MAX_BAD``.

Only DataFrame functions. Counts are pre-aggregated by host before they move, and pages meet their host's figure in a
join that can split a hot host; the figures of hosts are never collected. Three numbers reach the driver.

Defined results: a null url, or one without ``://``, has an empty host and path, and the posterior of the empty host; a
page with a null id counts as unlabelled; repeated pages are judged each; of repeated labels a bad one decides; null
labels are no outcome; an empty label table leaves the priors at one half, which blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_BAD = 0.5
Z = 1.645
#: Labels that stand before a country's two letters in public suffixes of two labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: IPv4 in four numbers, or IPv6 in brackets.
ADDRESS = r"\A(?:\d{1,3}(?:\.\d{1,3}){3}|\[[0-9a-f:.]*\])\z"
#: Characters of further suffixes that one expression takes.
SUFFIX_BYTES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":\d*\z", ""), r"\.\z", "")


def suffix_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The public suffix: the longest of ``suffixes`` that fits, else two labels or one by rule; an IP address is its own."""
    name = name_of(host)
    two = rf"(?:\A|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})\z"
    found = F.when(name.rlike(ADDRESS), name)
    if sum(map(len, suffixes)) > SUFFIX_BYTES:
        raise ValueError("the list of suffixes is too long for an expression")
    for x in sorted(suffixes, key=lambda x: (-x.count("."), x)):
        found = found.when((name == x) | name.endswith("." + x), x)
    return found.when(name.rlike(two), F.regexp_extract(name, two, 1)).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The public suffix and the label before it; the host itself where it has no more labels, or is an IP address."""
    name = name_of(host)
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when((name == suffix) | name.rlike(ADDRESS), name).otherwise(F.array_join(F.reverse(F.slice(F.reverse(F.split(name, r"\.")), F.lit(1), labels)), "."))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def _under(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key, F.col("n").alias("pn"), F.col("bad").alias("pb")), key)


def _weight(rows: DataFrame, key: str) -> float:
    """Weight of the parents' mean as a prior: (1 - r) / r for the intraclass correlation r, within [1, 1000].

    ``rows`` are children with their own counts (n, bad) and their parent's (pn, pb).
    """
    p, m = F.try_divide("bad", "n"), F.try_divide("pb", "pn")
    x = rows.where("n > 0").agg(F.count("*").alias("k"), F.countDistinct(key).alias("g"), F.sum("n").alias("n"), F.sum(F.try_divide(F.col("n") * F.col("n"), F.col("pn"))).alias("nn"), F.sum(F.col("n") * (p - m) * (p - m)).alias("between"), F.sum(F.col("n") * p * (1 - p)).alias("within")).first()
    if not x["k"] or x["k"] <= x["g"] or x["n"] <= x["k"]:
        return 1000.0 if x["k"] else 1.0
    msb, msw, size = x["between"] / (x["k"] - x["g"]), x["within"] / (x["n"] - x["k"]), (x["n"] - x["nn"]) / (x["k"] - x["g"])
    total = msb + (size - 1) * msw
    r = (msb - msw) / total if total > 0 else 0.0
    return min(1000.0, max(1.0, (1 - r) / r)) if r > 0 else 1000.0


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, bad, bad_mean, bad_low) of every host of ``pages`` (page_id, host); ``outcomes`` is (page_id, bad)."""
    bad = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    # Written before pages meet them, and so are all counts below: a join of plain exchanges can split a hot key, as of a
    # suffix that most domains have, while one that took over an aggregation's partitions would leave it to one task.
    bad = common.materialize(bad)
    counts = lambda df, *keys: common.materialize(df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    hosts = pages.select("page_id", "host").join(bad, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = common.materialize(hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    domains = counts(hosts, "domain", "suffix")
    suffix = counts(domains, "suffix")
    total = suffix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    w0 = _weight(suffix.select(F.lit(1).alias("one"), "n", "bad", F.lit(total["n"]).alias("pn"), F.lit(total["bad"]).alias("pb")), "one")
    w1, w2 = _weight(_under(domains, suffix, "suffix"), "suffix"), _weight(_under(hosts, domains, "domain"), "domain")
    m0 = (total["bad"] + 1) / (total["n"] + 2)
    s = suffix.select("suffix", ((F.col("bad") + w0 * m0) / (F.col("n") + w0)).alias("ms"))
    d = domains.join(s, "suffix").select("domain", ((F.col("bad") + w1 * F.col("ms")) / (F.col("n") + w1)).alias("md"))
    h = hosts.join(common.materialize(d), "domain").select("host", "n", "bad", (F.col("bad") + w2 * F.col("md")).alias("a"), (F.col("n") - F.col("bad") + w2 * (1 - F.col("md"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    return h.select("host", "n", "bad", mean.alias("bad_mean"), (mean - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bad_low"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, suffixes: tuple[str, ...] = (), page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_low) of every page."""
    rows = common.pick(pages, list(dict.fromkeys([page_id, url]))).select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    outcomes = common.pick(labels, [label_id, label]).select(F.col(label_id).alias("page_id"), (F.col(label) == 0).alias("bad"))
    known = common.materialize(reputation(rows, outcomes, suffixes).select("host", "bad_low"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    found = rows.join(known, "host", "left")
    method = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_low")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels")).drop("bad_low")


_WEIGHT_SQL = """
{name} as (select case when k = 0 then 1.0 when k <= g or n <= k then 1000.0 when not r > 0 then 1000.0 else least(1000.0, greatest(1.0, (1 - r) / r)) end as w from (
 select k, g, n, case when total > 0 then (msb - msw) / total else 0 end as r from (select *, msb + (size - 1) * msw as total from (
 select k, g, n, b / nullif(k - g, 0) as msb, w / nullif(n - k, 0) as msw, (n - nn) / nullif(k - g, 0) as size from (
 select count(*) as k, count(distinct c.{key}) as g, sum(c.n) as n, sum(c.n * c.n / p.n) as nn, sum(c.n * (c.bad / c.n - p.bad / p.n) * (c.bad / c.n - p.bad / p.n)) as b, sum(c.n * (c.bad / c.n) * (1 - c.bad / c.n)) as w
 from {child} c join {parent} p on c.{key} = p.{key} where c.n > 0)))))"""
SQL_TEXT = rf"""
with p as materialized (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
l as (select doc_id, max((quality = 0)::int) as bad from labels where doc_id is not null and quality is not null group by doc_id),
hn as (select host, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '') as name, count(l.bad)::double as n, coalesce(sum(l.bad), 0)::double as bad from p left join l on l.doc_id = p.page_id group by host),
hs as (select *, regexp_matches(name, '{ADDRESS.replace(chr(92) + "A", "^").replace(chr(92) + "z", "$")}') as ip, regexp_extract(name, '(?:^|[.])((?:{"|".join(SECOND_LEVEL)})[.][a-z][a-z])$', 1) as two from hn),
hx as (select *, case when ip then name when two <> '' then two else string_split(name, '.')[-1] end as suffix from hs),
h as materialized (select host, n, bad, suffix, case when ip or name = suffix then name else array_to_string(string_split(name, '.')[-(len(string_split(suffix, '.')) + 1):], '.') end as domain from hx),
d as materialized (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as materialized (select suffix, 1 as one, sum(n) as n, sum(bad) as bad from d group by all),
t as materialized (select 1 as one, coalesce(sum(n), 0) as n, coalesce(sum(bad), 0) as bad from s),
{_WEIGHT_SQL.format(name="w0", key="one", child="s", parent="t")},
{_WEIGHT_SQL.format(name="w1", key="suffix", child="d", parent="s")},
{_WEIGHT_SQL.format(name="w2", key="domain", child="h", parent="d")},
ms as (select suffix, (s.bad + (select w from w0) * (t.bad + 1) / (t.n + 2)) / (s.n + (select w from w0)) as m from s, t),
md as (select domain, (d.bad + (select w from w1) * m) / (d.n + (select w from w1)) as m from d join ms using (suffix)),
ab as (select host, h.bad + (select w from w2) * m as a, h.n - h.bad + (select w from w2) * (1 - m) as b from h join md using (domain)),
low as (select host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bad_low from ab),
r(kind, rh, rp) as (values {", ".join(str(x) for x in RULES)}),
f as (select distinct host, path, kind, rh || rp as rule from (select distinct host, path from p), r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
b as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(kind, length(rule)) as kind from f group by host, path)
select p.page_id, p.host, p.path, b.rule, coalesce(b.kind, case when bad_low > {MAX_BAD} then 'block' else 'allow' end) as verdict from p left join b on p.host = b.host and p.path = b.path left join low on p.host = low.host
"""

QUERIES = {"op10_url_filter": op10_url_filter}
SQL = {"op10_url_filter": SQL_TEXT}
