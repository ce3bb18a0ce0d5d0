"""Fetching documents into tables: an optional stage, never part of a verification, which reads tables only.

``refresh`` takes the documents that citations name, leaves out those already held (an anti join on the document's URL),
asks for the rest and writes them as a new part of the table; a part is seen whole or not at all, as Spark's committers
write it, and a run that dies leaves the parts before it as they were. Hosts are dealt to tasks by key, so that one task
asks one host and its pace holds for the whole cluster: a host's own pace bounds it, whatever the machines. ``Policy`` has
that pace, the retries and the back-off; ``Client`` is what asks, and tests use one of their own.

Defined results: each document is asked for once a run, however often it is named; a null URL is none; a document that
can't be had is a row without a body, with the status of the last answer (null: no server was reached) and the reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from typing import Protocol
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeplane.connectors import DEFAULT, Registry
from citeplane.functions import urls

FETCHED = "url string, status int, final_url string, chain array<struct<status:int,url:string>>, body string, reason string, fetched_at timestamp"
#: Answers that no further try changes.
FINAL = frozenset({403, 404, 410})
REDIRECTS = frozenset({301, 302, 303, 307, 308})


@dataclass(frozen=True)
class Answer:
    """One answer of a server, not followed: headers by lower-case name."""

    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


class Client(Protocol):
    """Asks for one address. Raises ``OSError`` where no server was reached. Keeps nothing between calls: no cookies."""

    def get(self, url: str) -> Answer: ...


@dataclass(frozen=True)
class Policy:
    """Seconds between two requests to a host, tries, seconds that a pause doubles from and at most takes, hops, bytes."""

    interval: float = 1.0
    tries: int = 4
    pause: float = 1.0
    longest: float = 120.0
    hops: int = 10
    most_bytes: int = 64 << 20
    timeout: float = 30.0
    agent: str = "citeplane"


class HttpClient:
    """The standard library's client without redirects and cookies."""

    def __init__(self, policy: Policy = Policy()):  # noqa: B008
        import urllib.request as u

        class Stay(u.HTTPRedirectHandler):
            def redirect_request(self, *a, **k):
                return None

        self.policy, self.opener = policy, u.build_opener(Stay)

    def get(self, url: str) -> Answer:
        import urllib.error
        import urllib.request as u

        if urlsplit(url).scheme not in ("http", "https"):
            raise OSError(f"no address of the web: {url}")
        request = u.Request(url, headers={"User-Agent": self.policy.agent})
        try:
            got = self.opener.open(request, timeout=self.policy.timeout)
        except urllib.error.HTTPError as e:
            got = e
        with got:
            return Answer(got.status, {k.lower(): v for k, v in got.headers.items()}, got.read(self.policy.most_bytes + 1))


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for: a number of them, or a date; null where it is neither."""
    if not value:
        return None
    try:
        return max(0.0, float(int(value.strip())))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


class Pace:
    """When each host may be asked next. A penalty moves that time out, and the later of two times holds: they don't add up."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.after = interval, clock, sleep, {}

    def wait(self, host: str) -> None:
        left = self.after.get(host, 0.0) - self.clock()
        if left > 0:
            self.sleep(left)
        self.after[host] = self.clock() + self.interval

    def penalize(self, host: str, seconds: float) -> None:
        self.after[host] = max(self.after.get(host, 0.0), self.clock() + seconds)


def ask(client: Client, url: str, pace: Pace, policy: Policy, now: Callable[[], float] = time.time) -> dict:
    """What became of a URL: its redirects are followed and kept, and what may pass is tried again."""
    chain: list[dict] = []
    at, status, reason = url, None, ""

    def ended(body: str | None = None) -> dict:
        return {"url": url, "status": status, "final_url": at, "chain": chain, "body": body, "reason": reason}

    tried = 0
    while True:
        host = urlsplit(at).netloc
        pace.wait(host)
        try:
            got = client.get(at)
        except OSError as e:
            got, reason = None, str(e) or type(e).__name__
        tried += 1
        if got is not None:
            status, reason = got.status, f"status {got.status}"
            if status in REDIRECTS and got.headers.get("location"):
                if len(chain) >= policy.hops:
                    reason = "too many redirects"
                    return ended()
                chain.append({"status": status, "url": at})
                at, tried = urljoin(at, got.headers["location"]), 0
                continue
            if status < 300:
                if len(got.body) > policy.most_bytes:
                    reason = f"more than {policy.most_bytes} bytes"
                    return ended()
                reason = ""
                return ended(decoded(got))
            if status in FINAL or status < 500 and status not in (408, 429):
                return ended()
        if tried >= policy.tries:
            return ended()
        asked = retry_after(got.headers.get("retry-after"), now()) if got is not None else None
        pace.penalize(host, min(policy.longest, policy.pause * 2 ** (tried - 1) if asked is None else asked))


def decoded(answer: Answer) -> str:
    """The body by the character set that its header names, else as UTF-8; what fits neither is replaced."""
    charset = next((x.strip()[8:].strip("\"'") for x in answer.headers.get("content-type", "").split(";") if x.strip().lower().startswith("charset=")), "utf-8")
    try:
        return answer.body.decode(charset, "replace")
    except LookupError:
        return answer.body.decode("utf-8", "replace")


def fetch(wanted: DataFrame, client: Callable[[], Client] = HttpClient, policy: Policy = Policy(), tasks: int | None = None) -> DataFrame:  # noqa: B008
    """FETCHED rows of the distinct documents that ``wanted`` (url) names, a host's in one task."""
    each = wanted.where("url is not null").select(urls.document_url(F.col("url")).alias("url")).where("url <> ''").distinct().withColumn("host", F.coalesce(urls.host(F.col("url")), F.lit("")))
    each = (each.repartition(tasks, "host") if tasks else each.repartition("host")).sortWithinPartitions("host", "url")
    names = [x.split()[0] for x in FETCHED.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.struct([("status", pa.int32()), ("url", pa.string())])), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, pace = client(), Pace(policy.interval)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                got = ask(asking, url, pace, policy)
                yield pa.RecordBatch.from_arrays([*(pa.array([got[n]], k) for n, k in zip(names, kinds)), pa.array([int(time.time() * 1e6)], pa.timestamp("us", "UTC"))], names=names)

    return each.mapInArrow(run, FETCHED)


def held(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each document in a table of fetches; none where there is no table yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], FETCHED)
    rows = spark.read.schema(FETCHED).parquet(path)
    return rows.groupBy("url").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "url")), "fetched_at").alias("x")).select("url", "x.*").select(*rows.columns)


def missing(wanted: DataFrame, had: DataFrame, force: bool = False) -> DataFrame:
    """(url) the distinct documents to ask for: those that aren't held with a body; with ``force`` all of them, once."""
    each = wanted.where("url is not null").select(urls.document_url(F.col("url")).alias("url")).where("url <> ''").distinct()
    return each if force else each.join(had.where("body is not null").select("url"), "url", "left_anti")


def refresh(wanted: DataFrame, path: str, client: Callable[[], Client] = HttpClient, policy: Policy = Policy(), force: bool = False) -> DataFrame:  # noqa: B008
    """Adds what is missing of ``wanted`` (url) to the table at ``path`` and returns the last row of each document there."""
    spark = wanted.sparkSession
    fetch(missing(wanted, held(spark, path), force), client, policy).write.mode("append").parquet(path)
    return held(spark, path)


def world_tables(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, fetches) of a run, as ``World`` takes them."""
    return fetched.where("body is not null").select("url", "body"), fetched.where("status is not null").select("url", "final_url", "chain")


def crawl(targets: DataFrame, client: Callable[[], Client] = HttpClient, policy: Policy = Policy(), registry: Registry = DEFAULT) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(files, crawls) of the distinct documents (repo, key) of ``targets``, through their connectors, once for each key.

    404 and 410 say that there is no such document; any other failure, that nobody knows.
    """
    from citeplane.scratch import materialize

    each = targets.select("repo", "key").where("key is not null").where(F.col("repo").isin(*registry.crawlers)).distinct()
    known = {c.name: c for c in registry if c.crawls}
    names = ["repo", "key", "status", "reason", "files"]
    file = pa.struct([("name", pa.string()), ("title", pa.string()), ("number", pa.int32()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, pace = client(), Pace(policy.interval)
        for batch in batches:
            for repo, key in zip(*(c.to_pylist() for c in batch.columns)):
                got = [ask(asking, u, pace, policy) for u in known[repo].pages(key)]
                bad = next((g for g in got if g["body"] is None), None)
                status = "ok" if bad is None else "not_found" if bad["status"] in (404, 410) else "unavailable"
                made = [] if bad else [dict(zip(("name", "title", "number", "body"), f)) for f in known[repo].files(key, [g["body"] for g in got])]
                yield pa.RecordBatch.from_arrays([pa.array([repo]), pa.array([key]), pa.array([status]), pa.array([bad["reason"] if bad else ""]), pa.array([made], pa.list_(file))], names=names)

    # A repository is a host or two: it is asked by one task, at its pace.
    rows = materialize(each.repartition("repo").mapInArrow(run, "repo string, key string, status string, reason string, files array<struct<name:string,title:string,number:int,body:string>>"))
    return rows.select("repo", "key", F.explode("files").alias("f")).select("repo", "key", "f.*"), rows.select("repo", "key", "status", "reason")
