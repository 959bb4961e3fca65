"""Feeds: stored payloads to raw items, and a Python data source that fetches them."""

from __future__ import annotations

import codecs
import json
import re
import time
import urllib.request
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scores import parse_published
from ..functions.urls import legacy_url
from .markup_scan import entries
from .store import replace_folder

TIMEOUT, ATTEMPTS, MOST_BYTES = 10, 3, 10 << 20
LEAST_POINTS, MOST_HITS, MOST_RESULTS = 100, 200, 5
# Adapters by name, and the addresses they ask.
ADAPTERS = ("rss", "hn", "tavily")
HN_SEARCH = "https://hn.algolia.com/api/v1/search?tags=front_page&hitsPerPage={}"
PERMALINK = "https://news.ycombinator.com/item?id="
WEB_SEARCH = "https://api.tavily.com/search"
ENTRY_COLUMNS = ("place", "link", "id", "title", "published", "updated", "created", "pubDate")
ITEM = "url string, title string, source_id string, published_at long, points int, extra string"
HITS = "struct<hits: array<struct<objectID: string, title: string, url: string, points: int, created_at: string>>>"
RESULTS = "struct<results: array<struct<url: string, title: string, published_date: string>>>"
LEGACY_ITEM = "url string, title string, source string, published string, extra struct<points: int, is_release: boolean>, collected_at string, is_new boolean"


def feed_entries(payloads: DataFrame) -> DataFrame:
    """Entries of RSS (0.9x to 2.0, RDF) and Atom payloads (source_id, body): ``(source_id, place, link, id, title, published, updated, created, pubDate)``.

    Payloads are read as they come, well-formed or not (see markup_scan). What
    is no feed or failed to come has no entries, what breaks off those before.
    Of several links the first that is no relation other than "alternate" counts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in enumerate(batch["body"].to_pylist()):
                if found := entries(body):
                    of = batch["source_id"].take(pa.array([row] * len(found)))
                    columns = [pa.array([_entry_value(e, c) for e in found], pa.string()) for c in ENTRY_COLUMNS[1:]]
                    yield pa.RecordBatch.from_arrays([of, pa.array(range(len(found)), pa.int32()), *columns], names=["source_id", *ENTRY_COLUMNS])

    own = payloads.select("source_id", "body")
    fields = [T.StructField("place", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ENTRY_COLUMNS[1:])]
    return own.mapInArrow(scan, T.StructType([own.schema["source_id"], *fields]))


def _entry_value(entry: dict, column: str) -> str | None:
    if column == "link":
        links = [address for kind, address in entry["links"] if kind == "alternate"] or [address for _, address in entry["links"]]
        return links[0].strip() if links and links[0] else None
    names = {"id": ("id", "guid"), "published": ("published", "pubDate", "date")}.get(column, (column,))
    found = next((entry[n] for n in names if n in entry), None)
    return found.strip() if found is not None and column != "title" else found


def _feed_rows(entries: DataFrame) -> DataFrame:
    first = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("published", "updated", "created", "pubDate")))
    url = F.coalesce(F.nullif("link", F.lit("")), F.nullif("id", F.lit("")))
    title = F.trim(F.coalesce("title", F.lit("")))
    return entries.withColumns({"url": url, "title": title, "published": first, "points": F.lit(0)}).where("url is not null")


def _hit_rows(payloads: DataFrame, least_points: int, permalink: str) -> DataFrame:
    hits = payloads.withColumn("h", F.from_json("body", HITS)["hits"]).select("*", F.posexplode("h").alias("place", "hit"))
    rows = hits.withColumns({
        "url": F.coalesce(F.nullif("hit.url", F.lit("")), F.concat(F.lit(permalink), F.coalesce("hit.objectID", F.lit("")))), "title": F.coalesce("hit.title", F.lit("")),
        "published": F.nullif("hit.created_at", F.lit("")), "points": F.coalesce("hit.points", F.lit(0)),
    })
    return rows.where(F.col("points") >= least_points)


def _result_rows(payloads: DataFrame, most: int) -> DataFrame:
    rows = payloads.select("*", F.posexplode(F.slice(F.from_json("body", RESULTS)["results"], 1, most)).alias("place", "r")).where("coalesce(r.url, '') <> ''")
    return rows.withColumns({"url": F.col("r.url"), "title": F.coalesce("r.title", F.lit("")), "published": F.nullif("r.published_date", F.lit("")), "points": F.lit(0)})


def _items(rows: DataFrame) -> DataFrame:
    kept = [c for c in ("asked", "place") if c in rows.columns]
    return rows.select("url", "title", "source_id", parse_published(F.col("published")).alias("published_at"), "points", F.lit(None).cast("string").alias("extra"), *kept)


def feed_items(entries: DataFrame) -> DataFrame:
    """Entries (source_id, link, id, title, published, updated, created, pubDate) as raw items; url-less ones go."""
    return _items(_feed_rows(entries))


def hacker_news_items(payloads: DataFrame, least_points: int = LEAST_POINTS, permalink: str = PERMALINK) -> DataFrame:
    """Payloads (source_id, body) as raw items of at least ``least_points``; without url the permalink."""
    return _items(_hit_rows(payloads, least_points, permalink))


def search_items(payloads: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """Search answers (source_id, body) as raw items, ``most`` an answer; results without url go."""
    return _items(_result_rows(payloads, most))


def requests_of(sources: list, adapters: dict[str, str] | None = None, search_key: str | None = None, queries: list[str] | None = None) -> list[dict]:
    """What FeedSource fetches for ``sources`` (id, name, url, type), in order.

    A source's adapter is ``adapters``' one, else its type's, else rss; an
    unknown one is skipped with a warning. A feed without url asks nothing, nor
    does a search without a key; a search without ``queries`` asks its source's name.
    """
    out = []
    for source in sources:
        kind = (adapters or {}).get(source.id, source.type or "rss")
        if kind not in ADAPTERS:
            warnings.warn(f"unknown adapter {kind!r} of source {source.id!r}", stacklevel=2)
        elif kind == "rss" and source.url:
            out.append({"id": source.id, "url": source.url, "kind": kind})
        elif kind == "hn":
            out.append({"id": source.id, "url": HN_SEARCH.format(MOST_HITS), "kind": kind})
        elif kind == "tavily" and search_key:
            for query in queries or [source.name]:
                body = json.dumps({"query": query, "max_results": MOST_RESULTS, "search_depth": "basic"})
                out.append({"id": source.id, "url": WEB_SEARCH, "kind": kind, "body": body, "headers": {"Authorization": f"Bearer {search_key}", "Content-Type": "application/json"}})
    return [r | {"asked": k} for k, r in enumerate(out)]


def collected(payloads: DataFrame) -> DataFrame:
    """Raw items with ``seq`` of all payloads (source_id, kind, asked, body), each read by its kind.

    ``seq`` follows the requests' order and within an answer its rows'. A
    payload that failed or cannot be read has no items and stops no other.
    """
    fed = payloads.where("kind = 'rss'")
    entries = feed_entries(fed.withColumn("source_id", F.struct("source_id", "asked"))).select("source_id.*", *ENTRY_COLUMNS)
    parts = [feed_items(entries), hacker_news_items(payloads.where("kind = 'hn'")), search_items(payloads.where("kind = 'tavily'"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("seq", F.col("asked").cast("long") * F.lit(1 << 32) + F.col("place")).drop("asked", "place")


def fetch(spark: SparkSession, requests: list[dict], attempts: int = ATTEMPTS, timeout: int = TIMEOUT) -> DataFrame:
    """``(source_id, kind, asked, body, error)`` of ``requests``, fetched by executors."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("feed").option("feeds", json.dumps(requests)).option("attempts", attempts).option("timeout", timeout).load()


def legacy_collected(payloads: DataFrame) -> DataFrame:
    """The older pipeline's items of payloads (asked, kind, name, is_release, body): all feeds, the front page, then searches.

    A feed's items carry its name and release mark, hits a fixed name and their
    points, results their query's first 40 characters. Urls take the older
    normal form; items that it leaves none go.
    """
    entries = feed_entries(payloads.where("kind = 'rss'").withColumn("source_id", F.struct("asked", "name", "is_release"))).select("source_id.*", *ENTRY_COLUMNS)
    hits = _hit_rows(payloads.where("kind = 'hn'"), LEAST_POINTS, PERMALINK).withColumns({"name": F.lit("Hacker News"), "is_release": F.lit(False)})
    found = _result_rows(payloads.where("kind = 'tavily'"), MOST_RESULTS).withColumns({"name": F.concat(F.lit("Tavily:"), F.substring("name", 1, 40)), "is_release": F.lit(False)})
    out = None
    for rank, rows in enumerate((_feed_rows(entries), hits, found)):
        seq = F.lit(rank).cast("long") * F.lit(1 << 56) + F.col("asked").cast("long") * F.lit(1 << 32) + F.col("place")
        own = rows.select(
            seq.alias("seq"), legacy_url(F.col("url")).alias("url"), "title", F.col("name").alias("source"), F.coalesce("published", F.lit("")).alias("published"),
            F.col("points").cast("int").alias("points"), F.coalesce("is_release", F.lit(False)).alias("is_release"),
        )
        out = own if out is None else out.unionByName(own)
    return out.where("coalesce(url, '') <> ''")


def legacy_requests(config: dict, search_key: str | None = None) -> list[dict]:
    """What the older pipeline asks for ``config`` (feeds with name, url, is_release; tavily_queries), in order; with name and is_release."""
    out = [{"id": f["name"], "url": f.get("url"), "kind": "rss", "name": f["name"], "is_release": bool(f.get("is_release"))} for f in config.get("feeds") or [] if f.get("url")]
    out.append({"id": "hn", "url": HN_SEARCH.format(MOST_HITS), "kind": "hn", "name": "Hacker News", "is_release": False})
    for query in (config.get("tavily_queries") or []) if search_key else []:
        body = json.dumps({"query": query, "max_results": MOST_RESULTS, "search_depth": "basic"})
        out.append({"id": query, "url": WEB_SEARCH, "kind": "tavily", "body": body, "headers": {"Authorization": f"Bearer {search_key}", "Content-Type": "application/json"}, "name": query, "is_release": False})
    return [r | {"asked": k} for k, r in enumerate(out)]


def legacy_fetch(spark: SparkSession, requests: list[dict], attempts: int = ATTEMPTS, timeout: int = TIMEOUT) -> DataFrame:
    """Payloads of :func:`legacy_requests` as :func:`legacy_collected` reads them."""
    known = spark.createDataFrame([(r["asked"], r["name"], r["is_release"]) for r in requests], "asked int, name string, is_release boolean")
    return fetch(spark, requests, attempts, timeout).join(F.broadcast(known), "asked")


def in_order(parts: list[DataFrame]) -> DataFrame:
    """All parts' items with ``seq`` in order of parts, and within a part of its rows."""
    numbered = [p.withColumn("seq", F.monotonically_increasing_id() + F.lit(k << 52)) for k, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return out


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Legacy items of a JSON-lines file; lines that do not parse are dropped, missing keys get their defaults."""
    rows = spark.read.schema(LEGACY_ITEM).option("mode", "DROPMALFORMED").json(path)
    return rows.select(
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "source", "published")), F.coalesce("extra.points", F.lit(0)).alias("points"),
        F.coalesce("extra.is_release", F.lit(False)).alias("is_release"), F.coalesce("collected_at", F.lit("")).alias("collected_at"), F.coalesce("is_new", F.lit(True)).alias("is_new"),
    )


def repair_jsonl(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rewrites a JSON-lines folder or file with the lines that parse; (lines that are not blank, lines kept)."""
    total, recovered = repair_counts(spark, path).first()
    if recovered < total:
        lines = spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
        replace_folder(spark, path, lambda beside: lines.write.text(beside))
    return total, recovered


def repair_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines of a JSON-lines file that are not blank, and those that parse."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.agg(F.count("*").alias("total"), F.count_if(F.try_parse_json("value").isNotNull()).alias("recovered"))


_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*\sencoding\s*=\s*["']([\w.:\-]+)["']""")


def decoded(body: bytes, charset: str | None = None) -> str:
    """Text by the answer's charset, else its byte order mark, else what its XML declares, else UTF-8; bytes that are none are replaced."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            charset = charset if charset and charset.lower() not in ("utf-8", "utf-16") else name
    if not charset and (found := _DECLARED.match(body[:200])):
        charset = found[1].decode()
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


class FeedSource(DataSource):
    """``spark.read.format("feed").option("feeds", json)``: one partition a feed, fetched with retries.

    feeds: [{"id", "url", "kind"?, "asked"?, "body"?, "headers"?}, ...]; a body is
    posted. Rows are (source_id, kind, asked, body, error); what fails does not
    stop the others. Options attempts and timeout bound how long a feed is tried.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "source_id string, kind string, asked int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(json.loads(self.options.get("feeds", "[]")), int(self.options.get("attempts", ATTEMPTS)), float(self.options.get("timeout", TIMEOUT)))


class FeedReader(DataSourceReader):
    def __init__(self, feeds: list[dict], attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> None:
        self.feeds, self.attempts, self.timeout = feeds, attempts, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.feeds if f.get("url")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        feed = partition.value
        error, named = None, (feed["id"], feed.get("kind", "rss"), feed.get("asked", 0))
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(attempt)
            try:
                data = feed["body"].encode() if feed.get("body") else None
                with urllib.request.urlopen(urllib.request.Request(feed["url"], data, feed.get("headers") or {}), timeout=self.timeout) as answer:
                    body, charset = answer.read(MOST_BYTES + 1), answer.headers.get_content_charset()
                if len(body) > MOST_BYTES:
                    error = "too large"
                    break
                yield *named, decoded(body, charset), None
                return
            except Exception as problem:  # noqa: BLE001  one feed's failure is its row
                error = str(problem)
        yield *named, None, error
