"""Feeds from their bytes to items, sinks, store conflicts, and the clustering queries against plain versions."""

import http.server
import json
import threading
import warnings

import pytest
from pyspark.sql import functions as F

from storyline import catalog
from storyline.operators import stories
from storyline.sources import feeds
from storyline.sources.config import SourceConfig
from storyline.sources.store import Store, prune_older, replace_folder, write_text

from .test_operators import plain_clusters

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title><item><title><![CDATA[ A & B ]]></title><link>http://x/1</link>
<guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>No link</title><guid>http://x/2</guid><dc:date>2024-01-02T00:00:00Z</dc:date></item><item><title>Nothing</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">At</title><link rel="self" href="http://x/self"/><link href="http://x/4"/><updated>2024-01-03T00:00:00Z</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/"><channel><title>q</title></channel><item><title>R</title><link>http://x/6</link></item></rdf:RDF>"""


def test_feed_formats(spark):
    rows = spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("bad", "<rss><channel><item><title>x"), ("none", None), ("text", "not xml")], "source_id string, body string")
    found = {(r["source_id"], r["url"], r["title"], r["published_at"]) for r in feeds.feed_items(feeds.feed_entries(rows)).collect()}
    assert found == {("rss", "http://x/1", "A & B", 1704067200), ("rss", "http://x/2", "No link", 1704153600), ("atom", "http://x/4", "At", 1704240000), ("rdf", "http://x/6", "R", None)}
    assert feeds.feed_entries(rows.limit(0)).count() == 0


class Answers(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        body = RSS.encode()
        self.send_response(500 if self.path == "/broken" else 200)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        query = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Answers.asked.append((query["query"], self.headers["Authorization"]))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"results": [{"url": f"http://r/{k}", "title": query["query"], "published_date": "2024-01-01"} for k in range(7)] + [{"url": ""}]}).encode())


def test_collect_end_to_end(spark, monkeypatch):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setattr(feeds, "WEB_SEARCH", f"{at}/search")
    known = [SourceConfig("a", "A", f"{at}/feed"), SourceConfig("b", "B", f"{at}/broken"), SourceConfig("c", "C", None), SourceConfig("s", "Some Query", type="tavily"), SourceConfig("o", "O", f"{at}/feed", type="odd")]
    with pytest.warns(UserWarning, match="unknown adapter 'odd'"):
        assert [r["id"] for r in feeds.requests_of(known)] == ["a", "b"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        asked = feeds.requests_of(known, search_key="key")
    assert feeds.requests_of([known[0]], {"a": "hn"})[0]["url"].endswith("hitsPerPage=200")
    payloads = feeds.fetch(spark, asked, attempts=1, timeout=5).persist()
    assert {r["source_id"]: r["error"] is None for r in payloads.collect()} == {"a": True, "b": False, "s": True}
    found = feeds.collected(payloads).orderBy("seq").collect()
    assert [(r["source_id"], r["url"]) for r in found] == [("a", "http://x/1"), ("a", "http://x/2"), *(("s", f"http://r/{k}") for k in range(5))]
    assert set(Answers.asked) == {("Some Query", "Bearer key")}
    old = payloads.withColumns({"name": F.col("source_id"), "is_release": F.lit(True)})
    assert {(r["source"], r["is_release"]) for r in feeds.legacy_collected(old).collect()} == {("a", True), ("Tavily:s", False)}
    server.shutdown()


def test_jsonl(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text('{"url":"u","title":"t","extra":{"points":3}}\n\n{"url": broken\n{"url":"v"}\n')
    assert sorted((r["url"], r["points"], r["is_new"]) for r in feeds.read_jsonl(spark, str(path)).where("url <> ''").collect()) == [("u", 3, True), ("v", 0, True)]
    assert feeds.repair_jsonl(spark, str(path)) == (3, 2)
    assert feeds.repair_jsonl(spark, str(path)) == (2, 2)
    assert feeds.read_jsonl(spark, str(path)).count() == 2


def test_sinks(spark, tmp_path):
    target = f"{tmp_path}/d"
    for n in (1, 2):
        replace_folder(spark, target, lambda beside, n=n: spark.range(n).write.parquet(beside))
        assert spark.read.parquet(target).count() == n and [p.name for p in tmp_path.iterdir()] == ["d"]
    with pytest.raises(ZeroDivisionError):
        replace_folder(spark, target, lambda beside: 1 / 0)
    assert spark.read.parquet(target).count() == 2
    assert write_text(spark, f"{tmp_path}/t/x", "one") and not write_text(spark, f"{tmp_path}/t/x", "two", replace=False)
    assert write_text(spark, f"{tmp_path}/t/x", "three") and (tmp_path / "t" / "x").read_text() == "three"
    import time

    assert prune_older(spark, f"{tmp_path}/t/x", 1, time.time()) == 0 and prune_older(spark, f"{tmp_path}/t/x", 1, time.time() + 3 * 86_400) == 1


def test_commits_do_not_undo_each_other(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.commit({"a": spark.range(1)})
    # Another writer commits between this one's reading of the pointer and its claim of the next number.
    plain, raced = Store._pointer, []

    def pointer(self):
        now = plain(self)
        if self is two and not raced:
            raced.append(1)
            one.commit({"b": spark.range(2)})
        return now

    monkeypatch.setattr(Store, "_pointer", pointer)
    two.commit({"c": spark.range(3)})
    monkeypatch.undo()
    assert [one.read(t).count() for t in "abc"] == [1, 2, 3] and one.prune() == 0


def test_cluster_queries_equal_plain_rules(spark):
    """Both queries over a whole table against the rules as stated, times apart included."""
    d = "/root/testdata/sf0.001"
    articles, changes = catalog._clustered(spark, d)
    rows = [r.asDict() for r in articles.collect()]
    accepted = catalog._accepted(spark, d, catalog.raw_items(spark, d))
    from storyline.operators import ingest

    topics = [tuple(r) for r in ingest.article_topics(None, accepted, catalog.TOPICS).select("article_id", "topic").collect()]
    expected = plain_clusters(rows, topics, stories.ClusterConfig())
    assert {(r["story_id"], r["article_id"], r["canonical_article_id"], r["last_updated"], r["step"]) for r in changes.collect()} == expected
    assert {(r["story_id"], r["article_id"], r["step"]) for r in catalog.cluster_stories(spark, d).collect()} == {(s, a, n) for s, a, _, _, n in expected}
    last = {}
    for story, _, canonical, _, step in expected:
        last[story] = max(last.get(story, (0, "")), (step, canonical))
    assert {(r["id"], r["canonical_article_id"]) for r in catalog.canonical_election(spark, d).collect()} == {(s, c) for s, (_, c) in last.items()}
    assert len(last) > 1


def test_optional_matching():
    rows = [
        {"story_id": None, "article_id": k, "title": t, "norm": t, "collected_at": n, "seq": n, "score_base": 0.0, "story_type": "news", "topics": [], "paper": None, "numbers": []}
        for n, (k, t) in enumerate([("a", "red green blue yellow"), ("b", "red green blue yellows x"), ("c", "red green blue yellow")])
    ]

    def folded(config):
        return list(stories.fold(stories.Shelf([], config), rows))

    latest = [r["story_id"] for r in folded(stories.ClusterConfig(threshold=0.99))]
    assert latest == ["a", "b", "a"]
    loose = stories.ClusterConfig(threshold=0.6, token_overlap=5)
    assert [r["story_id"] for r in folded(loose)] == ["a", "b", "c"]
    rows[1]["topics"], rows[0]["topics"] = ["x"], ["y"]
    assert [r["story_id"] for r in folded(stories.ClusterConfig(threshold=0.6))] == ["a", "b", "b"]
    assert [r["story_id"] for r in folded(stories.ClusterConfig(threshold=0.6, best_match=True))] == ["a", "b", "a"]
    # Stop words are no shared tokens.
    told = [dict(r, title=t, norm=t, topics=[]) for r, t in zip(rows, ["this is the news of it all", "this is the news of it now", "this is the news of it all"], strict=True)]
    assert [r["story_id"] for r in stories.fold(stories.Shelf([], stories.ClusterConfig(threshold=0.6, token_overlap=2)), told)] == ["a", "b", "a"]
