"""Continuous collection: unchanged feeds give nothing, restarts repeat and lose nothing."""

import http.server
import json
import threading

import pytest

from storyline.sources import feed_stream


class Feeds(http.server.BaseHTTPRequestHandler):
    bodies: dict = {}
    asked: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        body = self.bodies.get(self.path)
        tag = f'"{hash(body)}"'
        same = body is not None and self.headers["If-None-Match"] == tag
        self.asked.append((self.path, same))
        self.send_response(500 if body is None else 304 if same else 200)
        self.send_header("ETag", tag)
        self.end_headers()
        if body is not None and not same:
            self.wfile.write(body.encode())


@pytest.fixture()
def server():
    Feeds.bodies, Feeds.asked = {"/a": "one", "/b": "two"}, []
    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Feeds)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def listed(at):
    return [{"id": "a", "url": f"{at}/a"}, {"id": "b", "url": f"{at}/b", "asked": 1}, {"id": "none", "url": ""}]


def test_rounds_and_replays(server, tmp_path):
    make = lambda: feed_stream.FeedStreamReader(listed(server), f"file://{tmp_path}/spool")
    reader = make()

    def read(reader, start, end):
        return [row for p in reader.partitions(start, end) for row in reader.read(p)]

    zero, one = reader.initialOffset(), reader.latestOffset()
    assert (zero, one) == ({"round": 0}, {"round": 1})
    first = read(reader, zero, one)
    assert [(r[0], r[2], r[3], r[5]) for r in first] == [("a", 0, "one", 1), ("b", 1, "two", 1)]
    # The same round again, by another reader and after the feeds have changed: the same rows, and nobody is asked.
    Feeds.bodies["/a"] = "changed"
    assert read(make(), zero, one) == first and len(Feeds.asked) == 2
    reader.commit(one)
    two = make().latestOffset()
    assert [(r[0], r[3]) for r in read(make(), one, two)] == [("a", "changed")] and Feeds.asked[-1] == ("/b", True)
    Feeds.bodies["/a"] = None  # an error keeps what the feed said of itself
    three = make().latestOffset()
    assert [(r[0], r[3], r[4] is None) for r in read(make(), two, three)] == [("a", None, False)]
    Feeds.bodies["/a"] = "changed"
    make().commit(three)
    assert read(make(), three, make().latestOffset()) == []
    assert feed_stream.FeedStreamReader([], f"{tmp_path}/spool", interval=3600).latestOffset() == {"round": 4}


def test_stream_over_restarts(spark, server, tmp_path):
    spark.dataSource.register(feed_stream.FeedStream)

    def run():
        stream = spark.readStream.format("feed_stream").option("feeds", json.dumps(listed(server))).option("spool", f"{tmp_path}/spool").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    Feeds.bodies["/b"] = "three"
    run()
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["source_id"], r["body"]) for r in rows) == [("a", "one"), ("b", "three"), ("b", "two")]
