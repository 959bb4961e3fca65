"""Continuous collection: feeds asked round by round, with their validators, so that a restart repeats and loses nothing."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feeds import MOST_BYTES, TIMEOUT, decoded


class Spool:
    """What each feed answered in each round, one file a feed and round, in a folder that all nodes share."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def _at(self, *names: str) -> tuple[pafs.FileSystem, str]:
        files, path = pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)
        return files, "/".join([path.rstrip("/"), *names])

    def rounds(self) -> list[int]:
        files, path = self._at()
        found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("round="))

    def age(self, number: int) -> float:
        """Seconds since the round's last answer."""
        files, path = self._at(f"round={number}")
        times = [f.mtime_ns / 1e9 for f in files.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.mtime_ns]
        return time.time() - max(times, default=0)

    def get(self, number: int, feed: dict) -> dict | None:
        files, path = self._at(f"round={number}", _name(feed))
        if files.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def put(self, number: int, feed: dict, answer: dict) -> None:
        """Whole or not at all: written beside its place and moved."""
        files, folder = self._at(f"round={number}")
        files.create_dir(folder)
        beside = f"{folder}/.{_name(feed)}.{time.time_ns()}"
        with files.open_output_stream(beside) as stream:
            stream.write(json.dumps(answer).encode())
        files.move(beside, f"{folder}/{_name(feed)}")

    def drop_before(self, number: int) -> None:
        files, _ = self._at()
        for old in self.rounds():
            if old < number:
                files.delete_dir(self._at(f"round={old}")[1])


def _name(feed: dict) -> str:
    return hashlib.sha256(json.dumps([feed["id"], feed["url"]]).encode()).hexdigest()[:24] + ".json"


class FeedStream(DataSource):
    """``spark.readStream.format("feed_stream").option("feeds", json).option("spool", folder)``.

    Rows are (source_id, kind, asked, body, error, round), as the batch source's;
    a feed that has not changed has none. Option ``interval`` is the least
    number of seconds between rounds.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_stream"

    def schema(self) -> str:
        return "source_id string, kind string, asked int, body string, error string, round long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(json.loads(self.options.get("feeds", "[]")), self.options["spool"], float(self.options.get("interval", 0)), float(self.options.get("timeout", TIMEOUT)))


class Asked(InputPartition):
    def __init__(self, feed: dict, number: int) -> None:
        self.feed, self.number = feed, number


class FeedStreamReader(DataSourceStreamReader):
    """The offset is a round's number; a round is asked once, and read from the spool each time after."""

    def __init__(self, feeds: list[dict], spool: str, interval: float = 0, timeout: float = TIMEOUT) -> None:
        self.feeds, self.spool, self.interval, self.timeout = [f for f in feeds if f.get("url")], Spool(spool), interval, timeout

    def initialOffset(self) -> dict:
        return {"round": max(self.spool.rounds(), default=0)}

    def latestOffset(self) -> dict:
        last = max(self.spool.rounds(), default=0)
        return {"round": last if last and self.spool.age(last) < self.interval else last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Asked(f, number) for number in range(start["round"] + 1, end["round"] + 1) for f in self.feeds]

    def read(self, partition: Asked) -> Iterator[tuple]:
        feed, number = partition.feed, partition.number
        answer = self.spool.get(number, feed)
        if answer is None:
            # What the feed said last, in whichever round is still there.
            before = next((a for n in reversed([r for r in self.spool.rounds() if r < number]) if (a := self.spool.get(n, feed))), {})
            answer = self._ask(feed, before)
            self.spool.put(number, feed, answer)
        if answer["body"] is not None or answer["error"] is not None:
            yield feed["id"], feed.get("kind", "rss"), feed.get("asked", 0), answer["body"], answer["error"], number

    def _ask(self, feed: dict, before: dict) -> dict:
        kept = {"etag": before.get("etag"), "modified": before.get("modified"), "body": None, "error": None}
        headers = dict(feed.get("headers") or {})
        headers |= {name: kept[own] for name, own in (("If-None-Match", "etag"), ("If-Modified-Since", "modified")) if kept[own]}
        try:
            data = feed["body"].encode() if feed.get("body") else None
            with urllib.request.urlopen(urllib.request.Request(feed["url"], data, headers), timeout=self.timeout) as answer:
                body = answer.read(MOST_BYTES + 1)
                if len(body) > MOST_BYTES:
                    return kept | {"error": "too large"}
                return {"etag": answer.headers.get("ETag"), "modified": answer.headers.get("Last-Modified"), "body": decoded(body, answer.headers.get_content_charset()), "error": None}
        except urllib.error.HTTPError as problem:
            return kept if problem.code == 304 else kept | {"error": str(problem)}
        except Exception as problem:  # noqa: BLE001  one feed's failure is its row, and its validators stay
            return kept | {"error": str(problem)}

    def commit(self, end: dict) -> None:
        """What a committed round said is needed no more, but for its validators."""
        self.spool.drop_before(end["round"])
