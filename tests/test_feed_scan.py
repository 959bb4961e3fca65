"""Feeds as they come: namespaces kept apart, markup in titles, broken entities and tags, charsets."""

import pytest

from storyline.sources import feeds
from storyline.sources.markup_scan import entries


def told(body):
    return [(feeds._entry_value(e, "link"), e.get("title")) for e in entries(body)]


MEDIA = """<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>C</title>
<atom:link href="http://x/self" rel="self"/><item><title>A</title><link>http://x/1</link><media:group><media:title>B</media:title></media:group><media:title>B</media:title><itunes:title>I</itunes:title></item></channel></rss>"""
XHTML = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">Less: <em>is</em> more</div></title>
<link href="http://x/2"/><source><title>S</title><id>s</id></source><id>i</id></entry></feed>"""


@pytest.mark.parametrize("body, expected", [
    (MEDIA, [("http://x/1", "A")]),
    (XHTML, [("http://x/2", "Less: is more")]),
    # A bare sign or an entity of HTML costs no entry.
    ("<rss><channel><item><title>A</title><link>http://x/1</link></item><item><title>B & C&nbsp;&copy; &unknown; &lt;b&gt;</title><link>http://x/?a=1&b=2</link></item></channel></rss>",
     [("http://x/1", "A"), ("http://x/?a=1&b=2", "B & C\xa0© &unknown; <b>")]),
    # Ends that are missing, crossed or too many.
    ("<rss><channel><item><title>A<link>http://x/1</link><item><title>B</b></title><link>http://x/2</link></item></channel></rss>", [("http://x/1", "A"), ("http://x/2", "B")]),
    ("<rss><channel><item><title>A <b>b</title><link>http://x/1</link></item><item><title>C</title></p><link>http://x/2</link></item>", [("http://x/1", "A b"), ("http://x/2", "C")]),
    ("<rss><channel><item><title>A</title><link>http://x/1</link></item><item><title>broken off", [("http://x/1", "A")]),
    ("<rss><channel><item><title><![CDATA[<b>A</b> & B]]> &amp; c</title><guid>http://x/g</guid></item></channel></rss>", [(None, "<b>A</b> & B & c")]),
    ("<!DOCTYPE rss [<!ENTITY a 'b'>]><rss><!-- <item><title>no</title></item> --><channel><item><title>1 < 2</title><link>http://x/1</link></item></channel></rss>", [("http://x/1", "1 < 2")]),
    ('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>T</a:title><a:link rel="self" href="http://x/s"/><a:link href="http://x/4"/></a:entry></a:feed>', [("http://x/4", "T")]),
    ("<html><body><title>page</title><item>x</item></body></html>", []), ("", []), (None, []), ("{}", []),
])
def test_entries(body, expected):
    assert told(body) == expected


def test_dates_of_either_vocabulary(spark):
    body = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><channel><item><title>A</title><link>http://x/1</link><dc:title>no</dc:title>
<dcterms:created>2001-01-01</dcterms:created><dc:date>2024-01-02T00:00:00Z</dc:date></item></channel></rss>"""
    rows = spark.createDataFrame([("s", body), ("t", MEDIA), ("u", None)], "source_id string, body string")
    found = {(r["source_id"], r["title"], r["published_at"]) for r in feeds.feed_items(feeds.feed_entries(rows)).collect()}
    assert found == {("s", "A", 1704153600), ("t", "A", None)}


@pytest.mark.parametrize("body, charset, expected", [
    ("é".encode("latin-1"), "iso-8859-1", "é"), ("é".encode(), None, "é"), ("é".encode("utf-8-sig"), None, "é"), ("é".encode("utf-16"), None, "é"), (b"\xe9", None, "�"), (b"x", "no-such", "x"),
    ('<?xml version="1.0" encoding="windows-1252"?>“'.encode("cp1252"), None, '<?xml version="1.0" encoding="windows-1252"?>“'),
])
def test_charsets(body, charset, expected):
    assert feeds.decoded(body, charset) == expected


def test_long_payloads_take_no_square_time():
    body = "<rss><channel>" + "".join(f"<item><title>{'&' * 20}{k}</title><link>http://x/{k}</link><description>{'<p>' * 20}</description></item>" for k in range(5000)) + "<" * 50_000
    assert len(entries(body)) == 5000
    assert entries("<rss " + "a='" * 20_000) == [] and entries("<!" + "[" * 20_000) == []
