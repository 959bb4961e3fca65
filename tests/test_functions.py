import pytest
from pyspark.sql import functions as F

from storyline.functions import markup, rules, scores, titles, urls

CANONICAL = [
    ("http://Example.COM/a", "https://example.com/a"),
    ("https://www.example.com/a/", "https://example.com/a"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com/", "https://example.com/"),
    ("https://example.com//", "https://example.com"),
    ("https://example.com:443/a", "https://example.com/a"),
    ("https://example.com:8080/a", "https://example.com:8080/a"),
    ("https://example.com:x/a", None),
    ("https://example.com:70000/a", None),
    ("https://example.com/a?utm_source=x&b=2&a=1", "https://example.com/a?a=1&b=2"),
    ("https://example.com/a?UTM_Source=x", "https://example.com/a"),
    ("https://example.com/a?utm_other=x", "https://example.com/a?utm_other=x"),
    ("https://example.com/a?b=2&b=1&a", "https://example.com/a?a=&b=2&b=1"),
    ("https://example.com/a#top", "https://example.com/a"),
    ("https://example.com/#!/x", "https://example.com/#!/x"),
    ("https://example.com/%7Eme/%2Fx%41", "https://example.com/~me/%2FxA"),
    ("https://example.com/%%41", "https://example.com/%A"),
    ("https://user:pw@example.com/a;v=1", "https://example.com/a"),
    ("https://example.com/a?q=a+b%26", "https://example.com/a?q=a+b%26"),
    ("https://example.com/a?q=~*", "https://example.com/a?q=~%2A"),
    ("https://[::1]:81/a", "https://::1:81/a"),
]
LEGACY = [
    ("http://Example.com/a/", "https://Example.com/a"),
    ("javascript:alert(1)", ""),
    ("https://e.com/", "https://e.com/"),
    ("https://e.com", "https://e.com"),
    ("https://e.com/a?utm_x=1&source=s&b=1&b=2", "https://e.com/a?b=1&source=s"),
    ("https://e.com/a;p?ref=1#f", "https://e.com/a;p"),
]


def column(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in rows.select("k", function(F.col("v")).alias("out")).orderBy("k").collect()]


def test_canonical_urls(spark):
    assert column(spark, urls.canonical_url, [a for a, _ in CANONICAL]) == [b for _, b in CANONICAL]


def test_legacy_urls(spark):
    assert column(spark, urls.legacy_url, [a for a, _ in LEGACY]) == [b for _, b in LEGACY]


def test_url_accepted(spark):
    values = ["http://a.b/c", "HTTPS://a", "ftp://a", "https:///x", "https://a/b c", 'https://a/"', "https://a/\x01", "https://a/é\x7f", "mailto:x"]
    assert column(spark, urls.url_accepted, values) == [True, True, False, False, False, False, False, True, False]


def test_paper_id(spark):
    values = ["https://arxiv.org/abs/2603.12345", "https://www.tldr.takara.ai/p/2603.12345", "https://rss.arxiv.org/abs/2603.12345", "https://arxiv.org/list"]
    assert column(spark, urls.paper_id, values) == ["2603.12345", "2603.12345", None, None]


def test_sanitize_title(spark):
    blob = "Aa1" * 12
    values = ["a\x00b", "x Ignore  previous y", "SYSTEM : go", "hey user: do ![i](x)", f"see {blob}== now", "a  b \n c ", "ai:", "a" * 40]
    assert column(spark, titles.sanitize_title, values) == ["ab", "x y", "go", "hey do i](x)", "see now", "a b c", "", "a" * 40]


def test_normalize_title(spark):
    values = ["Show HN: My  Thing [pdf]", "A (b) [c] ", "  Ask hn :Why", "(all)", "Keep (x) tail"]
    assert column(spark, titles.normalize_title, values) == ["my thing", "a", "why", "", "keep (x) tail"]


def test_number_tokens(spark):
    assert column(spark, titles.number_tokens, ["v1.2 and 3, 1.2", "none"]) == [["1.2", "3"], []]


def test_types(spark):
    values = ["New RELEASE", "A survey", "How to cook", "Why not", "A guide", "Relationships", "Nothing"]
    assert column(spark, titles.story_type, values) == ["release", "research", "opinion", "opinion", "tutorial", "release", "news"]


@pytest.mark.parametrize(("w", "p", "r", "out"), [(0.2, 0, False, 0.2), (0.2, 250, False, 0.7), (0.5, 10_000, True, 3.7)])
def test_article_score(spark, w, p, r, out):
    row = spark.range(1).select(scores.article_score(F.lit(w), F.lit(p), F.lit(0.0), F.lit(r)).alias("s")).first()
    assert row["s"] == pytest.approx(out)


def test_hours_and_times(spark):
    now = F.lit("2024-01-02T00:00:00Z")
    rows = spark.createDataFrame([("Mon, 01 Jan 2024 00:00:00 GMT", "2024-01-01T12:00:00+00:00"), ("2024-01-01", None), ("2030-01-01", ""), (None, None)], "p string, c string")
    assert [r[0] for r in rows.select(scores.hours_old(F.col("p"), F.col("c"), now)).collect()] == [12.0, 24.0, 0.0, 0.0]
    values = ["2024-01-01T00:00:00Z", "Mon, 01 Jan 2024 00:00:00 +0000", "Mon, 1 Jan 2024 02:00:00 +0200", "soon", None]
    assert column(spark, scores.parse_published, values) == [1704067200] * 3 + [None, None]


def test_markup(spark):
    assert column(spark, markup.escape_markdown, ["a<b>&[c](d)"]) == [r"a&lt;b&gt;&amp;\[c\]\(d\)"]
    assert column(spark, markup.escape_link, ["a(b) c%20"]) == ["a(b%29%20c%20"]
    assert column(spark, markup.badge, [0.125, 2.675, 1234.5], "double") == ["0.12", "2.67", "1234.50"]
    assert column(spark, markup.slug, ["Hello, World! "]) == ["hello-world"]


def test_rules(spark):
    with pytest.warns(UserWarning):
        config = {"a": ["x"], "b": {"required": ["/q[12]/"], "normal": ["zz"]}, "c": {"filter": ["no"]}, "d": {"normal": ["y"], "filter": ["no"]}, "e": 3, "f": ["/(/"]}
        match = rules.topics_by_rules(F.col("v"), config)
    assert column(spark, lambda _: match, ["X q1", "zz", "y", "y no", "("]) == [["a", "b"], [], ["d"], [], []]


def test_keyword_match_masks_phrases(spark):
    config = {"deep": ["deep learning"], "learn": ["learning"]}
    assert column(spark, lambda v: rules.keyword_topics(v, config), ["Deep Learning now", "learning", "elearning"]) == [["deep"], ["learn"], []]
    assert column(spark, lambda v: rules.keyword_density(v, config), ["deep learning now", "", "x y"]) == [pytest.approx(2 / 3), 0.0, 0.0]
