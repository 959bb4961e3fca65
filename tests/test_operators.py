import random
import re
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyline.operators import dedup, ingest, search, similarity, stories
from storyline.operators.components import connected_components
from storyline.plans import brief
from storyline.sources.store import Store

ITEM = "seq long, url string, title string, source_id string, published_at long, points int, extra string"


def items(spark, *rows):
    return spark.createDataFrame([(k, u, t, s, None, p, None) for k, (u, t, s, p) in enumerate(rows)], ITEM)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("a", 0.5), ("b", 0.2)], "id string, weight double")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (7, 7), (None, 1), (2, 1)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert connected_components(chain).where("component = 0").count() == 201
    assert connected_components(chain.limit(0)).count() == 0


def test_upsert(spark, sources):
    batch = items(spark, ("http://x.com/a", "First launch", "a", 10), ("https://www.x.com/a/", "Second", "b", 90), ("https://x.com/a", "Third", "a", 90), ("ftp://x", "No", "a", 1), ("https://x.com/b", "ai:", "a", 1), ("https://x.com/c", "T", "z", 1))
    accepted = ingest.accepted_items(batch, sources)
    rows = ingest.upsert_articles(None, accepted, 100).collect()
    assert [(r["url_canonical"], r["title"], r["points"], r["story_type"], r["origin_source_id"]) for r in rows] == [("https://x.com/a", "First launch", 90, "release", "a")]
    assert rows[0]["score_base"] == pytest.approx(0.2 + 90 / 500)
    stored = ingest.upsert_articles(None, accepted, 100)
    lower = ingest.accepted_items(items(spark, ("https://x.com/a", "Other", "a", 5), ("https://x.com/n", "Fresh", "a", 1)), sources)
    after = {r["url_canonical"]: r for r in ingest.upsert_articles(stored, lower, 200).collect()}
    assert after["https://x.com/a"]["points"] == 90 and after["https://x.com/a"]["scored_at"] == 100
    assert after["https://x.com/n"]["collected_at"] == 200
    assert sorted(tuple(r) for r in ingest.mentions(None, accepted, 1).select("source_id", "points").collect()) == [("a", 10), ("b", 90)]
    assert ingest.ingest_counts(stored, lower).first().asDict() == {"articles_new": 1, "articles_updated": 1}
    with pytest.raises(Exception, match="negative points"):
        ingest.upsert_articles(None, ingest.accepted_items(items(spark, ("https://x.com/m", "Minus", "a", -1)), sources), 1).collect()


def test_gate_never_hides_similar_titles():
    dice = random.Random(1)
    for _ in range(500):
        a, b = ("".join(dice.choices("abc d", k=dice.randint(1, 30))) for _ in range(2))
        for t in (0.65, 0.85):
            assert similarity.similar(a, b, t, False, True) == (similarity.ratio(a, b) >= t)


def plain_clusters(articles, topics, config):
    """Stories by the rules as they are stated, one article after another over all stories: (story, article, canonical, last_updated, step)."""
    prefix, brackets = re.compile(r"^(ask hn|show hn|tell hn)\s*:\s*", re.I), re.compile(r"(\s*[\[(][^\])]*[\])]\s*)+$")

    def plain(title):
        return re.sub(r"\s+", " ", brackets.sub("", prefix.sub("", title.strip())).lower()).strip()

    def numbers(text):
        return set(re.findall(r"\d+(?:\.\d+)*", text))

    stories, steps = [], []
    by_id = {a["id"]: a for a in articles}
    tags = {}
    for article, topic in topics:
        tags.setdefault(article, set()).add(topic)
    for a in sorted(articles, key=lambda a: (a["collected_at"], a["seq"])):
        if len(plain(a["title"]).split()) < config.min_title_words:
            continue
        own, paper = tags.get(a["id"], set()), re.search(r"arxiv\.org/abs/(\d+\.\d+)", a["url_canonical"])
        paper = paper and paper[1]
        chosen = None
        for story in sorted(reversed(stories), key=lambda s: -s["last"]):
            members = [by_id[m] for m in story["members"]]
            shared = set().union(*(tags.get(m["id"], set()) for m in members))
            papers = {m[1] for x in members if (m := re.search(r"arxiv\.org/abs/(\d+\.\d+)", x["url_canonical"]))}
            if abs(a["collected_at"] - story["last"]) > config.max_time_gap_days * 86_400 or numbers(plain(a["title"])) != numbers(plain(story["title"])):
                continue
            if own and shared and not own & shared or paper and papers - {paper}:
                continue
            if SequenceMatcher(None, plain(a["title"]), plain(story["title"])).ratio() >= config.threshold:
                chosen = story
                break
        if chosen is None:
            stories.append({"id": a["id"], "title": a["title"], "canonical": a["id"], "last": a["collected_at"], "members": [a["id"]]})
            chosen = stories[-1]
        else:
            if a["score_base"] > by_id[chosen["canonical"]]["score_base"] + config.canonical_delta:
                chosen["canonical"], chosen["title"] = a["id"], a["title"]
            chosen["members"].append(a["id"])
            chosen["last"] = max(chosen["last"], a["collected_at"])
        steps.append((chosen["id"], a["id"], chosen["canonical"], chosen["last"], len(chosen["members"])))
    return set(steps)


def test_cluster_equals_sequential(spark):
    dice = random.Random(7)
    words = "alpha beta gamma delta launch model paper v2 3 new tiny big fast slow".split()
    base = [" ".join(dice.choices(words, k=6)) for _ in range(14)]
    rows = []
    for k in range(60):
        title = dice.choice(base).split()
        if dice.random() < 0.5:
            title[dice.randrange(6)] = dice.choice(words)
        rows.append((f"id{k:02d}", f"https://{'arxiv.org/abs/2401.0000' + str(k % 3) if k % 9 == 0 else 'x.com/' + str(k)}", " ".join(title), 1000 + dice.randrange(20) * 86_400, k, dice.random(), "news"))
    articles = spark.createDataFrame(rows, "id string, url_canonical string, title string, collected_at long, seq long, score_base double, story_type string")
    topics = spark.createDataFrame([(r[0], f"t{k % 2}") for k, r in enumerate(rows) if k % 3], "article_id string, topic string")
    expected = plain_clusters([r.asDict() for r in articles.collect()], [tuple(t) for t in topics.collect()], stories.ClusterConfig())
    found = {(r["story_id"], r["article_id"], r["canonical_article_id"], r["last_updated"], r["step"]) for r in stories.cluster(articles, topics).collect()}
    assert found == expected
    changes = stories.cluster(articles, topics)
    after, members = stories.apply_clusters(None, None, changes, articles.withColumn("origin_source_id", F.lit("s")), 10_000_000)
    assert stories.cluster(articles, topics, after, members).count() == 0


@pytest.mark.parametrize("chunk", [1 << 14, 4])
def test_cluster_over_years(spark, monkeypatch, chunk):
    """Chains of titles over years, with pauses: sessions and waves of a few rows against the plain fold, and in two batches."""
    monkeypatch.setattr(stories, "CHUNK", chunk)
    dice = random.Random(chunk)
    words = "alpha beta gamma delta launch model paper tiny big fast slow seven".split()
    base = [" ".join(dice.choices(words, k=7)) for _ in range(3)]
    rows, at = [], 0
    for k in range(70):
        at += dice.choice([0, 3600, 86_400, 3 * 86_400, 7 * 86_400, 7 * 86_400 + 1, 40 * 86_400])
        title = dice.choice(base).split()
        title[dice.randrange(7)] = dice.choice(words)
        rows.append((f"id{k:02d}", f"https://x.com/{k}", " ".join(title), at, k, dice.random(), "news"))
    schema = "id string, url_canonical string, title string, collected_at long, seq long, score_base double, story_type string"
    articles, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], "article_id string, topic string")

    def told(changes):
        return {(r["story_id"], r["article_id"], r["canonical_article_id"], r["last_updated"], r["step"]) for r in changes.collect()}

    expected = plain_clusters([r.asDict() for r in articles.collect()], [], stories.ClusterConfig())
    assert told(stories.cluster(articles, none)) == expected
    early, sourced = articles.where("seq < 40"), articles.withColumn("origin_source_id", F.lit("s"))
    after, members = stories.apply_clusters(None, None, stories.cluster(early, none), sourced.where("seq < 40"), at)
    later = told(stories.cluster(articles, none, after, members))
    assert {x[:4] for x in later} == {x[:4] for x in expected if int(x[1][2:]) >= 40}


def test_cluster_guards(spark):
    schema = "id string, url_canonical string, title string, collected_at long, seq long, score_base double, story_type string"
    none = spark.createDataFrame([], "article_id string, topic string")

    def groups(*rows):
        made = spark.createDataFrame([(f"a{k}", f"https://x.com/{k}", t, at, k, s, "news") for k, (t, at, s) in enumerate(rows)], schema)
        return stories.cluster(made, none)

    title = "the big new model is here today"
    assert groups((title, 0, 1.0), (title + " folks", 7 * 86_400, 1.0)).select("story_id").distinct().count() == 1
    assert groups((title, 0, 1.0), (title + " folks", 7 * 86_400 + 1, 1.0)).select("story_id").distinct().count() == 2
    assert groups((title + " v2", 0, 1.0), (title + " v3", 0, 1.0)).select("story_id").distinct().count() == 2
    assert groups(("too few words", 0, 1.0)).count() == 0
    led = groups((title, 0, 1.0), (title + " folks", 1, 1.05), (title + " all", 2, 1.2)).orderBy(F.desc("step")).first()
    assert (led["canonical_article_id"], led["step"]) == ("a2", 3)


def test_effective_sources(spark):
    paper = "https://arxiv.org/abs/2401.00001"
    rows = [("s", "A", paper, 1), ("s", "B", paper, 2), ("s", "A", "https://x.com", 3), ("r", "B", paper, 1), ("r", "A", paper, 2), ("r", "A", "https://x.com", 3)]
    found = stories.effective_sources(spark.createDataFrame(rows, "story_id string, source_id string, url string, seq long"), [F.col("seq")])
    assert {tuple(r) for r in found.collect()} == {("s", 1), ("r", 2)}


def plain_acceptance(rows):
    """The older rules as they are stated, one item after another over all that was accepted."""
    urls, kept, accepted = set(), [], []
    for seq, url, title in sorted(rows):
        low = title.lower()
        if url in urls or any(low == t or SequenceMatcher(None, low, t, False).ratio() > 0.85 for t in kept):
            continue
        urls.add(url)
        kept.append(low)
        accepted.append(seq)
    return accepted


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_dedup_items(spark, seed):
    dice = random.Random(seed)
    base = ["".join(dice.choices("abcdefgh ", k=40)) for _ in range(8)]
    rows = []
    for k in range(90):
        title = list(dice.choice(base))
        for _ in range(dice.randrange(8)):
            title[dice.randrange(40)] = dice.choice("xyzX")
        rows.append((k, f"u{dice.randrange(50)}", "".join(title)))
    rows += [(k, f"v{k}", "".join(dice.choices("klmnopqrst", k=30))) for k in range(100, 110)]
    # A chain in which each title rivals only the next.
    rows += [(200 + k, f"w{k}", "0" * (4 * k) + "1" * (40 - 4 * k)) for k in range(10)]
    dice.shuffle(rows)
    found = dedup.dedup_items(spark.createDataFrame(rows, "seq long, url string, title string"))
    assert sorted(r["seq"] for r in found.collect()) == plain_acceptance(rows)
    assert dedup.dedup_items(spark.createDataFrame([], "seq long, url string, title string")).count() == 0


def test_seen(spark):
    lines = spark.createDataFrame([("k1 2024-01-01T00:00:00",), ("k2 2020-01-01",), ("bad",), ("k3 x",)], "value string")
    assert [r["key"] for r in dedup.parse_seen(lines, datetime(2024, 2, 1)).collect()] == ["k1"]


def test_search(spark):
    index = search.postings(spark.createDataFrame([(1, "Big model news"), (2, "big cat"), (3, None)], "id long, title string"))
    assert [r["id"] for r in search.matches_all(index, ["BIG", "model"]).collect()] == [1]
    assert [r["id"] for r in search.bm25(index, ["model", "big"]).orderBy(F.desc("rank")).collect()] == [1, 2]


def test_store_and_run(spark, tmp_path, sources):
    from storyline.plans.run import run_batch

    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("articles") is None
    batch = items(spark, ("https://x.com/1", "The big new model is here today", "a", 10), ("https://y.com/1", "The big new model is here today folks", "b", 20), ("https://z.com/1", "Something else entirely happened over there", "a", 5))
    text = run_batch(store, batch, sources, {"ai": ["model"]}, now=1_000_000, briefs=f"file://{tmp_path}/briefs")
    assert "story_count: 2" in text and "2 sources" in text and "`ai`" in text
    assert store.read("stories").count() == 2 and store.read("pipeline_runs").count() == 1
    again = run_batch(store, batch, sources, {"ai": ["model"]}, now=1_000_100)
    assert "story_count: 2" in again and store.read("articles").count() == 3
    assert store.prune() == 0  # within the lease
    assert store.prune(lease=-60) > 0 and store.read("articles").count() == 3 and store.prune(lease=-60) == 0
    runs = {r["id"]: (r["articles_new"], r["articles_updated"], r["stories_created"], r["stories_updated"]) for r in store.read("pipeline_runs").collect()}
    assert runs == {1: (3, 0, 2, 1), 2: (0, 3, 0, 0)}
    assert "story_count" in run_batch(store, batch.limit(0), sources, {"ai": ["model"]}, now=1_000_200)
    assert brief.freshness(store.read("pipeline_runs"), 1_000_000).first()["freshness"] == "fresh"


def test_feeds(spark):
    import json

    from storyline.sources import feeds

    body = json.dumps({"hits": [{"objectID": "1", "title": "A", "url": "https://a", "points": 150, "created_at": "2024-01-01T00:00:00Z"}, {"objectID": "2", "title": "B", "points": 50}, {"objectID": "3", "title": "C", "url": None, "points": 100}]})
    found = feeds.hacker_news_items(spark.createDataFrame([("hn", body)], "source_id string, body string")).collect()
    assert [(r["url"], r["points"], r["published_at"]) for r in found] == [("https://a", 150, 1704067200), ("https://news.ycombinator.com/item?id=3", 100, None)]
    spark.dataSource.register(feeds.FeedSource)
    got = spark.read.format("feed").option("feeds", json.dumps([{"id": "x", "url": "file:///nonexistent"}, {"id": "y", "url": ""}])).load().collect()
    assert [(r["source_id"], r["body"]) for r in got] == [("x", None)]
