import pytest
from pyspark.sql import functions as F

from storyline.operators import dedup
from storyline.plans import brief, digest, query
from storyline.sources import config


def test_digest(spark):
    rows = [(1, "u1", "Big agents", "S", "2024-01-01", "", 100, True, None, True), (2, "u2", "Small agents", "T", "", "2024-01-02T00:00:00", 0, False, "sum", False), (3, "u3", "Other", "S", "", "", 0, False, None, False)]
    items = spark.createDataFrame(rows, "seq long, url string, title string, source string, published string, collected_at string, points int, is_release boolean, summary string, is_new boolean")
    weights = spark.createDataFrame([("S", 0.2, 1), ("S", 0.4, 2)], "source string, weight double, seq long")
    scored = digest.scored_items(items, weights, {"ai": ["agents"]}, "2024-01-02").orderBy("seq").collect()
    assert [r["seq"] for r in scored] == [1, 2]
    assert scored[0]["score"] == pytest.approx(0.4 + 0.2 + 0.5 * 0.2 + 0.2 - 24 * 0.005)
    assert scored[1]["score"] == pytest.approx(0.1 + 0.5 * 0.2)
    text = digest.digest_markdown(digest.hard_cap(digest.scored_items(items, weights, {"ai": ["agents"]}, "2024-01-02")), "2024-01-02", {"kept": 2})
    assert "1. [[NEW] Big agents](u1)" in text and "2. [Small agents](u2)" in text and "Kept: 2" in text and "## Ai (score: 0.9" in text


def test_analyze_chain(spark, tmp_path):
    rows = [
        (1, "https://x/1", "Big agents launch today", "S", "2024-01-01", "", 100, False), (2, "https://x/1", "Same url again", "S", "", "", 0, False),
        (3, "https://x/3", "Big agents launch today!", "T", "", "", 0, False), (4, "https://x/4", "No topic here", "S", "", "", 0, False),
        (5, "https://x/5", "Small agents and tools", "T", "", "2024-01-01T00:00:00", 2000, True), (6, "https://x/6", "Agents seen before", "T", "", "", 0, False),
    ]
    items = spark.createDataFrame(rows, "seq long, url string, title string, source string, published string, collected_at string, points int, is_release boolean")
    seen = spark.createDataFrame([("https://x/6", "2024-01-01 00:00:00")], "url string, t string").select(F.sha2("url", 256).alias("key"), F.col("t").cast("timestamp").alias("seen_at"))
    config = {"keywords": {"ai": ["agents"]}, "feeds": [{"name": "S", "weight": 0.9}], "scoring": {"max_items": 1}}
    result = digest.analyze(items, seen, config, "2024-01-02", "2024-01-02")
    assert result.stats == {"collected": 6, "filtered": 2, "kept": 1, "cost": 0.0}
    assert [r["seq"] for r in result.items.collect()] == [1] and "_Collected: 6 | Filtered: 2 | Kept: 1 | Cost: $0.0000_" in result.text
    assert result.text.endswith("_Generated by storyline_") and result.text.index("**Analysis Guide**") > result.text.index("## Ai")
    digest.write_digest(spark, result, str(tmp_path), "2024-01-02", f"{tmp_path}/seen", "2024-01-02T00:00:00")
    assert (tmp_path / "digests" / "2024-01-02.md").read_text() == result.text
    assert '"status": "success", "items_collected": 6, "items_kept": 1' in (tmp_path / "state" / "last_run.json").read_text()
    again = dedup.parse_seen(spark.read.text(f"{tmp_path}/seen"), "2024-01-03")
    assert {r["key"] for r in again.collect()} == {r["key"] for r in result.seen.collect()} and again.count() == 4
    # Only the item whose url was refused for its title is new the next time.
    assert [r["seq"] for r in digest.analyze(items, again, config, "2024-01-02", "2024-01-02").items.collect()] == [3]
    everything = digest.demo(items, {}, "2024-01-02", "2024-01-02")
    assert "Kept: 4" in everything and "## Uncategorized" in everything
    thousand = spark.createDataFrame([(1, "u", "Agents cost", "S", "", "", 0, False)], items.schema).withColumns({"topics": F.array(F.lit("ai")), "score": F.lit(1234.56), "hours_old": F.lit(0.0), "summary": F.lit(None).cast("string"), "is_new": F.lit(None).cast("boolean")})
    assert "Score: 1234.6 |" in digest.digest_markdown(thousand, "d", {})


def test_read_commands(spark):
    stories = spark.createDataFrame([("s", 2.0, "active"), ("t", 1.0, "inactive")], "id string, score double, status string")
    members = spark.createDataFrame([("s", "a", "x", 1.0, 1), ("s", "b", "y", 2.0, 2), ("s", "c", "x", 2.0, 1)], "story_id string, article_id string, source_id string, score_base double, seq long")
    topics = spark.createDataFrame([("s", "k"), ("s", "b")], "story_id string, topic string")
    assert [tuple(r) for r in query.story_list(stories, members).orderBy("id").collect()] == [("s", 2.0, "active", 3, 2), ("t", 1.0, "inactive", 0, 0)]
    one = query.story_detail(stories, members, topics, "s").first()
    assert one["articles"] == ["c", "b", "a"] and one["topics"] == ["b", "k"] and query.story_detail(stories, members, topics, "no").count() == 0
    tagged = spark.createDataFrame([("a", "k")], "article_id string, topic string")
    article = query.article_detail(spark.createDataFrame([("a", "T")], "id string, title string"), members, tagged, "a").first()
    assert (article["story_id"], article["topics"]) == ("s", ["k"])
    assert [r["json"] for r in query.envelope(stories.where("id = 's'"), "stories").collect()] == ['{"command":"stories","data":{"id":"s","score":2.0,"status":"active"}}']
    rows = spark.createDataFrame([(1, "New model, new agents"), (2, "A model"), (3, "Models and agents")], "id long, title string")
    assert [tuple(r)[::2] for r in query.search_answer(rows, ["Model", "agents"]).collect()] == [(1, "New <b>model</b>, new <b>agents</b>")]


def test_brief_window_and_sections(spark):
    rows = [("a", "A", 2.0, 100, "news", "active"), ("b", "B", 3.0, 99, "news", "active"), ("c", "C", 1.0, 100, "zine", "active"), ("d", "D", 9.0, 100, "release", "inactive")]
    stories = spark.createDataFrame(rows, "id string, title string, score double, last_updated long, story_type string, status string")
    top = brief.top_stories(stories, 100 + 24 * 3600)
    assert [r["id"] for r in top.collect()] == ["a", "c"]
    none = spark.createDataFrame([], "story_id string, article_id string, source_id string, title string, url string, score_base double, seq long")
    text = brief.brief_markdown(brief.brief_rows(top, none, spark.createDataFrame([], "story_id string, topic string")), 0)
    assert text.index("## News") < text.index("## Zine") and "0 sources" in text and "generated_at: 1970-01-01T00:00:00Z" in text
    assert brief.brief_markdown(brief.brief_rows(top.limit(0), none, spark.createDataFrame([], "story_id string, topic string")), 0).endswith("---\n")
    assert stories.select(brief.section_rank(F.col("story_type")).alias("r")).distinct().count() == 3


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.yaml").write_text("feeds:\n- {name: Pre Set, url: u, weight: 0.4}\n")
    (tmp_path / "more.yaml").write_text("sources:\n- {id: pre-set}\n- {id: new, type: hacker_news}\n")
    main = tmp_path / "c.yaml"
    main.write_text("preset: x\nincludes: [more.yaml, gone.yaml]\nclustering: {threshold: 0.7}\n")
    with pytest.warns(UserWarning):
        found = config.load_config(main, tmp_path / "p")
    assert [(s.id, s.type, s.weight) for s in found.sources] == [("pre-set", "rss", 0.4), ("new", "hn", 0.2)]
    assert found.clustering.threshold == 0.7
    main.write_text(f"sources: [{{id: a, url: u}}]\nincludes: ['{tmp_path}/more.yaml']\n")
    assert [s.id for s in config.load_config(main).sources] == ["a", "pre-set", "new"]
    main.write_text("preset: ../c\n")
    with pytest.raises(ValueError, match="outside"):
        config.load_config(main, tmp_path / "p")
    assert config.apply_overlay({"feeds": [{"name": "a"}], "keywords": {"k": [1]}}, {"remove_feeds": ["a"], "add_keywords": {"n": [2]}, "max_items": 3}) == {"feeds": [], "keywords": {"k": [1], "n": [2]}, "max_items": 3}
