"""The brief: top stories of a window with their articles and topics, as rows and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import markup
from ..operators.stories import effective_sources

# Order and headings of the sections; other types follow by name.
SECTIONS = {"release": "Releases", "research": "Research", "tutorial": "Tutorials", "opinion": "Opinion", "news": "News"}
HOURS, MOST = 24, 25


def top_stories(stories: DataFrame, now: int, hours: int = HOURS, most: int = MOST, topics: DataFrame | None = None, topic: str | None = None) -> DataFrame:
    """The best active stories updated in the last ``hours`` (inclusive), of one topic if given; ties by id."""
    recent = stories.where((F.col("status") == "active") & (F.col("last_updated") >= now - hours * 3600))
    if topic is not None:
        recent = recent.join(topics.where(F.col("topic") == topic).select(F.col("story_id").alias("id")), "id", "left_semi")
    return recent.orderBy(F.desc("score"), "id").limit(most)


def section_rank(story_type: Column) -> Column:
    place = F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), story_type)
    return F.when(place > 0, place).otherwise(F.lit(len(SECTIONS) + 1)).cast("int")


def brief_rows(chosen: DataFrame, members: DataFrame, topics: DataFrame) -> DataFrame:
    """One row per story: section_rank, position in its section, badge, sources, topics and articles by score.

    ``members`` has story_id, article_id, source_id, title, url, score_base, seq.
    """
    own = members.join(chosen.select(F.col("id").alias("story_id")), "story_id", "left_semi")
    listed = own.groupBy("story_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score_base")).alias("k"), "seq", "title", "url"))), lambda a: F.struct(a["title"].alias("title"), a["url"].alias("url"))).alias("articles")
    )
    counted = effective_sources(own, [F.desc("score_base"), F.col("seq")])
    tagged = topics.groupBy(F.col("story_id")).agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    within = Window.partitionBy("story_type").orderBy(F.desc("score"), "id")
    rows = chosen.withColumnRenamed("id", "story_id").join(listed, "story_id", "left").join(counted, "story_id", "left").join(tagged, "story_id", "left")
    return rows.withColumnRenamed("story_id", "id").select(
        section_rank(F.col("story_type")).alias("section_rank"), "story_type", F.row_number().over(within).alias("position"), "id", "title", "score",
        markup.badge(F.col("score")).alias("badge"), F.coalesce("sources", F.lit(0)).alias("sources"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "articles",
    )


def story_markdown() -> Column:
    """Markdown of one row of :func:`brief_rows`."""
    links = F.transform("articles", lambda a: F.concat(F.lit("- ["), markup.escape_markdown(a["title"]), F.lit("]("), markup.escape_link(a["url"]), F.lit(")")))
    tags = F.array_join(F.transform("topics", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ")
    return F.concat(
        F.lit("### "), markup.escape_markdown(F.col("title")), F.lit("\n\n⭐ "), F.col("badge"), F.lit(" &nbsp;·&nbsp; "), markup.sources_label(F.col("sources")),
        F.when(F.size("topics") > 0, F.concat(F.lit("\n\n"), tags)).otherwise(""),
        F.when(F.size("articles") > 0, F.concat(F.lit("\n\n"), F.array_join(links, "\n"))).otherwise(""),
    )


def brief_markdown(rows: DataFrame, now: int, hours: int = HOURS) -> str:
    """The whole brief as text; ``rows`` are a brief's few (top_stories bounds them)."""
    listed = rows.withColumn("text", story_markdown()).orderBy("section_rank", "story_type", "position").select("story_type", "text").collect()
    stamp = rows.sparkSession.range(1).select(markup.iso_label(F.lit(now)).alias("t")).first()["t"]
    head = f"---\ngenerated_at: {stamp}\nstory_count: {len(listed)}\nperiod_hours: {hours}\n---\n"
    blocks: list[str] = []
    before = None
    for row in listed:
        if row["story_type"] != before:
            blocks += [f"## {SECTIONS.get(row['story_type'], row['story_type'].title())}", ""]
            before = row["story_type"]
        blocks += [row["text"], ""]
    return head + "\n".join(blocks)


def status(articles: DataFrame, stories: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: articles, active stories, when the last run ended."""
    return articles.agg(F.count("*").alias("articles")).join(stories.agg(F.count_if(F.col("status") == "active").alias("active_stories"))).join(
        runs.agg(F.max_by("finished_at", "id").alias("last_finished"))
    )


def freshness(runs: DataFrame, now: int) -> DataFrame:
    """One row: fresh, stale, or null while the last run has not ended."""
    last = runs.agg(F.max_by("finished_at", "id").alias("finished_at"))
    age = F.lit(now) - F.col("finished_at")
    return last.select(F.when(age < 86_400, "fresh").when(age >= 86_400, "stale").alias("freshness"))
